"""Text to ordered chunks, as folds over arrays of paragraphs or lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsloom import fixed_values as fv
from opsloom.functions import text as tx
from opsloom.functions.binding import bind

# A heading mark, white space (which may run onto the next line) and a title.
_HEADING = r"^#{1,4}(?U:\s+)[^\n]+$"
_MARK = "\ue000"


def _pieces(text: Column, splitter: str) -> Column:
    parts = F.transform(F.split(text, splitter), tx.strip)
    return F.filter(parts, lambda p: p != "")


def _pack(parts: Column, joiner: str, max_chars: int, overlap: int) -> Column:
    """Greedy packing: add a part while the result fits, else flush.

    A part longer than the limit stays whole. With an overlap, the tail of the
    flushed chunk opens the next one, which may then exceed the limit.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(state: Column, part: Column) -> Column:
        cur = state["cur"]
        joined = F.concat(cur, F.lit(joiner), part)
        fits = (cur == "") | (F.length(joined) <= max_chars)
        if overlap > 0:
            tail = F.when(F.length(cur) > overlap, F.substring(cur, -overlap, overlap)).otherwise(cur)
            fresh = tx.strip(F.concat(tail, F.lit("\n"), part))
        else:
            fresh = part
        return F.struct(
            F.when(fits, state["done"])
            .otherwise(F.concat(state["done"], F.array(cur)))
            .alias("done"),
            F.when(cur == "", part).when(fits, joined).otherwise(fresh).alias("cur"),
        )

    def finish(state: Column) -> Column:
        return F.when(
            state["cur"] != "", F.concat(state["done"], F.array(state["cur"]))
        ).otherwise(state["done"])

    return F.aggregate(parts, start, step, finish)


def line_chunks(
    text: Column, max_chars: int = fv.CATALOG_MAX_CHARS, overlap: int = fv.CATALOG_OVERLAP
) -> Column:
    """Lines packed greedily with an overlapping tail."""
    return _pack(_pieces(F.coalesce(text, F.lit("")), "\n"), "\n", max_chars, overlap)


def paragraph_chunks(text: Column, max_chars: int = fv.KNOWLEDGE_MAX_CHARS) -> Column:
    """Blank-line paragraphs packed greedily, without overlap."""
    return _pack(_pieces(F.coalesce(text, F.lit("")), "\n\n"), "\n\n", max_chars, 0)


def markdown_sections(text: Column) -> Column:
    """Array of (title, content) for headings of level 1 to 4.

    Text before the first heading is dropped, as are empty sections; without a
    usable heading the whole text is one section. Headings are marked in one
    left-to-right pass, so a bare ``#`` line takes the next line as its title.
    """
    body = F.coalesce(text, F.lit(""))
    marked = F.regexp_replace(body, f"(?dm)({_HEADING})", f"{_MARK}$1{_MARK}")

    def sections(parts: Column) -> Column:
        # Odd items are heading lines, each followed by its content.
        heads = F.filter(
            F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
            lambda s: s["i"] % 2 == 1)
        pairs = F.transform(heads, lambda s: F.struct(
            tx.strip(F.regexp_replace(s["p"], r"^#{1,4}(?U:\s+)", "")).alias("title"),
            tx.strip(F.get(parts, s["i"] + 1)).alias("content")))
        return F.filter(pairs, lambda s: s["content"] != "")

    whole = F.array(F.struct(F.lit(fv.DEFAULT_SECTION_TITLE).alias("title"),
                             tx.strip(body).alias("content")))
    return bind(bind(F.split(marked, _MARK), sections),
                lambda kept: F.when(F.size(kept) > 0, kept).otherwise(whole))


def knowledge_chunks(text: Column, max_chars: int = fv.KNOWLEDGE_MAX_CHARS) -> Column:
    """Array of (title, content): sections cut into paragraph chunks, in order."""
    return F.flatten(
        F.transform(
            markdown_sections(text),
            lambda s: F.transform(
                paragraph_chunks(s["content"], max_chars),
                lambda c: F.struct(s["title"].alias("title"), c.alias("content")),
            ),
        )
    )
