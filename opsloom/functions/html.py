"""Counts, links and text of stored web pages, from their HTML text."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsloom.functions import text as tx


#: Markup inside the body element, to the end of the page if it is not closed.
BODY = r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)"


def body(html: Column) -> Column:
    """Markup without comments, scripts, styles and the head."""
    out = F.coalesce(html, F.lit(""))
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<script\b.*?</script>",
                    r"(?is)<style\b.*?</style>", r"(?is)<head\b.*?</head>"):
        out = F.regexp_replace(out, pattern, " ")
    return out


#: Named references of Latin letters and signs, from the standard table.
_NAMED = {name[:-1]: sign for name, sign in html5.items() if name.endswith(";") and len(sign) == 1 and (
    ord(sign) < 0x100 or sign in "–—‘’‚“”„†‡•…‰‹›€™ŒœŠšŸƒˆ˜\u2002\u2003\u2009")}
_REFERENCE = r"(?s)&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,30});|[^&]+|&"


def unescape(c: Column) -> Column:
    """Decode numeric references and named ones of Latin letters and signs; others stay."""
    table = F.create_map(*[F.lit(x) for pair in _NAMED.items() for x in pair])

    def sign(part: Column) -> Column:
        name = F.regexp_replace(part, "^&|;$", "")
        hexadecimal = F.regexp_extract(part, "^&#[xX]([0-9a-fA-F]+);$", 1)
        decimal = F.regexp_extract(part, "^&#([0-9]+);$", 1)
        code = F.coalesce(F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10).cast("int")),
                          F.when(decimal != "", decimal.cast("int")))
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        number = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(~part.startswith("&"), part).when(valid, number).otherwise(
            F.coalesce(F.try_element_at(table, name), part))

    decoded = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_REFERENCE), F.lit(0)), sign), "")
    return F.when(c.contains("&"), decoded).otherwise(c)


# The functions below read the result of ``body``: settle it once, then use it.


def text_lines(markup: Column) -> Column:
    """Visible text lines: every tag ends a line, blank lines are dropped."""
    raw = F.split(F.regexp_replace(markup, r"(?s)<[^>]*>", "\n"), "\n")
    lines = F.transform(raw, lambda s: tx.clean(unescape(s)))
    return F.filter(lines, lambda s: s != "")


def text_chunks(markup: Column, limit: int = 20, max_len: int = 120) -> Column:
    """First distinct text lines, each cut to ``max_len``."""
    cut = F.transform(text_lines(markup), lambda s: F.substring(s, 1, max_len))
    return F.slice(F.array_distinct(cut), 1, limit)


def count_tags(markup: Column, tag: str) -> Column:
    return F.regexp_count(markup, F.lit(rf"(?i)<{tag}\b"))


def _attribute(markup: Column, name: str) -> Column:
    """Value of an attribute of the first tag: in either quotes, or bare."""
    found = [F.regexp_extract(markup, rf"(?is)^<[^>]*?\s{name}\s*=\s*{form}", 1)
             for form in ('"([^"]*)"', "'([^']*)'", r"""([^\s"'>]+)""")]
    return unescape(F.coalesce(*[F.nullif(f, F.lit("")) for f in found], F.lit("")))


#: Links and buttons of a page that are listed if nothing else is asked.
LINKS, BUTTONS = 50, 30


def _pattern(tag: str) -> str:
    element = rf"<{tag}\b[^>]*>.*?</{tag}>"
    if tag != "button":
        return rf"(?is)({element})"
    role = r"""<([a-z][a-z0-9]*)\b[^>]*?\srole\s*=\s*["']?button\b[^>]*>.*?</\2>"""
    return rf"(?is)({element}|{role})"


def elements(markup: Column, tag: str, limit: int | None = None) -> Column:
    """Links or buttons: (text, href, aria_label, title), blanks dropped,
    distinct over the four fields in page order. An element of any tag with
    ``role="button"`` is a button."""
    found = F.regexp_extract_all(markup, F.lit(_pattern(tag)), F.lit(1))
    rows = F.transform(
        found,
        lambda m: F.struct(
            tx.clean(unescape(F.regexp_replace(m, r"(?s)<[^>]*>", " ")), 200).alias("text"),
            _attribute(m, "href").alias("href"),
            _attribute(m, "aria-label").alias("aria_label"),
            _attribute(m, "title").alias("title"),
        ),
    )
    kept = F.array_distinct(
        F.filter(rows, lambda r: F.concat(r["text"], r["href"], r["aria_label"], r["title"]) != "")
    )
    return kept if limit is None else F.slice(kept, 1, limit)


def has_layer(markup: Column, words: tuple[str, ...]) -> Column:
    """An element whose class, role or test id names a banner or dialog."""
    names = "|".join(words)
    return markup.rlike(rf'(?i)\s(?:class|role|data-testid)\s*=\s*(?:"[^"]*(?:{names})|\'[^\']*(?:{names})|[^\s"\'>]*(?:{names}))')
