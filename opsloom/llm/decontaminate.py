"""Benchmark decontamination by multi-pattern search over words.

Windows of benchmark items are the patterns. For each pattern length there is
a table of shifts by the last two words of the place looked at (positions that
cannot end an occurrence are jumped over), buckets of patterns by a hash of
their last words, and a direct comparison of the words' bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.arrow import ragged, spans, text_pieces
from opsloom.llm.store import fresh, quoted
from opsloom.llm.words import Words, runs_of, words_of, words_of_text

#: Benchmark text that one search table is built from. A larger benchmark is
#: searched in several blocks, each with a table of its own.
BLOCK_BYTES = 32_000_000
BLOCK_WORDS = 2          # words that a shift is looked up by
SUFFIX_WORDS = 5         # words that a bucket is keyed by
LANE = 64                # places that one lane of the search looks at
_SLOTS = 1 << 20


@dataclass
class _Length:
    """The patterns of one length."""

    width: int
    shift: np.ndarray = field(repr=False)
    suffix: np.ndarray = field(repr=False)     # sorted
    pattern: np.ndarray = field(repr=False)    # number of the pattern, by suffix
    keys: np.ndarray = field(repr=False)       # word hashes of each pattern


@dataclass
class PatternTable:
    """Search tables of one block of items."""

    ids: list[str]
    lengths: list[_Length]
    spelling: list[bytes]
    items: list[list[int]]      # places in ids of the items that have the pattern

    def search(self, w: Words) -> Iterator[tuple[int, int, int]]:
        """(first word, number of words, pattern) of each confirmed occurrence."""
        for each in self.lengths:
            ends = _candidates(each, w)
            yield from self._confirm(each, w, ends)

    def _confirm(self, each: _Length, w: Words, ends: np.ndarray):
        suffix = min(SUFFIX_WORDS, each.width)
        tails = runs_of(w.key, suffix)
        for low in range(0, len(ends), 100_000):
            part = ends[low:low + 100_000]
            tail = tails[part - suffix + 1]
            left, right = (np.searchsorted(each.suffix, tail, side) for side in ("left", "right"))
            count = right - left
            for begin in _cuts(count, 1_000_000):
                places = spans(left[begin], count[begin])
                end = np.repeat(part[begin], count[begin])
                pattern = each.pattern[places]
                same = np.ones(len(end), bool)
                for j in range(each.width):
                    alive = np.flatnonzero(same)
                    same[alive] = w.key[end[alive] - each.width + 1 + j] == each.keys[places[alive], j]
                for e, p in zip(end[same].tolist(), pattern[same].tolist()):
                    if w.spell(e - each.width + 1, e + 1) == self.spelling[p]:
                        yield e - each.width + 1, each.width, p


def _cuts(count: np.ndarray, most: int) -> Iterator[slice]:
    """Slices whose counts add up to about ``most`` at most."""
    total, low = np.cumsum(count), 0
    while low < len(count):
        base = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, base + most, "right")))
        yield slice(low, high)
        low = high


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(_SLOTS - 1)).astype(np.int64)


def _candidates(each: _Length, w: Words) -> np.ndarray:
    """Word positions whose last words may end a pattern, ascending.

    The positions are cut into lanes; all lanes jump by their own shifts at once.
    """
    block = min(BLOCK_WORDS, each.width)
    hashes = runs_of(w.key, block)
    low = np.repeat(w.first[:-1] + each.width - 1, _lanes(w, each.width))
    step = spans(np.zeros(len(w.counts), np.int64), _lanes(w, each.width)) * LANE
    at = low + step
    stop = np.minimum(at + LANE, np.repeat(w.first[1:], _lanes(w, each.width)))
    found = []
    while len(at):
        jump = each.shift[_slot(hashes[at - block + 1])]
        found.append(at[jump == 0])
        at = at + np.maximum(jump, 1)
        alive = at < stop
        at, stop = at[alive], stop[alive]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _lanes(w: Words, width: int) -> np.ndarray:
    return np.maximum(-(-(w.counts - width + 1) // LANE), 0)


def pattern_table(items: list[tuple[str | None, str | None]], window: int) -> PatternTable:
    """Tables for the windows of (id, text) items; an item without id has windows but no name."""
    ids = sorted({i for i, _ in items if i is not None})
    number = {i: n for n, i in enumerate(ids)}
    places: dict[bytes, int] = {}
    owners: list[set[int]] = []
    by_width: dict[int, list[tuple[int, np.ndarray]]] = {}
    for name, text in items:
        w = words_of_text(text)
        n = len(w.key)
        width = min(window, n)
        for low in range(n - width + 1 if n else 0):
            spelled = w.spell(low, low + width)
            p = places.get(spelled)
            if p is None:
                p = places[spelled] = len(owners)
                owners.append(set())
                by_width.setdefault(width, []).append((p, w.key[low:low + width]))
            if name is not None:
                owners[p].add(number[name])
    lengths = []
    for width, made in sorted(by_width.items()):
        keys = np.stack([k for _, k in made])
        block, suffix = min(BLOCK_WORDS, width), min(SUFFIX_WORDS, width)
        shift = np.full(_SLOTS, width - block + 1, np.uint8 if width < 250 else np.int32)
        for end in range(block, width + 1):
            hashes = runs_of(keys[:, end - block:end].reshape(-1), block)[::block]
            np.minimum.at(shift, _slot(hashes), width - end)
        tails = runs_of(keys[:, width - suffix:].reshape(-1), suffix)[::suffix]
        order = np.argsort(tails, kind="stable")
        lengths.append(_Length(width, shift, tails[order], np.array([p for p, _ in made])[order], keys[order]))
    return PatternTable(ids, lengths, list(places), [sorted(o) for o in owners])


def _blocks(items: DataFrame, id_column: str, text_column: str, block_bytes: int) -> list[list]:
    """The items in blocks of bounded size, one block on the driver at a time."""
    rows = items.select(quoted(id_column).cast("string").alias("i"), quoted(text_column).alias("t")).distinct()
    size = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    for b in range(n):
        yield rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()


def find_overlaps(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Occurrences of the items' windows in every document.

    A window is ``window`` consecutive words of an item; an item with fewer
    words, but not none, is one window. Adds to ``docs``: n_words, hit_runs
    (flat list of first word and end of each stretch of hit words, ascending),
    hit_items (sorted ids as strings). Clashing names get a leading underscore.
    No shuffle: each block of items is one more pass over the rows.

    Null and empty texts have no words and no hits; null, empty or no items hit
    nothing; items without id hit words but are not listed; repeated rows are
    searched each on its own; repeated items count once. Whole texts are read,
    and a long text is held by the one task that reads it.
    """
    added = fresh(docs, "n_words", "hit_runs", "hit_items")
    out = docs.select("*", F.lit(0).cast("long").alias(added[0]), F.array().cast("array<long>").alias(added[1]),
                      F.array().cast("array<string>").alias(added[2]))
    context = docs.sparkSession.sparkContext
    for block in _blocks(items, item_id, item_text, block_bytes):
        table = context.broadcast(pattern_table([tuple(r) for r in block], window))
        out = out.mapInArrow(_search(table, text, added), out.schema)
    return out


def _search(table, text: str, added: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = table.value
        for batch in batches:
            place = batch.schema.names.index(text)
            for low, high, raw, offsets in text_pieces(batch.column(place)):
                part = batch.slice(low, high - low)
                w = words_of(raw, offsets)
                yield _with_hits(part, w, patterns, added)

    return run


def _with_hits(part: pa.RecordBatch, w: Words, table: PatternTable, added: list[str]) -> pa.RecordBatch:
    names = part.schema.names
    hit = np.zeros(len(w.key) + 1, np.int32)
    found: dict[int, set[int]] = {}
    for at, width, pattern in table.search(w):
        hit[at] += 1
        hit[at + width] -= 1
        found.setdefault(int(np.searchsorted(w.first, at, "right")) - 1, set()).update(table.items[pattern])
    mark = np.cumsum(hit[:-1]) > 0
    earlier = part.column(names.index(added[1])).to_pylist()
    items = part.column(names.index(added[2])).to_pylist()
    for i, runs in enumerate(earlier):       # of blocks searched before
        for a, b in zip(runs[::2], runs[1::2]):
            mark[w.first[i] + a:w.first[i] + b] = True
    for i, more in found.items():
        items[i] = sorted({*items[i], *(table.ids[k] for k in more)})
    first, runs, sizes = w.first, [], []
    for i in range(len(part)):
        inside = mark[first[i]:first[i + 1]]
        if inside.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
            runs.append(edge)
            sizes.append(len(edge))
        else:
            sizes.append(0)
    flat = np.concatenate(runs) if runs else np.zeros(0, np.int64)
    columns = {added[0]: pa.array(w.counts, pa.int64()), added[1]: ragged(flat, np.array(sizes), pa.int64()),
               added[2]: pa.array(items, pa.list_(pa.string()))}
    return pa.RecordBatch.from_arrays([columns.get(n, part.column(i)) for i, n in enumerate(names)], names)


def overlap_report(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    plain = docs.select(quoted(id_column).alias("doc_id"), quoted(options.pop("text", "text")).alias("text"))
    found = find_overlaps(plain, items, "text", **options).drop("text")
    pairs = F.sequence(F.lit(0), F.expr("size(hit_runs) div 2 - 1"))
    hit = F.when(F.size("hit_runs") > 0, F.aggregate(
        pairs, F.lit(0).cast("long"),
        lambda t, i: t + F.get("hit_runs", 2 * i + 1) - F.get("hit_runs", 2 * i))).otherwise(F.lit(0).cast("long"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_runs") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents in which no window of an item occurs; columns as they were."""
    found = find_overlaps(docs, items, **options)
    runs = found.columns[len(docs.columns) + 1]
    return found.filter(F.size(quoted(runs)) == 0).select(*[quoted(c) for c in docs.columns])


