"""Line deduplication across documents: exact copies and lines that are nearly alike.

A line's normal form is its words (see ``words``), joined by one space. Equal
forms are one line from the start. Other lines get MinHash signatures of
character shingles (one permutation, cut into bins), are banded, verified by
exact Jaccard similarity, and joined into components; the first line of each
component stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.arrow import SpanHasher, distinct, mix, ragged, spans, text_pieces
from opsloom.llm.banding import band_keys, linked
from opsloom.llm.store import BROADCAST_ROWS, fresh, kept, numbered, quoted, small_side
from opsloom.llm.words import LOWER, WORD

SHINGLE, SIMILARITY = 8, 0.8
#: Lines at the least similarity share a band with probability 1 - (1 - 0.8**4)**12 = 0.998.
BANDS, ROWS = 12, 4
_PIECE = 400_000
_BASE = 0x9E3779B97F4A7C15

_A, _B = SpanHasher(0x9E3779B97F4A7C15), SpanHasher(0xD1B54A32D192ED03)


class Lines:
    """The lines of consecutive texts that have a word, in normal form."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        cut = Cuts(raw, offsets)
        lower = LOWER[cut.raw]
        inside = WORD[lower]
        after = np.zeros(len(inside), bool)           # the first sign after each word becomes the blank between words
        after[1:] = inside[:-1] & ~inside[1:]
        keep = inside | after
        form = lower[keep]
        form[after[keep]] = 32
        ends = np.cumsum(keep)[cut.end]
        begins = np.append(0, ends[:-1]) if len(ends) else ends
        spoken = np.flatnonzero(ends > begins)
        self.text, self.number = cut.text[spoken], cut.number[spoken]
        self.begin, self.size = cut.begin[spoken], cut.end[spoken] - cut.start[spoken]
        first, last = begins[spoken], ends[spoken] - 1
        if len(form) and form.max() > 127:
            chars = np.concatenate([[0], np.cumsum((form & 0xC0) != 0x80)])
            self.code = np.frombuffer(form.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
            self.start, self.end = chars[first], chars[last]
        else:
            self.code, self.start, self.end = form, first, last

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        return _A(self.code, self.start, self.end), _B(self.code, self.start, self.end)

    def shingles(self, which: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``which``, hash) of every shingle; a shorter line is one shingle."""
        size = (self.end - self.start)[which]
        count = np.maximum(size - width + 1, 0)
        owner = np.repeat(np.arange(len(which)), count)
        keys = mix(_windows(self.code, width)[spans(self.start[which], count)])
        short = np.flatnonzero(count == 0)
        if len(short):
            owner = np.concatenate([owner, short])
            keys = np.concatenate([keys, _A(self.code, self.start[which[short]], self.end[which[short]])])
        return owner, keys


class Cuts:
    """All lines of consecutive texts. ``raw`` has a line break behind every text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        self.raw = np.insert(raw, offsets[1:], np.uint8(10))
        first = offsets + np.arange(n + 1)                            # where the texts begin
        self.end = np.flatnonzero(self.raw == 10)                     # of each line, at its break
        self.start = np.append(0, self.end[:-1] + 1) if len(self.end) else self.end
        self.text = np.searchsorted(first, self.start, "right") - 1
        self.number = np.arange(len(self.end)) - np.searchsorted(self.start, first[:-1])[self.text]
        self.begin = self.start - first[self.text]                    # in the bytes of the text


def _windows(code: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` symbols from each place on, by doubling."""
    power = code.astype(np.uint64)                                    # windows of 1, 2, 4 ... symbols
    out, done, size = None, 0, 1
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                if out is None:
                    out = power
                else:
                    n = max(len(code) - done - size + 1, 0)
                    out = out[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + power[done:done + n]
                done += size
            if done == width:
                return out
            n = max(len(power) - size, 0)
            power = power[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + power[size:size + n]
            size *= 2


def bin_minhash(owner: np.ndarray, keys: np.ndarray, n: int, size: int) -> np.ndarray:
    """Signatures of ``n`` sets by one permutation; an empty bin borrows a filled one's value."""
    bins = (((keys >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)
    out = np.full(n * size, np.uint64((1 << 64) - 1))
    np.minimum.at(out, owner * size + bins, keys << np.uint64(8))     # bits that did not choose the bin
    out = out.reshape(n, size)
    filled = out != np.uint64((1 << 64) - 1)
    row, bin_ = np.nonzero(~filled)
    with np.errstate(over="ignore"):
        attempt = 0
        while len(row):
            attempt += 1
            draw = mix(bin_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt))
            source = (draw % np.uint64(size)).astype(np.int64)
            ready = filled[row, source]
            out[row[ready], bin_[ready]] = out[row[ready], source[ready]]
            row, bin_ = row[~ready], bin_[~ready]
    return out


def _sign(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for low, high, raw, offsets in text_pieces(batch.column(2), _PIECE):
                lines = Lines(raw, offsets)
                n = len(lines.text)
                if not n:
                    continue
                h1, h2 = lines.keys()
                _, which = np.unique(h1, return_index=True)     # equal lines nearby are signed once
                which.sort()
                owner, keys = lines.shingles(which, width)
                keyed = band_keys(bin_minhash(owner, keys, len(which), bands * rows), rows)
                signed = np.zeros(n, bool)
                signed[which] = True
                place = pa.array(low + lines.text)
                yield pa.RecordBatch.from_pydict({
                    "lid": pa.array(lid + np.arange(n)), "uid": batch.column(0).take(place),
                    "order": batch.column(1).take(place), "line": pa.array(lines.number, pa.int32()),
                    "begin": pa.array(lines.begin, pa.int32()), "size": pa.array(lines.size, pa.int32()),
                    "h1": pa.array(h1.view(np.int64)), "h2": pa.array(h2.view(np.int64)),
                    "bands": ragged(keyed.reshape(-1), signed * bands, pa.int64())})
                lid += n

    return run


def _holds(width: int, least: float, rows: int = 2000):
    """Keep the pairs (a, b, line of a, line of b) whose shingle sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), rows):
                part = batch.slice(low, rows)
                yield part.select(["a", "b"]).filter(pa.array(_pairs_alike(part.column(2), part.column(3), width, least)))

    return run


def _pairs_alike(one: pa.Array, two: pa.Array, width: int, least: float) -> np.ndarray:
    """For each pair of lines whether the Jaccard similarity of their distinct shingles is ``least`` or more."""
    good = np.zeros(len(one), bool)
    for low, high, raw, offsets in text_pieces(pc.binary_join_element_wise(one, two, "\n"), _PIECE):
        n = high - low
        lines = Lines(raw, offsets)
        owner, keys = lines.shingles(np.arange(len(lines.text)), width)
        bits = np.uint64(max(n.bit_length(), 1))                      # the pair in front, the rest of the hash behind
        code = lines.text[owner].astype(np.uint64) << np.uint64(64) - bits | keys >> bits
        side = lines.number[owner]
        first, second = distinct(code[side == 0]), distinct(code[side == 1])
        every = np.sort(np.concatenate([first, second]))
        of = lambda c: np.bincount((c >> np.uint64(64) - bits).astype(np.int64), minlength=n)
        both = of(every[1:][every[1:] == every[:-1]])
        good[low:high] = both >= least * (of(every) - both) - 1e-9
    return good


def _alike(one: np.ndarray, two: np.ndarray, least: float) -> bool:
    """Whether two sets of distinct shingles have a Jaccard similarity of ``least`` or more."""
    if min(len(one), len(two)) < least * max(len(one), len(two)) - 1e-9:
        return False
    both = len(one) + len(two) - len(distinct(np.concatenate([one, two])))
    return both >= least * (len(one) + len(two) - both) - 1e-9


def _line_sets(lines: pa.Array, width: int) -> list[np.ndarray]:
    """The distinct shingles of each line."""
    out = []
    for low, high, raw, offsets in text_pieces(lines, _PIECE):
        form = Lines(raw, offsets)
        owner, keys = form.shingles(np.arange(len(form.text)), width)
        owner = form.text[owner]
        order = np.argsort(owner, kind="stable")
        out += [distinct(k) for k in np.split(keys[order], np.searchsorted(owner[order], np.arange(1, high - low)))]
    return out


def repeated_lines(docs: DataFrame, text: str = "text", order: str = "doc_id", width: int = SHINGLE,
                   least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(uid, lines): for rows of ``docs`` numbered by its scan, the lines to take out, counted from 0.

    The line that stays is the first by ``order`` (null last), row and place.
    Lines without any word are left alone. Whole tables and whole lines count.
    """
    plain = numbered(docs.select(quoted(order).alias("order"), quoted(text).alias("text")))
    signed = kept(plain.select("uid", "order", "text").mapInArrow(
        _sign(width, bands, rows),
        f"lid long, uid long, order {plain.schema['order'].dataType.simpleString()}, line int, begin int, size int, "
        "h1 long, h2 long, bands array<long>"), "lines")
    copies = signed.groupBy("h1", "h2").agg(F.min("lid").alias("rep"), F.count("*").alias("n"))
    reps = kept(copies, "forms")
    single = signed.select("lid", "bands").join(reps.select("rep"), F.col("lid") == F.col("rep")).select(
        F.col("rep").alias("id"), "bands")

    def texts(ids: DataFrame) -> DataFrame:
        ids = small_side(ids.withColumnRenamed("id", "lid"))
        where = kept(signed.select("lid", "uid", "begin", "size").join(ids, "lid"), "where")
        return plain.select("uid", F.col("text").cast("binary").alias("text")).join(small_side(where), "uid").select(
            F.col("lid").alias("id"), F.substring("text", F.col("begin") + 1, F.col("size")).cast("string").alias("text"))

    def sets(column: pa.Array) -> list:
        return [(keys, np.ones(len(keys))) for keys in _line_sets(column, width)]

    def alike(a: tuple, b: tuple) -> bool:
        return _alike(a[0], b[0], least)

    roots = linked(single, texts, _holds(width, least), sets, alike, least, False).withColumnsRenamed({"node": "rep"})
    several = reps.join(roots, "rep", "left").filter("n > 1 OR root IS NOT NULL").select(
        "h1", "h2", F.coalesce("root", "rep").alias("root"))
    placed = kept(signed.drop("bands").join(several, ["h1", "h2"]), "repeats")
    stays = placed.groupBy("root").agg(F.min(F.struct(
        F.col("order").isNull().alias("none"), "order", "uid", "line", "lid")).getField("lid").alias("lid"))
    gone = placed.join(stays.select("lid"), "lid", "left_anti")         # by line, not by root: no component is gathered
    return gone.groupBy("uid").agg(F.collect_list("line").alias("lines"))


def without_repeats(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """Take repeated lines out of the texts: adds n_lines and n_removed.

    The other lines keep their order and characters. Null texts stay null and
    have no lines; an empty text is one line without a word. Repeated rows are
    documents of their own, so only the first keeps its lines. Clashing names
    get a leading underscore; an empty table gives an empty one.
    """
    uid, lines, n_lines, n_removed = fresh(docs, "uid", "lines", "n_lines", "n_removed")
    gone = kept(repeated_lines(docs, text, **options).withColumnsRenamed({"uid": uid, "lines": lines}), "gone")
    total = gone.agg(F.sum(F.size(quoted(lines)) + 2)).first()[0] or 0
    joined = numbered(docs, uid).join(small_side(gone, total, 4 * BROADCAST_ROWS), uid, "left")
    shaped = joined.select(*[quoted(c) for c in docs.columns], F.lit(0).alias(n_lines), F.lit(0).alias(n_removed),
                           quoted(lines))
    return shaped.mapInArrow(_take_out(text, n_lines, n_removed, lines), shaped.drop(lines).schema)


def _take_out(text: str, n_lines: str, n_removed: str, lines: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            column, gone = batch.column(names.index(text)), batch.column(names.index(lines))
            for low, high, raw, offsets in text_pieces(column):
                part = batch.slice(low, high - low)
                there = np.asarray(column.slice(low, high - low).is_valid())
                made = _without(raw, offsets, gone.slice(low, high - low))
                texts = pa.StringArray.from_buffers(high - low, *made[:2], pa.array(there).buffers()[1])
                kind = batch.schema.field(text).type
                columns = {text: texts.cast(kind), n_lines: pa.array(np.where(there, made[2], 0), pa.int32()),
                           n_removed: pa.array(np.where(there, made[3], 0), pa.int32())}
                keep = [n for n in names if n != lines]
                yield pa.RecordBatch.from_arrays([columns.get(n, part.column(names.index(n))) for n in keep], keep)

    return run


def _without(raw: np.ndarray, offsets: np.ndarray, gone: pa.Array) -> tuple[pa.Buffer, pa.Buffer, np.ndarray, np.ndarray]:
    """Texts without the lines listed for each: (offsets, bytes, lines there were, lines taken out)."""
    cut = Cuts(raw, offsets)
    n = len(offsets) - 1
    there = np.bincount(cut.text, minlength=n)
    first = np.cumsum(there) - there
    taken = np.asarray(gone.value_lengths().fill_null(0)).astype(np.int64)
    stays = np.ones(len(cut.end), bool)
    stays[np.repeat(first, taken) + np.asarray(gone.flatten()).astype(np.int64)] = False
    keep = np.repeat(stays, cut.end - cut.start + 1)
    left = np.flatnonzero(stays)
    closing = left[np.append(cut.text[left][1:] != cut.text[left][:-1], True)] if len(left) else left
    keep[cut.end[closing]] = False                   # no break behind the last line
    out = np.ascontiguousarray(cut.raw[keep])
    kept_before = np.append(0, np.cumsum(keep))
    edge = kept_before[offsets + np.arange(n + 1)].astype(np.int32)
    return pa.py_buffer(edge), pa.py_buffer(out), there, taken


def cleaned_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """Texts without repeated lines; a document left without any word by it goes. Columns as they were."""
    out = without_repeats(docs, text, **options)
    n_removed = quoted(out.columns[-1])
    spoken = quoted(text).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    return out.filter((n_removed == 0) | spoken).select(*[quoted(c) for c in docs.columns])
