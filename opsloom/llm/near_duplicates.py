"""Near-duplicate documents by probability Jaccard of weighted word shingles.

Signatures follow ProbMinHash: every shingle of a document sends arrivals of a
Poisson process whose rate is the shingle's count; each arrival falls into one
of the signature's places, which keeps its earliest. A shingle stops as soon as
its next arrival is later than all places hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.arrow import SpanHasher, distinct, mix, ragged, text_pieces
from opsloom.llm.banding import band_keys, linked
from opsloom.llm.store import fresh, kept, numbered, quoted, small_side
from opsloom.llm.words import Words, shingles_of, words_of, words_of_text

SHINGLE, SIMILARITY = 5, 0.8
#: Pairs at the least similarity share a band with probability 1 - (1 - 0.8**4)**16 = 0.9998.
BANDS, ROWS = 16, 4

_A, _B = SpanHasher(0x9E3779B97F4A7C15), SpanHasher(0xD1B54A32D192ED03)


def weighted_shingles(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count), ordered by text and shingle."""
    texts, keys = shingles_of(w, width)
    order = np.lexsort((keys, texts))
    texts, keys = texts[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (texts[1:] != texts[:-1]) | (keys[1:] != keys[:-1])
    at = np.flatnonzero(new)
    return texts[at], keys[at], np.diff(np.append(at, len(keys)))


def prob_minhash(texts: np.ndarray, keys: np.ndarray, weights: np.ndarray, n: int, size: int) -> np.ndarray:
    """Signatures of ``n`` weighted sets: in each place the key that arrived first."""
    time = np.full(n * size, np.inf)
    first = np.zeros(n * size, np.uint64)
    latest = np.full(n, np.inf)
    clock = np.zeros(len(keys))
    number = 0
    with np.errstate(over="ignore"):
        while len(keys):
            number += 1
            draw = mix(keys + np.uint64(number * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            clock = clock - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53) / weights
            on = clock < latest[texts]
            texts, keys, weights, clock, draw = texts[on], keys[on], weights[on], clock[on], draw[on]
            place = mix(draw + np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)
            slot = texts * size + ((place * np.uint64(size)) >> np.uint64(32)).astype(np.int64)
            better = np.flatnonzero(clock < time[slot])
            better = better[np.argsort(-clock[better], kind="stable")]     # the earliest is written last
            time[slot[better]], first[slot[better]] = clock[better], keys[better]
            touched = distinct(texts[better])
            latest[touched] = time.reshape(n, size)[touched].max(axis=1)
    return first.reshape(n, size)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact value for two weighted sets (sorted keys, weights)."""
    both, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = a[1][at_a].astype(float), b[1][at_b].astype(float)
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    below = a[1].sum() - x.sum() + np.cumsum(x)
    above = b[1].sum() - np.cumsum(y)
    return float((1 / (below / x + above / y)).sum())


def _sign(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            empty = np.asarray(batch.column(1).is_null())
            for low, high, raw, offsets in text_pieces(batch.column(1)):
                w = words_of(raw, offsets)
                n = high - low
                spoken = w.counts > 0
                content = []
                for hasher in (_A, _B):
                    plain = mix(hasher(raw, offsets[:-1], offsets[1:]) ^ np.uint64(0x5851F42D4C957F2D))
                    content.append(np.where(spoken, hasher(w.key, w.first[:-1], w.first[1:]), plain))
                texts, keys, counts = weighted_shingles(w, width)
                keyed = band_keys(prob_minhash(texts, keys, counts, n, bands * rows), rows)
                null = empty[low:high]
                yield pa.RecordBatch.from_pydict({
                    "uid": batch.column(0).slice(low, n),
                    "h1": pa.array(content[0].view(np.int64), mask=null),
                    "h2": pa.array(content[1].view(np.int64), mask=null),
                    "bands": ragged(keyed[spoken].reshape(-1), spoken * bands, pa.int64())})

    return run


def _holds(width: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, None
        for batch in batches:
            good = []
            for a, text_a, text_b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if a != name:
                    name, held = a, weighted_shingles(words_of_text(text_a), width)[1:]
                other = weighted_shingles(words_of_text(text_b), width)[1:]
                good.append(probability_jaccard(held, other) >= least - 1e-12)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, text: str = "text", order: str = "doc_id", width: int = SHINGLE,
                    least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Class of every document: uid, order, root, first (uid of the class's first row), class_size.

    ``uid`` numbers the rows of the scan (see ``store.numbered``). Texts with
    the same words in the same order are one class from the start and are
    represented once; other classes are the components of pairs with a
    probability Jaccard of ``least`` or more, verified on whole texts.

    A text of fewer words than ``width`` is one shingle. Texts without any word
    (the empty one too) are alike only if equal; a null text is alone. The first
    row of a class has the smallest ``order`` (null last), then the smallest uid;
    repeated rows are copies. An empty table gives an empty one. Other columns
    are not read.
    """
    plain = numbered(docs.select(quoted(order).alias("order"), quoted(text).alias("text")))
    signed = kept(plain.select("uid", "text").mapInArrow(
        _sign(width, bands, rows), "uid long, h1 long, h2 long, bands array<long>"), "signatures")
    copies = signed.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("uid").alias("rep"))
    member = kept(signed.select("uid", "h1", "h2").join(copies, ["h1", "h2"], "left").select(
        "uid", F.coalesce("rep", "uid").alias("rep")), "members")
    single = signed.select(F.col("uid").alias("rep"), "bands").join(
        member.filter("uid = rep").select("rep"), "rep").select(F.col("rep").alias("id"), "bands")

    def texts(ids: DataFrame) -> DataFrame:
        return plain.join(small_side(ids.withColumnRenamed("id", "uid")), "uid").select(F.col("uid").alias("id"), "text")

    def sets(column: pa.Array) -> list:
        return [weighted_shingles(words_of_text(t), width)[1:] for t in column.to_pylist()]

    def alike(a: tuple, b: tuple) -> bool:
        return probability_jaccard(a, b) >= least - 1e-12

    roots = linked(single, texts, _holds(width, least), sets, alike, least)
    rooted = member.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select(
        "uid", F.coalesce("root", "rep").alias("root"))
    placed = kept(plain.select("uid", "order").join(rooted, "uid"), "classes")
    by_class = placed.groupBy("root").agg(
        F.min(F.struct(F.col("order").isNull().alias("none"), "order", "uid")).alias("least"),
        F.count("*").alias("class_size"))
    return placed.join(by_class, "root").select(
        "uid", "order", "root", F.col("least.uid").alias("first"), F.col("least.order").alias("first_order"),
        "class_size")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The first document of every class; columns as they were."""
    (uid,) = fresh(docs, "uid")
    classes = near_duplicates(docs, **options)
    gone = kept(classes.filter("uid <> first").select(F.col("uid").alias(uid)), "gone")
    return numbered(docs, uid).join(small_side(gone), uid, "left_anti").drop(uid)


def class_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, class_id (the class's first doc_id), class_size, kept."""
    return near_duplicates(docs, **options).select(
        F.col("order").alias("doc_id"), F.col("first_order").alias("class_id"), "class_size",
        (F.col("uid") == F.col("first")).alias("kept"))
