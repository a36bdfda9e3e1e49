"""Top-k of a corpus for one query or a batch of queries."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.operators.keyed import first_n


def top_k(scored: DataFrame, order: Sequence[Column], k: int, rank: str = "rank_position") -> DataFrame:
    """Global top-k with its position: each task keeps k rows, one task merges.

    The position is added to the k surviving rows only.
    """
    best = scored.orderBy(*order).limit(max(k, 1))
    return first_n(best.withColumn("_all", F.lit(1)), ["_all"], order, k, rank).drop("_all")


def _unit(rows: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(lengths == 0, np.nan, lengths)


class _Nearest:
    """The k nearest ids of each query of a block so far; equal distances go to the larger id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = _unit(queries), k
        self.distance = np.full((len(queries), k), np.inf)
        self.ids = np.full((len(queries), k), None, object)

    def add(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        step = max(1, TILE_CELLS // max(len(self.queries), 1))
        for low in range(0, len(vectors), step):
            self._tile(1.0 - self.queries @ _unit(vectors[low:low + step]).T, ids[low:low + step])

    def _tile(self, distance: np.ndarray, ids: np.ndarray) -> None:
        distance = np.where(np.isnan(distance), np.inf, distance)
        bound = self.distance[:, -1]
        if distance.shape[1] > self.k:
            bound = np.minimum(bound, np.partition(distance, self.k - 1, axis=1)[:, self.k - 1])
        query, at = np.nonzero((distance <= bound[:, None]) & np.isfinite(distance))
        if not len(query):
            return
        touched = np.unique(query)
        old_query, old_at = np.nonzero(np.isfinite(self.distance[touched]))
        owner = np.concatenate([touched[old_query], query])
        score = np.concatenate([self.distance[touched][old_query, old_at], distance[query, at]])
        names = np.concatenate([self.ids[touched][old_query, old_at], ids[at]])
        rank = np.unique(names, return_inverse=True)[1]
        order = np.lexsort((-rank, score, owner))
        owner, score, names = owner[order], score[order], names[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        first = place < self.k
        self.distance[touched], self.ids[touched] = np.inf, None
        self.distance[owner[first], place[first]] = score[first]
        self.ids[owner[first], place[first]] = names[first]


#: Distances worked out at once by a task (queries x rows).
TILE_CELLS = 2_000_000


def vector_top_k(corpus: DataFrame, queries: DataFrame, k: int, block_values: int = 2_000_000) -> DataFrame:
    """Exact cosine top-k of ``corpus(id, vec)`` for each ``queries(query_id, vec)``.

    Ordered by distance, then id descending; ids keep their types. Queries are
    worked on in blocks of at most ``block_values`` numbers, so a block travels
    with the tasks whatever the vectors' width. For each block the corpus is
    scanned in place: a task works in tiles of bounded size and returns k rows
    per query, and only those are shuffled.
    """
    corpus = corpus.where(F.col("vec").isNotNull()).select("id", "vec")
    queries = queries.where(F.col("vec").isNotNull()).select("query_id", F.col("vec").alias("qvec"))
    size = queries.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("qvec")), F.lit(0)).alias("dim")
    ).first()
    k = max(k, 1)
    blocks = max(1, math.ceil(size["n"] * size["dim"] / block_values))
    out = T.StructType([queries.schema["query_id"], corpus.schema["id"], T.StructField("cosine_distance", T.DoubleType())])
    partial = None
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        found = corpus.mapInPandas(_scan([r["query_id"] for r in rows], [r["qvec"] for r in rows], k), out)
        partial = found if partial is None else partial.unionByName(found)
    return first_n(
        partial, ["query_id"], [F.col("cosine_distance").asc(), F.col("id").desc()], k
    )


def _scan(names: list, vectors: list, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not names:
            return
        best = _Nearest(np.array(vectors, np.float64), k)
        for pdf in batches:
            if len(pdf):
                best.add(np.stack(pdf["vec"].to_numpy()).astype(np.float64), pdf["id"].to_numpy(object))
        query, place = np.nonzero(np.isfinite(best.distance))
        yield pd.DataFrame({
            "query_id": [names[i] for i in query], "id": list(best.ids[query, place]),
            "cosine_distance": best.distance[query, place]})

    return run


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """Mean vector per group: sums per (group, position) combine on the map side."""
    flat = vectors.select(group, F.posexplode("vec").alias("pos", "x"))
    means = flat.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("vec")
    )


def reciprocal_rank_fusion(first: DataFrame, second: DataFrame, keys: Sequence[str],
                           first_rank: str, second_rank: str, c: int = 60) -> DataFrame:
    """Fuse two ranked lists: sum of 1 / (c + rank), a missing rank adds nothing."""

    def part(rank: str) -> Column:
        return F.coalesce(F.lit(1.0) / (F.lit(c) + F.col(rank)), F.lit(0.0))

    both = first.select(*keys, first_rank).join(second.select(*keys, second_rank), list(keys), "full_outer")
    return both.withColumn("score_final", part(first_rank) + part(second_rank))
