"""Nearest vectors by randomly rotated one-bit codes.

The index holds, for every distinct vector, the signs of its rotated direction
from a common centre, packed into bytes, and two correction scalars. For a
query the codes give an estimate of every inner product and a bound on its
error; vectors whose upper bound reaches the k-th best exact score so far are
scored exactly on the original numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.llm.store import kept, quoted

#: Rows that the centre is taken from.
CENTRE_ROWS = 8192
#: Vector widths, each of which has a rotation in memory; more are refused.
MOST_WIDTHS = 1000
#: Standard deviations of the code's error that the bound allows.
CERTAINTY = 3.0
#: Queries held by a task at once; with a dimension of 1,536 that is 25 MB.
QUERY_BLOCK = 2048
#: Estimates made at once (rows x queries).
TILE = 2_000_000


def rotation(width: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def encode(units: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, distance from the centre, share of the direction that the signs keep)."""
    away = units - centre
    far = np.linalg.norm(away, axis=1)
    turned = away @ turn / np.maximum(far, 1e-12)[:, None]
    share = np.abs(turned).sum(axis=1) / np.sqrt(units.shape[1])
    return np.packbits(turned > 0, axis=1), far, share


def estimate(codes: np.ndarray, far: np.ndarray, share: np.ndarray, width: int, turned_queries: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, error bounds) of inner products of encoded directions with queries (rotated, from the centre)."""
    signs = np.unpackbits(codes, axis=1, count=width).astype(np.float32) * 2 - 1
    scale = far / np.maximum(share, 1e-6)
    rough = (signs @ turned_queries.T.astype(np.float32)) / np.sqrt(width) * scale[:, None].astype(np.float32)
    spread = CERTAINTY * scale * np.sqrt(np.maximum(1 - share**2, 0)) / np.sqrt(max(width - 1, 1))
    return rough, spread[:, None] * np.linalg.norm(turned_queries, axis=1)[None, :]


def _vectors(column: pa.Array) -> np.ndarray:
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def distinct_vectors(table: DataFrame, key: str, vector: str, most: int) -> DataFrame:
    """(ids, v): each usable distinct vector with its ``most`` smallest ids, and its width.

    Null, empty and zero vectors and those with null or non-finite components
    are left out, as are rows without id. Repeated ids count once.
    """
    v = quoted(vector)
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(
        v, lambda x: x != 0)
    rows = table.filter(usable).select(quoted(key).cast("long").alias("id"), v.alias("v")).dropna()
    first = Window.partitionBy("v").orderBy("id")
    return (rows.withColumn("place", F.dense_rank().over(first)).filter(F.col("place") <= most)
            .groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
            .select("ids", "v", F.size("v").alias("width")))


def _index(centres, turns):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in _by_width(batch, 2):
                width = rows.shape[1]
                units = rows / np.linalg.norm(rows, axis=1)[:, None]
                codes, far, share = encode(units, centres.value[width], turns.value[width])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(far), pa.array(share)],
                    [*part.schema.names, "code", "far", "share"])

    return run


def _by_width(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch whose vectors (column 1) have one width (``column``)."""
    widths = batch.column(column).to_numpy()
    for width in np.unique(widths):
        part = batch.filter(pa.array(widths == width))
        if len(part):
            yield part, _vectors(part.column(1))


def build_index(table: DataFrame, key: str, vector: str, most: int) -> tuple[DataFrame, dict, dict]:
    """Written index of all distinct vectors, and the centre and rotation of each width.

    Centres are means over at most ``CENTRE_ROWS`` vectors, those with the
    smallest hash; every vector is indexed.
    """
    spark = table.sparkSession
    found = kept(distinct_vectors(table, key, vector, most), "vectors")
    sample = found.orderBy(F.xxhash64("v"), "ids").limit(CENTRE_ROWS).select("v", "width").collect()
    centres, turns = {}, {}
    widths = found.select("width").distinct().limit(MOST_WIDTHS + 1).collect()
    if len(widths) > MOST_WIDTHS:
        raise ValueError(f"vectors of more than {MOST_WIDTHS} widths")
    for (width,) in widths:
        rows = np.array([r.v for r in sample if r.width == width], float).reshape(-1, width)
        units = rows / np.linalg.norm(rows, axis=1)[:, None]
        centres[width] = units.mean(axis=0) if len(rows) else np.zeros(width)
        turns[width] = rotation(width)
    schema = T.StructType(found.schema.fields + T.StructType.fromDDL("code binary, far double, share double").fields)
    coded = found.mapInArrow(_index(spark.sparkContext.broadcast(centres), spark.sparkContext.broadcast(turns)), schema)
    return kept(coded, "index"), centres, turns


class _Best:
    """The best exact scores of a block of queries so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.row = np.full((n, k), -1, np.int64)

    def take(self, query: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        """Add candidates, given as flat arrays; ties go to the smaller row key."""
        touched = np.unique(query)
        query = np.concatenate([np.repeat(touched, self.k), query])
        score = np.concatenate([self.score[touched].reshape(-1), score])
        row = np.concatenate([self.row[touched].reshape(-1), row])
        order = np.lexsort((row, -score, query))
        query, score, row = query[order], score[order], row[order]
        begin = np.searchsorted(query, touched)
        at = begin[:, None] + np.arange(self.k)
        self.score[touched], self.row[touched] = score[at], row[at]


def _search(block, k: int, centre: np.ndarray, turn: np.ndarray):
    """Per task: the k best distinct vectors of each query of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = block.value
        width = queries.shape[1]
        norms = np.linalg.norm(queries, axis=1)
        units = queries / norms[:, None]
        turned = (units - centre) @ turn
        base = units @ centre
        best, ids = _Best(len(queries), k), {}
        step = max(1, TILE // len(queries))
        for batch in batches:
            first = np.fromiter((x[0] for x in batch.column(0).to_pylist()), np.int64, len(batch))
            lists = batch.column(0)
            for low in range(0, len(batch), step):
                part = batch.slice(low, step)
                codes = np.stack([np.frombuffer(c, np.uint8) for c in part.column(3).to_pylist()])
                far, share = part.column(4).to_numpy(), part.column(5).to_numpy()
                rough, bound = estimate(codes, far, share, width, turned)
                # <o, q> = <o - c, q - c> + <c, q> + <o, c> - <c, c>
                rows = _vectors(part.column(1))
                row_norms = np.linalg.norm(rows, axis=1)
                along = rows @ centre / row_norms - centre @ centre
                upper = rough + bound + along[:, None] + base[None, :]
                if np.isinf(best.score[:, -1]).any():       # scores to start from
                    n = min(2 * k, len(part))
                    top = np.argpartition(-rough, n - 1, axis=0)[:n]
                    _score(best, rows, row_norms, queries, norms, top.reshape(-1),
                           np.tile(np.arange(len(queries)), n), first[low:low + step])
                    upper[top, np.arange(len(queries))] = -np.inf
                at, query = np.nonzero((upper >= best.score[:, -1][None, :] - 1e-6) & np.isfinite(upper))
                for a in range(0, len(at), 500_000):
                    _score(best, rows, row_norms, queries, norms, at[a:a + 500_000], query[a:a + 500_000],
                           first[low:low + step])
            alive = np.unique(best.row)
            for i in np.flatnonzero(np.isin(first, alive)).tolist():
                ids[int(first[i])] = lists[i].as_py()
            if len(ids) > 4 * best.row.size:
                ids = {r: ids[r] for r in alive.tolist() if r in ids}
        query, place = np.nonzero(best.row >= 0) if ids else (np.zeros(0, int), np.zeros(0, int))
        yield pa.RecordBatch.from_pydict({
            "query": pa.array(query, pa.int32()), "score": pa.array(best.score[query, place], pa.float64()),
            "ids": pa.array([ids[int(r)] for r in best.row[query, place]], pa.list_(pa.int64()))})

    return run


def _score(best: _Best, rows, row_norms, queries, norms, at, query, keys) -> None:
    score = np.einsum("ij,ij->i", rows[at], queries[query]) / (row_norms[at] * norms[query])
    best.take(query, score, keys[at])


def nearest(table: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5,
            query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine of each row whose id is divisible by ``every``.

    A query's own row is no candidate; vectors of another width are none
    either. Fewer candidates give fewer rows, a table without usable vectors
    gives none. Scores are exact; ties go to the smaller id. Equal vectors are
    searched once, whether queries or candidates, so copies cost nothing.

    Queries are worked on in blocks of bounded size. A block goes through all
    index rows, and each task returns k vectors per query.
    """
    spark = table.sparkSession
    index, centres, turns = build_index(table, key, vector, k + 1)
    asked = (table.filter(quoted(key).cast("long") % every == 0)
             .select(quoted(key).cast("long").alias("query_id"), quoted(vector).alias("v")).distinct())
    distinct = kept(asked.join(index.select("v", "width"), "v").select("v", "width").distinct(), "queries")
    results = []
    for (width, n) in distinct.groupBy("width").count().orderBy("width").collect():
        blocks = -(-n // query_block)
        for b in range(blocks):
            rows = (distinct.filter((F.col("width") == width) & (F.pmod(F.xxhash64("v"), F.lit(blocks)) == b))
                    .select("v").orderBy(F.xxhash64("v")).collect())
            if not rows:
                continue
            block = spark.sparkContext.broadcast(np.array([r.v for r in rows], float))
            names = spark.createDataFrame([(i, r.v) for i, r in enumerate(rows)],
                                          T.StructType([T.StructField("query", T.IntegerType()), distinct.schema["v"]]))
            found = index.filter(F.col("width") == width).mapInArrow(
                _search(block, k + 1, centres[width], turns[width]), "query int, score double, ids array<long>")
            top = Window.partitionBy("query").orderBy(F.desc("score"), F.get("ids", F.lit(0)))
            best = found.withColumn("place", F.row_number().over(top)).filter(F.col("place") <= k + 1)
            results.append(kept(best.join(names, "query").select("v", "score", "ids"), "nearest"))
    empty = spark.createDataFrame([], T.StructType.fromDDL("query_id long, rank int, vec_id long, score double"))
    if not results:
        return empty
    found = results[0]
    for more in results[1:]:
        found = found.union(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (asked.join(found, "v").select("query_id", "score", F.explode("ids").alias("vec_id"))
            .filter("vec_id <> query_id")
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
