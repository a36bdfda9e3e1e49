"""Whitening of embeddings: distributed centred covariance, its leading
components by ``symmetric_eigen``, and a projection that every task holds.

Only what grows with the width of the vectors reaches the driver: their sums
and the covariance matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.llm.store import kept, quoted
from opsloom.llm.symmetric_eigen import leading

COMPONENTS = 8
#: Vectors are fitted as whole numbers floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: An eigenvalue below this share of their sum counts as zero.
NOTHING = 1e-11
#: Partial matrices of one row are first added in so many groups of tasks.
GROUPS = 64
#: n times the largest number stays below this, so that n * x - S is exact.
_EXACT = 1 << 62


def _whole_numbers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of whole numbers) of the vectors that take part, by width.

    Null and empty vectors and those with a null or non-finite entry do not.
    """
    size = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = column.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).astype(float)
    begin = np.cumsum(size) - size
    bad = np.zeros(len(values) + 1, np.int64)
    np.cumsum(~np.isfinite(values), out=bad[1:])
    fit = (size > 0) & (bad[begin + size] == bad[begin])
    for width in np.unique(size[fit]).tolist():
        rows = np.flatnonzero(fit & (size == width))
        x = np.floor(values[begin[rows][:, None] + np.arange(width)] * SCALE)
        if np.abs(x).max(initial=0) >= _EXACT:
            raise OverflowError(f"components from {_EXACT // SCALE} on are not exact as whole numbers")
        yield rows, x.astype(np.int64) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for batch in batches:
        for rows, x in _whole_numbers(batch.column(0)):
            n, total, most = found.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64), 0])
            most = max(most, int(np.abs(x).max()))
            if (n + len(rows)) * most >= _EXACT:
                raise OverflowError("sums of the vectors are too large to be exact")
            found[x.shape[1]] = [n + len(rows), total + x.sum(axis=0), most]
    for width, (n, total, most) in found.items():
        yield pa.RecordBatch.from_pydict({
            "width": pa.array([width], pa.int32()), "n": pa.array([n], pa.int64()), "most": pa.array([most], pa.int64()),
            "sums": pa.array([total.tolist()], pa.list_(pa.int64()))})


def _rows_of(matrix: np.ndarray, first: int = 0) -> Iterator[pa.RecordBatch]:
    for i, row in enumerate(matrix, first):
        yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "row": pa.array([row], pa.list_(pa.float64()))})


def _products(batches: Iterator[pa.RecordBatch], n: int, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """This task's part of the sum of products of centred vectors."""
    total = np.zeros((len(sums), len(sums)))
    for batch in batches:
        for _, x in _whole_numbers(batch.column(0)):
            centred = (n * x - sums) / n
            total += centred.T @ centred
    yield from _rows_of(total)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each row number, the sum of those that come."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        width = len(batch.column("row")[0])
        rows = np.asarray(batch.column("row").flatten()).reshape(-1, width)
        for i, row in zip(batch.column("i").to_pylist(), rows):
            if i in total:
                total[i] += row
            else:
                total[i] = row.copy()
    for i, row in total.items():
        yield from _rows_of(row[None], i)


def covariance(vectors: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """Covariance (divisor n) of the whole numbers, centred before multiplying.

    ``vectors`` has one column, of array<double>. Partial matrices are added
    row by row in two steps, so a task receives one row of a group of tasks.
    """
    kind = "i int, row array<double>"
    parts = vectors.mapInArrow(partial(_products, n=n, sums=sums), kind)
    parts = parts.withColumn("part", F.spark_partition_id() % GROUPS).repartition("i", "part").drop("part")
    parts = parts.mapInArrow(_added, kind).repartition("i").mapInArrow(_added, kind)
    out = np.zeros((len(sums), len(sums)))
    for r in parts.collect():
        out[r.i] = r.row
    return (out + out.T) / (2 * n)


def _project(batches: Iterator[pa.RecordBatch], n: int, sums: np.ndarray, axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    count = axes.shape[1]
    for batch in batches:
        for rows, x in _whole_numbers(batch.column(1)):
            away = n * x - sums
            large = (away.astype(float)**2).sum(axis=1) >= 2.0**63 * (1 - 1e-9)
            length = np.where(large[:, None], 0, away)
            length = (length * length).sum(axis=1)
            white = (away / n) @ axes
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0).take(pa.array(rows)), "deviation": pa.array(length, pa.int64(), mask=large),
                "white": pa.ListArray.from_arrays(pa.array(np.arange(0, (len(rows) + 1) * count, count, np.int32)), pa.array(white.reshape(-1)))})


def whitened(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", *, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error).

    One row for each vector that takes part and each of the leading components
    of the covariance V of x = floor(1024 * c) + 100000, numbered from 1 by
    falling eigenvalue e; all vectors are fitted. ``deviation`` is the exact sum
    over dimensions of (n * x - S)^2, null where a long cannot hold it;
    ``whitened`` is x - S / n along the component, over sqrt(e); ``explained`` is
    e / trace(V); ``identity_error`` is one value, the largest absolute entry of
    the whitened values' covariance minus the identity.

    Null and empty vectors and those with null or non-finite entries take no
    part. Components whose eigenvalue is zero give no rows (fewer distinct
    vectors than components, constant vectors); so a table without vectors, or
    with one, gives none. Repeated rows and ids count each; a null id stays.
    Vectors of several widths are refused. No other column is read.
    """
    plain = df.select(quoted(id_column).alias("id"), quoted(vector_column).cast("array<double>").alias("vector"))
    out = T.StructType([
        T.StructField("vec_id", plain.schema["id"].dataType), T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    nothing = df.sparkSession.createDataFrame([], out)
    parts = kept(plain.select("vector").mapInArrow(_sums, "width int, n long, most long, sums array<long>"), "sums")
    widths = parts.groupBy("width").agg(F.sum("n").alias("n"), F.max("most").alias("most")).limit(2).collect()
    if not widths:
        return nothing
    if len(widths) > 1:
        raise ValueError("vectors of several widths cannot be whitened together")
    width, n, most = widths[0]
    if n * most >= _EXACT:
        raise OverflowError("sums of the vectors are too large to be exact")
    sums = np.zeros(width, np.int64)
    for r in parts.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
        sums[r.i] = r.x
    v = covariance(plain.select("vector"), n, sums)
    values, axes = leading(v, components)
    there = values > NOTHING * max(np.trace(v), 0)
    values, axes = values[there], axes[:, there]
    if not len(values):
        return nothing
    schema = T.StructType([T.StructField("id", out["vec_id"].dataType), T.StructField("deviation", T.LongType()),
                           T.StructField("white", T.ArrayType(T.DoubleType()))])
    white = kept(plain.mapInArrow(partial(_project, n=n, sums=sums, axes=axes / np.sqrt(values)), schema), "whitened")
    count = len(values)
    entry = {(i, j): F.covar_pop(F.col("white")[i], F.col("white")[j]) for i in range(count) for j in range(i + 1)}
    found = white.agg(*[c.alias(f"{i}_{j}") for (i, j), c in entry.items()]).first()
    error = max(abs(found[f"{i}_{j}"] - (i == j)) for i, j in entry)
    share = F.array(*[F.lit(float(x)) for x in values / np.trace(v)])
    return white.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("white").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("place")].alias("explained"), F.lit(float(error)).alias("identity_error"))
