"""Latest row, first N, ordered dedupe, upsert and replace by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on keys that may be NULL: NULL meets NULL. Key columns come from the left."""
    renamed = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    test = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_same_{k}"))
        test = same if test is None else test & same
    joined = left.join(renamed, test, how)
    return joined if how in ("left_anti", "left_semi") else joined.drop(*[f"_same_{k}" for k in keys])


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key by the order columns.

    ``max`` over a struct combines on the map side, so a key that holds a
    third of all rows reaches its reducer as one row per input task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in [*order, *rest]]).select(
        *df.columns
    )


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
            rank: str = "rank_position") -> DataFrame:
    """First ``n`` rows per key with their position.

    Spark cuts each input task to ``n`` rows per key before the shuffle
    (window group limit), so hot keys stay small.
    """
    spec = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(spec)).where(F.col(rank) <= max(n, 1))


def dedupe_ordered(df: DataFrame, scope: Sequence[str], fields: Sequence[str],
                   position: str, cap: int | None = None) -> DataFrame:
    """Keep the first occurrence of each combination, in order, then cap."""
    rest = [c for c in df.columns if c not in scope and c not in fields and c != position]
    firsts = df.groupBy(*scope, *fields).agg(
        F.min(F.struct(position, *rest)).alias("_first")
    ).select(*scope, *fields, *[F.col(f"_first.{c}").alias(c) for c in [position, *rest]])
    if cap is None:
        return firsts.select(*df.columns)
    return first_n(firsts, scope, [F.col(position)], cap, "_n").select(*df.columns)


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key by ``order``, then by all other columns."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    if not order and not rest:
        return df.distinct()
    maps = [c for c, kind in df.dtypes if "map<" in kind]
    if not maps:
        return latest_per_key(df, keys, [*order, *rest])
    # Maps have no order: their text decides in their place.
    rank = F.struct(*[F.to_json(c).alias(c) if c in maps else c for c in [*order, *rest]])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*order, *rest), rank).alias("_row"))
    return best.select(*keys, F.col("_row.*")).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; of several new ones the last stays.

    Last means by ``order``, then by the other columns. A key may hold NULLs.
    No window, and the old side is shuffled once at most.
    """
    last = one_per_key(new, keys, order)
    return join_same(old, last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def replace_children(old: DataFrame, new: DataFrame, parent_key: str,
                     touched: DataFrame) -> DataFrame:
    """Drop every child of a touched parent, then add the new children."""
    parents = touched.select(parent_key).distinct()
    return old.join(parents, parent_key, "left_anti").unionByName(new)


def insert_absent(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Existing rows plus one of the new ones for each key that is not there yet."""
    fresh = join_same(one_per_key(new, keys, order), existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-NULL reference has no parent row."""
    ids = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.where(F.col(child_key).isNotNull()).join(ids, child_key, "left_anti")
