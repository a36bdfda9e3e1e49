"""Ordered scans over long histories without one task per key.

A plain window over (key ORDER BY time) sends a whole key to one task. Here a
key with more rows than a target is first cut into segments at quantiles of its
own times, so a burst is cut as well. Each (key, segment) is scanned on its
own, one summary row per segment carries the state across segments, and the two
meet again in an equi join. Results equal those of the plain window, rows with
NULL keys or times included; only a key's summaries ever share a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.operators.keyed import join_same
from opsloom.session import cut_lineage

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, whatever the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, {ts})")


def with_segments(df: DataFrame, keys: Sequence[str], ts: str, out: str = "_seg",
                  target_rows: int = 2_000_000, parts: int = 256) -> DataFrame:
    """Add the segment of each row: 0 for keys of up to ``target_rows`` rows.

    The quantiles of busier keys, few rows, are saved: any cut gives the same
    results, but every use has to see the same one. Rows without time are first.
    """
    at = micros(ts)
    busy = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > target_rows)
    cuts = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    bounds = cut_lineage(
        join_same(df, busy, keys).groupBy(*keys).agg(F.percentile_approx(at, cuts).alias("_cuts")))
    segment = F.when(at.isNull(), -1).otherwise(
        F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<bigint>")), lambda c: c < at)))
    return join_same(df, bounds, keys, "left").withColumn(out, segment).drop("_cuts")


def _carry(df: DataFrame, keys: Sequence[str], seg: str, order: Sequence[str], value: Column,
           out: str, forward: bool, inclusive: bool) -> DataFrame:
    up = [F.col(c).asc() if forward else F.col(c).desc() for c in order]
    seg_up = F.col(seg).asc() if forward else F.col(seg).desc()
    rows_end = 0 if inclusive else -1
    marked = df.withColumn("_v", value)
    local = F.last("_v", ignorenulls=True).over(
        W.partitionBy(*keys, seg).orderBy(*up).rowsBetween(W.unboundedPreceding, rows_end)
    )
    pick = F.max_by if forward else F.min_by
    known = F.struct(*order)
    edges = (
        marked.where(F.col("_v").isNotNull())
        .groupBy(*keys, seg)
        .agg(pick("_v", known).alias("_edge"))
    )
    # Every segment needs the carry of the ones before it, even if it has no value.
    spans = join_same(marked.select(*keys, seg).distinct(), edges, [*keys, seg], "left")
    carried = spans.select(
        *keys, seg,
        F.last("_edge", ignorenulls=True)
        .over(W.partitionBy(*keys).orderBy(seg_up).rowsBetween(W.unboundedPreceding, -1))
        .alias("_in"),
    ).where(F.col("_in").isNotNull())
    return (
        join_same(marked.withColumn("_local", local), carried, [*keys, seg], "left")
        .withColumn(out, F.coalesce("_local", "_in"))
        .drop("_v", "_local", "_in")
    )


def last_known(df: DataFrame, keys: Sequence[str], seg: str, order: Sequence[str],
               value: Column, out: str, inclusive: bool = True) -> DataFrame:
    """Last non-NULL value at or before each row."""
    return _carry(df, keys, seg, order, value, out, True, inclusive)


def next_known(df: DataFrame, keys: Sequence[str], seg: str, order: Sequence[str],
               value: Column, out: str) -> DataFrame:
    """First non-NULL value after each row."""
    return _carry(df, keys, seg, order, value, out, False, False)


def running_count(df: DataFrame, keys: Sequence[str], seg: str, order: Sequence[str],
                  test: Column, out: str) -> DataFrame:
    """Number of rows up to and including each row for which ``test`` holds."""
    flagged = df.withColumn("_f", F.when(test, 1).otherwise(0).cast("long"))
    local = F.sum("_f").over(
        W.partitionBy(*keys, seg).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    )
    totals = flagged.groupBy(*keys, seg).agg(F.sum("_f").alias("_t"))
    before = totals.select(
        *keys, seg,
        F.coalesce(
            F.sum("_t").over(
                W.partitionBy(*keys).orderBy(seg).rowsBetween(W.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_before"),
    )
    return (
        join_same(flagged.withColumn("_local", local), before, [*keys, seg])
        .withColumn(out, F.col("_local") + F.col("_before"))
        .drop("_f", "_local", "_before")
    )


def runs_of(df: DataFrame, keys: Sequence[str], seg: str, order: Sequence[str],
            test: Column, min_length: int) -> DataFrame:
    """Unbroken runs of rows passing ``test``: start, end and length per run."""
    numbered = running_count(df, keys, seg, order, ~test, "_island")
    first = order[0]
    return (
        numbered.where(test)
        .groupBy(*keys, "_island")
        .agg(F.count(F.lit(1)).alias("run_length"), F.min(first).alias("run_start"),
             F.max(first).alias("run_end"))
        .where(F.col("run_length") >= min_length)
        .drop("_island")
    )
