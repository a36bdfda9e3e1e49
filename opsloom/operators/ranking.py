"""Competition ranks of large scopes without one task per scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.operators.keyed import join_same
from opsloom.session import cut_lineage


def competition_ranks(rows: DataFrame, scope: str, measure: str, most: str, least: str,
                      parts: int = 64) -> DataFrame:
    """Ranks with gaps, highest first and lowest first, per scope.

    Equal values share a rank, so ranks are found on distinct values. These are
    cut at approximate percentiles into ``parts``: each part counts on its own,
    totals of the parts give the offsets. Any cut gives the same ranks; it only
    has to stay the same, so it is saved. As in a plain window, rows without a
    measure are lowest, and rows without a scope are a scope of their own.
    """
    counts = rows.groupBy(scope, measure).agg(F.count(F.lit(1)).alias("_n"))
    cuts = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    bounds = cut_lineage(counts.groupBy(scope).agg(
        F.percentile_approx(measure, cuts).alias("_cuts"), F.sum("_n").alias("_all")))
    above = F.size(F.filter(F.coalesce("_cuts", F.array()), lambda c: c < F.col(measure)))
    placed = join_same(counts, bounds, [scope]).withColumn(
        "_b", F.when(F.col(measure).isNull(), -1).otherwise(above)).drop("_cuts")
    inside = W.partitionBy(scope, "_b").orderBy(measure).rowsBetween(W.unboundedPreceding, -1)
    local = placed.withColumn("_below", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    before = W.partitionBy(scope).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy(scope, "_b").agg(F.sum("_n").alias("_t")).select(
        scope, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    ranked = join_same(local, offsets, [scope, "_b"]).select(
        scope, measure,
        (F.col("_below") + F.col("_off") + 1).alias(least),
        (F.col("_all") - F.col("_below") - F.col("_off") - F.col("_n") + 1).alias(most))
    return join_same(rows, ranked, [scope, measure])
