"""Model usage, cost and budgets; worker runs, attempts and response times."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.operators import keyed, segmented
from opsloom.operators.ranges import as_of, elementary_ranges


def priced_usage(usage: DataFrame, prices: DataFrame, bucket_days: int | None = None) -> DataFrame:
    """Usage with the price in force at its time: the latest start wins.

    ``prices`` holds (provider, model, effective_from, effective_to, input_price,
    output_price) per million tokens; usage without a price keeps NULL.
    """
    pieces = elementary_ranges(
        prices, ["provider", "model"], "effective_from", "effective_to",
        ["-effective_from", "-input_price"])
    return as_of(usage, "created_at", pieces, ["provider", "model"], "effective_from",
                 "effective_to", "left", bucket_days)


def usage_cost() -> Column:
    """Exact cost of one call as a decimal.

    Multiplying by a millionth keeps all twelve decimals; a decimal division
    would be cut to six.
    """

    def part(tokens: str, price: str) -> Column:
        exact = F.col(tokens).cast("decimal(15,0)") * F.col(price).cast("decimal(12,6)")
        return exact * F.lit(Decimal("0.000001"))

    return (part("input_tokens", "input_price") + part("output_tokens", "output_price")).cast(
        "decimal(28,12)")


def cost_by(usage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Calls, tokens, cost, mean latency and error share; partial sums combine
    before the shuffle, so hot tenants cost one row per task."""
    return usage.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost").alias("cost"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.avg(F.when(F.col("is_error"), 1.0).otherwise(0.0)).alias("error_share"),
    )


def budget_state(spend: DataFrame, limits: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``ok``, ``threshold`` or ``exceeded`` per workspace and period."""
    share = F.try_divide(F.col("cost"), F.col("budget"))
    state = (
        F.when(F.col("budget").isNull(), "unlimited").when(F.col("cost") > F.col("budget"), "exceeded")
        .when(share >= threshold, "threshold").otherwise("ok")
    )
    return spend.join(limits, "workspace_id", "left").withColumn("budget_state", state)


def worker_health(runs: DataFrame) -> DataFrame:
    return runs.groupBy("worker_id").agg(
        F.max("started_at").alias("last_run"), F.count_if("is_error").alias("errors"),
        F.avg("duration_s").alias("avg_duration_s"), F.count(F.lit(1)).alias("runs"))


def latest_attempts(attempts: DataFrame, max_attempts: int) -> DataFrame:
    """Newest attempt per idempotency key; exhausted when it is the last allowed."""
    last = keyed.latest_per_key(attempts, ["idempotency_key"], ["attempt", "run_id"])
    return last.withColumn("exhausted", F.col("attempt") >= max_attempts)


def failure_runs(events: DataFrame, key: str, ts: str, test: Column, tie: str,
                 at_least: int = 3, target_rows: int = 2_000_000) -> DataFrame:
    """Unbroken failure runs of a worker, by time."""
    cut = segmented.with_segments(events, [key], ts, "_seg", target_rows)
    return segmented.runs_of(cut, [key], "_seg", [ts, tie], test, at_least)


def response_positions(turns: DataFrame, thread: str, position: str, role: str,
                       segment_turns: int = 100_000) -> DataFrame:
    """Each inbound turn with the position of the first reply after it.

    Threads are cut into position segments, so one endless thread is spread.
    """
    cut = turns.withColumn("_seg", F.floor(F.col(position) / segment_turns).cast("long"))
    reply = F.when(F.col(role) == "assistant", F.col(position))
    found = segmented.next_known(cut, [thread], "_seg", [position], reply, "reply_position")
    return found.where(F.col(role) == "user").drop("_seg")


def response_times(messages: DataFrame, thread: str, ts: str, tie: str, inbound: Column,
                   outbound: Column, target_rows: int = 2_000_000) -> DataFrame:
    """Seconds from each inbound message to the first outbound one after it."""
    cut = segmented.with_segments(messages, [thread], ts, "_seg", target_rows)
    found = segmented.next_known(cut, [thread], "_seg", [ts, tie],
                                 F.when(outbound, F.col(ts)), "replied_at")
    seconds = F.expr(f"timestampdiff(SECOND, {ts}, replied_at)")
    return found.where(inbound).withColumn("response_s", seconds).drop("_seg")
