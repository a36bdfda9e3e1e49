"""Event streams: the same transforms run on batch and streaming DataFrames.

Watermarks, windows and gaps are parameters. State is keyed and bounded by the
watermark; nothing waits for a whole key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.session import ROCKSDB_PROVIDER, new_scratch
from opsloom.sources.keyed_table import KeyedTable
from opsloom.sources.sinks import batch_appender


def deduplicated(events: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """First event per key; repeats within the watermark are dropped."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def event_counts(events: DataFrame, ts: str, keys: list[str], width: str = "1 hour",
                 slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts per key and window; with ``slide`` the windows overlap."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (
        events.withWatermark(ts, delay).groupBy(window.alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), *keys, "n")
    )


THREADS = "last_message_at timestamp, messages long, inbound_messages long, thread_status string"


def thread_state(messages: DataFrame, thread: str, ts: str, inbound: Column) -> DataFrame:
    """Per thread: last message, counts, who spoke last. Partial states have the same columns."""
    return messages.groupBy(thread).agg(
        F.max(ts).alias("last_message_at"), F.count(F.lit(1)).alias("messages"),
        F.count_if(inbound).alias("inbound_messages"),
        F.max_by(F.when(inbound, "open").otherwise("answered"), F.struct(F.col(ts), ~inbound)).alias("thread_status"))


def merged_threads(thread: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Put partial thread states together."""
    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.unionByName(new).groupBy(thread).agg(
            F.max("last_message_at").alias("last_message_at"), F.sum("messages").alias("messages"),
            F.sum("inbound_messages").alias("inbound_messages"),
            F.max_by("thread_status", F.struct("last_message_at", F.col("thread_status") == "answered")).alias("thread_status"))

    return combine


def keyed_sink(table: Callable[[SparkSession], KeyedTable], partial: Callable[[DataFrame], DataFrame],
               combine: Callable[[DataFrame, DataFrame], DataFrame], stream: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: a batch is reduced to one row per key and merged into a keyed table.

    The stream itself holds no state, so nothing has to expire in it; the table
    remembers the last batch of the stream, so a batch that is run again
    changes nothing.
    """
    def write(df: DataFrame, batch_id: int) -> None:
        table(df.sparkSession).merge(partial(df), combine, stream, batch_id)

    return write


def sessions_by_gap(events: DataFrame, key: str, ts: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """Activity sessions closed by inactivity."""
    return (
        events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last_at"))
        .select(key, F.col("w.start").alias("started_at"), "last_at", F.col("w.end").alias("closed_at"), "n")
    )


def heartbeat_timeouts(pings: DataFrame, worker: str, ts: str, timeout: str,
                       delay: str = "1 minute") -> DataFrame:
    """One alert per silence: a session of pings with the timeout as its gap
    ends exactly when the alert is due."""
    return sessions_by_gap(pings, worker, ts, timeout, delay).select(
        worker, F.col("last_at").alias("last_ping"), F.col("closed_at").alias("alert_at"))


def lease_ends(renewals: DataFrame, lease: str, ts: str, seconds: Column) -> DataFrame:
    """(lease, expires_at) by the renewal that reaches farthest."""
    return renewals.groupBy(lease).agg(F.max(F.timestamp_add("SECOND", seconds, F.col(ts))).alias("expires_at"))


def merged_leases(lease: str, forget: Column | None = None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Put lease ends together; those that ended before ``forget`` go."""
    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.unionByName(new).groupBy(lease).agg(F.max("expires_at").alias("expires_at"))
        return both if forget is None else both.where(F.col("expires_at") >= forget)

    return combine


def lease_state(ends: DataFrame, at: Column) -> DataFrame:
    """Whether each lease still holds at a moment."""
    return ends.withColumn("lease_state", F.when(F.col("expires_at") <= at, "expired").otherwise("held"))


def budget_events(spend: DataFrame, ts: str, key: str, amount: str, limits: DataFrame,
                  threshold: float = 0.8, delay: str = "1 hour") -> DataFrame:
    """Days on which a workspace reached the threshold or exceeded its budget."""
    daily = (
        spend.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("w"), key)
        .agg(F.sum(amount).alias("spent"))
    )
    share = F.col("spent") / F.col("budget")
    return (
        daily.join(limits, key).where(share >= threshold)
        .select(F.col("w.start").alias("day"), key, "spent",
                F.when(share > 1, "exceeded").otherwise("threshold").alias("budget_event"))
    )


def retrieval_join(begins: DataFrame, finishes: DataFrame, hits: DataFrame, bound: str = "1 hour",
                   delay: str = "10 minutes") -> DataFrame:
    """Searches with their finish time and hits: event_id, started_at, finished_at, rank_position.

    Left outer joins on the event within ``bound`` of its begin: a search
    without finish or without hits comes out, with NULLs, once the watermark
    shows that none can come any more. State is the rows of ``bound``.
    """
    b = begins.withWatermark("started_at", delay)
    f = finishes.withWatermark("finished_at", delay).withColumnRenamed("event_id", "f_id")
    h = hits.withWatermark("hit_at", delay).withColumnRenamed("event_id", "h_id")
    timed = F.expr(
        f"event_id = f_id AND finished_at >= started_at AND finished_at <= started_at + INTERVAL {bound}")
    hit = F.expr(f"event_id = h_id AND hit_at >= started_at AND hit_at <= started_at + INTERVAL {bound}")
    # A stream carries one event time: the begin time goes on, the finish time
    # becomes a plain column.
    closed = b.join(f, timed, "left_outer").select(
        "event_id", "started_at", F.expr("finished_at + INTERVAL '0' SECOND").alias("finished_at"))
    return closed.join(h, hit, "left_outer").select("event_id", "started_at", "finished_at", "rank_position")


def lateness(events: DataFrame, occurred: str, created: str, edges: tuple[int, ...] = (1, 60, 3600, 86400)) -> DataFrame:
    """Histogram of the gap between occurrence and arrival, in seconds."""
    gap = F.expr(f"timestampdiff(SECOND, {occurred}, {created})")
    bucket = None
    for edge in edges:
        test = gap < edge
        bucket = F.when(test, f"<{edge}s") if bucket is None else bucket.when(test, f"<{edge}s")
    return events.groupBy(bucket.otherwise(f">={edges[-1]}s").alias("lag_bucket")).agg(
        F.count(F.lit(1)).alias("n"))


# Running a stream to the end of its input -------------------------------------


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of its own for stateful streams: RocksDB state and one state
    partition per core, as the partition count is frozen into the checkpoint."""
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    session.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return session


def drain(stream: DataFrame, mode: str, spark: SparkSession,
          write: Callable[[str], Callable[[DataFrame, int], None]] = batch_appender,
          folder: str | None = None) -> str:
    """Process everything available and stop; returns the folder of the output.

    Output and checkpoint live in the shared folder, so the query can restart
    on other executors; with the same ``folder`` it goes on where it stopped.
    """
    folder = folder or new_scratch(spark, "stream")
    query = (
        stream.writeStream.foreachBatch(write(f"{folder}/out")).outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return f"{folder}/out"
