"""Streaming queries over ``events``, each run to the end of its input and
compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.catalogue.console import _RULE_VALUES, rules
from opsloom.catalogue.registry import Tables, query
from opsloom.plans import tenancy as tn
from opsloom.session import new_scratch
from opsloom.sources.keyed_table import KeyedTable
from opsloom.sources.sinks import batch_appender, latest_state
from opsloom.streaming import jobs
from opsloom.streaming.streaks import error_streaks

_STAMP = "yyyy-MM-dd HH:mm:ss"


def _stream(t: Tables):
    session = jobs.stream_session(t.spark)
    raw = session.readStream.schema(t.events.schema).parquet(f"{t.folder}/events*.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


#: Sets of files that the events arrive in, one set per trigger.
FILES = 4


def _parts(t: Tables) -> int:
    """Files of a set: one for each core, however large the table is."""
    return t.spark.sparkContext.defaultParallelism


def _arriving(t: Tables, drop: str = "false"):
    """The events as sets of files that come one after the other, in order of time but for some rows that come a set late.

    Two sets of rows of no event close the stream: they move the watermark past all others.
    """
    folder = new_scratch(t.spark, "arriving")
    low, high = t.events.agg(F.min("ts"), F.max("ts")).first()
    part = F.least(F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(low).cast("timestamp")))
                           * FILES / F.greatest(F.unix_micros(F.lit(high).cast("timestamp")) - F.unix_micros(F.lit(low).cast("timestamp")), F.lit(1))),
                   F.lit(FILES - 1))
    late = F.when((F.col("event_id") % 5 == 0) & (F.col("part") < FILES - 1), 1).otherwise(0)
    placed = t.events.where(~F.expr(drop)).withColumn("part", part).withColumn("file", F.col("part") + late)
    for n in range(FILES):
        placed.where(F.col("file") == n).drop("part", "file").repartition(_parts(t)).write.parquet(f"{folder}/{n}")
    for n in range(2):
        end = t.events.limit(1).withColumn("event_id", F.lit(-1 - n).cast("long")).withColumn("event_type", F.lit("end")).withColumn(
            "ts", F.timestamp_add("DAY", F.lit(400 * (n + 1)), F.lit(high)).cast(dict(t.events.dtypes)["ts"]))
        copies = t.spark.range(0, _parts(t), 1, _parts(t)).select().crossJoin(F.broadcast(end))
        copies.write.parquet(f"{folder}/{FILES + n}")
    return folder


def _follow(t: Tables, folder: str, session=None):
    session = session or jobs.stream_session(t.spark)
    raw = session.readStream.schema(t.events.schema).option("maxFilesPerTrigger", _parts(t)).parquet(f"{folder}/*")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _read(t: Tables, stream, mode: str):
    return t.spark.read.parquet(jobs.drain(stream, mode, t.spark))


def _text(column: str):
    return F.date_format(column, _STAMP).alias(column)


@query("stream_dedupe", """
SELECT event_id, event_type FROM events
""")
def stream_dedupe(t: Tables):
    twice = _stream(t).select("event_id", "event_type", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    out = jobs.deduplicated(twice, ["event_id"], "ts").select("event_id", "event_type")
    return _read(t, out, "append").select("event_id", "event_type")


@query("stream_counts", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL
""")
def stream_counts(t: Tables):
    out = jobs.drain(jobs.event_counts(_stream(t), "ts", ["event_type"]), "update", t.spark)
    return latest_state(t.spark, out, ["window_start", "event_type"]).select(_text("window_start"), "event_type", "n")


@query("stream_counts_sliding", """
WITH w AS (SELECT event_type, unnest([0, 1]) AS k, ts FROM events)
SELECT strftime(date_trunc('hour', ts) - k * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*)::BIGINT AS n FROM w GROUP BY ALL
""")
def stream_counts_sliding(t: Tables):
    out = jobs.drain(jobs.event_counts(_stream(t), "ts", ["event_type"], "2 hours", "1 hour"), "update", t.spark)
    return latest_state(t.spark, out, ["window_start", "event_type"]).select(_text("window_start"), "event_type", "n")


@query("stream_threads", """
SELECT user_id AS thread_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_message_at, count(*)::BIGINT AS messages,
 count(*) FILTER (WHERE event_type = 'view')::BIGINT AS inbound_messages, arg_max(CASE WHEN event_type = 'view' THEN 'open' ELSE 'answered' END, ts) AS thread_status
FROM events GROUP BY 1
""")
def stream_threads(t: Tables):
    """Thread states merged batch by batch into a keyed table; every batch is written twice."""
    rows = _follow(t, _arriving(t)).where("event_id >= 0").withColumnRenamed("user_id", "thread_id")
    kind = dict(rows.dtypes)["thread_id"]
    folder = new_scratch(t.spark, "threads")

    def table(spark):
        return KeyedTable(spark, folder, f"thread_id {kind}, {jobs.THREADS}", ["thread_id"])

    def write(_):
        sink = jobs.keyed_sink(table, lambda df: jobs.thread_state(df, "thread_id", "ts", F.col("event_type") == "view"),
                               jobs.merged_threads("thread_id"), "threads")
        return lambda df, n: (sink(df, n), sink(df, n))

    jobs.drain(rows, "append", t.spark, write)
    return table(t.spark).read().select("thread_id", _text("last_message_at"), "messages", "inbound_messages", "thread_status")


_SESSIONS = """
g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL {gap} THEN 0 ELSE 1 END AS fresh FROM events),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g),
f AS (SELECT user_id, min(ts) AS started_at, max(ts) AS last_at, max(ts) + INTERVAL {gap} AS closed_at, count(*) AS n FROM i GROUP BY user_id, s),
mark AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL {delay} AS m FROM events)
"""


@query("stream_sessions", "WITH " + _SESSIONS.format(gap="6 HOUR", delay="1 HOUR") + """
SELECT user_id, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(closed_at, '%Y-%m-%d %H:%M:%S') AS closed_at, n::BIGINT AS n
FROM f, mark WHERE closed_at <= m
""")
def stream_sessions(t: Tables):
    out = _read(t, jobs.sessions_by_gap(_stream(t), "user_id", "ts", "6 hours"), "append")
    return out.select("user_id", _text("started_at"), _text("closed_at"), "n")


@query("stream_heartbeat", "WITH " + _SESSIONS.format(gap="12 HOUR", delay="1 MINUTE") + """
SELECT user_id, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_ping, strftime(closed_at, '%Y-%m-%d %H:%M:%S') AS alert_at FROM f, mark WHERE closed_at <= m
""")
def stream_heartbeat(t: Tables):
    out = _read(t, jobs.heartbeat_timeouts(_stream(t), "user_id", "ts", "12 hours"), "append")
    return out.select("user_id", _text("last_ping"), _text("alert_at"))


@query("stream_leases", """
SELECT user_id, strftime(max(ts + to_seconds(3600 * (event_id % 48))), '%Y-%m-%d %H:%M:%S') AS expires_at,
 CASE WHEN max(ts + to_seconds(3600 * (event_id % 48))) <= TIMESTAMP '2024-01-31 00:00:00' THEN 'expired' ELSE 'held' END AS lease_state FROM events GROUP BY 1
""")
def stream_leases(t: Tables):
    rows = _follow(t, _arriving(t)).where("event_id >= 0")
    kind = dict(rows.dtypes)["user_id"]
    folder = new_scratch(t.spark, "leases")
    seconds = (F.col("event_id") % 48 * 3600).cast("int")

    def table(spark):
        return KeyedTable(spark, folder, f"user_id {kind}, expires_at timestamp", ["user_id"])

    jobs.drain(rows, "append", t.spark, lambda _: jobs.keyed_sink(
        table, lambda df: jobs.lease_ends(df, "user_id", "ts", seconds), jobs.merged_leases("user_id"), "leases"))
    out = jobs.lease_state(table(t.spark).read(), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return out.select("user_id", _text("expires_at"), "lease_state")


@query("stream_budget", """
WITH d AS (SELECT date_trunc('day', ts) AS day, user_id, sum(floor(value * 100)::BIGINT) AS spent FROM events GROUP BY ALL),
l AS (SELECT c_custkey AS user_id, greatest(floor(c_acctbal * 2)::BIGINT, 100) AS budget FROM customer)
SELECT strftime(day, '%Y-%m-%d %H:%M:%S') AS day, user_id, spent::BIGINT AS spent, CASE WHEN spent > budget THEN 'exceeded' ELSE 'threshold' END AS budget_event
FROM d JOIN l USING (user_id) WHERE spent / budget >= 0.8
""")
def stream_budget(t: Tables):
    stream = _stream(t).withColumn("cents", F.floor(F.col("value") * 100))
    limits = stream.sparkSession.read.parquet(f"{t.folder}/customer.parquet").select(
        F.col("c_custkey").alias("user_id"), F.greatest(F.floor(F.col("c_acctbal") * 2), F.lit(100)).alias("budget"))
    out = jobs.drain(jobs.budget_events(stream, "ts", "user_id", "cents", limits), "update", t.spark)
    return latest_state(t.spark, out, ["day", "user_id"]).select(_text("day"), "user_id", "spent", "budget_event")


# Searches whose id 7 divides get no hits, those that end in an error no finish.
@query("stream_retrieval", """
SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN unnest(CASE WHEN event_id % 7 = 0 THEN [1] ELSE range(1, event_id % 3 + 2) END) END AS rank_position,
 strftime(ts, '%Y-%m-%d %H:%M:%S') AS started_at,
 CASE WHEN event_type <> 'error' THEN strftime(ts + to_seconds(event_id % 50), '%Y-%m-%d %H:%M:%S') END AS finished_at FROM events
""")
def stream_retrieval(t: Tables):
    folder, session = _arriving(t), jobs.stream_session(t.spark)
    begins = _follow(t, folder, session).select("event_id", F.col("ts").alias("started_at"))
    later = F.timestamp_add("SECOND", (F.col("event_id") % 50).cast("int"), F.col("ts"))
    finishes = _follow(t, folder, session).where("event_type <> 'error' OR event_id < 0").select("event_id", later.alias("finished_at"))
    hits = _follow(t, folder, session).where("event_id % 7 <> 0").select(
        "event_id", F.col("ts").alias("hit_at"), F.explode(F.sequence(F.lit(1), F.greatest(F.col("event_id") % 3 + 1, F.lit(1)).cast("int"))).alias("rank_position"))
    out = _read(t, jobs.retrieval_join(begins, finishes, hits, delay="60 days"), "append").where("event_id >= 0")
    return out.select("event_id", F.col("rank_position").cast("long").alias("rank_position"), _text("started_at"), _text("finished_at"))


@query("stream_error_streaks", """
WITH o AS (SELECT user_id, ts, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts)
  - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts) AS island FROM events),
r AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id, island ORDER BY ts) AS n FROM o WHERE bad)
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS alert_at FROM r WHERE n = 3
""")
def stream_error_streaks(t: Tables):
    rows = _follow(t, _arriving(t))
    out = _read(t, error_streaks(rows, "user_id", "ts", F.col("event_type") == "error", delay="60 days"), "append")
    return out.select("user_id", _text("alert_at"))


@query("stream_lateness", """
WITH g AS (SELECT floor(value)::BIGINT * 40 AS lag_s FROM events)
SELECT CASE WHEN lag_s < 1 THEN '<1s' WHEN lag_s < 60 THEN '<60s' WHEN lag_s < 3600 THEN '<3600s' WHEN lag_s < 86400 THEN '<86400s' ELSE '>=86400s' END AS lag_bucket,
 count(*)::BIGINT AS n FROM g GROUP BY 1
""")
def stream_lateness(t: Tables):
    created = F.timestamp_add("SECOND", (F.floor("value") * 40).cast("int"), F.col("ts"))
    rows = _stream(t).withColumn("created_at", created)
    out = jobs.drain(jobs.lateness(rows, "ts", "created_at"), "update", t.spark)
    return latest_state(t.spark, out, ["lag_bucket"]).select("lag_bucket", "n")


@query("stream_routing", f"""
WITH r(rule_id, priority, channel_id, match_type, match_value, target, f, u) AS (VALUES {_RULE_VALUES}),
m AS (SELECT event_id, rule_id, row_number() OVER (PARTITION BY event_id ORDER BY priority, rule_id) AS n FROM events JOIN r ON channel_id = event_type
 AND (f IS NULL OR f::TIMESTAMP <= ts) AND (u IS NULL OR ts < u::TIMESTAMP) AND (match_type = 'any' OR match_type = 'sender' AND match_value = user_id::VARCHAR
 OR match_type = 'keyword' AND contains(props, match_value)))
SELECT e.event_id AS message_id, CASE WHEN rule_id IS NULL THEN 'missed' ELSE 'matched' END AS routing
FROM events e LEFT JOIN (SELECT * FROM m WHERE n = 1) x USING (event_id)
""")
def stream_routing(t: Tables):
    """Each batch of messages is routed as it comes; a batch that is run again overwrites its own rows."""
    messages = _follow(t, _arriving(t)).where("event_id >= 0").select(
        F.col("event_id").alias("message_id"), F.col("event_type").alias("channel_id"),
        F.col("user_id").cast("string").alias("sender"), F.col("props").alias("body"),
        F.col("ts").cast("timestamp_ntz").alias("ts"))

    def write(folder: str):
        append = batch_appender(folder)
        return lambda df, n: append(tn.route(df, rules(Tables(df.sparkSession, t.folder)), "ts"), n)

    out = jobs.drain(messages, "append", t.spark, write)
    return t.spark.read.parquet(out).select("message_id", "routing")
