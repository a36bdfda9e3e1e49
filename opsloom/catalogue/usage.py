"""Queries over model usage and worker runs. Events are calls and runs: the
type is the model, the user the workspace, the value the work done."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.catalogue.registry import Tables, plain, query
from opsloom.operators.literals import fixed_table
from opsloom.plans import usage as us

USAGE = """
SELECT event_id AS call_id, concat('p', CAST(user_id % 2 AS STRING)) AS provider, event_type AS model, user_id % 20 AS workspace_id,
  CAST(floor(value * 1000) AS BIGINT) AS input_tokens, CAST(floor(value * 100) AS BIGINT) AS output_tokens,
  CAST(floor(value * 10) AS BIGINT) AS latency_ms, event_type = 'error' AS is_error, ts AS created_at FROM {events}
"""
# (provider, model, from, to, input price, output price) per million tokens.
PRICES = [
    ("p0", "view", "2023-01-01 00:00:00", None, "0.05", "0.40"),
    ("p0", "view", "2024-01-10 00:00:00", "2024-01-20 00:00:00", "0.10", "0.40"),
    ("p0", "click", "2024-01-03 00:00:00", "2024-01-12 00:00:00", "0.20", "0.80"),
    ("p0", "click", "2024-01-12 00:00:00", None, "0.30", "0.90"),
    ("p0", "error", "2023-06-01 00:00:00", None, "0.01", "0.02"),
    ("p1", "view", "2023-01-01 00:00:00", "2024-01-25 00:00:00", "0.15", "0.60"),
    ("p1", "purchase", "2024-01-05 00:00:00", None, "1.25", "5.00"),
    ("p1", "purchase", "2024-01-15 00:00:00", "2024-01-16 00:00:00", "1.00", "4.00"),
    ("p1", "signup", "2024-01-01 00:00:00", None, "0.07", "0.28"),
    ("p1", "error", "2023-06-01 00:00:00", None, "0.01", "0.02"),
]
_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in PRICES)
_PRICED = f"""
u AS ({plain(USAGE)}), pr(provider, model, f, t, ip, op) AS (VALUES {_VALUES}),
m AS (SELECT u.call_id, ip, op, row_number() OVER (PARTITION BY u.call_id ORDER BY f::TIMESTAMP DESC) AS n FROM u JOIN pr
  ON u.provider = pr.provider AND u.model = pr.model AND f::TIMESTAMP <= created_at AND (t IS NULL OR created_at < t::TIMESTAMP)),
c AS (SELECT u.*, ip, op, (100 * (input_tokens * ip::DECIMAL(12,6) + output_tokens * op::DECIMAL(12,6)))::BIGINT AS cost
  FROM u LEFT JOIN (SELECT * FROM m WHERE n = 1) x USING (call_id))
"""


def prices(t: Tables):
    raw = fixed_table(t.spark, ["provider", "model", "effective_from", "effective_to", "input_price", "output_price"], PRICES)
    return raw.withColumns({
        "effective_from": F.to_timestamp_ntz("effective_from"), "effective_to": F.to_timestamp_ntz("effective_to"),
        "input_price": F.col("input_price").cast("decimal(12,6)"), "output_price": F.col("output_price").cast("decimal(12,6)")})


def costed(t: Tables, bucket_days=None):
    return us.priced_usage(t.derive(USAGE), prices(t), bucket_days).withColumn("cost", us.usage_cost())


def _e8():
    """Cost in hundred-millionths, the exact unit both engines can print."""
    return (F.col("cost") * 100_000_000).cast("long").alias("cost_e8")


@query("price_asof", f"WITH {_PRICED} SELECT call_id, ip::DOUBLE AS input_price, op::DOUBLE AS output_price, cost AS cost_e8 FROM c")
def price_asof(t: Tables):
    return costed(t, bucket_days=7).select(
        "call_id", F.col("input_price").cast("double").alias("input_price"),
        F.col("output_price").cast("double").alias("output_price"),
        _e8())


@query("usage_cost_daily", f"WITH {_PRICED}" + """
SELECT strftime(created_at, '%Y-%m-%d') AS day, workspace_id, model, count(*)::BIGINT AS calls, sum(input_tokens)::BIGINT AS input_tokens,
 sum(output_tokens)::BIGINT AS output_tokens, sum(cost)::BIGINT AS cost_e8, round(avg(latency_ms), 4) AS avg_latency_ms,
 round(avg(CASE WHEN is_error THEN 1.0 ELSE 0.0 END), 6) AS error_share FROM c GROUP BY ALL
""")
def usage_cost_daily(t: Tables):
    rows = costed(t).withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
    return us.cost_by(rows, ["day", "workspace_id", "model"]).select(
        "day", "workspace_id", "model", "calls", "input_tokens", "output_tokens",
        _e8(), F.round("avg_latency_ms", 4).alias("avg_latency_ms"),
        F.round("error_share", 6).alias("error_share"))


@query("budget_state", f"WITH {_PRICED}" + """
, d AS (SELECT strftime(created_at, '%Y-%m-%d') AS period, 'day' AS grain, workspace_id, sum(cost) AS cost FROM c GROUP BY ALL
 UNION ALL SELECT strftime(created_at, '%Y-%m'), 'month', workspace_id, sum(cost) FROM c GROUP BY ALL),
l AS (SELECT c_custkey AS workspace_id, round(c_acctbal / 1000, 1) / 10 AS budget FROM customer WHERE c_acctbal > 0)
SELECT period, grain, workspace_id, cost::BIGINT AS cost_e8, CASE WHEN budget IS NULL THEN 'unlimited' WHEN cost / 1e8 > budget THEN 'exceeded'
 WHEN cost / 1e8 / budget >= 0.8 THEN 'threshold' ELSE 'ok' END AS budget_state FROM d LEFT JOIN l USING (workspace_id)
""")
def budget_state(t: Tables):
    rows = costed(t)
    day = us.cost_by(rows.withColumn("period", F.date_format("created_at", "yyyy-MM-dd")), ["period", "workspace_id"])
    # Months add up the days already aggregated.
    month = day.groupBy(F.substring("period", 1, 7).alias("period"), "workspace_id").agg(F.sum("cost").alias("cost"))
    spend = day.select("period", F.lit("day").alias("grain"), "workspace_id", "cost").unionByName(
        month.select("period", F.lit("month").alias("grain"), "workspace_id", "cost"))
    limits = t.customer.where("c_acctbal > 0").select(
        F.col("c_custkey").alias("workspace_id"), (F.round(F.col("c_acctbal") / 1000, 1) / 10).alias("budget"))
    return us.budget_state(spend, limits).select(
        "period", "grain", "workspace_id", _e8(), "budget_state")


@query("worker_health", """
SELECT user_id AS worker_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_run, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS errors,
 round(avg(value), 6) AS avg_duration_s, count(*)::BIGINT AS runs FROM events GROUP BY user_id
""")
def worker_health(t: Tables):
    runs = t.events.select(F.col("user_id").alias("worker_id"), F.col("ts").alias("started_at"),
                           (F.col("event_type") == "error").alias("is_error"), F.col("value").alias("duration_s"))
    return us.worker_health(runs).select(
        "worker_id", F.date_format("last_run", "yyyy-MM-dd HH:mm:ss").alias("last_run"), "errors",
        F.round("avg_duration_s", 6).alias("avg_duration_s"), "runs")


@query("worker_runs", """
SELECT event_type AS worker_name, count(*)::BIGINT AS n_runs, count(DISTINCT user_id)::BIGINT AS n_workers FROM events GROUP BY 1
""")
def worker_runs(t: Tables):
    # Two steps instead of a distinct aggregate: (name, worker) pairs first.
    pairs = t.events.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(F.col("event_type").alias("worker_name")).agg(
        F.sum("n").alias("n_runs"), F.count(F.lit(1)).alias("n_workers"))


@query("attempts_latest", """
WITH a AS (SELECT event_id AS run_id, event_type || '-' || user_id AS idempotency_key, CAST(floor(value) AS BIGINT) % 4 + 1 AS attempt FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY attempt DESC, run_id DESC) AS n FROM a)
SELECT idempotency_key, attempt, run_id, CASE WHEN attempt >= 4 THEN 'exhausted' ELSE 'open' END AS state FROM r WHERE n = 1
""")
def attempts_latest(t: Tables):
    rows = t.events.select(
        F.concat_ws("-", "event_type", "user_id").alias("idempotency_key"),
        (F.floor("value") % 4 + 1).alias("attempt"), F.col("event_id").alias("run_id"))
    return us.latest_attempts(rows, 4).select(
        "idempotency_key", "attempt", "run_id", F.when(F.col("exhausted"), "exhausted").otherwise("open").alias("state"))


@query("consecutive_errors", """
WITH o AS (SELECT user_id, event_id, ts, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
  - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS island FROM events)
SELECT user_id, count(*)::BIGINT AS run_length, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS run_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS run_end
FROM o WHERE bad GROUP BY user_id, island HAVING count(*) >= 3
""")
def consecutive_errors(t: Tables):
    rows = t.events.select("user_id", "event_id", "ts", "event_type")
    runs = us.failure_runs(rows, "user_id", "ts", F.col("event_type") == "error", "event_id")
    return runs.select("user_id", "run_length", F.date_format("run_start", "yyyy-MM-dd HH:mm:ss").alias("run_start"),
                       F.date_format("run_end", "yyyy-MM-dd HH:mm:ss").alias("run_end"))


@query("response_time", """
SELECT conv_id, turn, (SELECT min(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND b.role = 'assistant') AS reply_turn
FROM conversations a WHERE role = 'user'
""")
def response_time(t: Tables):
    rows = t.conversations.select("conv_id", "turn", "role")
    return us.response_positions(rows, "conv_id", "turn", "role").select(
        "conv_id", "turn", F.col("reply_position").alias("reply_turn"))


@query("response_seconds", """
WITH e AS (SELECT user_id, event_id, ts, event_type, min(CASE WHEN event_type = 'click' THEN struct_pack(ts, event_id) END) OVER
   (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM events)
SELECT event_id, date_diff('microsecond', ts, nx.ts) // 1000000 AS response_s FROM e WHERE event_type = 'view'
""")
def response_seconds(t: Tables):
    rows = t.events.select("user_id", "event_id", "ts", "event_type")
    out = us.response_times(rows, "user_id", "ts", "event_id", F.col("event_type") == "view",
                            F.col("event_type") == "click")
    return out.select("event_id", "response_s")


@query("conversation_tokens", """
SELECT conv_id, role, count(*)::BIGINT AS turns, sum(greatest(1, length(text) // 4))::BIGINT AS tokens, max(length(text))::BIGINT AS longest
FROM conversations GROUP BY conv_id, role
""")
def conversation_tokens(t: Tables):
    from opsloom.functions.text import token_estimate

    return t.conversations.groupBy("conv_id", "role").agg(
        F.count(F.lit(1)).alias("turns"), F.sum(token_estimate(F.col("text"))).alias("tokens"),
        F.max(F.length("text")).cast("long").alias("longest"))
