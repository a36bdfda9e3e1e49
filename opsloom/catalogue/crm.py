"""Queries over funnel, sales and marketing KPIs. Events are CRM activity:
signup a lead, view a reply, click a meeting, purchase a close, error a loss."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom import fixed_values as fv
from opsloom.catalogue.registry import Tables, plain, query
from opsloom.plans import kpi

STAGES = {"lead": "signup", "responded": "view", "meeting": "click", "close": "purchase", "lost": "error"}


def activity(t: Tables):
    return t.events.select(F.col("user_id").alias("lead_id"), "event_id", F.col("event_type").alias("activity"),
                           "ts", "value")


def milestones(t: Tables):
    return kpi.lead_milestones(activity(t), STAGES)


_MILE = "m AS (SELECT user_id AS lead_id, " + ", ".join(
    f"min(ts) FILTER (WHERE event_type = '{e}') AS {s}_at" for s, e in STAGES.items()) + " FROM events GROUP BY user_id)"
_DAY = "strftime(lead_at, '%Y-%m-%d')"


@query("funnel_counts", f"""WITH {_MILE} SELECT {_DAY} AS period, {', '.join(f'count({s}_at)::BIGINT AS {s}' for s in STAGES)} FROM m GROUP BY 1""")
def funnel_counts(t: Tables):
    return kpi.funnel_counts(milestones(t), list(STAGES), F.date_format("lead_at", "yyyy-MM-dd"))


@query("funnel_rates", f"""WITH {_MILE}, c AS (SELECT {_DAY} AS period, {', '.join(f'count({s}_at) AS {s}' for s in STAGES)} FROM m GROUP BY 1)
SELECT period, {', '.join(f"round({a}::DOUBLE / nullif({b}, 0), 6) AS {n}" for n, (a, b) in kpi.FUNNEL_RATES.items())} FROM c
""")
def funnel_rates(t: Tables):
    rows = kpi.funnel_rates(kpi.funnel_counts(milestones(t), list(STAGES), F.date_format("lead_at", "yyyy-MM-dd")))
    return rows.select("period", *[F.round(n, 6).alias(n) for n in kpi.FUNNEL_RATES])


@query("lead_to_close", f"""WITH {_MILE} SELECT {_DAY} AS period, count(*)::BIGINT AS closes,
 round(avg(date_diff('microsecond', lead_at, close_at) // 1000000), 4) AS avg_close_s, max(date_diff('microsecond', lead_at, close_at) // 1000000)::BIGINT AS max_close_s
FROM m WHERE close_at >= lead_at GROUP BY 1
""")
def lead_to_close(t: Tables):
    rows = kpi.time_to_close(milestones(t))
    return rows.groupBy(F.date_format("lead_at", "yyyy-MM-dd").alias("period")).agg(
        F.count(F.lit(1)).alias("closes"), F.round(F.avg("close_s"), 4).alias("avg_close_s"),
        F.max("close_s").alias("max_close_s"))


@query("carry_forward", """
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lead_source FROM events
""")
def carry_forward(t: Tables):
    rows = t.events.select("user_id", "event_id", "ts", "event_type", "props")
    source = F.when(F.col("event_type") == "signup", F.col("props"))
    return kpi.carried_field(rows, "user_id", "ts", "event_id", source, "lead_source").select(
        "event_id", "lead_source")


SALES = """
SELECT date_format(o_orderdate, 'yyyy-MM') AS month, l_suppkey AS advisor, l_partkey, o_orderkey, l_quantity, l_returnflag, l_linestatus,
 CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey
"""
_SALES = plain(SALES).replace("date_format(o_orderdate, 'yyyy-MM')", "strftime(o_orderdate, '%Y-%m')")


@query("kpi_rollup", f"WITH s AS ({_SALES})" + """
SELECT month, advisor, sum(price)::DOUBLE AS revenue, count(*)::BIGINT AS closes,
 CASE GROUPING(month, advisor) WHEN 0 THEN 'member' WHEN 1 THEN 'team' ELSE 'all' END AS level FROM s GROUP BY ROLLUP (month, advisor)
""")
def kpi_rollup(t: Tables):
    # Members are summed first, so the rollup expands totals and not order lines.
    member = t.derive(SALES).groupBy("month", "advisor").agg(F.sum("price").alias("revenue"), F.count(F.lit(1)).alias("closes"))
    out = kpi.with_totals(member, "month", "advisor", ["revenue", "closes"])
    return out.withColumn("revenue", F.col("revenue").cast("double"))


@query("kpi_rank", f"WITH s AS ({_SALES})" + """
, t AS (SELECT month, advisor, sum(price) AS revenue FROM s GROUP BY ALL)
SELECT month, advisor, revenue::DOUBLE AS revenue, rank() OVER (PARTITION BY month ORDER BY revenue DESC) AS rank_most,
 rank() OVER (PARTITION BY month ORDER BY revenue) AS rank_least FROM t
""")
def kpi_rank(t: Tables):
    totals = t.derive(SALES).groupBy("month", "advisor").agg(F.sum("price").alias("revenue"))
    return kpi.ranking(totals, "month", "revenue").select(
        "month", "advisor", F.col("revenue").cast("double").alias("revenue"),
        F.col("rank_most").cast("long").alias("rank_most"), F.col("rank_least").cast("long").alias("rank_least"))


LEADS = """
SELECT o_orderkey AS lead_id, date_format(o_orderdate, 'yyyy-MM') AS month,
 CASE WHEN o_custkey % 50 <> 0 THEN o_custkey % 50 END AS advisor, o_totalprice, o_orderstatus, o_orderpriority,
 o_custkey % 4 AS followups, CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS revenue FROM {orders}
"""
_LEADS = plain(LEADS).replace("date_format(o_orderdate, 'yyyy-MM')", "strftime(o_orderdate, '%Y-%m')")
LEAD_STAGES = {
    "lead": "true", "assigned": "advisor IS NOT NULL", "responded": "o_totalprice > 20000",
    "qualified": "o_orderpriority IN ('1-URGENT', '2-HIGH')", "meeting": "o_totalprice > 60000",
    "visit": "o_totalprice > 100000", "negotiation": "o_totalprice > 150000 AND o_orderstatus = 'O'",
    "close": "o_totalprice > 150000 AND o_orderstatus = 'F'", "lost": "o_orderstatus NOT IN ('F', 'O')",
    "recovered": "lead_id % 7 = 0 AND o_orderstatus = 'F'",
}


@query("advisor_funnel", f"WITH l AS ({_LEADS}), c AS (SELECT month, advisor, CASE GROUPING(month, advisor) WHEN 0 THEN 'member' WHEN 1 THEN 'team' ELSE 'all' END AS level, "
       + ", ".join(f"count(*) FILTER (WHERE {test})::BIGINT AS {stage}" for stage, test in LEAD_STAGES.items())
       + ", sum(followups)::BIGINT AS followups, sum(revenue)::DOUBLE AS revenue FROM l GROUP BY ROLLUP (month, advisor)) SELECT *, "
       + ", ".join(f"{a}::DOUBLE / nullif({b}, 0) AS {name}" for name, (a, b) in kpi.TEAM_RATES.items()) + " FROM c")
def advisor_funnel(t: Tables):
    stages = {stage: F.expr(test) for stage, test in LEAD_STAGES.items()}
    out = kpi.advisor_funnel(t.derive(LEADS), "month", "advisor", stages, ["followups", "revenue"])
    return out.withColumn("revenue", F.col("revenue").cast("double"))


_DIMENSIONS = ("source", "format", "development", "campaign")


@query("dimension_rank", """
WITH s AS (SELECT p_type AS source, p_size % 5 AS format, p_brand AS development, l_returnflag AS campaign FROM lineitem JOIN part ON p_partkey = l_partkey),
t AS (""" + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d}::VARCHAR AS value, count(*)::BIGINT AS leads FROM s GROUP BY 2" for d in _DIMENSIONS) + """)
SELECT *, rank() OVER (PARTITION BY dimension ORDER BY leads DESC) AS rank_most, rank() OVER (PARTITION BY dimension ORDER BY leads) AS rank_least FROM t
""")
def dimension_rank(t: Tables):
    rows = t.derive("SELECT p_type AS source, p_size % 5 AS format, p_brand AS development, l_returnflag AS campaign, "
                    "CAST(1 AS BIGINT) AS leads FROM {lineitem} JOIN {part} ON p_partkey = l_partkey")
    return kpi.dimension_ranking(rows, _DIMENSIONS, "leads").select(
        "dimension", "value", "leads", F.col("rank_most").cast("long").alias("rank_most"),
        F.col("rank_least").cast("long").alias("rank_least"))


@query("target_diff", f"WITH s AS ({_SALES})" + """
, r AS (SELECT month, advisor, sum(price) AS result FROM s GROUP BY ALL)
SELECT month, advisor, result::DOUBLE AS result, (CASE WHEN s_acctbal > 0 THEN s_acctbal::DECIMAL(18,2) * 100 END)::DOUBLE AS target,
 (result - CASE WHEN s_acctbal > 0 THEN s_acctbal::DECIMAL(18,2) * 100 END)::DOUBLE AS difference FROM r LEFT JOIN supplier ON s_suppkey = advisor
""")
def target_diff(t: Tables):
    result = t.derive(SALES).groupBy("month", "advisor").agg(F.sum("price").alias("result"))
    targets = t.supplier.where("s_acctbal > 0").select(
        F.col("s_suppkey").alias("advisor"), (F.col("s_acctbal").cast("decimal(18,2)") * 100).alias("target"))
    out = kpi.target_difference(result, targets, ["advisor"])
    return out.select("month", "advisor", *[F.col(c).cast("double").alias(c) for c in ("result", "target", "difference")])


ADS = """
SELECT date_format(l_shipdate, 'yyyy-MM') AS month, p_type AS source, sum(CAST(l_discount * l_quantity AS DECIMAL(18,2))) AS spend,
 count(*) AS clicks, sum(CAST(l_quantity AS BIGINT)) AS impressions FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
 GROUP BY 1, 2
"""
CRM = """
SELECT date_format(o_orderdate, 'yyyy-MM') AS month, p_type AS source, count(*) AS leads,
 count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS meetings, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS revenue
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {part} ON p_partkey = l_partkey GROUP BY 1, 2
"""
_ADS = plain(ADS).replace("date_format(l_shipdate, 'yyyy-MM')", "strftime(l_shipdate, '%Y-%m')").replace(
    "CAST(l_discount * l_quantity AS DECIMAL(18,2))", "CAST(l_discount * l_quantity AS DECIMAL(18,2))")
_CRM = plain(CRM).replace("date_format(o_orderdate, 'yyyy-MM')", "strftime(o_orderdate, '%Y-%m')")


@query("ads_crm_outer", f"WITH a AS ({_ADS}), c AS ({_CRM})" + """
SELECT month, source, spend::DOUBLE AS spend, clicks::BIGINT AS clicks, leads::BIGINT AS leads, spend::DOUBLE / nullif(leads, 0) AS cpl,
 spend::DOUBLE / nullif(clicks, 0) AS cpc, clicks::DOUBLE / nullif(impressions, 0) AS ctr, spend::DOUBLE / nullif(meetings, 0) AS cost_per_meeting
FROM a FULL JOIN c USING (month, source)
""")
def ads_crm_outer(t: Tables):
    rows = kpi.marketing_rates(kpi.ads_with_crm(t.derive(ADS), t.derive(CRM), ["month", "source"]))
    return rows.select("month", "source", F.col("spend").cast("double").alias("spend"), "clicks", "leads",
                       *kpi.MARKETING_RATES)


@query("kpi_by_source", f"WITH a AS (SELECT source, sum(spend) AS spend, sum(clicks) AS clicks FROM ({_ADS}) GROUP BY 1), c AS (SELECT source, sum(leads) AS leads, sum(meetings) AS closes, sum(revenue) AS revenue FROM ({_CRM}) GROUP BY 1)" + """
SELECT source, round((revenue::DOUBLE - spend::DOUBLE) / nullif(spend::DOUBLE, 0), 6) AS roi, round(spend::DOUBLE / nullif(closes, 0), 6) AS cac,
 round(closes::DOUBLE / nullif(leads, 0), 6) AS conversion FROM a FULL JOIN c USING (source)
""")
def kpi_by_source(t: Tables):
    ads = t.derive(ADS).groupBy("source").agg(F.sum("spend").alias("spend"))
    crm = t.derive(CRM).groupBy("source").agg(
        F.sum("leads").alias("leads"), F.sum("meetings").alias("closes"), F.sum("revenue").alias("revenue"))
    rows = kpi.finance(kpi.ads_with_crm(ads, crm, ["source"]).withColumn("area", F.lit(None).cast("double")))
    return rows.select("source", F.round("roi", 6).alias("roi"), F.round("cac", 6).alias("cac"),
                       F.round(kpi.ratio("closes", "leads"), 6).alias("conversion"))


@query("kpi_marketing", f"WITH a AS ({_ADS})" + """
SELECT month, sum(spend)::DOUBLE AS spend, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions,
 round(sum(spend)::DOUBLE / nullif(sum(clicks), 0), 6) AS cpc, round(sum(clicks)::DOUBLE / nullif(sum(impressions), 0), 6) AS ctr FROM a GROUP BY month
""")
def kpi_marketing(t: Tables):
    rows = t.derive(ADS).groupBy("month").agg(
        F.sum("spend").alias("spend"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    return rows.select("month", F.col("spend").cast("double").alias("spend"), "clicks", "impressions",
                       F.round(kpi.ratio("spend", "clicks"), 6).alias("cpc"), F.round(kpi.ratio("clicks", "impressions"), 6).alias("ctr"))


@query("kpi_finance", f"WITH s AS ({_SALES})" + """
, f AS (SELECT month, sum(price) AS revenue, count(*) AS closes, sum(l_quantity::DECIMAL(18,2)) AS area,
  sum(CASE WHEN l_returnflag = 'R' THEN price * 0.1::DECIMAL(4,2) END) AS spend FROM s GROUP BY month)
SELECT month, round(revenue::DOUBLE / closes, 6) AS ticket, round(spend::DOUBLE / closes, 6) AS cac,
 round((revenue::DOUBLE - spend::DOUBLE) / spend::DOUBLE, 6) AS roi, round(revenue::DOUBLE / area::DOUBLE, 6) AS value_per_area FROM f
""")
def kpi_finance(t: Tables):
    rows = t.derive(SALES).groupBy("month").agg(
        F.sum("price").alias("revenue"), F.count(F.lit(1)).alias("closes"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("area"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("price") * F.lit("0.10").cast("decimal(4,2)"))).alias("spend"))
    return kpi.finance(rows).select("month", *[F.round(c, 6).alias(c) for c in ("ticket", "cac", "roi", "value_per_area")])


@query("kpi_parameterised", f"WITH s AS ({_SALES})" + """
, f AS (SELECT advisor, count(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_partkey END) AS units_sold, count(DISTINCT l_partkey) AS stock,
  sum(CASE WHEN l_linestatus = 'F' THEN price ELSE 0 END) AS revenue, sum(CASE WHEN l_linestatus = 'O' THEN price ELSE 0 END) AS pipeline FROM s GROUP BY advisor)
SELECT advisor, round(units_sold::DOUBLE / nullif(stock, 0), 6) AS absorption, round(revenue::DOUBLE * 0.03, 4) AS commission,
 round(revenue::DOUBLE + pipeline::DOUBLE * 0.25, 4) AS projected_revenue FROM f
""")
def kpi_parameterised(t: Tables):
    # One row per (advisor, unit) first: distinct units become plain counts.
    sold = F.col("l_linestatus") == "F"
    zero = F.lit(0).cast("decimal(18,2)")
    units = t.derive(SALES).groupBy("advisor", "l_partkey").agg(
        F.max(F.when(sold, 1).otherwise(0)).alias("sold"),
        F.sum(F.when(sold, F.col("price")).otherwise(zero)).alias("revenue"),
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("price")).otherwise(zero)).alias("pipeline"))
    rows = units.groupBy("advisor").agg(
        F.sum("sold").alias("units_sold"), F.count(F.lit(1)).alias("stock"), F.sum("revenue").alias("revenue"),
        F.sum("pipeline").alias("pipeline"))
    return kpi.parameterised(rows).select(
        "advisor", F.round("absorption", 6).alias("absorption"), F.round("commission", 4).alias("commission"),
        F.round("projected_revenue", 4).alias("projected_revenue"))


_SCEN = ", ".join(f"('{n}', {a}::DECIMAL(6,4), {b}::DECIMAL(6,4), {c}::DECIMAL(8,2))" for n, a, b, c in fv.SCENARIOS)


@query("scenario_projection", f"""
WITH v AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS visits FROM events WHERE event_type = 'view' GROUP BY 1),
s(scenario, capture, conversion, ticket) AS (VALUES {_SCEN})
SELECT day, scenario, visits::BIGINT AS visits, round(visits * capture, 4)::DOUBLE AS leads,
  round(visits * capture::DOUBLE * conversion::DOUBLE * ticket::DOUBLE, 4) AS income FROM v, s
""")
def scenario_projection(t: Tables):
    visits = t.events.where("event_type = 'view'").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("visits"))
    return kpi.scenario_projection(visits).select(
        "day", "scenario", "visits", F.col("leads").cast("double").alias("leads"),
        F.round(F.col("income").cast("double"), 4).alias("income"))


@query("traction_daily", """
WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS topic, count(*) AS interactions, sum(floor(value * 100)::BIGINT) AS views FROM events GROUP BY ALL)
SELECT topic, sum(views)::BIGINT AS views, sum(interactions)::BIGINT AS interactions, round(sum(interactions)::DOUBLE / sum(views), 8) AS interaction_rate,
 arg_max(day, (views, day)) AS peak_day, round(avg(views), 4) AS avg_daily_views FROM d GROUP BY topic
""")
def traction_daily(t: Tables):
    daily = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("topic")).agg(
        F.count(F.lit(1)).alias("interactions"), F.sum(F.floor(F.col("value") * 100)).alias("views"))
    return daily.groupBy("topic").agg(
        F.sum("views").alias("views"), F.sum("interactions").alias("interactions"),
        F.round(F.sum("interactions").cast("double") / F.sum("views"), 8).alias("interaction_rate"),
        F.max(F.struct("views", "day"))["day"].alias("peak_day"), F.round(F.avg("views"), 4).alias("avg_daily_views"))


@query("attribution", f"""WITH {_MILE},
d AS (SELECT user_id AS lead_id, count(*) FILTER (WHERE event_type = 'view') AS views, sum(CASE WHEN event_type = 'purchase' THEN floor(value * 100)::BIGINT ELSE 0 END) AS revenue,
 max(event_type) AS x FROM events GROUP BY user_id)
SELECT 'topic' || (lead_id % 6) AS topic, sum(views)::BIGINT AS views, count(lead_at)::BIGINT AS leads, count(meeting_at)::BIGINT AS qualified, count(close_at)::BIGINT AS sales,
 sum(revenue)::BIGINT AS revenue_cents, round(count(close_at)::DOUBLE / nullif(count(lead_at), 0), 6) AS conversion,
 round(avg(CASE WHEN responded_at >= lead_at THEN date_diff('microsecond', lead_at, responded_at) // 1000000 END), 4) AS avg_response_s
FROM m JOIN d USING (lead_id) GROUP BY 1
""")
def attribution(t: Tables):
    acts = activity(t)
    totals = acts.groupBy("lead_id").agg(
        F.count_if(F.col("activity") == "view").alias("views"),
        F.sum(F.when(F.col("activity") == "purchase", F.floor(F.col("value") * 100)).otherwise(0)).alias("revenue"))
    rows = milestones(t).join(totals, "lead_id")
    wait = F.when(F.col("responded_at") >= F.col("lead_at"), F.expr("timestampdiff(SECOND, lead_at, responded_at)"))
    return rows.groupBy(F.concat(F.lit("topic"), F.col("lead_id") % 6).alias("topic")).agg(
        F.sum("views").alias("views"), F.count("lead_at").alias("leads"), F.count("meeting_at").alias("qualified"),
        F.count("close_at").alias("sales"), F.sum("revenue").alias("revenue_cents"),
        F.round(F.try_divide(F.count("close_at").cast("double"), F.count("lead_at").cast("double")), 6).alias("conversion"),
        F.round(F.avg(wait), 4).alias("avg_response_s"))


# Customers play the leads: sold if an order of theirs is final. Clicks are what a campaign pays for.
_LEADS = """l AS (SELECT c_custkey, 'cmp' || (c_custkey % 8) AS campaign, c_mktsegment AS channel, coalesce(r, 0) AS revenue, r IS NOT NULL AS sold
 FROM customer LEFT JOIN (SELECT o_custkey, sum(round(o_totalprice * 100)::BIGINT) AS r FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey),
p AS (SELECT 'cmp' || (user_id % 9) AS campaign, sum(floor(value * 100)::BIGINT) AS spend FROM events WHERE event_type = 'click' GROUP BY 1)"""


def _leads(t: Tables):
    final = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("r"))
    return t.customer.join(final, "c_custkey", "left").select(
        F.concat(F.lit("cmp"), F.col("c_custkey") % 8).alias("campaign"), F.col("c_mktsegment").alias("channel"),
        F.coalesce("r", F.lit(0)).alias("revenue"), F.col("r").isNotNull().alias("sold"))


@query("campaign_returns", f"""WITH {_LEADS}, w AS (SELECT campaign, count(*) AS leads, count(*) FILTER (WHERE sold) AS sales, sum(revenue) AS revenue FROM l GROUP BY 1)
SELECT campaign, leads::BIGINT AS leads, sales::BIGINT AS sales, revenue::BIGINT AS revenue, spend::BIGINT AS spend, round(spend::DOUBLE / leads, 4) AS cost_per_lead,
 round(revenue::DOUBLE / leads, 4) AS revenue_per_lead, round(revenue::DOUBLE / spend, 6) AS return_on_spend FROM w FULL JOIN p USING (campaign)
""")
def campaign_returns(t: Tables):
    spend = t.events.where("event_type = 'click'").select(
        F.concat(F.lit("cmp"), F.col("user_id") % 9).alias("campaign"), F.floor(F.col("value") * 100).alias("spend"))
    out = kpi.campaign_returns(_leads(t), spend)
    return out.withColumns({c: F.round(c, n) for c, n in (("cost_per_lead", 4), ("revenue_per_lead", 4), ("return_on_spend", 6))})


@query("channel_conversion", f"""WITH {_LEADS}
SELECT channel, count(*)::BIGINT AS leads, count(*) FILTER (WHERE sold)::BIGINT AS sales, round(count(*) FILTER (WHERE sold)::DOUBLE / count(*), 6) AS conversion FROM l GROUP BY 1
""")
def channel_conversion(t: Tables):
    return kpi.channel_conversion(_leads(t)).withColumn("conversion", F.round("conversion", 6))


@query("content_traction", """
WITH e AS (SELECT 'topic' || (user_id % 6) AS topic, event_type AS k, floor(value * 100)::BIGINT AS views FROM events)
SELECT topic, sum(views)::BIGINT AS views, count(*)::BIGINT AS interactions, count(*) FILTER (WHERE k = 'click')::BIGINT AS comments,
 count(*) FILTER (WHERE k = 'purchase')::BIGINT AS shares, count(*) FILTER (WHERE k = 'signup')::BIGINT AS follows,
 round(count(*) FILTER (WHERE k = 'click')::DOUBLE / count(*), 6) AS comment_share FROM e GROUP BY 1
""")
def content_traction(t: Tables):
    """Clicks play the comments, purchases the shares, signups the follows."""
    kind = F.col("event_type")
    return t.events.groupBy(F.concat(F.lit("topic"), F.col("user_id") % 6).alias("topic")).agg(
        F.sum(F.floor(F.col("value") * 100)).alias("views"), F.count(F.lit(1)).alias("interactions"),
        F.count_if(kind == "click").alias("comments"), F.count_if(kind == "purchase").alias("shares"),
        F.count_if(kind == "signup").alias("follows"),
        F.round(F.count_if(kind == "click").cast("double") / F.count(F.lit(1)), 6).alias("comment_share"))


@query("team_targets", """
WITH r AS (SELECT 'adv' || (o_custkey % 40) AS advisor, 'team' || (o_custkey % 40 % 3) AS team, count(*) AS result FROM orders GROUP BY 1, 2),
g AS (SELECT 'adv' || (s_suppkey % 40) AS advisor, count(*) * 12 AS target FROM supplier WHERE s_suppkey % 40 < 35 GROUP BY 1),
b AS (SELECT * FROM r LEFT JOIN g USING (advisor))
SELECT team, advisor, result::BIGINT AS result, target::BIGINT AS target, (result - target)::BIGINT AS difference, false AS is_team FROM b
UNION ALL SELECT team, NULL, sum(result), sum(target), sum(result) - sum(target), true FROM b GROUP BY team
""")
def team_targets(t: Tables):
    advisor = lambda c: F.concat(F.lit("adv"), F.col(c) % 40).alias("advisor")
    results = t.orders.groupBy(advisor("o_custkey"), F.concat(F.lit("team"), F.col("o_custkey") % 40 % 3).alias("team")).agg(
        F.count(F.lit(1)).alias("result"))
    targets = t.supplier.where("s_suppkey % 40 < 35").groupBy(advisor("s_suppkey")).agg((F.count(F.lit(1)) * 12).alias("target"))
    return kpi.team_targets(results, targets, "team", "advisor")


@query("controls_by_user_and_source", """
WITH o AS (SELECT 'user' || (o_custkey % 25) AS u, c_mktsegment AS s FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT 'by_user' AS control, u AS bucket, count(*)::BIGINT AS n FROM o GROUP BY 2
UNION ALL SELECT 'by_source', s, count(*) FROM o GROUP BY 2
""")
def controls_by_user_and_source(t: Tables):
    counted = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))       # before the join: one row per customer
    rows = counted.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    marks = F.array(F.struct(F.lit("by_user").alias("control"), F.concat(F.lit("user"), F.col("o_custkey") % 25).alias("bucket")),
                    F.struct(F.lit("by_source").alias("control"), F.col("c_mktsegment").alias("bucket")))
    return rows.select("n", F.explode(marks).alias("m")).groupBy("m.control", "m.bucket").agg(F.sum("n").alias("n"))


@query("inbox_channels", """
WITH c AS (SELECT event_type AS channel, user_id AS chat, max(ts) AS last_at, count(*) AS n, arg_max(value, (ts, event_id)) > 100 AS is_open FROM events GROUP BY 1, 2)
SELECT channel, count(*)::BIGINT AS chats, count(*) FILTER (WHERE is_open)::BIGINT AS open_chats, sum(n)::BIGINT AS messages,
 strftime(max(last_at), '%Y-%m-%d %H:%M:%S') AS last_message_at FROM c GROUP BY 1
""")
def inbox_channels(t: Tables):
    """Chats by channel; one whose last message is a large one is open."""
    chats = t.events.groupBy(F.col("event_type").alias("channel"), "user_id").agg(
        F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("n"),
        (F.max_by("value", F.struct("ts", "event_id")) > 100).alias("open"))
    return chats.groupBy("channel").agg(
        F.count(F.lit(1)).alias("chats"), F.count_if("open").alias("open_chats"), F.sum("n").alias("messages"),
        F.date_format(F.max("last_at"), "yyyy-MM-dd HH:mm:ss").alias("last_message_at"))


@query("winner_rule", """
WITH p AS (SELECT user_id AS post_id, min(ts) AS posted_at FROM events GROUP BY 1),
s AS (SELECT post_id, sum(floor(value * 100)::BIGINT) AS views, count(*) AS interactions FROM events JOIN p ON post_id = user_id
  WHERE ts <= posted_at + INTERVAL 48 HOUR GROUP BY 1)
SELECT post_id, coalesce(views, 0)::BIGINT AS views, coalesce(interactions, 0)::BIGINT AS interactions,
 CASE WHEN views > 50000 OR interactions > 5000 THEN 'winner' ELSE 'other' END AS state FROM p LEFT JOIN s USING (post_id)
""")
def winner_rule(t: Tables):
    posts = t.events.groupBy(F.col("user_id").alias("post_id")).agg(F.min("ts").alias("posted_at"))
    measures = t.events.select(F.col("user_id").alias("post_id"), "ts", F.floor(F.col("value") * 100).alias("views"),
                               F.lit(1).alias("interactions"))
    return kpi.winners(posts, measures).select(
        "post_id", "views", "interactions", F.when(F.col("winner"), "winner").otherwise("other").alias("state"))


@query("followup_due", """
WITH l AS (SELECT user_id AS lead_id, max(ts) AS started_at FROM events WHERE event_type = 'signup' GROUP BY 1),
o AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 200)
SELECT lead_id, date_diff('day', started_at, TIMESTAMP '2024-01-31')::BIGINT AS day_number,
 CASE date_diff('day', started_at, TIMESTAMP '2024-01-31') WHEN 0 THEN 'entrega recurso o respuesta' WHEN 1 THEN 'pregunta de interes' WHEN 3 THEN 'recomendacion de ruta'
  WHEN 7 THEN 'invitacion a clase/oferta' WHEN 14 THEN 'cierre o opt-out' END AS step
FROM l WHERE lead_id NOT IN (SELECT user_id FROM o) AND date_diff('day', started_at, TIMESTAMP '2024-01-31') IN (0, 1, 3, 7, 14)
""")
def followup_due(t: Tables):
    leads = t.events.where("event_type = 'signup'").groupBy(F.col("user_id").alias("lead_id")).agg(F.max("ts").alias("started_at"))
    out = t.events.where("event_type = 'error' AND value > 200").select(F.col("user_id").alias("lead_id"))
    return kpi.followups_due(leads, out, F.expr("TIMESTAMP_NTZ'2024-01-31 00:00:00'")).withColumn(
        "day_number", F.col("day_number").cast("long"))


@query("crm_controls", """
SELECT 'by_status' AS control, o_orderstatus AS bucket, count(*)::BIGINT AS n FROM orders GROUP BY 2
UNION ALL SELECT 'by_priority', o_orderpriority, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'tasks', CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'overdue' ELSE 'open' END, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'leads_without_tasks', c_mktsegment, count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 2
""")
def crm_controls(t: Tables):
    """Control totals from one pass over orders, plus an anti join for leads without tasks."""
    task = (F.when(F.col("o_orderstatus") == "F", "done")
            .when(F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ'2000-01-01 00:00:00'"), "overdue").otherwise("open"))
    small = t.orders.groupBy("o_orderstatus", "o_orderpriority", task.alias("task")).agg(F.count(F.lit(1)).alias("n"))
    marks = F.array(*[F.struct(F.lit(name).alias("control"), F.col(c).alias("bucket")) for name, c in (
        ("by_status", "o_orderstatus"), ("by_priority", "o_orderpriority"), ("tasks", "task"))])
    totals = small.select("n", F.explode(marks).alias("m")).groupBy("m.control", "m.bucket").agg(F.sum("n").alias("n"))
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    idle = t.customer.join(urgent, "c_custkey", "left_anti").groupBy(F.col("c_mktsegment").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")).select(F.lit("leads_without_tasks").alias("control"), "bucket", "n")
    return totals.unionByName(idle)


@query("inbox_counters", """
WITH c AS (SELECT conv_id, max(turn) AS last_turn, arg_max(role, turn) AS last_role, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id, last_turn, last_role, n::BIGINT AS messages, CASE WHEN last_role = 'user' THEN 'open' ELSE 'answered' END AS state FROM c
""")
def inbox_counters(t: Tables):
    rows = t.conversations.groupBy("conv_id").agg(
        F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), F.count(F.lit(1)).alias("messages"))
    return rows.withColumn("state", F.when(F.col("last_role") == "user", "open").otherwise("answered"))
