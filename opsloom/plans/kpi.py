"""Sales funnel, marketing and management KPIs from activity, sales and ads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom import fixed_values as fv
from opsloom.operators import segmented
from opsloom.operators.ranking import competition_ranks


def ratio(a: str, b: str) -> Column:
    """Ratio of sums as a double; NULL when the divisor is zero."""
    return F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))


def month_of(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM")


def lead_milestones(activity: DataFrame, stages: dict[str, str]) -> DataFrame:
    """First time each lead reached each stage, one row per lead.

    ``stages`` maps a stage name to its activity. One aggregate, combined
    before the shuffle: a busy lead costs one row per task.
    """
    firsts = [
        F.min(F.when(F.col("activity") == kind, F.col("ts"))).alias(f"{stage}_at")
        for stage, kind in stages.items()
    ]
    return activity.groupBy("lead_id").agg(*firsts)


def funnel_counts(milestones: DataFrame, stages: Sequence[str], period: Column) -> DataFrame:
    """Leads that reached each stage, by the period their lead was created."""
    reached = [F.count(F.col(f"{stage}_at")).alias(stage) for stage in stages]
    return milestones.groupBy(period.alias("period")).agg(*reached)


FUNNEL_RATES = {
    "lead_to_meeting": ("meeting", "lead"), "meeting_to_close": ("close", "meeting"),
    "lead_to_close": ("close", "lead"), "responded_share": ("responded", "lead"),
    "lost_share": ("lost", "lead"),
}


def funnel_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns({name: ratio(a, b) for name, (a, b) in FUNNEL_RATES.items()})


def time_to_close(milestones: DataFrame) -> DataFrame:
    """Seconds from the lead to the first close at or after it."""
    return milestones.where("close_at >= lead_at").withColumn(
        "close_s", F.expr("timestampdiff(SECOND, lead_at, close_at)"))


def carried_field(activity: DataFrame, key: str, ts: str, tie: str, value: Column, out: str,
                  target_rows: int = 2_000_000) -> DataFrame:
    """Last known value of a changing field at each activity."""
    cut = segmented.with_segments(activity, [key], ts, "_seg", target_rows)
    return segmented.last_known(cut, [key], "_seg", [ts, tie], value, out).drop("_seg")


def with_totals(rows: DataFrame, period: str, member: str, sums: Sequence[str]) -> DataFrame:
    """Per member, team total per period and grand total in one rollup."""
    level = F.when(F.grouping_id() == 0, "member").when(F.grouping_id() == 1, "team").otherwise("all")
    return rows.rollup(period, member).agg(*[F.sum(c).alias(c) for c in sums], level.alias("level"))


TEAM_RATES = {
    "lead_to_meeting": ("meeting", "lead"), "meeting_to_visit": ("visit", "meeting"),
    "visit_to_close": ("close", "visit"), "lead_to_visit": ("visit", "lead"), "lead_to_close": ("close", "lead"),
}


def advisor_funnel(leads: DataFrame, period: str, member: str, stages: dict[str, Column],
                   sums: Sequence[str] = ()) -> DataFrame:
    """Funnel counts, sums and rates per member, per team and over all, in one rollup.

    ``stages`` maps a stage to the test a lead passes in it. Members are counted
    first, so the rollup expands totals and not leads. A lead without member is
    a member of its own, told from the team by ``level``.
    """
    counts = [F.count_if(test).alias(stage) for stage, test in stages.items()]
    per_member = leads.groupBy(period, member).agg(*counts, *[F.sum(c).alias(c) for c in sums])
    out = with_totals(per_member, period, member, [*stages, *sums])
    return out.withColumns({name: ratio(a, b) for name, (a, b) in TEAM_RATES.items()})


def dimension_ranking(rows: DataFrame, dimensions: Sequence[str], measure: str, parts: int = 64) -> DataFrame:
    """Rank the values of several dimensions, each on its own, by the sum of a measure.

    Rows are summed by all dimensions first; one row per dimension and value is ranked.
    """
    summed = rows.groupBy(*dimensions).agg(F.sum(measure).alias(measure))
    each = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    totals = summed.select(measure, F.inline(each)).groupBy("dimension", "value").agg(F.sum(measure).alias(measure))
    return ranking(totals, "dimension", measure, parts)


def ranking(totals: DataFrame, period: str, measure: str, parts: int = 64) -> DataFrame:
    """Spreadsheet-style ranks per period, best and worst first."""
    return competition_ranks(totals, period, measure, "rank_most", "rank_least", parts)


def target_difference(results: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    return results.join(targets, list(keys), "left").withColumn(
        "difference", F.col("result") - F.col("target"))


def team_targets(results: DataFrame, targets: DataFrame, team: str, member: str) -> DataFrame:
    """Result, target and difference of every member and of every team (member NULL), in one rollup.

    A team's target is the sum of its members'; members without a target count
    with their result alone.
    """
    both = results.join(targets, member, "left")
    return both.groupingSets([[team, member], [team]], team, member).agg(
        F.sum("result").alias("result"), F.sum("target").alias("target"),
        (F.grouping(member) == 1).alias("is_team")).withColumn("difference", F.col("result") - F.col("target"))


def campaign_returns(leads: DataFrame, spend: DataFrame) -> DataFrame:
    """Cost and revenue per lead of every campaign, with spend or leads alone too.

    ``leads`` has campaign, sold (boolean) and revenue; ``spend`` campaign and spend.
    """
    won = leads.groupBy("campaign").agg(
        F.count(F.lit(1)).alias("leads"), F.count_if("sold").alias("sales"), F.sum("revenue").alias("revenue"))
    paid = spend.groupBy("campaign").agg(F.sum("spend").alias("spend"))
    both = won.join(paid, "campaign", "full_outer")
    return both.withColumns({
        "cost_per_lead": F.try_divide(F.col("spend").cast("double"), F.col("leads").cast("double")),
        "revenue_per_lead": F.try_divide(F.col("revenue").cast("double"), F.col("leads").cast("double")),
        "return_on_spend": F.try_divide(F.col("revenue").cast("double"), F.col("spend").cast("double"))})


def channel_conversion(leads: DataFrame) -> DataFrame:
    """Leads, sales and their share for every channel."""
    return leads.groupBy("channel").agg(F.count(F.lit(1)).alias("leads"), F.count_if("sold").alias("sales")).withColumn(
        "conversion", F.col("sales") / F.col("leads"))


def ads_with_crm(ads: DataFrame, crm: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both sides kept: spend without leads and leads without spend."""
    return ads.join(crm, list(keys), "full_outer")


MARKETING_RATES = {
    "cpl": ("spend", "leads"), "cpc": ("spend", "clicks"), "ctr": ("clicks", "impressions"),
    "cost_per_meeting": ("spend", "meetings"),
}


def marketing_rates(rows: DataFrame) -> DataFrame:
    return rows.withColumns({name: ratio(a, b) for name, (a, b) in MARKETING_RATES.items()})


def finance(rows: DataFrame) -> DataFrame:
    """Average ticket, acquisition cost, return on spend, value per area unit."""
    spend = F.col("spend").cast("double")
    return rows.withColumns({
        "ticket": ratio("revenue", "closes"), "cac": ratio("spend", "closes"),
        "roi": F.try_divide(F.col("revenue").cast("double") - spend, spend),
        "value_per_area": ratio("revenue", "area"),
    })


def parameterised(rows: DataFrame, commission_rate: float = 0.03,
                  pipeline_weight: float = 0.25) -> DataFrame:
    """KPIs whose rule is ours to set: absorption, commission, projected revenue."""
    revenue = F.col("revenue").cast("double")
    return rows.withColumns({
        "absorption": ratio("units_sold", "stock"),
        "commission": revenue * commission_rate,
        "projected_revenue": revenue + F.col("pipeline").cast("double") * pipeline_weight,
    })


def scenario_projection(visits: DataFrame, scenarios: Sequence[tuple] = fv.SCENARIOS) -> DataFrame:
    """Leads and income per fixed scenario: visits x capture x conversion x ticket."""
    dec = lambda text, kind: F.lit(text).cast(kind)
    items = F.array(*[
        F.struct(F.lit(name).alias("scenario"), dec(cap, "decimal(6,4)").alias("capture"),
                 dec(conv, "decimal(6,4)").alias("conversion"), dec(ticket, "decimal(8,2)").alias("ticket"))
        for name, cap, conv, ticket in scenarios
    ])
    rows = visits.select("*", F.explode(items).alias("s")).select("*", "s.*").drop("s")
    leads = F.col("visits").cast("decimal(18,0)") * F.col("capture")
    return rows.withColumn("leads", leads).withColumn(
        "income", F.col("leads") * F.col("conversion") * F.col("ticket"))


def winners(posts: DataFrame, measures: DataFrame, hours: int = fv.WINNER_HOURS,
            views: int = fv.WINNER_VIEWS, interactions: int = fv.WINNER_INTERACTIONS) -> DataFrame:
    """Posts above a views or interactions bound within hours of posting.

    Measures are summed per post and time first, so a busy post moves one row
    for each time; early ones are then summed per post.
    """
    early = F.expr(f"ts <= posted_at + INTERVAL '{hours}' HOUR AND ts >= posted_at")
    each = measures.groupBy("post_id", "ts").agg(
        F.sum("views").alias("views"), F.sum("interactions").alias("interactions"))
    sums = (
        each.join(posts.select("post_id", "posted_at"), "post_id").where(early)
        .groupBy("post_id").agg(F.sum("views").alias("views"), F.sum("interactions").alias("interactions"))
    )
    v, i = F.coalesce("views", F.lit(0)), F.coalesce("interactions", F.lit(0))
    return posts.join(sums, "post_id", "left").select(
        "post_id", v.alias("views"), i.alias("interactions"),
        ((v > views) | (i > interactions)).alias("winner"))


def followups_due(leads: DataFrame, opted_out: DataFrame, on: Column,
                  steps: Sequence[tuple[int, str]] = fv.FOLLOWUP_STEPS) -> DataFrame:
    """The follow-up step due on a day, for leads that did not opt out."""
    days = F.expr("timestampdiff(DAY, date_trunc('DAY', started_at), _on)")
    due = None
    for day, text in steps:
        due = F.when(F.col("_d") == day, text) if due is None else due.when(F.col("_d") == day, text)
    return (
        leads.join(opted_out.select("lead_id").distinct(), "lead_id", "left_anti")
        .withColumn("_on", on).withColumn("_d", days)
        .select("lead_id", F.col("_d").alias("day_number"), due.alias("step"))
        .where("step IS NOT NULL")
    )
