"""Weekly bursts of a business: zero-filled counts, z-scores, peaks, campaigns."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.operators.behavior import Q, Q1, r6
from plumbline.operators.facts import sql
from plumbline.operators.prefix import quantiles
from plumbline.scratch import cut

THRESHOLD = 2.0


def weekly(r: DataFrame) -> DataFrame:
    """(b, week, n) of every week from first to last review of the business, without reviews 0."""
    n = r.groupBy("b", "week").agg(F.count(F.lit(1)).alias("n"))
    spine = n.groupBy("b").agg(F.min("week").alias("lo"), F.max("week").alias("hi")).select("b", F.explode(F.sequence("lo", "hi", F.expr("interval 7 days"))).alias("week"))
    return spine.join(n, ["b", "week"], "left").select("b", "week", F.coalesce("n", F.lit(0)).alias("n"))


def burst_z(r: DataFrame) -> DataFrame:
    """(b, week, n, z): population z-score over the weeks of the business, 0 where all are alike.

    The mean and deviation come from the active weeks and the number of weeks; the zero weeks need no rows for it.
    """
    n = r.groupBy("b", "week").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("b")
    weeks = F.datediff(F.max("week").over(w), F.min("week").over(w)) / 7 + 1
    n = n.select("b", "week", "n", (F.sum("n").over(w) / weeks).alias("m"), (F.sum(F.col("n") * F.col("n")).over(w) / weeks).alias("q"))
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("m") * F.col("m")))
    return n.select("b", "week", "n", F.when(sd < 1e-12, 0.0).otherwise((F.col("n") - F.col("m")) / sd).alias("z"))


def review_burst(r: DataFrame) -> DataFrame:
    """`r` with the z-score `z` of each review's business and week."""
    return r.join(burst_z(r).select("b", "week", "z"), ["b", "week"])


def peaks(r: DataFrame) -> DataFrame:
    """(b, peak_week, peak_z): the week of greatest z, the earliest of equals."""
    p = burst_z(r).groupBy("b").agg(F.min(F.struct((-F.round("z", 9)).alias("m"), "week")).alias("p"))
    return p.select("b", F.col("p.week").alias("peak_week"), r6(-F.col("p.m")).alias("peak_z"))


def campaigns(r: DataFrame) -> DataFrame:
    """(b, campaign): the first day on which a review of the business was filtered, standing in for a known campaign."""
    return r.filter("y = 1").groupBy("b").agg(F.min("day").alias("campaign"))


def proximity(r: DataFrame) -> DataFrame:
    """(review_id, proximity): minus the days to the campaign of the business; businesses without one are left out."""
    return r.join(campaigns(r), "b").select("review_id", (-F.abs(F.datediff("day", "campaign"))).alias("proximity"))


def peak_distance(r: DataFrame) -> DataFrame:
    return peaks(r).join(campaigns(r), "b").select("b", "peak_week", "campaign", F.datediff("peak_week", "campaign").alias("distance"))


def alignment(r: DataFrame) -> DataFrame:
    """(n_businesses, median_distance, within_30, within_90): how far peaks are from campaigns, in days."""
    d = cut(peak_distance(r).select(F.lit(0).alias("all"), F.abs("distance").alias("a")))
    share = lambda n: r6(F.avg(F.when(F.col("a") <= n, 1.0).otherwise(0.0)))
    mid = quantiles(d, ["all"], "a", [0.5]).select(F.col("v").alias("median_distance"))
    # One row each.
    return d.agg(F.count(F.lit(1)).alias("n_businesses"), share(30).alias("within_30"), share(90).alias("within_90")).join(mid, F.lit(True), "left")


def unavailable(r: DataFrame) -> DataFrame:
    """(relation, status, peak_week, peak_z): of graphs without times no burst can be told; typed, and empty of values."""
    null = lambda t, n: F.lit(None).cast(t).alias(n)
    rows = r.sparkSession.createDataFrame([("rur",), ("rsr",), ("rtr",)], "relation string")
    return rows.select("relation", F.lit("unavailable").alias("status"), null("date", "peak_week"), null("double", "peak_z"))


def coburst(r: DataFrame, threshold: float = THRESHOLD, with_rating: bool = False) -> DataFrame:
    """(review_id, grp): the week of the business in a burst (and the rating), else a group of its own."""
    stars = [(F.col("rating") * 10).cast("int")] if with_rating else []
    return review_burst(r).select("review_id", F.when(F.round("z", 9) >= threshold, F.concat_ws("|", "b", *stars, F.col("week").cast("string"))).otherwise(F.concat_ws("|", F.lit("alone"), "review_id")).alias("grp"))


def participation(r: DataFrame) -> DataFrame:
    """(b, mean_z, max_z, share_in_burst) over the reviews of a business."""
    return review_burst(r).groupBy("b").agg(
        r6(F.avg("z")).alias("mean_z"), r6(F.max("z")).alias("max_z"), r6(F.avg(F.when(F.round("z", 9) >= THRESHOLD, 1.0).otherwise(0.0))).alias("share_in_burst")
    )


QUERIES = {
    "j11_weekly_counts": Q1(weekly), "w06_burst_z": Q(lambda r: review_burst(r).select("review_id", r6("z").alias("z"))), "w07_peak_week": Q(peaks), "w09_campaign_proximity": Q(proximity),
    "g18_peak_distance": Q(peak_distance), "a13_alignment": Q(alignment), "g13_coburst": Q(coburst), "g13_coburst_rating": Q(lambda r: coburst(r, with_rating=True)),
    "a22_burst_participation": Q(participation), "a12_campaign_dates": Q1(campaigns),
    "g24_no_times": Q1(unavailable),
}
SPINE = "wk as (select s.b, s.week, coalesce(c.n, 0) n from (select b, unnest(generate_series(min(week)::timestamp, max(week)::timestamp, interval 7 day))::date as week from r group by b) s left join (select b, week, count(*) n from r group by 1, 2) c on c.b = s.b and c.week = s.week)"
ZS = "zs as (select b, week, n, case when stddev_pop(n) over (partition by b) < 1e-12 then 0 else (n - avg(n) over (partition by b)) / stddev_pop(n) over (partition by b) end z from wk)"
RZ = "rz as (select r.*, z from r join zs on zs.b = r.b and zs.week = r.week)"
_PK = "pk as (select b, week peak_week, round(z, 6) peak_z from (select *, row_number() over (partition by b order by round(z, 9) desc, week) i from zs where n > 0) where i = 1)"
_CA = "ca as (select b, min(day) campaign from r where y = 1 group by b)"
_D = "(select pk.b, peak_week, campaign, date_diff('day', campaign, peak_week) distance from pk join ca on ca.b = pk.b)"
SQL = {
    "j11_weekly_counts": sql("select * from wk", SPINE), "w06_burst_z": sql("select review_id, round(z, 6) z from rz", SPINE, ZS, RZ), "w07_peak_week": sql("select * from pk", SPINE, ZS, _PK),
    "w09_campaign_proximity": sql("select review_id, -abs(date_diff('day', campaign, day)) proximity from r join ca on ca.b = r.b", _CA),
    "g18_peak_distance": sql(f"select * from {_D}", SPINE, ZS, _PK, _CA),
    "a13_alignment": sql(f"select count(*) n_businesses, quantile_cont(abs(distance), 0.5) median_distance, round(avg((abs(distance) <= 30)::int), 6) within_30, round(avg((abs(distance) <= 90)::int), 6) within_90 from {_D}", SPINE, ZS, _PK, _CA),
    "g13_coburst": sql("select review_id, case when round(z, 9) >= 2 then b || '|' || week else 'alone|' || review_id end grp from rz", SPINE, ZS, RZ),
    "g13_coburst_rating": sql("select review_id, case when round(z, 9) >= 2 then b || '|' || (rating * 10)::int || '|' || week else 'alone|' || review_id end grp from rz", SPINE, ZS, RZ),
    "a22_burst_participation": sql("select b, round(avg(z), 6) mean_z, round(max(z), 6) max_z, round(avg((round(z, 9) >= 2)::int), 6) share_in_burst from rz group by b", SPINE, ZS, RZ),
    "a12_campaign_dates": sql("select * from ca", _CA),
    "g24_no_times": "select unnest(['rur', 'rsr', 'rtr']) relation, 'unavailable' status, null::date peak_week, null::double peak_z",
}
