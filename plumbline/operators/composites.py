"""Composite queries: bundles of signals, evaluations of peeling and sanity scores, the coded review bundle."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.operators.behavior import Q, r6
from plumbline.operators.bursts import RZ, SPINE, ZS, campaigns, review_burst
from plumbline.operators.evaluate import _metrics_sql, metrics, topk, unpivot
from plumbline.operators.facts import RELATIONS, beside, sql
from plumbline.operators.relations import LONG, LOO, SQL as RELATIONAL, _G, _ODD, degree, enrichment, loo, oddball, survival
from plumbline.scratch import cut
from plumbline.sources.writers import bundle


def graph_signals(r: DataFrame) -> DataFrame:
    """(review_id, loo_rur, loo_rsr, loo_rtr, burst): the four signals of a review side by side."""
    return loo(r).join(review_burst(r).select("review_id", F.col("z").alias("burst")), "review_id").select("review_id", *[r6(c).alias(c) for c in (*[f"loo_{x}" for x in RELATIONS], "burst")])


def peeling_quality(r: DataFrame) -> DataFrame:
    """Metrics of the order in which peeling removes reviews of the week relation."""
    s = survival(r).join(r.select("review_id", "y"), "review_id").select("review_id", "y", F.lit("rtr").alias("signal"), F.col("place").cast("double").alias("score"))
    return metrics(s, ["signal"])


def sanity(r: DataFrame) -> DataFrame:
    """AUC and AP of degree, burst and campaign proximity alone; businesses without a campaign are left out of the last."""
    x = degree(r).join(review_burst(r).select("review_id", "y", "b", "day", F.col("z").alias("burst")), "review_id").join(campaigns(r), "b", "left")
    x = x.withColumn("proximity", -F.abs(F.datediff("day", "campaign")))
    return metrics(unpivot(x, ["d_rtr", "burst", "proximity"], "y"), ["signal"]).select("signal", "n", "auc", "ap")


def coded_bundle(r: DataFrame) -> DataFrame:
    return bundle(r, beside(r.select("review_id", "u"), "u", F.count(F.lit(1)).alias("u_n")).select("review_id", "u_n"))


def community_quality(r: DataFrame) -> DataFrame:
    """(relation, auc, ap, hits, lift, testable, significant, fraud_captured) of the communities of each relation: how
    leave-one-out scores rank, what their top 5 % hold, and how many communities are enriched."""
    s = cut(unpivot(loo(r), [f"loo_{x}" for x in RELATIONS], "review_id", "y").withColumn("relation", F.substring("signal", 5, 3)).drop("signal"))
    m = metrics(s, ["relation"]).select("relation", "n", "auc", "ap")
    t = topk(s, ["relation"], (0.05,)).select("relation", "hits", "lift")
    return m.join(t, "relation").join(enrichment(r).drop("nodes_covered"), "relation", "left")  # three rows each


def oddball_quality(r: DataFrame) -> DataFrame:
    """Metrics and hits in the top 5 % of egonet scores per relation."""
    s = oddball(r).join(r.select("review_id", "y"), "review_id").withColumnRenamed("relation", "signal")
    t = topk(s, ["signal"], (0.05,)).select("signal", "k", "hits")
    return metrics(s, ["signal"]).select("signal", "n", "auc", "ap").join(t, "signal")


QUERIES = {
    "g17_graph_signals": Q(graph_signals), "g16_peeling_quality": Q(peeling_quality), "e19_sanity_scores": Q(sanity), "k03_coded_bundle": Q(coded_bundle), "g12_oddball_quality": Q(oddball_quality),
    "e18_community_quality": Q(community_quality),
}
_TOP5 = "(select {0}, sum(y)::bigint hits, any_value(k) k, round(sum(y) / any_value(k) / nullif(any_value(pos) / any_value(n), 0), 6) lift from (select *, greatest(1, round_even(n * 0.05, 0))::bigint k from (select *, row_number() over (partition by {0} order by score desc, review_id) i, count(*) over (partition by {0}) n, sum(y) over (partition by {0}) pos from {1})) where i <= k group by {0})"
SQL = {
    "e18_community_quality": sql(
        "select m.relation, m.n, auc, ap, hits, lift, testable, significant, fraud_captured from (" + _metrics_sql("q", "relation") + ") m join " + _TOP5.format("relation", "q") + " t using (relation) join (" + RELATIONAL["a17_enrichment"] + ") e using (relation)",
        LOO, "q as (unpivot (select review_id, y, " + ", ".join(f"round(loo_{x}, 9) {x}" for x in RELATIONS) + " from lo) on " + ", ".join(RELATIONS) + " into name relation value score)"),
    "g12_oddball_quality": sql(
        "select signal, m.n, auc, ap, t.k, hits from (" + _metrics_sql("q", "signal") + ") m join " + _TOP5.format("signal", "q") + " t using (signal)", LONG, _G, _ODD,
        "q as (select relation signal, lk.review_id, y, round(case when s > 1 then (greatest(ei, f) + 1e-6) / (least(ei, f) + 1e-6) * ln(abs(ei - f) + 1) else 0 end, 5) score from lk join od using (relation, k))"),
    "g17_graph_signals": sql("select review_id, " + ", ".join(f"round(loo_{x}, 6) loo_{x}" for x in RELATIONS) + ", round(z, 6) burst from lo join rz using (review_id)", LOO, SPINE, ZS, RZ),
    "g16_peeling_quality": sql(_metrics_sql("sv", "signal"), "sv as (select 'rtr' signal, y, row_number() over (order by s, review_id)::double score from (select review_id, y, count(*) over (partition by k_rtr) s from r))"),
    "e19_sanity_scores": sql("select signal, n, auc, ap from (" + _metrics_sql("sc", "signal") + ")", SPINE, ZS, RZ, "ca as (select b, min(day) campaign from r where y = 1 group by b)",
        "sc as (unpivot (select y, (count(*) over (partition by k_rtr) - 1)::double d_rtr, round(z, 9) burst, -abs(date_diff('day', campaign, day))::double proximity from rz left join ca on ca.b = rz.b) on d_rtr, burst, proximity into name signal value score)"),
    "k03_coded_bundle": sql("select review_id, dense_rank() over (order by u) - 1 u_code, dense_rank() over (order by b) - 1 b_code, rating::tinyint rating, date_diff('day', min(day) over (), day) date_days, y, count(*) over (partition by u) u_n from r"),
}
