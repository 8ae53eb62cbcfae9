"""Evidence about a cluster of reviews: density, synchrony, bursts, accounts, and the card that sums them up.

A cluster here is the reviews of one business, weighed against the backdrop of reviewer-day edges (a relation that
doesn't define the cluster).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators.behavior import Q, r6
from plumbline.operators.bursts import RZ, SPINE, ZS, participation
from plumbline.operators.facts import beside, sql
from plumbline.operators.relations import same_day

SIZE = 5  # least reviews of a cluster
CUTS = {"density": (2.0, 5.0), "burst": (1.0, 2.0), "single": (0.3, 0.7)}


def strength(v: Column, name: str) -> Column:
    low, high = CUTS[name]
    return F.when(v.isNull() | F.isnan(v), "no evidence").when(v < low, "weak").when(v < high, "moderate").otherwise("strong")


def cluster_edges(r: DataFrame) -> DataFrame:
    """(b, k, degree, inside): reviews of the business, their degrees in the backdrop, and directed edges that stay in it.

    The backdrop is a relation by key, so the edges inside are sums over (business, key) and no edge is made.
    """
    r = same_day(r)
    n = r.groupBy("b", "k_rud").agg(F.count(F.lit(1)).alias("c"))
    g = beside(n, "k_rud", F.sum("c").alias("all")).withColumn("d", F.col("c") * (F.col("all") - 1))
    return g.groupBy("b").agg(F.sum("c").alias("k"), F.sum("d").alias("degree"), F.sum(F.col("c") * (F.col("c") - 1)).alias("inside"))


def backdrop(r: DataFrame) -> DataFrame:
    g = same_day(r).groupBy("k_rud").agg(F.count(F.lit(1)).alias("c"))
    return F.broadcast(g.agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("nnz")))  # one row


def density(r: DataFrame) -> DataFrame:
    """(b, observed, expected, ratio, unstable): edges inside against the configuration model, (sum of degrees)^2 / 4m."""
    c = cluster_edges(r).filter(F.col("k") >= SIZE).crossJoin(backdrop(r))
    obs, exp = F.col("inside") / 2, F.try_divide(F.col("degree") * F.col("degree"), 2 * F.col("nnz"))
    return c.select("b", obs.alias("observed"), r6(exp).alias("expected"), r6(F.try_divide(obs, exp)).alias("ratio"), ((obs < 5) & (exp < 0.01)).cast("int").alias("unstable"))


def synchrony(r: DataFrame) -> DataFrame:
    """(b, synchrony): density of edges inside over density of all edges; null for a single review."""
    c = cluster_edges(r).crossJoin(backdrop(r))
    d = F.try_divide(F.col("inside"), F.col("k") * (F.col("k") - 1))
    return c.select("b", F.round(F.try_divide(d, F.col("nnz") / (F.col("n") * (F.col("n") - 1))), 4).alias("synchrony"))


def single_share(r: DataFrame) -> DataFrame:
    one = beside(r.select("b", "u"), "u", (F.count(F.lit(1)) == 1).cast("double").alias("one"))
    return one.groupBy("b").agg(F.count(F.lit(1)).alias("n_reviews"), F.count_distinct("u").alias("n_accounts"), r6(F.avg("one")).alias("single_share"))


def cards(r: DataFrame) -> DataFrame:
    """(b, card): the evidence of each cluster as text, a line a measure."""
    j = single_share(r).join(density(r), "b").join(participation(r), "b")
    line = lambda name, v, lab: F.concat(F.lit(name + ": "), F.when(v.isNull(), "n/a").otherwise(F.format_string("%.6f", v)), F.lit(" ("), lab, F.lit(")"))
    return j.select("b", F.concat_ws(
        "\n", F.concat(F.lit("reviews: "), F.col("n_reviews").cast("string"), F.lit(", accounts: "), F.col("n_accounts").cast("string")),
        line("density", F.col("ratio"), strength(F.col("ratio"), "density")), line("burst", F.col("max_z"), strength(F.col("max_z"), "burst")),
        line("single-review accounts", F.col("single_share"), strength(F.col("single_share"), "single")), F.lit("account level: not available"),
    ).alias("card"))


QUERIES = {"a20_density": Q(density), "a21_synchrony": Q(synchrony), "a23_single_reviews": Q(single_share), "k06_evidence_cards": Q(cards)}
_ST = lambda v, n: f"case when {v} is null then 'no evidence' when {v} < {CUTS[n][0]} then 'weak' when {v} < {CUTS[n][1]} then 'moderate' else 'strong' end"
_CE = "ce as (select b, sum(c)::bigint k, sum(d)::bigint degree, sum(c * (c - 1))::bigint inside from (select b, u, day, count(*) c, sum(deg) d from (select *, count(*) over (partition by u, day) - 1 deg from r) group by 1, 2, 3) group by 1)"
_BD = "bd as (select sum(c)::bigint n, sum(c * (c - 1))::bigint nnz from (select count(*) c from r group by u, day))"
_DE = "de as (select b, inside / 2 observed, round(degree * degree / nullif(2 * nnz, 0), 6) expected, round(inside / 2 / nullif(degree * degree / nullif(2 * nnz, 0), 0), 6) ratio, (inside / 2 < 5 and degree * degree / nullif(2 * nnz, 0) < 0.01)::int unstable from ce, bd where k >= 5)"
_SS = "ss as (select b, count(*) n_reviews, count(distinct u) n_accounts, round(avg(one), 6) single_share from (select *, (count(*) over (partition by u) = 1)::int one from r) group by b)"
_LN = lambda name, v, k: f"'{name}: ' || coalesce(printf('%.6f', {v}), 'n/a') || ' (' || {_ST(v, k)} || ')'"
SQL = {
    "a20_density": sql("select * from de", _CE, _BD, _DE),
    "a21_synchrony": sql("select b, round(inside / nullif(k * (k - 1), 0) / nullif(nnz / (n * (n - 1)), 0), 4) synchrony from ce, bd", _CE, _BD),
    "a23_single_reviews": sql("select * from ss", _SS),
    "k06_evidence_cards": sql(f"select b, 'reviews: ' || n_reviews || ', accounts: ' || n_accounts || chr(10) || {_LN('density', 'ratio', 'density')} || chr(10) || {_LN('burst', 'mz', 'burst')} || chr(10) || {_LN('single-review accounts', 'single_share', 'single')} || chr(10) || 'account level: not available' card from ss join de using (b) join (select b, round(max(z), 6) mz from rz group by b) using (b)", SPINE, ZS, RZ, _CE, _BD, _DE, _SS),
}
