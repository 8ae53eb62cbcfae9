"""Relations between reviews as grouping keys, community scores, neighbour aggregates and anomaly scores on them.

A relation that is a union of cliques is its key: sums per key, joined back, replace sums over neighbours, and no edge is
made. The union of all three relations has such a form too: reviews of one week, business and rating also share business
and rating, so it is the union of the reviewer's clique U and the clique S of business and rating, which meet in the
clique M of all three. What is summed over neighbours is U + S - M, and the greatest is that of U and S. `edges` makes the
pairs of a relation only where a query is about pairs.
"""
from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plumbline.operators.behavior import Q, Q1, r6
from plumbline.operators.components import components
from plumbline.operators.facts import RELATIONS, beside, facts, sql
from plumbline.operators.prefix import quantiles
from plumbline.scratch import cut, numbered

KEYS = [f"k_{x}" for x in RELATIONS]


def long_keys(r: DataFrame, *more: str) -> DataFrame:
    """(relation, k, review_id, *more): one row per review and relation."""
    pairs = F.array(*[F.struct(F.lit(x).alias("relation"), F.col(f"k_{x}").alias("k")) for x in RELATIONS])
    return r.select("review_id", *more, F.explode(pairs).alias("p")).select("p.*", "review_id", *more)


def communities(r: DataFrame) -> DataFrame:
    """(review_id, c_*): the community of a review in each relation, named by its least review."""
    x = r.select("review_id", *KEYS)
    for k in KEYS:
        x = x.join(r.groupBy(k).agg(F.min("review_id").alias("c_" + k[2:])), k)
    return x.drop(*KEYS)


def labels(r: DataFrame, k: str = "k_rtr") -> DataFrame:
    """(review_id, label): communities as numbers from 0 in the order of their least review; a review without one fails."""
    c = r.select("review_id", k).join(r.groupBy(k).agg(F.min("review_id").alias("c")), k, "left")
    code = numbered(c.select("c").filter("c is not null").distinct(), ["c"], "n")
    return c.join(code, "c", "left").select("review_id", F.when(F.col("n").isNull(), F.raise_error(F.lit("a review has no community"))).otherwise(F.col("n") - 1).cast("bigint").alias("label"))


def group_sizes(r: DataFrame) -> DataFrame:
    g = cut(long_keys(r).groupBy("relation", "k").agg(F.count(F.lit(1)).alias("s")))
    mid = quantiles(g, ["relation"], "s", [0.5]).select("relation", F.col("v").alias("median_size"))  # three rows
    return g.groupBy("relation").agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("s") * (F.col("s") - 1)).alias("n_edges"), F.max("s").alias("max_size"),
        r6(F.avg((F.col("s") == 1).cast("double"))).alias("singleton_share"),
    ).join(mid, "relation")


def degree(r: DataFrame) -> DataFrame:
    x = r.select("review_id", *KEYS)
    for k in KEYS:
        x = x.join(r.groupBy(k).agg((F.count(F.lit(1)) - 1).alias("d_" + k[2:])), k)
    return x.drop(*KEYS)


def base_rate(r: DataFrame) -> DataFrame:
    return F.broadcast(r.agg(F.avg("y").alias("base")))  # one row


def loo(r: DataFrame) -> DataFrame:
    """(review_id, y, loo_*): share of fakes among the others of the group; alone, the base rate."""
    x, out = r.select("review_id", "y", *KEYS), []
    for k in KEYS:
        x = x.join(r.groupBy(k).agg(F.count(F.lit(1)).alias(f"n_{k}"), F.sum("y").alias(f"s_{k}")), k)
        n = F.col(f"n_{k}")
        out.append(F.when(n > 1, (F.col(f"s_{k}") - F.col("y")) / (n - 1)).otherwise(F.col("base")).alias("loo_" + k[2:]))
    return x.crossJoin(base_rate(r)).select("review_id", "y", *out)


def in_train(r: DataFrame, share: float = 0.7) -> Column:
    """Whether a review is a training row, by the first 8 digits of the MD5 of its id."""
    return F.conv(F.substring(F.md5(F.col("review_id").cast("string")), 1, 8), 16, 10).cast("double") / 2**32 < share


def loo_train(r: DataFrame) -> DataFrame:
    """(review_id, train, loo_*): as `loo`, but only labels of training rows are seen; a training row leaves itself out."""
    r = r.withColumn("train", in_train(r).cast("int")).withColumn("ty", F.col("train") * F.col("y"))
    base = F.broadcast(r.filter("train = 1").agg(F.avg("y").alias("base")))  # one row
    x, out = r.select("review_id", "train", "ty", *KEYS), []
    for k in KEYS:
        x = x.join(r.groupBy(k).agg(F.sum("train").alias(f"n_{k}"), F.sum("ty").alias(f"s_{k}")), k)
        n, t = F.col(f"n_{k}") - F.col("train"), F.col(f"s_{k}") - F.col("ty")
        out.append(F.when(n > 0, t / n).otherwise(F.col("base")).alias("loo_" + k[2:]))
    return x.crossJoin(base).select("review_id", "train", *out)


def neighbors(r: DataFrame, k: str, cols: tuple[str, ...]) -> DataFrame:
    """(review_id, group_size, {c}_mean_loo, _std_loo, _max_loo, _deviation) of the others in the group; null if alone.

    One shuffle on the key: sums, sums of squares, and the greatest two values with how often the greatest occurs.
    """
    g = r.groupBy(k).agg(
        F.count(F.lit(1)).alias("group_size"),
        *[x for c in cols for x in (F.sum(c).alias(f"{c}_s"), F.sum(F.col(c) * F.col(c)).alias(f"{c}_q"), F.max(c).alias(f"{c}_m"))],
    )
    j = r.select("review_id", k, *cols).join(g, k)
    seconds = j.groupBy(k).agg(*[x for c in cols for x in (F.max(F.when(F.col(c) < F.col(f"{c}_m"), F.col(c))).alias(f"{c}_2"), F.count(F.when(F.col(c) == F.col(f"{c}_m"), 1)).alias(f"{c}_k"))])
    j = j.join(seconds, k)
    n, out = F.col("group_size") - 1, []
    for c in cols:
        x = F.col(c)
        mean = F.when(n > 0, (F.col(f"{c}_s") - x) / n)
        var = F.when(n > 0, F.greatest(F.lit(0.0), (F.col(f"{c}_q") - x * x) / n - mean * mean))
        top = F.when(n > 0, F.when((x == F.col(f"{c}_m")) & (F.col(f"{c}_k") == 1), F.col(f"{c}_2")).otherwise(F.col(f"{c}_m")))
        out += [r6(mean).alias(f"{c}_mean_loo"), F.round(F.sqrt(var), 5).alias(f"{c}_std_loo"), r6(top).alias(f"{c}_max_loo"), r6(x - mean).alias(f"{c}_deviation")]
    return j.select("review_id", "group_size", *out)


def laplacian(r: DataFrame, ks: list[str], hs: list[str]) -> DataFrame:
    """(review_id, hs..., {relation}_{h}_l): h less the mean of its group, itself included, of each relation and column."""
    x = r.select("review_id", *hs, *ks)
    for k in ks:
        x = x.join(r.groupBy(k).agg(*[F.avg(h).alias(f"_{h}") for h in hs]), k)
        x = x.withColumns({f"{k[2:]}_{h}_l": F.col(h) - F.col(f"_{h}") for h in hs}).drop(*[f"_{h}" for h in hs])
    return x.drop(*ks)


def beta_thetas(d: int) -> list[list[float]]:
    """theta[p][k] of the beta wavelets of order d: coefficients of L^k in filter p."""
    return [
        [math.comb(d - p, k - p) * (-1) ** (k - p) / (2**k) * (math.factorial(d + 1) / (math.factorial(p) * math.factorial(d - p))) if k >= p else 0.0 for k in range(d + 1)]
        for p in range(d + 1)
    ]


def wavelets(r: DataFrame, ks: list[str], hs: list[str], d: int = 2) -> DataFrame:
    """(review_id, {relation}_{h}_w0..wd, {relation}_{h}_low): beta wavelets of order d and the low-pass (I - L/2)^d.

    On cliques L is a projector, so L^k h = L h for every k >= 1, and one mean per group does for all orders.
    """
    x, out = laplacian(r, ks, hs), []
    for k in ks:
        for h in hs:
            own, lh = F.col(h).cast("double"), F.col(f"{k[2:]}_{h}_l")
            out += [(t[0] * own + sum(t[1:]) * lh).alias(f"{k[2:]}_{h}_w{p}") for p, t in enumerate(beta_thetas(d))]
            out.append((own - (1 - 0.5**d) * lh).alias(f"{k[2:]}_{h}_low"))
    return x.select("review_id", *out)


def oddball(r: DataFrame) -> DataFrame:
    """(relation, review_id, ni, ei, score): egonets of cliques depend on the group's size alone; fit over ni > 1."""
    g = long_keys(r).groupBy("relation", "k").agg(F.count(F.lit(1)).alias("s"))
    g = g.select("relation", "k", "s", (F.col("s") * (F.col("s") - 1) / 2).alias("ei"))
    fit = (
        g.filter("s > 1").groupBy("relation", "s", "ei").agg(F.sum("s").alias("w"))  # reviews per size: few rows
        .groupBy("relation").agg(
            F.sum("w").alias("n"), F.sum(F.col("w") * F.ln("s")).alias("sx"), F.sum(F.col("w") * F.ln("ei")).alias("sy"),
            F.sum(F.col("w") * F.ln("s") * F.ln("s")).alias("sxx"), F.sum(F.col("w") * F.ln("s") * F.ln("ei")).alias("sxy"),
        )
        .withColumn("theta", F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")))
        .select("relation", "theta", ((F.col("sy") - F.col("theta") * F.col("sx")) / F.col("n")).alias("c"))
    )
    e = g.join(F.broadcast(fit), "relation", "left")  # three rows
    fitted = F.exp(F.col("c") + F.col("theta") * F.ln("s"))
    score = (F.greatest("ei", fitted) + 1e-6) / (F.least(F.col("ei"), fitted) + 1e-6) * F.ln(F.abs(F.col("ei") - fitted) + 1)
    e = e.select("relation", "k", F.col("s").alias("ni"), F.col("ei").cast("bigint").alias("ei"), F.round(F.when(F.col("s") > 1, F.coalesce(score, F.lit(0.0))).otherwise(0.0), 5).alias("score"))
    return long_keys(r).join(e, ["relation", "k"]).select("relation", "review_id", "ni", "ei", "score")


def fraudar(r: DataFrame) -> DataFrame:
    """Closed form of greedy peeling on cliques: (relation, max_density, detected, full_density)."""
    g = long_keys(r).groupBy("relation", "k").agg(F.count(F.lit(1)).alias("s"))
    top = F.max("s").over(Window.partitionBy("relation"))
    by = g.groupBy("relation", "s").agg(F.count(F.lit(1)).alias("c")).withColumn("top", top)  # a row per size
    return by.groupBy("relation").agg(
        F.max((F.col("top") - 1) / 2).alias("max_density"), F.sum(F.when(F.col("s") == F.col("top"), F.col("s") * F.col("c"))).alias("detected"),
        r6(F.sum(F.col("c") * F.col("s") * (F.col("s") - 1) / 2) / F.sum(F.col("c") * F.col("s"))).alias("full_density"),
    )


def survival(r: DataFrame, k: str = "k_rtr") -> DataFrame:
    """(review_id, place): the order in which greedy peeling removes reviews of cliques: by size, then id."""
    s = beside(r.select("review_id", k), k, F.count(F.lit(1)).alias("s")).select("review_id", "s")
    return numbered(s, ["s", "review_id"], "place").select("review_id", "place")


def same_day(r: DataFrame) -> DataFrame:
    return r.withColumn("k_rud", F.concat_ws("|", "u", F.col("day").cast("string")))


BLOCK = 1000


def edges(r: DataFrame, k: str) -> DataFrame:
    """Distinct (src, dst), src < dst, of reviews with the same key.

    A group is cut into blocks of about BLOCK rows by a hash, and each pair of its blocks is a join key of its own, so
    that no task holds a whole group. The pairs themselves are what is asked for: as many as the group has.
    """
    x = beside(r.select("review_id", k), k, F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb"))
    x = x.select(k, "nb", "review_id", F.pmod(F.xxhash64("review_id"), F.col("nb")).cast("int").alias("blk"))
    a = x.select(k, F.col("review_id").alias("src"), F.col("blk").alias("i"), F.explode(F.sequence("blk", F.col("nb") - 1)).alias("j"))
    b = x.select(k, F.col("review_id").alias("dst"), F.col("blk").alias("j"), F.explode(F.sequence(F.lit(0), "blk")).alias("i"))
    p = a.join(b, [k, "i", "j"]).filter((F.col("i") < F.col("j")) & (F.col("src") != F.col("dst")) | (F.col("src") < F.col("dst")))
    return p.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def both_keys(r: DataFrame) -> DataFrame:
    """`r` with k_m, the key of what the cliques of reviewer and of business and rating have in common."""
    return r.withColumn("k_m", F.concat_ws("|", "k_rur", "k_rsr"))


def union_edges(r: DataFrame) -> DataFrame:
    """Distinct (src, dst) of the union of the three relations, that of the reviewer's and of business and rating."""
    return edges(r, "k_rur").unionByName(edges(r, "k_rsr")).distinct()


def union_counts(r: DataFrame) -> DataFrame:
    """(review_id, u_n, s_n, m_n, degree) in the union of the three relations: sizes of the cliques and their union."""
    r = both_keys(r)
    x = r.select("review_id", "k_rur", "k_rsr", "k_m")
    for k, n in (("k_rur", "u_n"), ("k_rsr", "s_n"), ("k_m", "m_n")):
        x = x.join(r.groupBy(k).agg(F.count(F.lit(1)).alias(n)), k)
    return x.select("review_id", "u_n", "s_n", "m_n", (F.col("u_n") + F.col("s_n") - F.col("m_n") - 1).alias("degree"))


def union_degrees(r: DataFrame) -> DataFrame:
    """(review_id, degree) of the union by OR of the three relations, without its edges."""
    return union_counts(r).select("review_id", "degree")


def weighted_degrees(r: DataFrame) -> DataFrame:
    """(review_id, strength) of the weighted union: each relation's edges weigh one over the number of its entries."""
    d = cut(degree(r))
    t = F.broadcast(d.agg(*[F.sum(f"d_{x}").alias(f"t_{x}") for x in RELATIONS]))  # one row
    parts = [F.coalesce(F.try_divide(f"d_{x}", f"t_{x}"), F.lit(0.0)) for x in RELATIONS]
    return d.crossJoin(t).select("review_id", F.round(sum(parts[1:], parts[0]), 9).alias("strength"))


def union_neighbors(r: DataFrame, h: str) -> DataFrame:
    """(review_id, group_size, mean_loo, std_loo, max_loo, deviation) of h over the neighbours in the union."""
    r = both_keys(r.withColumn("h", F.col(h).cast("double")))
    x = r.select("review_id", "h", "k_rur", "k_rsr", "k_m")
    for k in ("k_rur", "k_rsr", "k_m"):
        sums = [F.count(F.lit(1)).alias(f"{k}_n"), F.sum("h").alias(f"{k}_s"), F.sum(F.col("h") * F.col("h")).alias(f"{k}_q")]
        x = x.join(r.groupBy(k).agg(*sums, F.max(F.struct("h", "review_id")).alias(f"{k}_t")), k)
    # The greatest of the others: of the group, unless it is the review's own; then the second, from the rest of the group.
    for k in ("k_rur", "k_rsr"):
        rest = x.filter(F.col("review_id") != F.col(f"{k}_t.review_id")).groupBy(k).agg(F.max("h").alias(f"{k}_2"))
        x = x.join(rest, k, "left")
    of = lambda c: F.col(f"k_rur_{c}") + F.col(f"k_rsr_{c}") - F.col(f"k_m_{c}")
    n, h_ = of("n") - 1, F.col("h")
    mean = F.when(n > 0, (of("s") - h_) / n)
    var = F.greatest(F.lit(0.0), (of("q") - h_ * h_) / n - mean * mean)
    top = F.greatest(*[F.when(F.col("review_id") == F.col(f"{k}_t.review_id"), F.col(f"{k}_2")).otherwise(F.col(f"{k}_t.h")) for k in ("k_rur", "k_rsr")])
    return x.select("review_id", (n + 1).alias("group_size"), r6(mean).alias("mean_loo"), F.when(n > 0, F.round(F.sqrt(var), 5)).alias("std_loo"), F.when(n > 0, r6(top)).alias("max_loo"), r6(h_ - mean).alias("deviation"))


def union_egonets(r: DataFrame) -> DataFrame:
    """(review_id, ni, ei) in the union: a neighbour by reviewer and one by business and rating are never joined unless
    both are both, so the edges of an egonet are those of the two cliques less those they share."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    c = union_counts(r).filter("degree > 0")
    return c.select("review_id", (F.col("degree") + 1).alias("ni"), (two("u_n") + two("s_n") - two("m_n")).cast("bigint").alias("ei"))


def union_laplacian(r: DataFrame, h: str) -> DataFrame:
    """(review_id, lx): x - D^-1/2 (A + I) D^-1/2 x on the union, with degrees that count the loop."""
    x = both_keys(r.join(union_degrees(r), "review_id").withColumn("d", F.col("degree") + 1).withColumn("v", F.col(h) / F.sqrt("d")))
    x = cut(x.select("review_id", F.col(h).alias("x"), "d", "v", "k_rur", "k_rsr", "k_m"))
    y = x
    for k in ("k_rur", "k_rsr", "k_m"):
        y = y.join(x.groupBy(k).agg(F.sum("v").alias(f"{k}_v")), k)
    s = F.col("k_rur_v") + F.col("k_rsr_v") - F.col("k_m_v")  # the loop stands in all three
    return y.select("review_id", r6(F.col("x") - s / F.sqrt("d")).alias("lx"))


def verify_union(r: DataFrame) -> DataFrame:
    """(n_nodes, n_mismatched, mismatch_share) of the union: reviews whose degree isn't the size of their component less one."""
    c = cut(union_components(r))
    j = union_degrees(r).filter("degree > 0").join(beside(c, "component", F.count(F.lit(1)).alias("s")), "review_id")
    bad = (F.col("degree") != F.col("s") - 1).cast("int")
    return j.agg(F.count(F.lit(1)).alias("n_nodes"), F.coalesce(F.sum(bad), F.lit(0)).cast("bigint").alias("n_mismatched"), r6(F.avg(bad)).alias("mismatch_share"))


def weighted_union(r: DataFrame) -> DataFrame:
    """(src, dst, weight): each relation weighs one over its number of (directed) edges."""
    parts = None
    for k in KEYS:
        e = edges(r, k)
        w = r.groupBy(k).agg(F.count(F.lit(1)).alias("s")).agg((1.0 / F.nullif(F.sum(F.col("s") * (F.col("s") - 1)), F.lit(0))).alias("w"))  # one row
        e = e.crossJoin(F.broadcast(w))
        parts = e if parts is None else parts.unionByName(e)
    return parts.groupBy("src", "dst").agg(F.sum("w").alias("weight"))


def both_ways(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def neighbors_on_edges(e: DataFrame, x: DataFrame) -> DataFrame:
    """(review_id, group_size, mean_loo, std_loo, max_loo, deviation) of x (review_id, x) over the neighbours in `e`."""
    n = both_ways(e).join(x.select(F.col("review_id").alias("dst"), F.col("x").alias("v")), "dst").groupBy("src").agg(
        F.count(F.lit(1)).alias("d"), F.avg("v").alias("m"), F.avg(F.col("v") * F.col("v")).alias("q"), F.max("v").alias("mx")
    )
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("m") * F.col("m")))
    return x.join(n, x["review_id"] == n["src"], "left").select(
        "review_id", (F.coalesce("d", F.lit(0)) + 1).alias("group_size"), r6("m").alias("mean_loo"), F.when(F.col("m").isNotNull(), F.round(sd, 5)).alias("std_loo"), r6("mx").alias("max_loo"), r6(F.col("x") - F.col("m")).alias("deviation")
    )


def egonets(e: DataFrame) -> DataFrame:
    """(review_id, ni, ei): nodes and edges of the egonet. Edges run from lower to higher degree before triangles are
    closed, so that a hub has few outgoing ones."""
    e = cut(e)
    deg = both_ways(e).groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    o = e.join(deg.select("src", F.col("d").alias("ds")), "src").join(deg.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    o = cut(o.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b")))
    two = o.join(o.select("a", F.col("b").alias("c")), "a").filter("b < c")
    closed = two.join(e.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"])
    t = closed.select(F.explode(F.array("a", "b", "c")).alias("src")).groupBy("src").agg(F.count(F.lit(1)).alias("t"))
    return deg.join(t, "src", "left").select(F.col("src").alias("review_id"), (F.col("d") + 1).alias("ni"), (F.col("d") + F.coalesce("t", F.lit(0))).alias("ei"))


def normal_laplacian(e: DataFrame, x: DataFrame) -> DataFrame:
    """(review_id, lx): x - D^-1/2 (A + I) D^-1/2 x with degrees that count the loop."""
    b = both_ways(e)
    d = x.join(b.groupBy("src").agg(F.count(F.lit(1)).alias("d")), x["review_id"] == F.col("src"), "left").select("review_id", "x", (F.coalesce("d", F.lit(0)) + 1).alias("d"))
    s = b.join(d.select(F.col("review_id").alias("dst"), (F.col("x") / F.sqrt("d")).alias("v")), "dst").groupBy("src").agg(F.sum("v").alias("v"))
    return d.join(s, d["review_id"] == s["src"], "left").select("review_id", r6(F.col("x") - F.col("x") / F.col("d") - F.coalesce("v", F.lit(0.0)) / F.sqrt("d")).alias("lx"))


def verify_cliques(e: DataFrame) -> DataFrame:
    """(n_nodes, n_mismatched, mismatch_share): nodes whose degree isn't the size of their component less one."""
    e = cut(e)
    comp = components(e)
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("s"))
    deg = both_ways(e).groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    j = comp.join(size, "component").join(deg, comp["node"] == deg["src"])
    bad = (F.col("d") != F.col("s") - 1).cast("int")
    return j.agg(F.count(F.lit(1)).alias("n_nodes"), F.coalesce(F.sum(bad), F.lit(0)).cast("bigint").alias("n_mismatched"), r6(F.avg(bad)).alias("mismatch_share"))


def union_components(r: DataFrame) -> DataFrame:
    """(review_id, component) in the union of the three relations, by edges between reviews and their keys."""
    node = F.xxhash64("relation", "k").bitwiseOR(F.lit(1))  # odd; reviews are even
    c = components(long_keys(r).select((F.col("review_id") * 2).alias("src"), node.alias("dst")).distinct())
    c = c.filter(F.col("node").bitwiseAND(F.lit(1)) == 0).select(F.shiftright("node", 1).alias("review_id"), "component")
    return c.join(c.groupBy("component").agg(F.min("review_id").alias("least")), "component").select("review_id", F.col("least").alias("component"))


def codes(r: DataFrame) -> DataFrame:
    """(b, code, first_code): dense codes by value, and by the first review."""
    x = r.groupBy("b").agg(F.min("review_id").alias("f"))
    return numbered(numbered(x, ["b"], "code"), ["f"], "first_code").select("b", (F.col("code") - 1).alias("code"), (F.col("first_code") - 1).alias("first_code"))


def projected(r: DataFrame) -> DataFrame:
    """(relation, n_communities, n_labelled): communities over all reviews that hold a labelled one, and those rows."""
    g = long_keys(r, "y").groupBy("relation", "k").agg(F.count("y").alias("n")).filter("n > 0")
    return g.groupBy("relation").agg(F.count(F.lit(1)).alias("n_communities"), F.sum("n").alias("n_labelled"))


def _tail(pop: int, pos: int, n: int, hits: int) -> float:
    """P(X >= hits) of n draws from pop with pos of a kind; sums from the near side of the tail while terms matter."""
    lo, hi = max(0, n - (pop - pos)), min(n, pos)
    if hits <= lo:
        return 1.0
    if hits > hi:
        return 0.0
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    up = hits >= n * pos / pop  # above the mean terms fall from `hits` on; below it those of the other side do
    at, step = (hits, 1) if up else (hits - 1, -1)
    term = math.exp(choose(pos, at) + choose(pop - pos, n - at) - choose(pop, n))
    total = 0.0
    while lo <= at <= hi and term > total * 1e-17:
        total += term
        up_by = (pos - at) * (n - at) / ((at + 1) * (pop - pos - n + at + 1)) if step > 0 else at * (pop - pos - n + at) / ((pos - at + 1) * (n - at + 1))
        term *= up_by
        at += step
    return total if up else 1.0 - total


@F.pandas_udf(T.DoubleType())
def _tails(pop: pd.Series, pos: pd.Series, n: pd.Series, hits: pd.Series) -> pd.Series:
    return pd.Series([_tail(*map(int, x)) for x in zip(pop, pos, n, hits)], dtype="float64")


def enrichment(r: DataFrame, alpha: float = 0.01) -> DataFrame:
    """(relation, testable, significant, fraud_captured, nodes_covered): hypergeometric P(X >= k) per community of two or
    more, against alpha over the number of tests. Communities of one size and count share their test."""
    g = long_keys(r, "y").groupBy("relation", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits")).filter("n > 1")
    g = g.groupBy("relation", "n", "hits").agg(F.count(F.lit(1)).alias("c"))
    g = g.crossJoin(F.broadcast(r.agg(F.count(F.lit(1)).alias("pop"), F.sum("y").alias("pos"))))  # one row
    g = g.withColumn("p", _tails("pop", "pos", "n", "hits"))
    tests = F.sum("c").over(Window.partitionBy("relation"))  # a row per size and count
    sig = F.col("p") < alpha / F.col("tests")
    zero = lambda c: F.coalesce(F.sum(F.when(sig, c)), F.lit(0)).cast("bigint")
    return g.withColumn("tests", tests).groupBy("relation").agg(
        F.sum("c").alias("testable"), zero(F.col("c")).alias("significant"), zero(F.col("c") * F.col("hits")).alias("fraud_captured"), zero(F.col("c") * F.col("n")).alias("nodes_covered")
    )


_x = lambda r: r.select("review_id", F.col("rating").alias("x"))
_aged = lambda r: r.withColumn("age", F.datediff("day", F.lit("2019-01-01").cast("date")).cast("double"))
_six = lambda df: df.select("review_id", *[r6(c).alias(c) for c in df.columns if c != "review_id"])
_rounded = lambda df: df.select(*[r6(c).alias(c) if c.startswith("loo_") else c for c in df.columns])
QUERIES = {
    "g02_relation_keys": Q1(lambda r: r.select("review_id", *KEYS)), "g03_communities": Q(communities), "a16_group_sizes": Q1(group_sizes), "a16_degree": Q(degree),
    "w08_loo_scores": Q(lambda r: _rounded(loo(r))), "w10_loo_train_only": Q(lambda r: _rounded(loo_train(r))),
    "w11_neighbors_business_rating": Q(lambda r: neighbors(_aged(r), "k_rsr", ("rating", "age"))), "w11_neighbors_reviewer": Q(lambda r: neighbors(_aged(r), "k_rur", ("rating", "age"))),
    "w12_group_laplacian": Q(lambda r: _six(laplacian(_aged(r), KEYS, ["rating", "age"]))), "g22_beta_wavelets": Q(lambda r: _six(wavelets(_aged(r), KEYS, ["rating", "age"]))),
    "g06_labels": Q(labels),
    "g12_oddball": Q(oddball), "g15_fraudar_cliques": Q1(fraudar), "t02_survival_order": Q(survival), "j12_edges_week": Q(lambda r: edges(r, "k_rtr")), "u06_union_degrees": Q(union_degrees),
    "u07_weighted_union": Q(weighted_degrees), "g10_union_neighbors": Q(lambda r: union_neighbors(r, "rating")), "g11_union_egonets": Q(union_egonets), "g21_normal_laplacian": Q(lambda r: union_laplacian(r, "rating")),
    "g10_neighbors_on_edges": Q(lambda r: neighbors_on_edges(edges(r, "k_rtr"), _x(r))), "g11_egonets": Q(lambda r: egonets(edges(r, "k_rtr"))), "g21_laplacian_on_edges": Q(lambda r: normal_laplacian(edges(r, "k_rtr"), _x(r))), "g09_verify_cliques": Q(lambda r: verify_cliques(edges(r, "k_rtr"))),
    "g09_verify_union": Q(verify_union), "g08_union_components": Q(union_components), "w15_codes": Q(codes),
    "g07_projected_communities": Q1(projected, labelled=False), "a17_enrichment": Q(enrichment),
}
LONG = "lk as (unpivot (select review_id, y, k_rur rur, k_rsr rsr, k_rtr rtr from r) on rur, rsr, rtr into name relation value k)"
_G = "gs as (select relation, k, count(*) s, sum(y) hits from lk group by 1, 2)"
_BASE = "(select avg(y) from r)"
LOO = "lo as (select review_id, y, " + ", ".join(f"case when count(*) over (partition by {k}) > 1 then (sum(y) over (partition by {k}) - y) / (count(*) over (partition by {k}) - 1) else {_BASE} end loo_{k[2:]}" for k in KEYS) + " from r)"
TRAIN = "(('0x' || left(md5(review_id::varchar), 8))::bigint / 4294967296.0 < 0.7)::int"
LOOT = f"lt as (select review_id, y, train, " + ", ".join(
    f"coalesce((sum(train * y) over (partition by {k}) - train * y) / nullif(sum(train) over (partition by {k}) - train, 0), (select avg(y) from (select *, {TRAIN} train from r) where train = 1)) loo_{k[2:]}" for k in KEYS
) + f" from (select *, {TRAIN} train from r))"


def _nb(k: str) -> str:
    one = lambda c: f"""round(avg(o.{c}), 6) {c}_mean_loo, round(stddev_pop(o.{c}), 5) {c}_std_loo, round(max(o.{c}), 6) {c}_max_loo, round(any_value(a.{c}) - avg(o.{c}), 6) {c}_deviation"""
    return sql(f"select a.review_id, count(o.review_id) + 1 group_size, {one('rating')}, {one('age')} from g a left join g o on o.{k} = a.{k} and o.review_id <> a.review_id group by a.review_id", _AGE)


_E1 = "e1 as (select a.review_id src, b.review_id dst from r a join r b on a.k_rtr = b.k_rtr and a.review_id < b.review_id)"
_E2 = "e2 as (select a.review_id src, b.review_id dst from r a join r b on a.u = b.u and a.review_id < b.review_id)"
_E3 = "e3 as (select a.review_id src, b.review_id dst from r a join r b on a.k_rsr = b.k_rsr and a.review_id < b.review_id)"
_EU = "e as (select * from e1 union select * from e2 union select * from e3)"
_EW = "e as (select * from e1)"
_UNION = (_E1, _E2, _E3, _EU)
_BW = "w as (select src, dst from e union all select dst, src from e)"
_AGE = "g as (select *, date_diff('day', date '2019-01-01', day)::double age from r)"
#: Least review of the component by passing on the least number, as often as no longest shortest path is longer.
COMPONENTS = ("cc0 as (select review_id, u, k_rsr, review_id c from r)", *[f"cc{i + 1} as materialized (select review_id, u, k_rsr, least(min(c) over (partition by u), min(c) over (partition by k_rsr)) c from cc{i})" for i in range(24)], "cc as (select * from cc24)")


def _bank(k: str, h: str) -> str:
    l = f"({h} - avg({h}) over (partition by {k}))"  # noqa: E741
    n = f"{k[2:]}_{h}"
    return f"round(3 * {h} - 2.25 * {l}, 6) {n}_w0, round(1.5 * {l}, 6) {n}_w1, round(0.75 * {l}, 6) {n}_w2, round({h} - 0.75 * {l}, 6) {n}_low"


def _on_edges(*e: str) -> str:
    return sql("select r.review_id, count(o.review_id) + 1 group_size, round(avg(o.rating), 6) mean_loo, round(stddev_pop(o.rating), 5) std_loo, round(max(o.rating), 6) max_loo, round(any_value(r.rating) - avg(o.rating), 6) deviation from r left join w on w.src = r.review_id left join r o on o.review_id = w.dst group by 1", *e, _BW)


def _ego(*e: str) -> str:
    return sql("select review_id, ni, ni - 1 + count(e.src) ei from (select src review_id, count(*) + 1 ni from w group by 1) n left join w p on p.src = review_id left join w q on q.src = review_id and q.dst > p.dst left join e on e.src = p.dst and e.dst = q.dst group by 1, 2", *e, _BW)


def _lap(*e: str) -> str:
    return sql("select r.review_id, round(any_value(rating) - any_value(rating / d.d) - coalesce(sum(v.x / sqrt(v.d)), 0) / sqrt(any_value(d.d)), 6) lx from r join dg d on d.review_id = r.review_id left join w on w.src = r.review_id left join dg v on v.review_id = w.dst group by 1", *e, _BW, "dg as (select r.review_id, any_value(rating) x, count(w.src) + 1 d from r left join w on w.src = r.review_id group by 1)")


_rl = ", ".join(f"round(loo_{k}, 6) loo_{k}" for k in RELATIONS)
_ODD = "od as (select *, exp(c + t * ln(s)) f from (select gs.*, s * (s - 1) / 2 ei from gs) join (select relation, regr_slope(ln(s * (s - 1) / 2), ln(s)) t, regr_intercept(ln(s * (s - 1) / 2), ln(s)) c from lk join gs using (relation, k) where s > 1 group by relation) using (relation))"
SQL = {
    "g02_relation_keys": sql("select review_id, k_rur, k_rsr, k_rtr from r"),
    "g03_communities": sql("select review_id, " + ", ".join(f"min(review_id) over (partition by {k}) c_{k[2:]}" for k in KEYS) + " from r"),
    "a16_group_sizes": sql("select relation, count(*) n_groups, sum(s * (s - 1))::bigint n_edges, max(s) max_size, quantile_cont(s, 0.5) median_size, round(avg((s = 1)::int), 6) singleton_share from gs group by 1", LONG, _G),
    "a16_degree": sql("select review_id, " + ", ".join(f"count(*) over (partition by {k}) - 1 d_{k[2:]}" for k in KEYS) + " from r"),
    "w08_loo_scores": sql(f"select review_id, y, {_rl} from lo", LOO), "w10_loo_train_only": sql(f"select review_id, train, {_rl} from lt", LOOT),
    "w11_neighbors_business_rating": _nb("k_rsr"), "w11_neighbors_reviewer": _nb("k_rur"),
    "w12_group_laplacian": sql("select review_id, round(rating, 6) rating, round(age, 6) age, " + ", ".join(f"round({h} - avg({h}) over (partition by {k}), 6) {k[2:]}_{h}_l" for k in KEYS for h in ("rating", "age")) + " from g", _AGE),
    "g22_beta_wavelets": sql("select review_id, " + ", ".join(_bank(k, h) for k in KEYS for h in ("rating", "age")) + " from g", _AGE),
    "g06_labels": sql("select review_id, dense_rank() over (order by c) - 1 as label from (select review_id, min(review_id) over (partition by k_rtr) c from r)"),
    "g12_oddball": sql("select relation, review_id, s ni, ei::bigint ei, round(case when s > 1 then (greatest(ei, f) + 1e-6) / (least(ei, f) + 1e-6) * ln(abs(ei - f) + 1) else 0 end, 5) score from lk join od using (relation, k)", LONG, _G, _ODD),
    "g15_fraudar_cliques": sql("select relation, max((top - 1) / 2) max_density, sum(case when s = top then s end)::bigint detected, round(sum(s * (s - 1) / 2) / sum(s), 6) full_density from (select *, max(s) over (partition by relation) top from gs) group by relation", LONG, _G),
    "t02_survival_order": sql("select review_id, row_number() over (order by s, review_id) place from (select review_id, count(*) over (partition by k_rtr) s from r)"),
    "j12_edges_week": sql("select * from e1", _E1),
    "u06_union_degrees": sql("select r.review_id, count(w.src) degree from r left join w on w.src = r.review_id group by 1", *_UNION, _BW),
    "u07_weighted_union": sql("select r.review_id, round(coalesce(sum(w), 0), 9) strength from r left join (select src, w from x union all select dst, w from x) q on q.src = r.review_id group by 1", _E1, _E2, _E3, "x as (" + " union all ".join(f"select src, dst, 1.0::double / (2 * (select count(*) from {e})) w from {e}" for e in ("e1", "e2", "e3")) + ")"),
    "g10_union_neighbors": _on_edges(*_UNION), "g10_neighbors_on_edges": _on_edges(_E1, _EW), "g11_union_egonets": _ego(*_UNION), "g11_egonets": _ego(_E1, _EW),
    "g21_normal_laplacian": _lap(*_UNION), "g21_laplacian_on_edges": _lap(_E1, _EW),
    "g08_union_components": sql("select review_id, c component from cc", *COMPONENTS),
    "g09_verify_union": sql("select count(*) n_nodes, count(*) filter (d <> s - 1) n_mismatched, round(avg((d <> s - 1)::int), 6) mismatch_share from (select review_id, count(*) over (partition by c) s from cc) join (select src, count(*) d from w group by 1) on src = review_id", *_UNION, _BW, *COMPONENTS),
    "w15_codes": sql("select b, dense_rank() over (order by b) - 1 code, dense_rank() over (order by f) - 1 first_code from (select b, min(review_id) f from r group by b)"),
    "g07_projected_communities": sql("select relation, count(*) n_communities, sum(n)::bigint n_labelled from (select relation, k, count(y) n from (unpivot (select review_id, y, k_rur rur, k_rsr rsr, k_rtr rtr from ra) on rur, rsr, rtr into name relation value k) group by 1, 2) where n > 0 group by 1"),
    "a17_enrichment": sql("""select relation, count(*) testable, count(*) filter (sig) significant, coalesce(sum(hits) filter (sig), 0)::bigint fraud_captured, coalesce(sum(s) filter (sig), 0)::bigint nodes_covered from
 (select *, p < 0.01 / count(*) over (partition by relation) sig from (select relation, s, hits, case when hits = 0 then 1 else list_sum(list_transform(range(hits::bigint, least(s, kk)::bigint + 1),
 lambda j: case when s - j <= nn - kk then exp(lgamma(kk + 1) - lgamma(j + 1) - lgamma(kk - j + 1) + lgamma(nn - kk + 1) - lgamma(s - j + 1) - lgamma(nn - kk - s + j + 1) - lgamma(nn + 1) + lgamma(s + 1) + lgamma(nn - s + 1)) else 0 end)) end p
 from gs, (select count(*) nn, sum(y) kk from r) where s > 1)) group by relation""", LONG, _G),
    "g09_verify_cliques": sql("select count(*) n_nodes, count(*) filter (d <> s - 1) n_mismatched, round(avg((d <> s - 1)::int), 6) mismatch_share from (select review_id, count(*) over (partition by k_rtr) s from r) join (select src, count(*) d from (select src from e1 union all select dst from e1) group by 1) on src = review_id", _E1),
}
