"""Evaluation of scores against labels: ranking metrics, slices, splits, bands, thresholds.

Curves come from running sums over distinct scores (`prefix.cumulative`), so that no metric sorts all rows in one task.
"""
from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.operators.behavior import SQL as BEHAVIOR, Q, Q1, TEXT, block1, r6, text_features, yelp_texts
from plumbline.operators.bursts import RZ, SPINE, ZS, review_burst
from plumbline.operators.facts import RELATIONS, beside, facts, sql
from plumbline.operators.prefix import cumulative, quantiles
from plumbline.operators.relations import LOO, LOOT, in_train, loo, loo_train
from plumbline.scratch import bounded, cut
from plumbline.sources.tables import table

FPRS = (0.01, 0.05, 0.1)
FRACTIONS = (0.05, 0.1, 0.2)
MIN_ROWS = 50
DIGITS = 9  # scores are equal if they agree to so many digits, so that the order of a sum doesn't break ties


def unpivot(df: DataFrame, cols: list[str], *keep: str) -> DataFrame:
    """(keep..., signal, score), null scores left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("signal"), F.round(F.col(c).cast("double"), DIGITS).alias("score")) for c in cols])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.*").filter("score is not null")


def signals(r: DataFrame) -> DataFrame:
    """(review_id, y, signal, score): leave-one-out scores of the relations and the burst z-score."""
    w = loo(r).join(review_burst(r).select("review_id", F.col("z").alias("burst")), "review_id")
    return unpivot(w, [f"loo_{x}" for x in RELATIONS] + ["burst"], "review_id", "y")


def curve(df: DataFrame, group: list[str]) -> DataFrame:
    """(group, score, p, q, tp, fp, P, N) from the highest score down; rows without label or score are left out."""
    a = cut(df.filter("y is not null and score is not null").groupBy(*group, "score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q")))
    c = cumulative(a, group, [F.desc("score")], {"tp": "p", "fp": "q"})
    return c.join(a.groupBy(*group).agg(F.sum("p").alias("pos"), F.sum("q").alias("neg")), group)


def metrics(df: DataFrame, group: list[str]) -> DataFrame:
    """(group, n, n_pos, auc, ap, recall_at_fpr_*): ties count half, AP is the step sum; null where a class is missing."""
    c = curve(df, group)
    both = F.first("pos") * F.first("neg")
    out = [F.sum(F.col("p") + F.col("q")).alias("n"), F.sum("p").alias("n_pos")]
    out.append(r6(F.try_divide(F.sum(F.col("q").cast("double") * (F.col("tp") - F.col("p") / 2)), both)).alias("auc"))
    out.append(r6(F.when(both > 0, F.sum(F.col("p") / F.nullif("pos", F.lit(0)) * F.col("tp") / (F.col("tp") + F.col("fp"))))).alias("ap"))
    for t in FPRS:
        got = F.max(F.when(F.col("fp") <= t * F.col("neg"), F.try_divide("tp", "pos")))
        out.append(r6(F.when(both > 0, F.coalesce(got, F.lit(0.0)))).alias(f"recall_at_fpr_{int(t * 100)}"))
    return c.groupBy(*group).agg(*out)


def topk(df: DataFrame, group: list[str], fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """(group, fraction, k, hits, precision, recall, lift) of the k highest scores, equal scores by review_id.

    k is n times the fraction, rounded half to even, at least 1.
    """
    one = df.filter("y is not null").withColumn("one", F.lit(1))
    c = cumulative(one, group, [F.desc("score"), F.col("review_id")], {"place": "one"})
    total = one.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    k = F.greatest(F.lit(1), F.bround(F.col("n") * F.col("fraction")).cast("bigint"))
    t = total.withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in fractions]))).withColumn("k", k)
    # As many rows as groups and fractions.
    h = c.select(*group, "place", "y").join(F.broadcast(t), group).filter("place <= k").groupBy(*group, "fraction", "k", "n", "pos").agg(F.sum("y").alias("hits"))
    precision = F.col("hits") / F.col("k")
    return h.select(*group, "fraction", "k", "hits", r6(precision).alias("precision"), r6(F.try_divide("hits", "pos")).alias("recall"), r6(F.try_divide(precision, F.col("pos") / F.col("n"))).alias("lift"))


def sliced(r: DataFrame) -> DataFrame:
    """(review_id, slice): the diagnostic slices a review is in; low_business: under the row-weighted median size."""
    w = beside(beside(r.select("review_id", "rating", "u", "b"), "u", F.count(F.lit(1)).alias("un")), "b", F.count(F.lit(1)).alias("bn"))
    mid = F.broadcast(quantiles(w.withColumn("all", F.lit(0)), ["all"], "bn", [0.5]).select(F.col("v").alias("mid")))  # one row
    tests = [("global", F.lit(True)), ("cold_start", F.col("un") == 1), ("reviewer_2_5", F.col("un").between(2, 5)), ("reviewer_6_up", F.col("un") >= 6), ("low_business", F.col("bn") < F.col("mid")), ("extreme_rating", F.col("rating").isin(1.0, 5.0))]
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in tests]), lambda x: x.isNotNull())
    return w.crossJoin(mid).select("review_id", F.explode(names).alias("slice"))


def by_slice(r: DataFrame) -> DataFrame:
    """Metrics of each signal within each slice of MIN_ROWS or more."""
    return metrics(signals(r).join(sliced(r), "review_id"), ["signal", "slice"]).filter(F.col("n") >= MIN_ROWS)


def thresholds(s: DataFrame) -> DataFrame:
    """(signal, low, high): the scores between which a signal abstains, its quantiles 0.1 and 0.9."""
    q = quantiles(s, ["signal"], "score", [0.1, 0.9])  # two rows a signal
    return q.groupBy("signal").agg(F.max(F.when(F.col("q") < 0.5, F.col("v"))).alias("low"), F.max(F.when(F.col("q") > 0.5, F.col("v"))).alias("high"))


def banded(s: DataFrame) -> DataFrame:
    """`s` with its band: suspicious from `high` up (also where low = high), genuine up to `low`, else uncertain."""
    return s.join(F.broadcast(thresholds(s)), "signal").withColumn("band", F.when(F.round("score", 6) >= F.round("high", 6), "suspicious").when(F.round("score", 6) <= F.round("low", 6), "genuine").otherwise("uncertain"))


def band_summary(r: DataFrame) -> DataFrame:
    b = banded(cut(signals(r))).groupBy("signal", "band").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("y")).alias("fraud_rate"))
    return b.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("signal"))))


def md5_of(c: str | Column) -> Column:
    return F.md5((F.col(c) if isinstance(c, str) else c).cast("string"))


def stratified_split(r: DataFrame, share: float = 0.7) -> DataFrame:
    """(review_id, split): of each label the first `share` in the order of the MD5 of the id are train."""
    x = r.select("review_id", "y", md5_of("review_id").alias("h")).withColumn("one", F.lit(1))
    c = cumulative(x, ["y"], [F.col("h"), F.col("review_id")], {"place": "one"})
    n = x.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    return c.join(F.broadcast(n), "y").select("review_id", F.when(F.col("place") <= F.floor(F.col("n") * share), "train").otherwise("test").alias("split"))


def group_split(r: DataFrame, key: str, share: float = 0.7) -> DataFrame:
    h = F.conv(F.substring(md5_of(key), 1, 8), 16, 10).cast("double") / 2**32
    return r.select("review_id", key, F.when(h < share, "train").otherwise("test").alias("split"))


def disjoint(r: DataFrame) -> DataFrame:
    """(key, shared): keys that stand in both parts of their own group split; 0 always."""
    out = None
    for k in ("u", "b"):
        s = group_split(r, k)
        both = s.groupBy(k).agg(F.count_distinct("split").alias("c")).agg(F.count(F.when(F.col("c") > 1, 1)).alias("shared")).select(F.lit(k).alias("key"), "shared")
        out = both if out is None else out.unionByName(both)
    return out


def temporal_split(r: DataFrame) -> DataFrame:
    """(day, n, split): the first 70 % of distinct days train, the next 15 % validation, the rest test."""
    d = r.groupBy("day").agg(F.count(F.lit(1)).alias("n"))  # one row per calendar day
    rank, all_ = F.row_number().over(Window.orderBy("day")), F.count(F.lit(1)).over(Window.partitionBy())
    return d.select("day", "n", F.when(rank <= F.floor(all_ * 0.7), "train").when(rank <= F.floor(all_ * 0.85), "validation").otherwise("test").alias("split"))


def standardised(r: DataFrame) -> DataFrame:
    """(review_id, z_rating, z_age) by mean and population deviation of the training rows alone; a deviation of 0 is 1."""
    r = r.withColumn("age", F.datediff("day", F.lit("2019-01-01").cast("date")).cast("double"))
    cols = ("rating", "age")
    st = r.filter(in_train(r)).agg(*[x for c in cols for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    j = r.crossJoin(F.broadcast(st))
    return j.select("review_id", *[r6((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") < 1e-8, 1.0).otherwise(F.col(f"s_{c}"))).alias(f"z_{c}") for c in cols])


def macro_f1(r: DataFrame) -> DataFrame:
    """(signal, threshold, macro_f1): of the 99 percentiles of each score the best threshold, the lowest of equals."""
    s = cut(signals(r))
    t = quantiles(s, ["signal"], "score", [i / 100 for i in range(1, 100)]).select("signal", F.round("v", 6).alias("t")).distinct()
    # Counts per score and label first, then 99 thresholds against distinct scores.
    c = s.groupBy("signal", F.round("score", 6).alias("score")).agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q")).join(F.broadcast(t), "signal")
    up = F.col("score") >= F.col("t")
    a = c.groupBy("signal", "t").agg(*[F.sum(F.when(x, F.col(k)).otherwise(0)).alias(n) for n, x, k in (("tp", up, "p"), ("fp", up, "q"), ("fn", ~up, "p"), ("tn", ~up, "q"))])
    f = lambda x, e1, e2: F.coalesce(F.try_divide(2 * F.col(x), 2 * F.col(x) + F.col(e1) + F.col(e2)), F.lit(0.0))
    a = a.withColumn("f", F.round((f("tp", "fp", "fn") + f("tn", "fn", "fp")) / 2, 6))
    return a.groupBy("signal").agg(F.min(F.struct((-F.col("f")).alias("g"), "t")).alias("x")).select("signal", F.col("x.t").alias("threshold"), (-F.col("x.g")).alias("macro_f1"))


def fused(r: DataFrame) -> DataFrame:
    """(review_id, fused): equal-weight sum of the signals after min-max scaling; a constant signal gives 0."""
    s = cut(signals(r))
    e = F.broadcast(s.groupBy("signal").agg(F.min("score").alias("lo"), F.max("score").alias("hi")))
    x = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return s.join(e, "signal").groupBy("review_id").agg(r6(F.sum(x) / 4).alias("fused"))


def average_ranks(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """(group, value, c, r): rank of each distinct value from the lowest, ties sharing the mean of their places."""
    d = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("c"))
    return cumulative(d, group, [F.col(value)], {"upto": "c"}).select(*group, value, "c", (F.col("upto") - F.col("c") / 2 + 0.5).alias("r"))


def percentile_priors(values: DataFrame, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """(kind, value, prior) of (kind, value, c): average-rank percentile of each distinct value among its kind, mapped to
    lo..hi; one value alone gives lo. All kinds are ranked in one pass over distinct values."""
    d = values.filter("value is not null").groupBy("kind", "value").agg(F.sum("c").alias("c"))
    r = cumulative(d, ["kind"], [F.col("value")], {"upto": "c"})
    n = r.groupBy("kind").agg(F.max("upto").alias("total"))  # one row a kind
    rank = F.col("upto") - F.col("c") / 2 + 0.5
    return r.join(F.broadcast(n), "kind").select("kind", "value", (lo + (rank - 1) / F.greatest(F.col("total") - 1, F.lit(1)) * (hi - lo)).alias("prior"))


def correlations(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(a, b, pearson, spearman) of each pair of number columns; null where one is constant or unknown throughout.

    Rows in which either of a pair is null don't count for Pearson; ranks are among the known values of a column. Ranks
    of all columns come from one pass over distinct values and are joined back per column.
    """
    df = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in cols])).alias("x")).select("x.*").filter("value is not null")
    ranks = cut(average_ranks(long, "value", ["kind"]).select("kind", "value", "r"))
    for c in cols:
        of = bounded(ranks.filter(F.col("kind") == c).select(F.col("value").alias(c), F.col("r").alias(f"r_{c}")))
        df = df.join(of, c, "left")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    safe = lambda a, b: F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))
    row = df.agg(*[x for a, b in pairs for x in (safe(a, b).alias(f"p_{a}_{b}"), safe(f"r_{a}", f"r_{b}").alias(f"s_{a}_{b}"))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r6(f"p_{a}_{b}").alias("pearson"), r6(f"s_{a}_{b}").alias("spearman")) for a, b in pairs])).alias("x")).select("x.*")


def kept_columns(df: DataFrame, cols: list[str], limit: float = 0.999) -> list[str]:
    """Those of `cols` with variance and without an earlier kept one they correlate with by `limit` or more, either way.

    Distributed passes give variances and the matrix of correlations; the choice runs over the list of columns. Nulls count as 0.
    """
    clean = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    x = VectorAssembler(inputCols=cols, outputCol="x").transform(clean).select("x")
    spread = x.select(Summarizer.variance(F.col("x"))).first()[0]
    corr = np.abs(Correlation.corr(x, "x").first()[0].toArray())  # columns x columns
    kept: list[int] = []
    for j in range(len(cols)):
        if spread[j] > 1e-12 and all(corr[i, j] < limit for i in kept):
            kept.append(j)
    return [cols[j] for j in kept]


def degenerate(df: DataFrame, cols: list[str], limit: float = 0.999) -> DataFrame:
    """(feature, kept) of each of `cols`, see `kept_columns`."""
    kept = set(kept_columns(df, cols, limit))
    return df.sparkSession.createDataFrame([(c, int(c in kept)) for c in cols], "feature string, kept int")


def seed_rank_average(r: DataFrame, seeds: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(review_id, mean_rank): mean over seeds of the place by a seeded score, equal scores by review_id."""
    x = r.select("review_id", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    x = x.withColumn("h", F.md5(F.concat_ws("|", "review_id", "seed"))).withColumn("one", F.lit(1))
    c = cumulative(x, ["seed"], [F.col("h"), F.col("review_id")], {"place": "one"})
    return c.groupBy("review_id").agg(r6(F.avg("place")).alias("mean_rank"))


def protocols(r: DataFrame) -> DataFrame:
    """(protocol, signal, ...): metrics on test rows of scores from all labels, and from those of training rows only."""
    leaky = loo(r).join(r.select("review_id", in_train(r).alias("train")), "review_id").filter("not train").withColumn("protocol", F.lit("all_labels"))
    clean = loo_train(r).filter("train = 0").join(r.select("review_id", "y"), "review_id").withColumn("protocol", F.lit("train_labels"))
    cols = [f"loo_{x}" for x in RELATIONS]
    return metrics(unpivot(leaky, cols, "protocol", "y").unionByName(unpivot(clean, cols, "protocol", "y")), ["protocol", "signal"])


def single_features(f: DataFrame, y: DataFrame, cols: list[str]) -> DataFrame:
    """(signal, auc, ap) of each raw feature of `f` by itself, against y (review_id, y), all in one pass."""
    return metrics(unpivot(f.join(y, "review_id"), cols, "y"), ["signal"]).select("signal", "auc", "ap")


def style_recall(s: DataFrame) -> DataFrame:
    """(style, n, n_pos, auc, recall...) of (style, y, score): fakes of one style, and of all but it, each against all
    genuine rows. Fakes without a style count in every `without_`; the styles are few."""
    styles = F.broadcast(s.filter("y = 1 and style is not null").select(F.col("style").alias("of")).distinct())
    every = s.join(styles, F.lit(True))
    names = F.filter(F.array(F.when((F.col("y") == 0) | F.col("style").eqNullSafe(F.col("of")), F.concat(F.lit("only_"), "of")), F.when((F.col("y") == 0) | ~F.col("style").eqNullSafe(F.col("of")), F.concat(F.lit("without_"), "of"))), lambda x: x.isNotNull())
    return metrics(every.select(F.explode(names).alias("style"), "y", "score"), ["style"]).select("style", "n", "n_pos", "auc", "recall_at_fpr_1", "recall_at_fpr_5")


def generated_styles(spark: SparkSession, d: str) -> DataFrame:
    """`style_recall` of lexical richness of `reviews`, low being suspect, by the generator of the fakes."""
    t = table(spark, d, "reviews", "id", "text", "is_fake", "generator").filter("is_fake is not null")
    t = t.groupBy(F.col("id").alias("review_id")).agg(F.max("text").alias("text"), F.max(F.col("is_fake").cast("int")).alias("y"), F.max(F.lower(F.trim("generator"))).alias("style"))
    f = text_features(t, "y", "style")
    return style_recall(f.select("style", "y", (-F.col("lexical_richness")).alias("score")))


def scattered(r: DataFrame) -> DataFrame:
    """(review_id, held_out): leave-one-out score of test rows, null for training rows."""
    held = loo_train(r).filter("train = 0").select("review_id", r6("loo_rsr").alias("held_out"))
    return r.select("review_id").join(held, "review_id", "left")


#: The columns that are correlated, and the features of block1 in their order.
WIDE = ["rating", "age", "y", "user_n", "business_n", "deviation"]
BLOCK1 = [
    "reviewer_n_reviews", "reviewer_avg_rd", "reviewer_pr", "reviewer_nr", "reviewer_active_life_days", "reviewer_bst", "reviewer_erd", "reviewer_etg", "reviewer_mnr",
    "business_n_reviews", "business_rating_std", "business_singleton_reviewer_ratio", "rating_deviation", "singleton", "rating_extremity", "temporal_position", *TEXT,
]


def _wide(r: DataFrame) -> DataFrame:
    x = beside(r.select("review_id", "u", "b", "rating", "day", "y"), "u", F.count(F.lit(1)).alias("user_n"))
    x = beside(x, "b", F.count(F.lit(1)).alias("business_n"), F.avg("rating").alias("mean"))
    return x.withColumn("age", F.datediff("day", F.lit("2019-01-01").cast("date"))).withColumn("deviation", F.round(F.abs(F.col("rating") - F.col("mean")), 9))


QUERIES = {
    "e01_e04_metrics": Q(lambda r: metrics(signals(r), ["signal"])), "t01_topk_capture": Q(lambda r: topk(signals(r), ["signal"])), "filter07_slices": Q(lambda r: sliced(r).groupBy("slice").agg(F.count(F.lit(1)).alias("n"))),
    "e05_by_slice": Q(by_slice), "a14_abstention_thresholds": Q(lambda r: thresholds(signals(r)).select("signal", r6("low").alias("low"), r6("high").alias("high"))), "a15_band_summary": Q(band_summary), "e07_stratified_split": Q1(stratified_split),
    "e08_group_split": Q1(lambda r: group_split(r, "u")), "u05_split_disjoint": Q(disjoint), "e09_temporal_split": Q1(temporal_split), "e10_standardised": Q(standardised), "e16_macro_f1": Q(macro_f1), "e17_linear_fusion": Q(fused),
    "a19_correlations": Q(lambda r: correlations(_wide(r), "review_id", WIDE)), "filter09_degenerate_columns": lambda s, d: degenerate(cut(block1(cut(facts(s, d)), yelp_texts(s, d))), BLOCK1), "w13_rank_average": Q(seed_rank_average), "e06_protocols": Q(protocols), 
    "e14_single_features": lambda s, d: (lambda r: single_features(block1(r, yelp_texts(s, d)), r.select("review_id", "y"), BLOCK1))(cut(facts(s, d))),
    "e20_style_recall": generated_styles, "e21_scattered": Q(scattered), 
    "w04_percentile_prior": Q1(lambda r: percentile_priors(r.groupBy("u").agg(F.count(F.lit(1)).alias("value")).select(F.lit("n").alias("kind"), "value", F.lit(1).alias("c"))).select(F.col("value").alias("n"), r6("prior").alias("prior"))),
}
SG = f"sg as (unpivot (select lo.review_id, lo.y, {', '.join(f'round(loo_{x}, 9) loo_{x}' for x in RELATIONS)}, round(z, 9) burst from lo join rz using (review_id)) on loo_rur, loo_rsr, loo_rtr, burst into name signal value score)"
_SIG = (LOO, SPINE, ZS, RZ, SG)


def _metrics_sql(src: str, group: str) -> str:
    rec = ", ".join(f"case when any_value(pos) * any_value(neg) > 0 then round(coalesce(max(case when fp <= {t} * neg then tp / pos end), 0), 6) end recall_at_fpr_{int(t * 100)}" for t in FPRS)
    return f"""select {group}, sum(p + q)::bigint n, sum(p)::bigint n_pos, round(sum(q * (tp - p / 2)) / nullif(any_value(pos) * any_value(neg), 0), 6) auc,
 case when any_value(pos) * any_value(neg) > 0 then round(sum(p / nullif(pos, 0) * tp / (tp + fp)), 6) end ap, {rec} from
 (select *, sum(p) over w tp, sum(q) over w fp, sum(p) over (partition by {group}) pos, sum(q) over (partition by {group}) neg from (select {group}, score, sum(y) p, sum(1 - y) q from {src} group by {group}, score)
  window w as (partition by {group} order by score desc)) group by {group}"""


_SLICES = """sl as (select review_id, unnest(list_filter(['global', case when un = 1 then 'cold_start' end, case when un between 2 and 5 then 'reviewer_2_5' end, case when un >= 6 then 'reviewer_6_up' end,
 case when bn < (select quantile_cont(bn, 0.5) from cn) then 'low_business' end, case when rating in (1, 5) then 'extreme_rating' end], lambda v: v is not null)) slice from cn)"""
_CN = "cn as (select *, count(*) over (partition by u) un, count(*) over (partition by b) bn from r)"
_PR = f"""pr as (unpivot (select 'all_labels' protocol, y, {', '.join(f'round(loo_{x}, 9) loo_{x}' for x in RELATIONS)} from lo where review_id not in (select review_id from lt where train = 1)
 union all select 'train_labels', y, {', '.join(f'round(loo_{x}, 9)' for x in RELATIONS)} from lt where train = 0) on loo_rur, loo_rsr, loo_rtr into name signal value score)"""
_CORR = lambda a, b, n, t: f"round(case when var_pop({a}) > 0 and var_pop({b}) > 0 then corr({a}, {b}) end, 6)"
_AV = "av as (select *, " + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2 r_{c}" for c in WIDE) + " from (select rating, date_diff('day', date '2019-01-01', day)::double age, y, count(*) over (partition by u) user_n, count(*) over (partition by b) business_n, round(abs(rating - avg(rating) over (partition by b)), 9) deviation from r))"
_PAIRS = [(a, b) for i, a in enumerate(WIDE) for b in WIDE[i + 1 :]]
_F20 = "f as (" + BEHAVIOR["block1_features"] + ")"
_LF = f"lf as (unpivot (select review_id, {', '.join(f'{c}::double {c}' for c in BLOCK1)} from f) on {', '.join(BLOCK1)} into name col value v)"
_STYLE = """ss as (select y, style, -coalesce(len(list_distinct(list_transform(w, lambda v: lower(v)))) / nullif(len(w), 0), 0) score from
 (select id, y, style, list_filter(regexp_split_to_array(x, '[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda v: v <> '') w from
 (select id, coalesce(max(text), '') x, max(is_fake::int) y, max(lower(trim(generator))) style from reviews where is_fake is not null group by id)))"""
_F1 = lambda x, a, b: f"coalesce(2 * {x} / nullif(2 * {x} + {a} + {b}, 0), 0)"
SQL = {
    "e01_e04_metrics": sql(_metrics_sql("sg", "signal"), *_SIG),
    "t01_topk_capture": sql("""select signal, fraction, k, sum(y)::bigint hits, round(sum(y) / k, 6) as precision, round(sum(y) / nullif(any_value(pos), 0), 6) recall, round(sum(y) / k / nullif(any_value(pos) / any_value(n), 0), 6) lift from
 (select *, greatest(1, round_even(n * fraction, 0))::bigint k from (select *, row_number() over (partition by signal order by score desc, review_id) i, count(*) over (partition by signal) n, sum(y) over (partition by signal) pos from sg), (select unnest([0.05, 0.1, 0.2]) fraction))
 where i <= k group by signal, fraction, k""", *_SIG),
    "filter07_slices": sql("select slice, count(*) n from sl group by 1", _CN, _SLICES),
    "e05_by_slice": sql("select * from (" + _metrics_sql("(select * from sg join sl using (review_id))", "signal, slice") + ") where n >= 50", *_SIG, _CN, _SLICES),
    "a14_abstention_thresholds": sql("select signal, round(quantile_cont(score, 0.1), 6) low, round(quantile_cont(score, 0.9), 6) high from sg group by 1", *_SIG),
    "a15_band_summary": sql("""select signal, band, count(*) n, round(avg(y), 6) fraud_rate, round(count(*) / sum(count(*)) over (partition by signal), 6) as share from (select signal, y, case when round(score, 6) >= round(hi, 6) then 'suspicious' when round(score, 6) <= round(lo, 6) then 'genuine' else 'uncertain' end band
 from sg join (select signal, quantile_cont(score, 0.1) lo, quantile_cont(score, 0.9) hi from sg group by 1) using (signal)) group by 1, 2""", *_SIG),
    "e07_stratified_split": sql("select review_id, case when row_number() over (partition by y order by md5(review_id::varchar), review_id) <= floor(count(*) over (partition by y) * 0.7) then 'train' else 'test' end split from r"),
    "e08_group_split": sql("select review_id, u, case when ('0x' || left(md5(u::varchar), 8))::bigint / 4294967296.0 < 0.7 then 'train' else 'test' end split from r"),
    "u05_split_disjoint": sql(" union all ".join(f"select '{k}' as key, count(*) filter (c > 1) shared from (select {k}, count(distinct ('0x' || left(md5({k}::varchar), 8))::bigint / 4294967296.0 < 0.7) c from r group by 1)" for k in ("u", "b"))),
    "e09_temporal_split": sql("select day, n, case when i <= floor(c * 0.7) then 'train' when i <= floor(c * 0.85) then 'validation' else 'test' end split from (select day, count(*) n, row_number() over (order by day) i, count(*) over () c from r group by day)"),
    "e10_standardised": sql("select review_id, round((rating - mr) / sr, 6) z_rating, round((age - ma) / sa, 6) z_age from (select *, date_diff('day', date '2019-01-01', day)::double age from r), (select avg(rating) mr, avg(age) ma, case when stddev_pop(rating) < 1e-8 then 1 else stddev_pop(rating) end sr, case when stddev_pop(age) < 1e-8 then 1 else stddev_pop(age) end sa from (select rating, date_diff('day', date '2019-01-01', day)::double age from r join lt using (review_id) where train = 1))", LOOT),
    "e16_macro_f1": sql(f"""select signal, t threshold, f macro_f1 from (select *, row_number() over (partition by signal order by f desc, t) i from (select signal, t, round(({_F1('tp', 'fp', 'fn')} + {_F1('tn', 'fn', 'fp')}) / 2, 6) f from
 (select sg.signal, t, sum(case when round(score, 6) >= t then y else 0 end) tp, sum(case when round(score, 6) >= t then 1 - y else 0 end) fp, sum(case when round(score, 6) < t then y else 0 end) fn, sum(case when round(score, 6) < t then 1 - y else 0 end) tn
 from sg join (select distinct signal, round(unnest(quantile_cont(score, [{', '.join(str(i / 100) for i in range(1, 100))}])), 6) t from sg group by signal) q on q.signal = sg.signal group by 1, 2))) where i = 1""", *_SIG),
    "e17_linear_fusion": sql("select review_id, round(sum(case when hi > lo_ then (score - lo_) / (hi - lo_) else 0 end) / 4, 6) fused from sg join (select signal, min(score) lo_, max(score) hi from sg group by 1) using (signal) group by 1", *_SIG),
    "a19_correlations": sql(" union all ".join(f"select '{a}' a, '{b}' b, {_CORR(a, b, 0, 0)} pearson, {_CORR('r_' + a, 'r_' + b, 0, 0)} spearman from av" for a, b in _PAIRS), _AV),
    "filter09_degenerate_columns": f"""with recursive {_F20}, {_LF}, nm as (select unnest({BLOCK1!r}) feature, unnest(range(1, {len(BLOCK1) + 1})) i),
 vr as (select i, var_pop(v) v from lf join nm on feature = col group by 1), cr as (select a.i i, b.i j, abs(corr(x.v, y.v)) c from nm a join nm b on a.i < b.i join lf x on x.col = a.feature join lf y on y.col = b.feature and y.review_id = x.review_id
  where a.i in (select i from vr where v > 1e-12) and b.i in (select i from vr where v > 1e-12) group by 1, 2),
 g as (select 0 j, []::bigint[] kept union all select j + 1, case when exists (select 1 from vr where vr.i = g.j + 1 and vr.v > 1e-12) and not exists (select 1 from cr where cr.j = g.j + 1 and c >= 0.999 and list_contains(g.kept, cr.i)) then list_append(kept, j + 1) else kept end from g where j < {len(BLOCK1)})
 select feature, list_contains((select kept from g where j = {len(BLOCK1)}), i)::int kept from nm""",
    "w13_rank_average": sql("select review_id, round(avg(i), 6) mean_rank from (select review_id, row_number() over (partition by s order by md5(review_id || '|' || s), review_id) i from r, (select unnest([1, 2, 3]) s)) group by 1"),
    "e06_protocols": sql(_metrics_sql("pr", "protocol, signal"), LOO, LOOT, _PR),
    "e14_single_features": sql("select signal, auc, ap from (" + _metrics_sql("(select col signal, round(v, 9) score, y from lf join r using (review_id))", "signal") + ")", _F20, _LF),
    "e20_style_recall": f"with {_STYLE} select style, n, n_pos, auc, recall_at_fpr_1, recall_at_fpr_5 from (" + _metrics_sql("(select inside || g style, round(score, 6) score, y from ss, (select distinct style g from ss where y = 1 and style is not null), (select unnest(['only_', 'without_']) inside) where y = 0 or (style is not distinct from g) = (inside = 'only_'))", "style") + ")",
    "e21_scattered": sql("select review_id, case when train = 0 then round(loo_rsr, 6) end held_out from lt", LOOT),
    "w04_percentile_prior": sql("select distinct n, round(0.05 + (rank() over (order by n) + (count(*) over (partition by n) - 1) / 2 - 1) / greatest(count(*) over () - 1, 1) * 0.9, 6) prior from (select u, count(*) n from r group by u)"),
}
