"""Label-free behaviour features of businesses, reviewers and reviews."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.operators.facts import beside, facts, sql
from plumbline.scratch import cut
from plumbline.sources.tables import table

#: Upper ends of the bins of gaps in days; each bin is open to the left.
GAP_BINS = (0, 1, 2, 3, 7, 14, 30, 90, 365)


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def business_stats(r: DataFrame) -> DataFrame:
    """(b, business_n_reviews, business_rating_mean, business_rating_std, business_singleton_reviewer_ratio)."""
    n = beside(r.select("b", "u", "rating"), "u", F.count(F.lit(1)).alias("n"))
    return n.withColumn("one", (F.col("n") == 1).cast("double")).groupBy("b").agg(
        F.count(F.lit(1)).alias("business_n_reviews"), r6(F.avg("rating")).alias("business_rating_mean"),
        r6(F.coalesce(F.stddev_samp("rating"), F.lit(0.0))).alias("business_rating_std"), r6(F.avg("one")).alias("business_singleton_reviewer_ratio"),
    )


def entropy(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """(key, h): Shannon entropy in bits of the counts per key."""
    t = counts.groupBy(key).agg(F.sum(n).alias("t"), F.sum(F.col(n) * F.log2(n)).alias("s"))
    # H = log2 T - sum(n log2 n) / T, in one pass
    return t.select(key, F.greatest(F.lit(0.0), F.log2("t") - F.col("s") / F.col("t")).alias("h"))


def gap_bin(c: Column) -> Column:
    out = F.lit(len(GAP_BINS))
    for i in range(len(GAP_BINS) - 1, -1, -1):
        out = F.when(c <= GAP_BINS[i], i).otherwise(out)
    return out


def rating_entropy(r: DataFrame) -> DataFrame:
    return entropy(r.groupBy("u", "rating").agg(F.count(F.lit(1)).alias("n")), "u").select("u", r6("h").alias("reviewer_erd"))


def active_days(r: DataFrame) -> DataFrame:
    """(u, day, n, gap): reviews of a reviewer on a day, days since the one before. One row a day, however many reviews."""
    d = r.groupBy("u", "day").agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("gap", F.datediff("day", F.lag("day").over(Window.partitionBy("u").orderBy("day"))))


def gap_entropy(r: DataFrame) -> DataFrame:
    """(u, reviewer_etg): a day's first review has the gap to the day before, the others 0."""
    gaps = F.array(F.struct(gap_bin(F.col("gap")).alias("bin"), F.when(F.col("gap").isNotNull(), 1).alias("n")), F.struct(gap_bin(F.lit(0)).alias("bin"), (F.col("n") - 1).alias("n")))
    g = active_days(r).select("u", F.inline(gaps)).filter("n > 0").groupBy("u", "bin").agg(F.sum("n").alias("n"))
    return r.select("u").distinct().join(entropy(g, "u"), "u", "left").select("u", r6(F.coalesce("h", F.lit(0.0))).alias("reviewer_etg"))


def max_per_day(r: DataFrame) -> DataFrame:
    """(u, max_day, reviewer_mnr): most reviews on a day, and that over the greatest of all."""
    m = r.groupBy("u", "day").agg(F.count(F.lit(1)).alias("n")).groupBy("u").agg(F.max("n").alias("max_day"))
    top = m.agg(F.max("max_day").alias("top"))  # one row
    return m.crossJoin(F.broadcast(top)).select("u", "max_day", r6(F.col("max_day") / F.col("top")).alias("reviewer_mnr"))


def reviewer_stats(r: DataFrame) -> DataFrame:
    dev = beside(r.select("u", "b", "rating", "day"), "b", F.avg("rating").alias("mean")).withColumn("rd", F.abs(F.col("rating") - F.col("mean")))
    share = lambda c: r6(F.avg(F.when(c, 1.0).otherwise(0.0)))
    life = F.datediff(F.max("day"), F.min("day"))
    base = dev.groupBy("u").agg(
        F.count(F.lit(1)).alias("reviewer_n_reviews"), r6(F.avg("rd")).alias("reviewer_avg_rd"),
        share(F.col("rating") >= 4).alias("reviewer_pr"), share(F.col("rating") <= 2).alias("reviewer_nr"), life.alias("reviewer_active_life_days"),
    )
    bst = F.when(F.col("reviewer_n_reviews") <= 1, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("reviewer_active_life_days") / 28))
    return (
        base.withColumn("reviewer_bst", r6(bst)).join(rating_entropy(r), "u").join(gap_entropy(r), "u")
        .join(max_per_day(r).select("u", "reviewer_mnr"), "u")
    )


def position(r: DataFrame) -> DataFrame:
    """`r` with temporal_position: place among the reviews of the business, 0 first to 1 last, 0.5 alone.

    What came on earlier days is a running sum over days; only the reviews of one business and day are ordered by rows.
    """
    d = r.groupBy("b", "day").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("b")
    d = d.select("b", "day", (F.sum("_n").over(w.orderBy("day")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("_all"))
    place = F.row_number().over(Window.partitionBy("b", "day").orderBy("review_id")) - 1
    r = r.join(d, ["b", "day"]).withColumn("_i", place)
    return r.withColumn("temporal_position", r6(F.when(F.col("_all") == 1, 0.5).otherwise((F.col("_before") + F.col("_i")) / (F.col("_all") - 1)))).drop("_before", "_all", "_i")


def temporal_position(r: DataFrame) -> DataFrame:
    """(review_id, temporal_position), see `position`."""
    return position(r.select("review_id", "b", "day")).select("review_id", "temporal_position")


def text_features(t: DataFrame, *keep: str) -> DataFrame:
    """(keep..., text_length_words, uppercase_ratio, exclamation_ratio, lexical_richness); null text counts as empty."""
    x = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")
    upper, alpha = F.regexp_count(x, F.lit("[A-Z]")), F.regexp_count(x, F.lit("[A-Za-z]"))
    bang = F.length(x) - F.length(F.replace(x, F.lit("!"), F.lit("")))
    n = F.size(words)
    return t.select(
        *(keep or ["review_id"]), n.alias("text_length_words"), r6(F.coalesce(F.try_divide(upper, alpha), F.lit(0.0))).alias("uppercase_ratio"),
        r6(F.coalesce(F.try_divide(bang, F.length(x)), F.lit(0.0))).alias("exclamation_ratio"),
        r6(F.coalesce(F.try_divide(F.size(F.array_distinct(F.transform(words, F.lower))), n), F.lit(0.0))).alias("lexical_richness"),
    )


def review_level(r: DataFrame) -> DataFrame:
    """(review_id, rating_deviation, singleton, rating_extremity)."""
    r = beside(beside(r.select("review_id", "u", "b", "rating"), "b", F.avg("rating").alias("mean")), "u", F.count(F.lit(1)).alias("n"))
    return r.select("review_id", r6(F.abs(F.col("rating") - F.col("mean"))).alias("rating_deviation"), (F.col("n") == 1).cast("int").alias("singleton"), r6(F.abs(F.col("rating") - 3) / 2).alias("rating_extremity"))


def yelp_texts(spark: SparkSession, d: str) -> DataFrame:
    """(review_id, text): one row per review; rows stored twice have one text."""
    return table(spark, d, "yelp", "review_id", "text").filter("review_id is not null").groupBy("review_id").agg(F.max("text").alias("text"))


def block1(r: DataFrame, texts: DataFrame) -> DataFrame:
    """The 20 features of each review: those of its reviewer, of its business and its own.

    Texts are reduced to their four numbers before anything moves; rows then move once by review, reviewer and business.
    """
    rows = r.select("review_id", "u", "b", "rating", "day").join(text_features(texts), "review_id", "left").na.fill(0, TEXT)
    mean = r.groupBy("b").agg(F.avg("rating").alias("_mean"))
    rows = position(rows).join(business_stats(r).drop("business_rating_mean").join(mean, "b"), "b").join(reviewer_stats(r), "u")
    own = [r6(F.abs(F.col("rating") - F.col("_mean"))).alias("rating_deviation"), (F.col("reviewer_n_reviews") == 1).cast("int").alias("singleton"), r6(F.abs(F.col("rating") - 3) / 2).alias("rating_extremity")]
    return rows.select("*", *own).drop("u", "b", "rating", "day", "_mean")


TEXT = ["text_length_words", "uppercase_ratio", "exclamation_ratio", "lexical_richness"]
#: A query over the facts: written once (Q) where an operator reads them several times, else read as they are (Q1).
Q = lambda f, **k: lambda s, d: f(cut(facts(s, d, **k)))
Q1 = lambda f, **k: lambda s, d: f(facts(s, d, **k))
QUERIES = {
    "a01_business_stats": Q(business_stats), "a02_a05_reviewer_stats": Q(reviewer_stats), "a06_rating_entropy": Q1(rating_entropy), "a07_gap_entropy": Q(gap_entropy),
    "a04_max_per_day": Q1(max_per_day), "w03_temporal_position": Q(temporal_position), "f08_review_level": Q(review_level),
    "f02_f05_text_features": lambda s, d: text_features(yelp_texts(s, d)),
    "block1_features": lambda s, d: block1(cut(facts(s, d)), yelp_texts(s, d)),
}

_BIZ = "select b, count(*) business_n_reviews, round(avg(rating), 6) business_rating_mean, round(coalesce(stddev_samp(rating), 0), 6) business_rating_std, round(avg(one), 6) business_singleton_reviewer_ratio from (select *, (count(*) over (partition by u) = 1)::int one from r) group by b"
_ERD = "select u, round(-sum(p * log2(p)) + 0.0, 6) reviewer_erd from (select u, count(*) / sum(count(*)) over (partition by u) p from r group by u, rating) group by u"
_BIN = "case " + " ".join(f"when g <= {v} then {i}" for i, v in enumerate(GAP_BINS)) + f" else {len(GAP_BINS)} end"
_ETG = f"select d.u, round(coalesce(h, 0), 6) reviewer_etg from (select distinct u from r) d left join (select u, -sum(p * log2(p)) + 0.0 h from (select u, count(*) / sum(count(*)) over (partition by u) p from (select u, {_BIN} bin from (select u, date_diff('day', lag(day) over (partition by u order by day, review_id), day) g from r) where g is not null) group by u, bin) group by u) e on e.u = d.u"
_MNR = "select u, m max_day, round(m / max(m) over (), 6) reviewer_mnr from (select u, max(n) m from (select u, day, count(*) n from r group by u, day) group by u)"
_REV = f"""select s.*, round(case when reviewer_n_reviews <= 1 then 0 else greatest(0, 1 - reviewer_active_life_days / 28) end, 6) reviewer_bst, reviewer_erd, reviewer_etg, reviewer_mnr from
(select u, count(*) reviewer_n_reviews, round(avg(rd), 6) reviewer_avg_rd, round(avg((rating >= 4)::int), 6) reviewer_pr, round(avg((rating <= 2)::int), 6) reviewer_nr, date_diff('day', min(day), max(day)) reviewer_active_life_days
 from (select *, abs(rating - avg(rating) over (partition by b)) rd from r) group by u) s join ({_ERD}) e using (u) join ({_ETG}) g using (u) join (select u, reviewer_mnr from ({_MNR})) m using (u)"""
_POS = "select review_id, round(case when count(*) over (partition by b) = 1 then 0.5 else (row_number() over (partition by b order by day, review_id) - 1) / (count(*) over (partition by b) - 1) end, 6) temporal_position from r"
_LVL = "select review_id, round(abs(rating - avg(rating) over (partition by b)), 6) rating_deviation, (count(*) over (partition by u) = 1)::int singleton, round(abs(rating - 3) / 2, 6) rating_extremity from r"
_TXT = r"""select review_id, len(w) text_length_words, round(coalesce(len(regexp_extract_all(x, '[A-Z]')) / nullif(len(regexp_extract_all(x, '[A-Za-z]')), 0), 0), 6) uppercase_ratio,
 round(coalesce((length(x) - length(replace(x, '!', ''))) / nullif(length(x), 0), 0), 6) exclamation_ratio, round(coalesce(len(list_distinct(list_transform(w, lambda v: lower(v)))) / nullif(len(w), 0), 0), 6) lexical_richness
 from (select review_id, x, list_filter(regexp_split_to_array(x, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda v: v <> '') w from (select review_id, coalesce(max(text), '') x from yelp where review_id is not null group by 1))"""
SQL = {
    "a01_business_stats": sql(_BIZ), "a02_a05_reviewer_stats": sql(_REV), "a06_rating_entropy": sql(_ERD), "a07_gap_entropy": sql(_ETG), "a04_max_per_day": sql(_MNR),
    "w03_temporal_position": sql(_POS), "f08_review_level": sql(_LVL), "f02_f05_text_features": _TXT,
    "block1_features": sql(f"""select r.review_id, v.* exclude (u), z.* exclude (b, business_rating_mean), l.* exclude (review_id), o.temporal_position,
 coalesce(t.text_length_words, 0) text_length_words, coalesce(t.uppercase_ratio, 0) uppercase_ratio, coalesce(t.exclamation_ratio, 0) exclamation_ratio, coalesce(t.lexical_richness, 0) lexical_richness
 from r join ({_REV}) v on v.u = r.u join ({_BIZ}) z on z.b = r.b join ({_LVL}) l on l.review_id = r.review_id join ({_POS}) o on o.review_id = r.review_id left join ({_TXT}) t on t.review_id = r.review_id"""),
}
