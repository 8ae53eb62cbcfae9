"""Problem 2: per-key results where a few keys hold most rows, by two-stage salted aggregation.

A first count finds the heavy keys, those with HEAVY or more of all rows, of which there are at most 1/HEAVY. Their rows
get a salt (a hash of the row, so a task that is run again gives the same), partial results are built per key and salt,
and merged by key. Rows of other keys keep salt 0.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.sources.tables import table

HEAVY, SALTS = 0.02, 64


def heavy_keys(rows: DataFrame, key: str, share: float = HEAVY) -> DataFrame:
    """(key, n) of keys with at least `share` of all `rows`, counted with rows that have no key: at most 1/share rows.

    Null is no key. Counts are made per task first, so a key costs at most one row per task; one scan.
    """
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(n.agg(F.sum("n").alias("_total")))  # one row
    return n.filter(F.col(key).isNotNull()).crossJoin(total).filter(F.col("n") >= share * F.col("_total")).drop("_total")


def salted(rows: DataFrame, key: str, identity: list[str | Column], share: float = HEAVY, salts: int = SALTS) -> DataFrame:
    """`rows` with the column `_salt`: 0..salts-1 by the hash of `identity` for heavy keys, 0 for others."""
    hot = heavy_keys(rows, key, share).select(F.col(key).alias("_hot"))
    # At most 1/share keys.
    return (
        rows.join(F.broadcast(hot), rows[key] == F.col("_hot"), "left")
        .withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*identity), F.lit(salts))).otherwise(F.lit(0).cast("bigint")))
        .drop("_hot")
    )


def salted_counts(rows: DataFrame, key: str, identity: list[str | Column]) -> DataFrame:
    """(key, n_rows): partial counts by key and salt, merged by key. Null is no key."""
    part = salted(rows.filter(F.col(key).isNotNull()), key, identity).groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("n"))
    return part.groupBy(key).agg(F.sum("n").alias("n_rows"))


def _known(c: str) -> Column:
    return F.when(F.col(c) != 0, F.col(c)) if c == "reviewer_id" else F.col(c)


def profile(rows: DataFrame, key: str, other: str) -> DataFrame:
    """(key_id, n_rows, n_reviews, n_others, n_texts, n_chars, first_date, last_date, busiest_day, busiest_day_reviews).

    n_rows counts rows as stored; the rest counts each review_id once, with its greatest known value where repeated rows
    differ. n_others: distinct known values of `other` (0 is none for reviewers). Ties of the busiest day go to the
    earlier. Null keys, and reviewer 0, are no keys. Empty tables give no rows.

    Rows are shuffled once, by key and salt; the rows of a review have one salt. Reviews, totals, days and others of a key
    and salt are made in place from there, and only these partial results move to be merged.
    """
    r = rows.select("review_id", _known(key).cast("bigint").alias("k"), _known(other).cast("bigint").alias("o"), F.to_date("date").alias("day"), F.length(F.trim("text")).alias("chars"))
    r = salted(r.filter("k is not null"), "k", ["review_id"]).repartition("k", "_salt")
    review = r.groupBy("k", "_salt", "review_id").agg(F.count(F.lit(1)).alias("rows"), F.max("day").alias("day"), F.max("chars").alias("chars"), F.max("o").alias("o"))
    base = review.groupBy("k", "_salt").agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("reviews"), F.count(F.when(F.col("chars") > 0, 1)).alias("texts"),
        F.sum("chars").alias("chars"), F.min("day").alias("first"), F.max("day").alias("last"),
    )
    others = review.filter("o is not null").select("k", "_salt", "o").distinct()
    days = review.filter("day is not null").groupBy("k", "_salt", "day").agg(F.count(F.lit(1)).alias("n"))
    # Stage two: merge the partial results.
    merged = base.groupBy("k").agg(
        F.sum("rows").alias("n_rows"), F.sum("reviews").alias("n_reviews"), F.sum("texts").alias("n_texts"), F.coalesce(F.sum("chars"), F.lit(0)).cast("bigint").alias("n_chars"),
        F.min("first").alias("first_date"), F.max("last").alias("last_date"),
    )
    others = others.select("k", "o").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("n_others"))
    days = days.groupBy("k", "day").agg(F.sum("n").alias("n"))
    top = days.groupBy("k").agg(F.min(F.struct((-F.col("n")).alias("m"), "day")).alias("t"))
    return (
        merged.join(others, "k", "left").join(top, "k", "left")
        .select(
            F.col("k").alias("key_id"), "n_rows", "n_reviews", F.coalesce("n_others", F.lit(0)).cast("bigint").alias("n_others"), "n_texts", "n_chars", "first_date", "last_date",
            F.col("t.day").alias("busiest_day"), (-F.col("t.m")).cast("bigint").alias("busiest_day_reviews"),
        )
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """key_column, key_id of the businesses and reviewers that hold at least 2 % of the rows of `yelp` as stored.

    The counts are the merged partial counts of the two-stage aggregation.
    """
    y = table(spark, d, "yelp", "review_id", "business_id", "reviewer_id").withColumn("reviewer_id", _known("reviewer_id"))
    n = F.broadcast(y.agg(F.count(F.lit(1)).alias("_n")))  # one row
    out = None
    for c in ("business_id", "reviewer_id"):
        one = salted_counts(y, c, ["review_id"]).crossJoin(n).filter(F.col("n_rows") >= HEAVY * F.col("_n")).select(F.lit(c).alias("key_column"), F.col(c).cast("bigint").alias("key_id"))
        out = one if out is None else out.unionByName(one)
    return out


def p2_businesses(spark: SparkSession, d: str) -> DataFrame:
    return profile(table(spark, d, "yelp", "review_id", "business_id", "reviewer_id", "date", "text"), "business_id", "reviewer_id")


def p2_reviewers(spark: SparkSession, d: str) -> DataFrame:
    return profile(table(spark, d, "yelp", "review_id", "business_id", "reviewer_id", "date", "text"), "reviewer_id", "business_id")


def _profile_sql(key: str, other: str) -> str:
    v = lambda c: f"nullif({c}, 0)" if c == "reviewer_id" else c
    return f"""
with r as (select {v(key)} k, review_id, {v(other)} o, try_cast(date as date) as day, length(trim(text, ' ')) chars from yelp where {v(key)} is not null),
 u as (select k, review_id, count(*) n_rows, max(o) o, max(day) as day, max(chars) chars from r group by 1, 2),
 b as (select k, day, count(*) n, row_number() over (partition by k order by count(*) desc, day) i from u where day is not null group by 1, 2)
select u.k key_id, sum(n_rows)::bigint n_rows, count(*) n_reviews, count(distinct o) n_others, count(case when chars > 0 then 1 end) n_texts, coalesce(sum(chars), 0)::bigint n_chars,
 min(u.day) first_date, max(u.day) last_date, max(b.day) busiest_day, max(b.n) busiest_day_reviews
from u left join b on b.k = u.k and b.i = 1 group by u.k"""


QUERIES = {"p2_found": p2_found, "p2_businesses": p2_businesses, "p2_reviewers": p2_reviewers}
SQL = {
    "p2_found": """
with y as (select business_id, nullif(reviewer_id, 0) reviewer_id from yelp), n as (select count(*) n from yelp)
select 'business_id' key_column, business_id key_id from y where business_id is not null group by business_id having count(*) >= 0.02 * (select n from n)
union all select 'reviewer_id', reviewer_id from y where reviewer_id is not null group by reviewer_id having count(*) >= 0.02 * (select n from n)""",
    "p2_businesses": _profile_sql("business_id", "reviewer_id"),
    "p2_reviewers": _profile_sql("reviewer_id", "business_id"),
}
