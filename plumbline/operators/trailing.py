"""Problem 6: totals over trailing periods by event-contribution deltas.

Reviews are summed to one row per entity and day first, so that a hot entity has no more rows than days. Each daily
amount then enters at its day and leaves `period` days later; running sums of these deltas over the days on which
anything changes are the trailing totals, constant until the next change. Only the last step lays the calendar over
these stretches, so days without activity cost no sorting.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.sources.tables import table

PERIODS = (7, 30)
MILLION = 1_000_000


def day_of(c: str) -> Column:
    """The day of a date in one of the notations 2021-02-03, 2021-02-03 04:05:06, 2/3/2021, Feb 3, 2021; else null.

    Where slashes occur the month comes first. Outer blanks don't matter.
    """
    t = F.trim(F.col(c))
    iso, us, word = r"^\d{4}-\d{1,2}-\d{1,2}", r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^([A-Za-z]{3})[a-z]*\.? (\d{1,2}), (\d{4})$"
    return F.coalesce(
        F.when(t.rlike(iso + r"([ T].*)?$"), F.try_to_timestamp(F.regexp_extract(t, iso, 0), F.lit("y-M-d"))),
        F.when(t.rlike(us), F.try_to_timestamp(t, F.lit("M/d/y"))),
        F.when(t.rlike(word), F.try_to_timestamp(F.concat_ws(" ", F.initcap(F.regexp_extract(t, word, 1)), F.regexp_extract(t, word, 2), F.regexp_extract(t, word, 3)), F.lit("MMM d y"))),
    ).cast("date")


def valid_reviews(meta: DataFrame) -> DataFrame:
    """(review_id, reviewer_id, business_id, rating, day): of each review the row loaded last.

    A review whose last row has no usable date (none, or later than the day it was loaded) is left out, as is a row
    without review_id. Of rows loaded at the same time the greatest counts. NaN ratings are null.
    """
    cols = ["rating", "date", "business_id", "reviewer_id"]
    last = meta.filter("review_id is not null").groupBy("review_id").agg(F.max(F.struct("loaded_at", *cols)).alias("r")).select("review_id", "r.*")
    last = last.withColumn("day", day_of("date")).filter("day is not null and (loaded_at is null or day <= to_date(loaded_at))")
    return last.select("review_id", "reviewer_id", "business_id", F.when(~F.isnan("rating"), F.col("rating")).alias("rating"), "day")


def stretches(reviews: DataFrame, entity: str, periods: tuple[int, ...] = PERIODS) -> DataFrame:
    """(entity, day, until, active, n_p, total_p in millionths, known_p for each period): totals that hold from `day` up to before
    `until`, within first and last review of the entity. Null entities are none."""
    r = reviews.select(F.col(entity).alias("_who"), "day", "rating").filter("_who is not null and day is not null")
    # Whole millionths: what is added and taken away again leaves nothing, whatever the amounts.
    daily = r.groupBy("_who", "day").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.round(F.col("rating") * MILLION).cast("bigint")), F.lit(0)).cast("bigint").alias("t"), F.count("rating").alias("k"))
    daily = daily.withColumn("_last", F.max("day").over(Window.partitionBy("_who")))
    names = [f"{x}_{p}" for p in periods for x in ("n", "total", "known")]

    def delta(at: int, sign_of) -> Column:
        vals = []
        for p in periods:
            s = sign_of(p)
            vals += [(F.col("n") * s).alias(f"n_{p}"), (F.col("t") * s).alias(f"total_{p}"), (F.col("k") * s).alias(f"known_{p}")]
        return F.struct(F.date_add("day", at).alias("_d"), *vals, F.lit(1 if at == 0 else 0).alias("active"))

    events = [delta(0, lambda p: 1)] + [delta(q, lambda p, q=q: -1 if p == q else 0) for q in periods]
    changes = (
        daily.select("_who", "_last", F.explode(F.array(*events)).alias("_e")).select("_who", "_last", "_e.*").filter("_d <= _last")
        .groupBy("_who", "_d").agg(F.max("_last").alias("_last"), F.max("active").alias("active"), *[F.sum(c).alias(c) for c in names])
    )
    w = Window.partitionBy("_who").orderBy("_d")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return changes.select(
        F.col("_who").alias(entity), F.col("_d").alias("day"), F.coalesce(F.lead("_d").over(w), F.date_add("_last", 1)).alias("until"), F.col("active"),
        *[F.sum(c).over(run).alias(c) for c in names],
    )


def calendar(s: DataFrame) -> DataFrame:
    """One row per day of each stretch; `active` only on the day it begins."""
    days = F.sequence("day", F.date_sub("until", 1))
    return s.withColumn("_start", F.col("day")).withColumn("day", F.explode(days)).withColumn("active", F.when(F.col("day") == F.col("_start"), F.col("active")).otherwise(0)).drop("_start", "until")


def rolling(reviews: DataFrame, entity: str, periods: tuple[int, ...] = PERIODS) -> DataFrame:
    """(entity, day, n_p, total_p, avg_p): every calendar day from first to last review of the entity.

    n counts reviews, total and avg their known ratings, to six places; avg is null where the period holds none.
    """
    c = calendar(stretches(reviews, entity, periods))
    out = []
    for p in periods:
        out += [F.col(f"n_{p}").cast("bigint").alias(f"n_{p}"), (F.col(f"total_{p}") / MILLION).alias(f"total_{p}"), F.round(F.try_divide(F.col(f"total_{p}") / MILLION, F.col(f"known_{p}")), 6).alias(f"avg_{p}")]
    return c.select(entity, "day", *out)


def _meta(spark: SparkSession, d: str) -> DataFrame:
    return valid_reviews(table(spark, d, "yelp_nyc_metadata", "review_id", "reviewer_id", "business_id", "rating", "date", "loaded_at"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """business_id, day of days without a review that end 7 days with at least 3 reviews and 60 % of those of 30 days."""
    s = stretches(_meta(spark, d), "business_id").filter("n_7 >= 3 and n_7 * 10 >= n_30 * 6")
    return calendar(s).filter("active = 0").select(F.col("business_id").cast("bigint").alias("business_id"), F.date_format("day", "yyyy-MM-dd").alias("day"))


def p6_businesses(spark: SparkSession, d: str) -> DataFrame:
    return rolling(_meta(spark, d), "business_id")


def p6_reviewers(spark: SparkSession, d: str) -> DataFrame:
    """Reviewer 0 is a closed account and no reviewer."""
    return rolling(_meta(spark, d).filter("reviewer_id <> 0"), "reviewer_id")


_VALID_SQL = r"""
with l as (select review_id, reviewer_id, business_id, rating, trim(date) date, loaded_at,
  row_number() over (partition by review_id order by loaded_at desc nulls last, rating desc nulls last, date desc nulls last, business_id desc nulls last, reviewer_id desc nulls last) i
  from yelp_nyc_metadata where review_id is not null),
 p as (select *, coalesce(try_cast(regexp_extract(date, '^\d{4}-\d{1,2}-\d{1,2}') as date), try_strptime(date, '%m/%d/%Y')::date, try_strptime(date, '%b %d, %Y')::date) as day from l where i = 1),
 v as (select review_id, nullif(reviewer_id, 0) reviewer_id, business_id, case when isnan(rating) then null else rating end rating, day from p where day is not null and (loaded_at is null or day <= loaded_at::date))"""


def _rolling_sql(entity: str) -> str:
    return _VALID_SQL + f""",
 a as (select {entity} e, day, count(*) n, coalesce(sum(rating), 0) t, count(rating) k from v where {entity} is not null group by 1, 2),
 s as (select e, unnest(generate_series(min(day)::timestamp, max(day)::timestamp, interval 1 day))::date as day from a group by e),
 f as (select s.e, s.day, coalesce(n, 0) n, coalesce(t, 0) t, coalesce(k, 0) k from s left join a on a.e = s.e and a.day = s.day)
select e {entity}, day, (sum(n) over w7)::bigint n_7, round(sum(t) over w7, 6) total_7, round(sum(t) over w7 / nullif(sum(k) over w7, 0), 6) avg_7,
 (sum(n) over w30)::bigint n_30, round(sum(t) over w30, 6) total_30, round(sum(t) over w30 / nullif(sum(k) over w30, 0), 6) avg_30
from f window w7 as (partition by e order by day rows 6 preceding), w30 as (partition by e order by day rows 29 preceding)"""


QUERIES = {"p6_found": p6_found, "p6_businesses": p6_businesses, "p6_reviewers": p6_reviewers}
SQL = {
    "p6_businesses": _rolling_sql("business_id"),
    "p6_reviewers": _rolling_sql("reviewer_id"),
    "p6_found": "with q as (" + _rolling_sql("business_id") + """), c as (select business_id, day, n_7, n_30, n_7 - lag(n_7, 1, 0) over (partition by business_id order by day) from q),
 act as (""" + _VALID_SQL + """ select distinct business_id, day from v where business_id is not null)
select c.business_id, strftime(c.day, '%Y-%m-%d') as day from c anti join act on act.business_id = c.business_id and act.day = c.day where n_7 >= 3 and n_7 * 10 >= n_30 * 6""",
}
