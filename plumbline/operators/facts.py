"""The fact table of reviews that the analytical operators work on.

`facts` holds one row per review: its row loaded last, with a usable date, a rating, a known reviewer and business.
u reviewer, b business, y 1 if the review was filtered as fake, 0 if not, null if unlabelled; k_rur, k_rsr, k_rtr are the
keys of the relations same reviewer, same business and rating, and those in the same week. Relations are unions of
cliques, so a key stands for all their edges and no edge is made unless asked for.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.operators.trailing import day_of
from plumbline.sources.tables import table

RELATIONS = ("rur", "rsr", "rtr")


def facts(spark: SparkSession, d: str, labelled: bool = True) -> DataFrame:
    cols = ["rating", "date", "business_id", "reviewer_id", "label"]
    m = table(spark, d, "yelp_nyc_metadata", "review_id", "loaded_at", *cols).filter("review_id is not null")
    m = m.withColumn("date", F.trim("date")).groupBy("review_id").agg(F.max(F.struct("loaded_at", *cols)).alias("r")).select("review_id", "r.*")
    m = m.withColumn("day", day_of("date")).filter(
        "day is not null and (loaded_at is null or day <= to_date(loaded_at)) and rating is not null and not isnan(rating) and business_id is not null and reviewer_id <> 0"
    )
    r = m.select(
        "review_id", F.col("reviewer_id").alias("u"), F.col("business_id").alias("b"), "rating", "day",
        F.when(F.col("label") == -1, 1).when(F.col("label").isNotNull(), 0).alias("y"),
    )
    return keyed(r.filter("y is not null") if labelled else r)


def keyed(r: DataFrame) -> DataFrame:
    """Adds week (its Monday) and the keys of the relations."""
    stars = (F.col("rating") * 10).cast("int")
    week = F.to_date(F.date_trunc("week", "day"))
    return r.withColumn("week", week).withColumns({
        "k_rur": F.col("u").cast("string"), "k_rsr": F.concat_ws("|", "b", stars), "k_rtr": F.concat_ws("|", "b", stars, week.cast("string")),
    })


def beside(r: DataFrame, key: str | list[str], *aggs: Column) -> DataFrame:
    """`r` with aggregates over the rows of its `key` beside each row. Rows with a null key go.

    Sums per task, one row per key, then a join, whose hot keys the engine splits; a window would sort all rows of a key
    in one task.
    """
    return r.join(r.groupBy(key).agg(*aggs), key)


_ALL = r"""
l as (select review_id, reviewer_id, business_id, rating, label, trim(date) date, loaded_at,
  row_number() over (partition by review_id order by loaded_at desc nulls last, rating desc nulls last, trim(date) desc nulls last, business_id desc nulls last, reviewer_id desc nulls last, label desc nulls last) i
  from yelp_nyc_metadata where review_id is not null),
p as (select *, coalesce(try_cast(regexp_extract(date, '^\d{4}-\d{1,2}-\d{1,2}') as date), try_strptime(date, '%m/%d/%Y')::date, try_strptime(date, '%b %d, %Y')::date) as day from l where i = 1),
ra as (select review_id, reviewer_id u, business_id b, rating, day, case when label = -1 then 1 when label is not null then 0 end y, date_trunc('week', day)::date as week,
  reviewer_id::varchar k_rur, business_id || '|' || (rating * 10)::int k_rsr, business_id || '|' || (rating * 10)::int || '|' || date_trunc('week', day)::date k_rtr
  from p where day is not null and (loaded_at is null or day <= loaded_at::date) and rating is not null and not isnan(rating) and business_id is not null and reviewer_id <> 0),
r as (select * from ra where y is not null)"""


def sql(body: str, *ctes: str) -> str:
    """`body` over r (labelled facts), ra (all of them) and further CTEs."""
    return "with" + ",\n".join([_ALL, *ctes]) + "\n" + body
