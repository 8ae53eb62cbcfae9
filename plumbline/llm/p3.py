"""Problem 3: near-duplicate records with small edits (HyperMinHash banding, see neardup)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import neardup as N
from plumbline.sources.tables import spread, table

TABS = ("reviews", "yelp")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    one = lambda g, name, key: spread(table(spark, d, name, key, "text"), key).select(F.lit(g).alias("g"), F.lit(0).alias("side"), F.col(key).cast("bigint").alias("id"), "text")
    return one(0, "reviews", "id").unionByName(one(1, "yelp", "review_id"))


def _tab() -> F.Column:
    return F.when(F.col("g") == 0, TABS[0]).otherwise(TABS[1])


def near_pairs(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sketch table, verified pairs of classes) of (g, side, id, text)."""
    sk = N.sketched(texts)
    return sk, N.verified(sk, N.candidates(sk, across=False), texts)


def every(spark: SparkSession, d: str) -> DataFrame:
    """p3_found: every pair of nearly the same records within `reviews` or `yelp`, of copies too, however many there are.

    Texts of under 8 words and nulls never count.
    """
    sk, pairs = near_pairs(_texts(spark, d))
    return N.multiplied(sk, pairs).select(_tab().alias("tab"), "id_a", "id_b")


def found(spark: SparkSession, d: str, full: int = N.FULL) -> DataFrame:
    """The short form of `every`: classes of copies give all their pairs up to `full` of them, else a star; `groups` names
    the rest.
    """
    sk, pairs = near_pairs(_texts(spark, d))
    return N.expanded(sk, pairs, full=full).select(_tab().alias("tab"), "id_a", "id_b")


def groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per record that resembles another: tab, id, group_id (least id joined through links), n_links, n_copies,
    class_id. A record with several texts has a row for each that does, and joins what they resemble into one group.

    Records of one class_id have the same word sequence: where `found` gives a star of copies, it gives the other pairs. n_links counts the other classes of texts linked directly, n_copies the records with the same word sequence.
    """
    from plumbline.operators.components import components

    sk, pairs = near_pairs(_texts(spark, d))
    both = pairs.select(F.col("fa").alias("fp"), F.col("fb").alias("o")).unionByName(pairs.select(F.col("fb").alias("fp"), F.col("fa").alias("o")))
    links = both.groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    own = N.several(sk).select(F.explode("fps").alias("src"), F.array_min("fps").alias("dst"))
    comp = components(pairs.select(F.col("fa").alias("src"), F.col("fb").alias("dst")).unionByName(own))
    c = N.classes(sk)
    size = c.groupBy("fp").agg(F.count(F.lit(1)).alias("n_copies"))
    rows = (
        c.join(size, "fp").join(links, "fp", "left").join(comp.select(F.col("node").alias("fp"), "component"), "fp", "left")
        .filter("n_copies > 1 or n_links is not null").withColumn("component", F.coalesce("component", "fp"))
    )
    lead = rows.groupBy("g", "component").agg(F.min("id").alias("group_id"))
    return rows.join(lead, ["g", "component"]).select(_tab().alias("tab"), "id", "group_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "n_copies", F.col("fp").alias("class_id"))
