"""Writers: feature tables, a metrics log with the latest value per key, coded bundles, checkpointed appends, DDL."""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

METRICS = "run_key string, path string, value string, at timestamp"


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    w = df.write.mode("overwrite").format(form)
    (w.option("header", True) if form == "csv" else w).save(path)


def flatten(doc: dict, at: str = "") -> list[tuple[str, str]]:
    out = []
    for k, v in doc.items():
        p = f"{at}.{k}" if at else k
        out += flatten(v, p) if isinstance(v, dict) else [(p, json.dumps(v))]
    return out


def log_metrics(spark: SparkSession, path: str, run_key: str, doc: dict) -> None:
    """Appends the leaves of `doc`; nothing is read or rewritten."""
    rows = [(run_key, p, v) for p, v in flatten(doc)]
    spark.createDataFrame(rows, "run_key string, path string, value string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """(run_key, path, value): the last logged value of each key."""
    return metrics.groupBy("run_key", "path").agg(F.max(F.struct("at", "value")).alias("x")).select("run_key", "path", "x.value")


def bundle(r: DataFrame, features: DataFrame) -> DataFrame:
    """Reviews with dense codes of reviewer and business, rating as byte, days since the first day, and features."""
    from plumbline.scratch import numbered

    def code(c: str) -> DataFrame:
        return numbered(r.select(c).distinct(), [c], "_n").select(c, (F.col("_n") - 1).cast("int").alias(f"{c}_code"))

    first = F.broadcast(r.agg(F.min("day").alias("_first")))  # one row
    x = r.join(code("u"), "u").join(code("b"), "b").crossJoin(first)
    return x.select("review_id", "u_code", "b_code", F.col("rating").cast("tinyint").alias("rating"), F.datediff("day", "_first").alias("date_days"), "y").join(features, "review_id", "left")


def append_new(df: DataFrame, path: str, key: list[str]) -> int:
    """Appends the rows whose key isn't in the table at `path` yet, each key once; how many. Running it again adds none."""
    from plumbline.sources.readers import existing

    spark = df.sparkSession
    df = df.dropDuplicates(key)
    if existing(spark, [path]):
        df = df.join(spark.read.parquet(path).select(*key), key, "left_anti")
    batch = f"{path}/batch={uuid.uuid4().hex}"
    df.write.parquet(batch)
    return spark.read.parquet(batch).count()


def create_reviews_table(spark: SparkSession, name: str = "reviews_store") -> None:
    """Creates the table if it isn't there; data are never touched."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (id BIGINT NOT NULL, text STRING NOT NULL, is_fake BOOLEAN NOT NULL, polarity STRING, fold STRING, hotel STRING, source_dataset STRING NOT NULL, generator STRING, category STRING, rating DOUBLE) USING parquet"
    )
