"""Weekly review counts as a stream, an extension: the tables' analyses are batch.

Windows of seven days from Monday, late rows up to the watermark; the z-score needs a business's whole history and is
left to the batch operator, over what the stream has written.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

LATE = "30 days"


def weekly_counts(stream: DataFrame, business: str, ts: str, late: str = LATE) -> DataFrame:
    """(b, week, n) of a stream (or a table) of reviews; rows without business or time don't count."""
    s = stream.select(F.col(business).alias("b"), F.col(ts).cast("timestamp").alias("ts")).filter("b is not null and ts is not null")
    s = s.withWatermark("ts", late) if s.isStreaming else s
    return s.groupBy("b", F.window("ts", "7 days", "7 days", "4 days").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("b", F.to_date("w.start").alias("week"), "n")


def run_once(spark: SparkSession, folder: str, schema: str, business: str, ts: str, out: str, checkpoint: str) -> None:
    """Reads what is new in a folder of Parquet files, updates the counts, and writes the finished weeks to `out`."""
    src = spark.readStream.schema(schema).parquet(folder)
    q = weekly_counts(src, business, ts).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def batch_query(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.sources.tables import table

    return weekly_counts(table(spark, d, "events", "event_type", "ts"), "event_type", "ts")


QUERIES = {"st01_weekly_windows": batch_query}
SQL = {"st01_weekly_windows": "select event_type b, date_trunc('week', ts)::date as week, count(*) n from events where event_type is not null and ts is not null group by 1, 2"}
