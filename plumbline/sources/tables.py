"""Reading of the Parquet tables of a data folder."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The table `name` of `folder`, only `columns` if any are given (pruned in the scan)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """The scan `df` as it is, or laid out anew by `key` if it has fewer partitions than there are cores.

    For work that is long per row: few or small files would leave most cores idle. `key` should have no hot value.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if df.rdd.getNumPartitions() < cores else df
