"""Readers of the corpora a user brings: text archives, CSV files with odd headers, edge lists, caches, databases."""
from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CORPUS = "text string, is_fake boolean, polarity string, fold string, hotel string, source_dataset string, generator string, category string, rating double"


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of `paths` that exist, by Hadoop's file systems; missing ones are skipped."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            out.append(p)
    return out


def path_labels(df: DataFrame, path: str) -> DataFrame:
    """Adds is_fake, polarity, fold and hotel as the parts of a text file's path tell them; other paths are left out.

    .../<polarity>_polarity/<deceptive|truthful>_.../<fold>/<d|t>_<hotel>_<n>.txt
    """
    p = F.lower(F.col(path))
    hotel = F.regexp_extract(p, r"[a-z]_([a-z]+)_\d+\.txt$", 1)
    df = df.withColumn("is_fake", F.when(p.contains("/deceptive"), True).when(p.contains("/truthful"), False))
    df = df.withColumns({
        "polarity": F.when(p.contains("positive_polarity"), "positive").when(p.contains("negative_polarity"), "negative"),
        "fold": F.nullif(F.regexp_extract(p, r"/(fold\d+)/", 1), F.lit("")), "hotel": F.nullif(hotel, F.lit("")),
    })
    return df.filter(p.endswith(".txt") & F.col("is_fake").isNotNull())


def read_text_archive(spark: SparkSession, folder: str, source: str = "archive") -> DataFrame:
    """One row per labelled .txt file below `folder` (an unpacked archive)."""
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.trim("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    return path_labels(raw, "path").select("text", "is_fake", "polarity", "fold", "hotel", F.lit(source).alias("source_dataset"))


def labelled_csv(df: DataFrame, source: str) -> DataFrame:
    """(category, rating, label, text_) of generated reviews to the common columns: label CG is fake."""
    fake = F.col("label") == "CG"
    return df.select(
        F.trim("text_").alias("text"), fake.alias("is_fake"), F.col("category"), F.col("rating").cast("double").alias("rating"),
        F.when(fake, "language_model").otherwise("human").alias("generator"), F.lit(source).alias("source_dataset"),
    )


def read_labelled_csv(spark: SparkSession, path: str, source: str = "generated") -> DataFrame:
    return labelled_csv(spark.read.csv(path, header=True, multiLine=True, escape='"', schema="category string, rating double, label string, text_ string"), source)


def read_positional_csv(spark: SparkSession, path: str, names: list[str], types: str) -> DataFrame:
    """A CSV whose header is overridden by position."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', enforceSchema=True, schema=types).toDF(*names)


def tri_state(c: Column) -> Column:
    """1 true, 0 false, anything else (also NaN) unknown."""
    return F.when(c == 1, True).when(c == 0, False)


def read_campaign_csv(spark: SparkSession, path: str, renames: dict[str, str], label: str) -> DataFrame:
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=True)
    for a, b in renames.items():
        df = df.withColumnRenamed(a, b)
    return df.withColumn("is_fake", tri_state(F.col(label).cast("double")))


def read_corpora(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Union of those corpus CSVs that exist; columns a file lacks are null. No file gives no rows."""
    out = spark.createDataFrame([], CORPUS + ", prompt_style string, seed int")
    for p in existing(spark, paths):
        out = out.unionByName(spark.read.csv(p, header=True, multiLine=True, escape='"'), allowMissingColumns=True)
    return out


def read_edges(spark: SparkSession, edges: str, nodes: str) -> tuple[DataFrame, DataFrame]:
    """(rel, src, dst, weight) and the nodes of a supplied graph. Such graphs are not unions of cliques."""
    return spark.read.schema("rel string, src bigint, dst bigint, weight double").parquet(edges), spark.read.parquet(nodes)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet at `path`, made first if it isn't there."""
    if not existing(spark, [f"{path}/_SUCCESS"]):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1, **properties: str) -> DataFrame:
    """A database table, read in `parts` ranges of `key` if one is given."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**properties)
    if key:
        r = r.option("partitionColumn", key).option("lowerBound", str(bounds[0])).option("upperBound", str(bounds[1])).option("numPartitions", str(parts))
    return r.load()


def stage(url: str, to: str, opener=None) -> str:
    """Downloads `url` to the file `to` unless it is there; 120 s at most. Returns the path."""
    import shutil
    import urllib.request

    if not os.path.exists(to):
        os.makedirs(os.path.dirname(to) or ".", exist_ok=True)
        with (opener or urllib.request.urlopen)(url, timeout=120) as r, open(to + ".part", "wb") as f:
            shutil.copyfileobj(r, f)
        os.replace(to + ".part", to)
    return to
