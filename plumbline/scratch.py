"""Intermediate tables in the folder that all executors share, and numbering of rows without a single-task window.

Iterative operators cut their lineage with `cut`: the frame is written as Parquet below the session's checkpoint
folder and read again, so a lost executor costs no more than the tasks of the step that was running.
"""
from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def folder(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`. Only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    if not (at := sc.getCheckpointDir()):
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            at = tempfile.mkdtemp(prefix="plumbline-")
            atexit.register(shutil.rmtree, at, ignore_errors=True)
        sc.setCheckpointDir(at)
        at = sc.getCheckpointDir() or at
    return at


#: Has an execution's shuffle files removed when it ends, not when the driver happens to collect its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, codec: str) -> DataFrame:
    spark = df.sparkSession
    at, was = f"{folder(spark)}/plumbline-{uuid.uuid4().hex}", spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", codec).parquet(at)
    finally:
        spark.conf.set(CLEAN, was)
    out = spark.read.schema(df.schema).parquet(at)
    out._plumbline_at = at
    return out


def cut(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """`df`, written to the shared folder and read again."""
    return _written(df, codec)


def counted(df: DataFrame, codec: str = "zstd") -> tuple[DataFrame, int]:
    """`cut` and the number of its rows, read off the files.

    Not by an Observation: a session that has used one can't ship a fitted logistic regression any more (Spark 4.1).
    """
    out = _written(df, codec)
    return out, out.count()


def forget(*frames: DataFrame | None) -> None:
    """Removes what `cut` wrote for these frames; nothing that is still to run may read them."""
    for df in frames:
        at = getattr(df, "_plumbline_at", None)
        if at:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """`df` (narrow rows) written and read again, marked for broadcast if it has no more than `rows` rows.

    Beyond that the mark is left off and the join shuffles as usual.
    """
    df, n = counted(df)
    if n > rows:
        return df
    out = F.broadcast(df)
    out._plumbline_at = df._plumbline_at
    return out


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """`df` with the place 1.. of each row in the order `order` as bigint `name`.

    Rows are range-partitioned and sorted; the place is the offset of the partition plus the place in it, so no task
    holds more than one range. `order` must end in a unique column, else the order of tied rows is any one.
    """
    s = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    # One row per partition: the window below is over that many rows.
    sizes = s.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    offset = sizes.withColumn("_o", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_o")
    return (
        s.withColumn("_p", part).join(F.broadcast(offset), "_p")
        .withColumn(name, F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
        .drop("_m", "_p", "_o")
    )
