"""Problem 8: filling containers of fixed capacity by minimum bin slack.

Lengths are at most the capacity, so what is available is a histogram of at most CAPACITY counts, whatever the corpus.
For one container after the other a subset-sum program over bitsets (bit k: fill k is reachable) finds the fullest
combination that holds the longest length left, and takes it as often as the histogram allows; each combination uses up
a length, so there are at most CAPACITY of them. Items are then numbered within their length and read off their
container. An item longer than a container is cut into whole containers and a rest; no other item is cut.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.llm import bpe
from plumbline.scratch import cut
from plumbline.sources.tables import spread, table

CAPACITY, SALTS = 1024, 64


def combination(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest {length: times} within `capacity` that holds the greatest length; more of the long ones first."""
    top = max(counts)
    left = capacity - top
    mask = (1 << (left + 1)) - 1
    layers, reach = [], 1
    for l in sorted((l for l in counts if l <= left), reverse=True):
        n = min(counts[l] - (l == top), left // l)
        k = 1
        while n > 0:  # times l, in powers of two
            take = min(k, n)
            layers.append((l, take, reach))
            reach |= (reach << (l * take)) & mask
            n -= take
            k *= 2
        if reach >> left & 1:
            break
    fill = reach.bit_length() - 1
    out = {top: 1}
    for l, take, before in reversed(layers):
        if not before >> fill & 1:
            out[l] = out.get(l, 0) + take
            fill -= l * take
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """[(containers, combination)] that uses up `counts` {length: items}."""
    left, out = dict(counts), []
    while left:
        c = combination(left, capacity)
        times = min(left[l] // n for l, n in c.items())
        out.append((times, c))
        for l, n in c.items():
            left[l] -= n * times
            if not left[l]:
                del left[l]
    return out


def pieces(sizes: DataFrame, key: str, capacity: int) -> DataFrame:
    """(key, piece, length): each item once, or its whole containers and its rest if it is larger than one."""
    last = F.greatest(F.lit(0), F.ceil(F.col("size") / capacity) - 1).cast("int")
    p = sizes.select(key, "size", last.alias("_last"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return p.select(key, "piece", F.when(F.col("piece") < F.col("_last"), capacity).otherwise(F.col("size") - F.col("_last") * capacity).cast("int").alias("length"))


def packed(sizes: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, length, container) of (key, size); containers count from 0. Items of size 0 go to container 0."""
    spark = sizes.sparkSession
    p = cut(pieces(sizes, key, capacity).withColumn("_salt", F.pmod(F.xxhash64(key, "piece"), F.lit(SALTS))))
    per = p.filter("length > 0").groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("c"))
    hist = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("c").alias("n")).collect()}  # at most `capacity` rows
    rows, used, bins = [], {l: 0 for l in hist}, 0
    for times, c in plan(hist, capacity):
        for l, n in c.items():
            rows.append((l, used[l], used[l] + n * times, n, bins))
            used[l] += n * times
        bins += times
    spans = spark.createDataFrame(rows, "length int, lo bigint, hi bigint, n int, bin bigint")
    before = per.withColumn("_b", F.sum("c").over(Window.partitionBy("length").orderBy("_salt")) - F.col("c")).select("length", "_salt", "_b")
    # A length that many items share is numbered by SALTS tasks.
    placed = (
        p.filter("length > 0").withColumn("_i", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(key, "piece")))
        .join(before, ["length", "_salt"]).withColumn("_i", F.col("_i") + F.col("_b") - 1)
    )
    # At most capacity combinations of lengths that add up to capacity: bounded whatever the corpus.
    full = placed.join(F.broadcast(spans), "length").filter("_i >= lo and _i < hi")
    container = (F.col("bin") + F.floor((F.col("_i") - F.col("lo")) / F.col("n"))).cast("bigint")
    return full.select(key, "piece", "length", container.alias("container")).unionByName(p.filter("length = 0").select(key, "piece", "length", F.lit(0).cast("bigint").alias("container")))


def sizes(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encoded(spread(table(spark, d, "documents", "doc_id", "text"), "doc_id"), "doc_id", "text", sizes=True)


def containers(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, piece, length, container of every document; null and empty texts have length 0."""
    return packed(sizes(spark, d), "doc_id")


def found(spark: SparkSession, d: str) -> DataFrame:
    """doc_id of documents that are larger than one container: those that `packed` had to cut."""
    return containers(spark, d).filter("piece = 1").select("doc_id")
