"""Problem 4: splits that keep related records together.

Components of the graph between reviewers and businesses are the units. Their sizes are balanced by largest
differencing: sizes as a histogram (at most about sqrt(2 rows) different ones, whatever the data), of each size as many
components as divide evenly go to all bins alike, the rest is differenced pairwise from the largest on, and whole bins
then go to splits by what each split still lacks. A unit larger than its bin stays whole, so one giant component gives
its split more than its share; proportions hold for the rest as far as sizes allow.
"""
from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.operators.components import components
from plumbline.scratch import bounded, cut
from plumbline.sources.tables import table

BINS = 40
SALTS = 64


def differencing(sizes: dict[int, int], bins: int = BINS) -> list[dict[int, int]]:
    """For each bin, how many units of each size: k-way largest differencing over a histogram {size: units}."""
    out: list[dict[int, int]] = [{s: n // bins for s, n in sizes.items() if n // bins} for _ in range(bins)]
    tie = 0
    heap = []
    for s in sorted(sizes, reverse=True):
        for _ in range(sizes[s] % bins):
            # A partition: its bins by weight, heaviest first; only bins that hold something are listed.
            heap.append((-s, tie, [(s, {s: 1})]))
            tie += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        x, y = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        x = x + [(0, {})] * (bins - len(x))
        y = y + [(0, {})] * (bins - len(y))
        merged = []
        for (wa, ca), (wb, cb) in zip(x, reversed(y)):  # heaviest meets lightest
            c = dict(ca)
            for s, n in cb.items():
                c[s] = c.get(s, 0) + n
            merged.append((wa + wb, c))
        merged.sort(key=lambda p: -p[0])
        tie += 1
        heapq.heappush(heap, (-(merged[0][0] - merged[-1][0]), tie, merged))
    if heap:
        for i, (_, c) in enumerate(heap[0][2]):
            for s, n in c.items():
                out[i][s] = out[i].get(s, 0) + n
    return out


def allot(bins: list[dict[int, int]], shares: dict[str, float]) -> list[str]:
    """The split of each bin: the heaviest bin goes to the split that lacks most of its wanted weight."""
    weight = [sum(s * n for s, n in b.items()) for b in bins]
    whole, total = sum(shares.values()) or 1.0, sum(weight)
    lack = {k: v / whole * total for k, v in shares.items()}
    out = [""] * len(bins)
    for i in sorted(range(len(bins)), key=lambda i: (-weight[i], i)):
        k = max(sorted(lack), key=lack.get)
        out[i] = k
        lack[k] -= weight[i]
    return out


def assigned(units: DataFrame, shares: dict[str, float], bins: int = BINS) -> DataFrame:
    """(unit, split_role) of (unit bigint, size bigint). Deterministic; no units give no rows."""
    spark = units.sparkSession
    units = units.withColumn("salt", F.pmod(F.xxhash64("unit"), F.lit(SALTS)))
    # Histogram: bounded by the number of different sizes, which add up to no more than all rows.
    hist = {r["size"]: r["n"] for r in units.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = differencing(hist, bins)
    role = allot(parts, shares)
    spans, at = [], {s: 0 for s in hist}
    for i, b in enumerate(parts):
        for s, n in b.items():
            spans.append((s, at[s], at[s] + n, role[i]))
            at[s] += n
    # Bins of one split side by side: neighbouring spans of a size and role become one.
    merged: dict[tuple[int, str], int] = {}
    for s, lo, hi, k in spans:
        merged[s, k] = merged.get((s, k), 0) + hi - lo
    rows, at = [], {s: 0 for s in hist}
    for (s, k), n in sorted(merged.items()):
        rows.append((s, at[s], at[s] + n, k))
        at[s] += n
    plan = spark.createDataFrame(rows, "size bigint, lo bigint, hi bigint, split_role string")
    # Place of a unit among those of its size, salted: a size most units share is numbered by SALTS tasks.
    per = units.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("c"))
    before = per.withColumn("before", F.sum("c").over(Window.partitionBy("size").orderBy("salt")) - F.col("c")).select("size", "salt", "before")
    placed = (
        units.withColumn("i", F.row_number().over(Window.partitionBy("size", "salt").orderBy("unit")))
        .join(before, ["size", "salt"]).withColumn("i", F.col("i") + F.col("before") - 1)
    )
    return placed.join(plan, "size").filter("i >= lo and i < hi").select("unit", "split_role")


def _shares(spark: SparkSession, d: str) -> dict[str, float]:
    rows = table(spark, d, "split_plan", "split_role", "share").filter("split_role is not null").collect()  # a row per split
    return {r["split_role"]: float(r["share"] or 0.0) for r in rows}


#: Kinds of nodes, modulo 3: businesses, reviewers, rows that are bound to nothing.
BUSINESS, REVIEWER, ROW = range(3)


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """(review_id, node, other) of each row of `yelp`: the node it hangs on, and the one it binds to it (or the same)."""
    y = table(spark, d, "yelp", "review_id", "business_id", "reviewer_id").select(
        F.col("review_id").cast("bigint").alias("review_id"), (F.col("business_id").cast("bigint") * 3 + BUSINESS).alias("b"),
        (F.when(F.col("reviewer_id") != 0, F.col("reviewer_id")).cast("bigint") * 3 + REVIEWER).alias("r"),
    )
    y = y.withColumn("node", F.coalesce("b", "r", F.col("review_id") * 3 + ROW))
    return y.select("review_id", "node", F.coalesce(F.when(F.col("b").isNotNull(), F.col("r")), F.col("node")).alias("other"))


def allotted(rows: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(node, component, split_role) of every node of (node, other): components are the units that are balanced."""
    comp = cut(components(rows.select(F.col("node").alias("src"), F.col("other").alias("dst")).distinct()))
    # Rows per node first: a business that holds a third of the rows is one row before the join.
    size = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(comp, "node").groupBy("component").agg(F.sum("n").alias("size"))
    role = assigned(size.select(F.col("component").alias("unit"), "size"), shares)
    return comp.join(role, comp["component"] == role["unit"]).select("node", "component", "split_role")


def found(spark: SparkSession, d: str) -> DataFrame:
    """business_a, the least business that business_b must share its split with; only where it is smaller.

    Read off the units as they were allotted to splits: businesses of one unit have its split in common.
    """
    to = allotted(_rows(spark, d), _shares(spark, d)).filter(F.col("node") % 3 == BUSINESS)
    to = cut(to.select("component", "split_role", F.floor(F.col("node") / 3).cast("bigint").alias("b")))
    # A unit has one split, so this groups by unit; the split is there because the rows come out of the allotment.
    least = to.groupBy("component", "split_role").agg(F.min("b").alias("a"))
    return to.join(least, ["component", "split_role"]).filter("a < b").select(F.col("a").alias("business_a"), F.col("b").alias("business_b"))


def split(spark: SparkSession, d: str) -> DataFrame:
    """review_id, split_role of every review of `yelp`: rows of one reviewer or business are in one split.

    A row without a business goes with its reviewer; without both (null, or reviewer 0) it is a unit of its own.
    """
    y = _rows(spark, d)
    to = bounded(allotted(y, _shares(spark, d)).select("node", "split_role"))
    return y.select("review_id", "node").join(to, "node").groupBy("review_id").agg(F.min("split_role").alias("split_role"))


def generator_split(spark: SparkSession, d: str) -> DataFrame:
    """id, split_role of every record of `reviews`: records of one generator (case and blanks aside) are in one split.

    Records without a generator are units of their own.
    """
    r = table(spark, d, "reviews", "id", "generator").groupBy(F.col("id").cast("bigint").alias("id")).agg(F.min(F.lower(F.trim("generator"))).alias("gen"))
    # The hash of null is a number, not null.
    r = r.withColumn("unit", F.when(F.col("gen").isNotNull(), F.xxhash64("gen").bitwiseOR(F.lit(1))).otherwise(F.col("id") * 2))
    size = cut(r.groupBy("unit").agg(F.count(F.lit(1)).alias("size")))
    return r.join(assigned(size, _shares(spark, d)), "unit").select("id", "split_role")
