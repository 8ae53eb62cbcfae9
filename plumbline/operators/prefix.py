"""Running sums in a global or grouped order without a single-task window."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.scratch import cut


def cumulative(df: DataFrame, group: list[str], order: list, sums: dict[str, str]) -> DataFrame:
    """Adds {name: column} running sums (inclusive) within `group` in the order `order`, a list of sort columns.

    Rows are range-partitioned by group and order; a partition sums its own rows and adds what the partitions before it
    hold of the group, a table of partitions x groups. A group of any size spreads over partitions.
    """
    by = [F.col(g) for g in group]
    s = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    s = cut(s.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    part = s.groupBy(*group, "_p").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = part.select(*group, "_p", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums])
    own = Window.partitionBy(*group, "_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    s = s.select("*", *[F.sum(c).over(own).alias(f"_s_{n}") for n, c in sums.items()])
    out = s.join(F.broadcast(base), [*group, "_p"])
    return out.withColumns({n: F.col(f"_s_{n}") + F.col(f"_b_{n}") for n in sums}).drop("_p", "_i", *[f"_{x}_{n}" for n in sums for x in "sb"])


def quantiles(df: DataFrame, group: list[str], value: str, qs: list[float]) -> DataFrame:
    """(group, q, v): exact quantiles of `value` (numbers, no nulls) in each group, interpolated between neighbours.

    Values are counted first and ranked by a running sum over distinct values, so that no task holds those of a group;
    each distinct value then tells which of the wanted places it takes. A group without rows has none.
    """
    c = cumulative(df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c")), group, [F.col(value)], {"_upto": "_c"})
    total = c.groupBy(*group).agg(F.max("_upto").alias("_all"))
    c = c.join(total, group)
    low = lambda q: F.floor(q * (F.col("_all") - 1)).cast("bigint")
    mine = lambda at: (at >= F.col("_upto") - F.col("_c")) & (at < F.col("_upto"))
    above = lambda q: F.least(low(q) + 1, F.col("_all") - 1)
    hit = F.filter(F.array(*[F.lit(float(q)) for q in qs]), lambda q: mine(low(q)) | mine(above(q)))
    c = c.select(*group, F.col(value).cast("double").alias("_v"), "_c", "_upto", "_all", F.explode(hit).alias("q"))
    lo, hi = F.max(F.when(mine(low(F.col("q"))), F.col("_v"))), F.max(F.when(mine(above(F.col("q"))), F.col("_v")))
    part = F.first(F.col("q") * (F.col("_all") - 1) - low(F.col("q")))
    return c.groupBy(*group, "q").agg((lo + (hi - lo) * part).alias("v"))
