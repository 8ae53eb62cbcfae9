"""Problem 5: one ranking from several differently-scaled scores, by leximin order of percentiles.

The percentile of a value is the share of known values (null and NaN are unknown) that are no larger. It comes from
quantile marks of each score: rows between two marks are ranked in a window of their own, about a MARKS-th of the rows,
and values that are marks themselves (all heavy ties are) need only counts. An item's percentiles are sorted ascending
and items compared by that array, larger first, so that a weak score can't be hidden by strong ones; an unknown score
counts as UNKNOWN. Ties go to the lower review_id.
"""
from __future__ import annotations

import functools
import operator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.scratch import cut, numbered
from plumbline.sources.tables import table

SCORES = ("rating_deviation", "temporal_density_z", "user_extreme_ratio", "user_max_per_day")
MARKS, MOST_MARKS, ROWS_A_MARK = 256, 8192, 200_000
UNKNOWN, TOP = 0.5, 0.05


def records(spark: SparkSession, d: str) -> DataFrame:
    """review_id and scores, one row per review (stored twice: once); NaN becomes null."""
    g = table(spark, d, "graph_speagle", "review_id", *SCORES).filter("review_id is not null")
    known = [F.max(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(c) for c in SCORES]
    return g.groupBy(F.col("review_id").cast("bigint").alias("review_id")).agg(*known)


def percentiles(items: DataFrame, key: str, scores: tuple[str, ...]) -> DataFrame:
    """(key, s, n_known, n_larger) per score number s and known value of `items`."""
    n = min(MOST_MARKS, max(MARKS, items.count() // ROWS_A_MARK))
    qs = [i / n for i in range(1, n + 1)]
    row = items.agg(*[F.percentile_approx(c, qs, 10000).alias(c) for c in scores]).first()  # n numbers a score
    marks = {c: sorted({float(v) for v in row[c] or []}) for c in scores}
    # Unpivot; slot 2j+1 is the mark j itself, 2j the open interval before it.
    slotted = items.select(key, *scores, *[_slots(marks[c])(c).alias(f"slot_{i}") for i, c in enumerate(scores)])
    arrays = [F.struct(F.lit(i).alias("s"), F.col(c).alias("v"), F.col(f"slot_{i}").alias("slot")) for i, c in enumerate(scores)]
    long = cut(slotted.select(key, F.explode(F.array(*arrays)).alias("x")).select(key, "x.*").filter("v is not null"))
    # At most 2 n + 1 rows a score from here to `per`.
    per = long.groupBy("s", "slot").agg(F.count(F.lit(1)).alias("n"))
    down, whole = Window.partitionBy("s").orderBy(F.desc("slot")), Window.partitionBy("s")
    per = per.select("s", "slot", (F.sum("n").over(down) - F.col("n")).alias("above"), F.sum("n").over(whole).alias("n_known"))
    at_mark = F.col("slot") % 2 == 1
    w = Window.partitionBy("s", "slot").orderBy(F.desc("v"))
    ranked = long.filter(~at_mark).withColumn("within", F.rank().over(w) - 1).unionByName(long.filter(at_mark).withColumn("within", F.lit(0)))
    return ranked.join(F.broadcast(per), ["s", "slot"]).select(key, "s", "n_known", (F.col("above") + F.col("within")).alias("n_larger"))


def _slots(marks: list[float]):
    """A function of a column: 2j+1 if the value is mark j, 2j if it lies before mark j."""

    @F.pandas_udf("int")
    def slot(v: pd.Series) -> pd.Series:
        m, x = np.array(marks, np.float64), v.to_numpy(np.float64)
        return pd.Series(np.searchsorted(m, x, "left") + np.searchsorted(m, x, "right"), dtype="int32")

    return slot


def placed(items: DataFrame, key: str = "review_id", scores: tuple[str, ...] = SCORES) -> DataFrame:
    """key, for each score its n_known and n_larger (null if unknown): every item once."""
    items = cut(items.select(key, *scores))
    p = percentiles(items, key, scores)
    cols = [F.max(F.when(F.col("s") == i, F.col(x))).alias(f"{x}_{i}") for i in range(len(scores)) for x in ("n_known", "n_larger")]
    return items.select(key).join(p.groupBy(key).agg(*cols), key, "left")


def leximin(items: DataFrame, key: str = "review_id", scores: tuple[str, ...] = SCORES) -> DataFrame:
    """(key, v, n_known_i, n_larger_i): v holds the percentiles of an item ascending, its weakest score first."""
    p = placed(items, key, scores)
    each = [F.coalesce(1 - F.col(f"n_larger_{i}") / F.col(f"n_known_{i}"), F.lit(UNKNOWN)) for i in range(len(scores))]
    return p.withColumn("v", F.sort_array(F.array(*each)))


def found(spark: SparkSession, d: str) -> DataFrame:
    """review_id of reviews whose four scores are known and each in its top twentieth.

    That is the head of the leximin order, the items whose weakest percentile is in the top; counts in whole numbers then
    decide at its very edge, where a quotient may be rounded.
    """
    p = leximin(records(spark, d)).filter(F.col("v")[0] > 1 - TOP - 1e-9)
    top = functools.reduce(operator.and_, [F.col(f"n_larger_{i}") < TOP * F.col(f"n_known_{i}") for i in range(len(SCORES))])
    return p.filter(top).select("review_id")


def ranking(spark: SparkSession, d: str) -> DataFrame:
    """review_id, place (1 the most suspicious), weakest (the least percentile of its scores)."""
    p = leximin(records(spark, d)).select("review_id", "v")
    order = [F.col("v")[i].desc() for i in range(len(SCORES))] + [F.col("review_id").asc()]
    return numbered(p, order, "place").select("review_id", "place", F.round(F.col("v")[0], 6).alias("weakest"))
