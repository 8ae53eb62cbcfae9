"""Connected components by contraction; only edges and labels move, never a neighbour list.

Each round every node joins the neighbour (or itself) of least priority, a hash that changes with the round; the graph
of what is left is made of the distinct edges between the targets. A round leaves at most a constant share of the nodes
in expectation, whatever the shape, so rounds grow with the logarithm of the nodes. A hub costs one partial
aggregation (a minimum) and joins whose other side has one row per node; AQE splits the hub's rows. Once no more than
LOCAL edges are left, counted when they are written, one task joins the rest.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.scratch import counted, cut, forget

MAX_ROUNDS = 60
SMALL = 500_000  # rows of two numbers that may be broadcast
LOCAL = 200_000  # edges of two numbers that one task may hold (some MB)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, t) of at most LOCAL edges: each node and one of its component, the same for all of it."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y]
            x = y
        return x

    for b in batches:
        for x, y in zip(b.column("src").to_pylist(), b.column("dst").to_pylist()):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    v = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array([find(x) for x in v], pa.int64())], ["v", "t"])


def _prio(c: Column, r: int) -> Column:
    return F.struct(F.xxhash64(c, F.lit(r)).alias("h"), c.alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected (src, dst) bigint edges; component is the least node. Null ends bind nothing.

    A self-loop makes its node a component. Repeated edges are harmless; no edges give no rows.
    """
    e = edges.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")).filter("src is not null and dst is not null")
    e, n = counted(e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    steps: list[DataFrame] = []  # (v, t): where the nodes that were left in a round went; ever fewer
    for r in range(MAX_ROUNDS):
        if n <= LOCAL:
            steps.append(cut(e.coalesce(1).mapInArrow(_joined, "v bigint, t bigint")))
            break
        ends = e.select(F.col("src").alias("v"), _prio(F.col("dst"), r).alias("p")).unionByName(e.select(F.col("dst").alias("v"), _prio(F.col("src"), r).alias("p")))
        # In the first round loops name their node; later there are none.
        target = ends.groupBy("v").agg(F.min("p").alias("p")).withColumn("p", F.least("p", _prio(F.col("v"), r)))
        target, nodes = counted(target.select("v", F.col("p.v").alias("t")))
        steps.append(target)
        side = F.broadcast(target) if nodes <= SMALL else target
        left, n = counted(
            e.join(side.select(F.col("v").alias("src"), F.col("t").alias("s")), "src")
            .join(side.select(F.col("v").alias("dst"), F.col("t").alias("d")), "dst")
            .filter("s <> d").select(F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst")).distinct()
        )
        forget(e)
        e = left
    else:
        raise RuntimeError(f"components did not end within {MAX_ROUNDS} rounds")
    # From the last step back: a step's targets either went on in the next one or stayed.
    label = steps.pop()
    while steps:
        up, step = label.select(F.col("v").alias("t"), F.col("t").alias("end")), steps.pop()
        nxt = cut(step.join(up, "t", "left").select("v", F.coalesce("end", "t").alias("t")))
        forget(label, step)
        label = nxt
    least = label.groupBy("t").agg(F.min("v").alias("component"))
    return label.join(least, "t").select(F.col("v").alias("node"), "component")
