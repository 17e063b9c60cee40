"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import attach
from .common import saved


def _pulled(edges: DataFrame) -> DataFrame:
    """Edges (node, other) with the least of the node and its neighbours; hubs are split over tasks."""
    stars = edges.groupBy("node").agg(F.min("other").alias("least"), F.count("*").alias("n"))
    return attach(edges, stars.select("node", F.least("least", "node").alias("least")), ["node"], "inner",
                  stars.select("node", "n"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): the root is the least node of its component.

    Edges stay rows of a table that each round writes anew; nothing of them passes through the driver but two sums.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    now = saved(edges.select(least.alias("root"), most.alias("node")).where("root <> node").distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("root", "node").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        both = now.select("node", F.col("root").alias("other")).unionByName(now.select(F.col("root").alias("node"), F.col("node").alias("other")))
        # Written, as the second half reads it over and over: the driver plans and tracks one half at a time.
        large = saved(_pulled(both).where("other > node").select(F.col("other").alias("node"), F.col("least").alias("other")).distinct(), "large")
        small = _pulled(large)
        now = saved(small.select(F.col("least").alias("root"), F.explode(F.array("node", "other")).alias("node"))
                    .where("root <> node").distinct(), "edges")
        last, seen = seen, mark(now)
        if last == seen:
            break
    return now.select("node", "root").unionByName(now.select(F.col("root").alias("node"), "root").distinct())
