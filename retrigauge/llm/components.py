"""Connected components by contraction, with DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import merged, written


def _jumped(parents: DataFrame, n: int) -> DataFrame:
    """parents(node, root) of n rows at most with every pointer followed to its end; each round doubles the reach."""
    while True:
        up = merged(parents.select(F.col("node").alias("root"), F.col("root").alias("top")), n)
        step = parents.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.coalesce(F.col("top") != F.col("root"), F.lit(False)).alias("moved"))
        step = written(step, "jump")
        moved = step.where("moved").limit(1).count()
        parents = step.select("node", "root")
        if not moved:
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); the component is its least node.

    Each round every node points to its least neighbour (or itself), the pointers are followed to
    their ends, and the edges are rewritten between those ends; rounds go on until no edge is left.
    Repeated edges, loops, nulls (ignored) and empty input are allowed.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null")
    both = written(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    total, n = None, both.count()  # of files in Parquet: their footers are read; there are n nodes at most
    while True:
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root"))
        parents = _jumped(written(least, "least"), n)
        if total is None:
            total = parents
        else:
            up = merged(parents.select(F.col("node").alias("root"), F.col("root").alias("top")), n)
            total = written(total.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "total")
        left = merged(parents.select(F.col("node").alias("a"), F.col("root").alias("ra")), n)
        right = merged(parents.select(F.col("node").alias("b"), F.col("root").alias("rb")), n)
        both = written(both.join(left, "a").join(right, "b").where("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        n = both.count()
        if not n:
            return total.select("node", F.col("root").alias("component"))
