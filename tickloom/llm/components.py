"""Connected components by alternating star contraction, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.llm.text import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of edges (a, b) with a > b: the neighbours of each vertex are tied to its least one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = both.join(least, "a")
    out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else (
        tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) of edges (a, b): the root is the least vertex of the component; only vertices with an edge to another appear.

    Each round at least halves what is left to contract in practice; rounds end when the edges no longer change.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == state or not sums[0]:
            break
        state = tuple(sums)
        now = stored(_stars(_stars(now, True), False), "edges")
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct())
