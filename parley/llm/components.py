"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.storage import drop, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.withColumn("m", F.least(F.min("b").over(Window.partitionBy("a")), F.col("a")))
    return least.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger id ``a`` to the smaller id ``b``; all smaller ones are tied to the least."""
    least = edges.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return least.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a != b").distinct()


def _unfinished(edges: DataFrame) -> DataFrame:
    """Nodes that hang on several others, or on one that hangs itself."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("root")), F.struct(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("root")))).alias("e")).select("e.*")
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up + root > 1")


def components(edges: DataFrame) -> DataFrame:
    """node and root for every node of ``edges`` (a, b), root being the smallest node it reaches.

    Large-star and small-star steps alternate until every node hangs on its root and on nothing else.
    A node's edges are dealt by node, 16 bytes each, and sorted and spilled by Spark; no list of
    neighbours is built.  Every round is written to the shared folder.
    """
    now = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    kept = None
    while True:
        now = stored(_small_star(_large_star(now)), "edges")
        if kept is not None:
            drop(kept)
        kept = now
        if _unfinished(now).isEmpty():
            break
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
