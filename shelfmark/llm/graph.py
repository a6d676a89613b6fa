"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import forget, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


#: Tasks over which the neighbours of one node are spread.
SALTS = 16


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges with m of their node a.  A star's centre has a row for every node of it, so rows
    are salted and least, which has one row a node, is repeated for each salt."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    each = least.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    # Merged, as least grows with the corpus: never broadcast on an estimate.
    return salted.join(each.hint("merge"), ["a", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the least of its neighbours."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _with_least(both.where("b > a"), least).select(F.col("b").alias("x"), "m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour, and the node itself, is linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = _with_least(down, least).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) of the nodes of edges (a, b), a component being its least node.

    Each round hangs nodes on the least node they know, so a component becomes a star
    within a few rounds (the square of the logarithm of its size at most).  Rounds are
    cut by written tables; nothing is collected but two numbers.  Loops, repeated edges
    and rows with a null are ignored; no edges give no rows.
    """
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(most):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen or not mark.n:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = mark
        before, now = now, written(_small_star(_large_star(now)), "edges")
        forget(before)
    raise RuntimeError(f"components did not settle within {most} rounds")
