"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import merged, remove, written


def _sum(edges: DataFrame) -> tuple:
    """Count and an order-free digest of an edge set."""
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The step's edges, and the table that they are read from."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return merged(both.filter("v > u"), least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a != b").distinct(), least


def _small_star(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(e.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = merged(e, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct(), least


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge to another one; root is the
    least node of its component.

    ``edges`` has columns a and b of one orderable type. Large-star and
    small-star steps alternate until nothing changes; each round is written to
    the shared folder, so that a lost executor costs a reread. The least
    neighbour is found by a pre-aggregated minimum and read from a table when it
    is joined, so that Spark can split a node that has very many neighbours.
    """
    now = written(edges.select("a", "b").filter("a != b").distinct(), "edges")
    state = _sum(now)
    while state[0]:
        large, of_large = _large_star(now)
        small, of_small = _small_star(large)
        stars = written(small, "stars")
        new = _sum(stars)
        for spent in (now, of_large, of_small):
            remove(spent)
        now = stars
        if new == state:
            break
        state = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
