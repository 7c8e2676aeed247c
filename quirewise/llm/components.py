"""Connected components by large-star and small-star rounds, as DataFrames.

Every round halves the depth of the trees; links stay on the executors, and each round is written
to the shared folder, so lineage stays short.  A node with very many links costs a row for each
link and no list: its neighbours meet in an aggregate and a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each linked node but the root; root is the least node.  links: (a, b), any order, any repeats."""
    edges = written(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    for _ in range(MOST_ROUNDS):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if not now[0] or now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
        edges = written(_small_star(_large_star(edges)), "links")
    raise RuntimeError("components do not settle")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node gets the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, get the node's least neighbour.  u > v in each edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
