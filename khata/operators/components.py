"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.lineage import cut


def _mark(edges: DataFrame) -> tuple:
    """Two tables of distinct edges with the same mark are the same."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node points its larger neighbours at the least node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node points itself and its smaller neighbours at the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    pointed = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return pointed.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); the component is its least node.

    Edges that stand alone are components as they are. The others go through alternating large and small stars, which
    end after a number of rounds that grows with the logarithm of the longest chain; a hub only ever meets its least neighbour.
    """
    edges = cut(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    shared = ends.groupBy("node").count().filter("count > 1").select("node")
    met = edges.join(shared.select(F.col("node").alias("a"), F.lit(True).alias("_a")), "a", "left").join(
        shared.select(F.col("node").alias("b"), F.lit(True).alias("_b")), "b", "left")
    met = cut(met.withColumn("meets", F.coalesce("_a", "_b", F.lit(False))).select("a", "b", "meets"), "edges-met")
    stars = met.filter("NOT meets").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    tangled = met.filter("meets").select("a", "b")
    mark = _mark(tangled)
    while mark[0]:
        tangled = cut(_small_star(_large_star(tangled)), "stars")
        before, mark = mark, _mark(tangled)
        if mark == before:
            break
    stars = stars.unionByName(tangled)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
