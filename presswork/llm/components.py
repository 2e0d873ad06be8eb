"""Connected components of a graph of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import checkpointed, staged


def _min_neighbour(edges: DataFrame) -> DataFrame:
    """Each vertex u with the least of itself and its neighbours v. A vertex of many edges is reduced map-side."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # staged, so that the edges of a vertex with very many are an input that Spark can split
    return both.join(staged(_min_neighbour(both)), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges with v < u: all smaller neighbours of u, and u, go to the least of them."""
    least = staged(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each vertex has one edge at most to a smaller one, and that one has none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    per = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return per.where("out > 1 or (out = 1 and into = 1)").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, comp) for each vertex that has a link: comp is the least vertex that can be reached from it.

    Links from a vertex to itself, repeated links and links with a null end are ignored. Each round of two
    contractions is checkpointed; there are about as many rounds as the logarithm of the longest path.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} <> {b}").distinct()
    edges = checkpointed(edges)
    while not _settled(edges):
        edges = checkpointed(_small_star(checkpointed(_large_star(edges))))
    roots = edges.select(F.col("v").alias("v"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("v"), F.col("v").alias("comp")).unionByName(roots)
