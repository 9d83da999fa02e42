"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    met = e.join(least, "u")
    return met.select(F.col("u"), F.col("m").alias("v")).unionByName(met.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: u, v. One row for each node that has an edge and isn't the smallest of its component: node, root."""
    e = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e, "edges")
    for _ in range(most_rounds):
        stars = e.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        if stars.filter("n > 1").isEmpty() and e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        e = written(_small_star(_large_star(e)), "edges")
    raise RuntimeError("the components did not settle")
