"""Connected components of an edge table, by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _with_least(pairs: DataFrame) -> DataFrame:
    """pairs with m, the least neighbour of u or u itself. The minimum is combined before the shuffle, and the join lets Spark split a hot u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("w")).select("u", "v", "m")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (u, v): root is the least node of the component.

    Self-loops and repeated edges are allowed; rows with a null end are ignored; an empty table gives an empty one. Each
    round is written to the shared folder, so lineage stays short; only counts reach the driver.
    """
    edges = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull()).select("u", "v").distinct()
    edges, before = materialise(edges, "edges"), None
    while True:
        large = _with_least(_both(edges)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _with_least(down)
        edges = materialise(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if before == now:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
