"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that has a link; root is the smallest node reachable.

    Large-star ties every larger neighbour of a node to the smallest one, small-star ties
    the smaller ones; both are a grouped minimum and an equi-join, so no neighbourhood is
    gathered.  Each round is written to the shared folder; it ends when nothing changes."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    edges = written(links.where(F.col(a) != F.col(b)).select(hi.alias("u"), lo.alias("v")).distinct(), "cc")
    print_of = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    before = tuple(edges.agg(*print_of).first())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.where("u != v").distinct(), "cc")
        now = tuple(edges.agg(*print_of).first())
        if now == before:
            break
        before = now
    return edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
