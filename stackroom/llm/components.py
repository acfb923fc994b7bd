"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, least of u and all its v). Grouping combines in the map tasks. The least, one
    row per node, are dealt by a hash of their node, so that the join back has an exchange on both sides: AQE
    splits skewed keys of such joins, but not of one that takes the grouping's partitions as they are."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    least = least.repartition(F.xxhash64("w"))
    return edges.join(least, F.col("u") == F.col("w")).drop("w")


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """links (a, b), longs, -> (node, component): component is the least node reachable. Only
    nodes with a link to another node appear; nulls and self links are ignored."""
    edges = shared_table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_least(large)  # here v < u always
        hooked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = shared_table(hooked.where("u <> v").distinct(), label)
        after = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = after
