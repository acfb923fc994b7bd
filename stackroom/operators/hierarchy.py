"""Forests of collections: closure, paths, subtree scope, resolution of names. Cycles and missing
parents are tolerated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: Rounds after which a lineage is cut, by a table in the shared folder.
CUT_EVERY = 4


def closure(edges: DataFrame, node: str = "key", parent: str = "parent") -> DataFrame:
    """(ancestor, node) pairs, each node its own ancestor. Rounds join pairs with pairs, so that the
    number of rounds is the logarithm of the depth; a round without new pairs ends it."""
    step = edges.where(F.col(parent).isNotNull() & F.col(node).isNotNull()).select(F.col(parent).alias("ancestor"), F.col(node).alias("node")).distinct()
    pairs = staged(step.unionByName(edges.select(F.col(node).alias("ancestor"), F.col(node).alias("node"))).distinct(), "closure")
    before = -1
    while (now := pairs.count()) != before:
        before = now
        further = pairs.select("ancestor", F.col("node").alias("via")).join(pairs.select(F.col("ancestor").alias("via"), "node"), "via").select("ancestor", "node")
        pairs = staged(pairs.unionByName(further).distinct(), "closure")
    return pairs


def descendants(edges: DataFrame, roots: Sequence, node: str = "key", parent: str = "parent") -> DataFrame:
    """(node) of the subtrees of roots, level by level from the roots: only their trees are walked. A root
    that is no node has none."""
    links = edges.where(F.col(parent).isNotNull() & F.col(node).isNotNull()).select(F.col(parent).alias("up"), F.col(node).alias("node"))
    front = staged(edges.select(F.col(node).alias("node")).where(F.col("node").isin(list(roots))).distinct(), "level")
    found = front
    while not front.isEmpty():
        front = staged(links.join(front.select(F.col("node").alias("up")), "up", "left_semi").select("node").distinct().join(found, "node", "left_anti"), "level")
        found = found.unionByName(front)
    return found


def paths(nodes: DataFrame, node: str = "key", parent: str = "parent", name: str = "name") -> DataFrame:
    """(node, path): names from the root; a missing parent or a cycle shortens it. Rounds end when
    no path grows: each adds a level, and none repeats a node."""
    base = nodes.select(F.col(node).alias("__n"), F.col(parent).alias("__p"), F.col(name).alias("__t"))
    grown = nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"), F.array(F.col(name)).alias("path"), F.array(F.col(node)).alias("seen"))
    rounds, growing = 0, True
    while growing:
        joined = grown.join(base, (F.col("up") == F.col("__n")) & ~F.array_contains("seen", F.col("up")), "left")
        more = F.col("__n").isNotNull()
        grown = joined.select("node", F.when(more, F.col("__p")).alias("up"), F.when(more, F.concat(F.array("__t"), "path")).otherwise(F.col("path")).alias("path"), F.when(more, F.concat("seen", F.array("__n"))).otherwise(F.col("seen")).alias("seen"))
        rounds += 1
        if rounds % CUT_EVERY == 0:
            grown = staged(grown, "paths")
        growing = not grown.where("up IS NOT NULL").isEmpty()
    return grown.select("node", "path")


def in_subtree(items: DataFrame, membership: DataFrame, edges: DataFrame, root, item: str, collection: str, node: str = "key", parent: str = "parent", recursive: bool = True) -> DataFrame:
    """Items filed in a collection, or in any below it."""
    wanted = descendants(edges, [root], node, parent) if recursive else edges.where(F.col(node) == root).select(F.col(node).alias("node"))
    filed = membership.join(wanted, F.col(collection) == F.col("node"), "left_semi")
    return items.join(filed.select(item), item, "left_semi")


def resolve(nodes: DataFrame, specs: Sequence[str], node: str = "key", parent: str = "parent", name: str = "name") -> DataFrame:
    """(position, spec, matches, node): a spec is a key, else trailing path segments by lower case
    ('A/B'). node is null unless exactly one matches; the caller reports which."""
    spark = nodes.sparkSession
    wanted = spark.createDataFrame([(i, s) for i, s in enumerate(dict.fromkeys(specs))], "position int, spec string")
    known = paths(nodes, node, parent, name).withColumn("low", F.transform("path", F.lower))
    segments = F.transform(F.split(F.lower("spec"), "/"), F.trim)
    tail = F.slice("low", F.greatest(F.size("low") - F.size(segments) + 1, F.lit(1)), F.size(segments))
    by_key = wanted.join(known, F.col("spec") == F.col("node").cast("string")).select("position", "spec", "node", F.lit(0).alias("rank"))
    exploded = known.withColumn("last", F.element_at("low", -1))
    by_path = wanted.withColumn("last", F.element_at(segments, -1)).join(exploded, "last").where(tail == segments).select("position", "spec", "node", F.lit(1).alias("rank"))
    found = by_key.unionByName(by_path)
    best = found.groupBy("position").agg(F.min("rank").alias("rank"))
    found = found.join(best, ["position", "rank"]).groupBy("position").agg(F.count(F.lit(1)).alias("matches"), F.min("node").alias("only"))
    return wanted.join(found, "position", "left").select("position", "spec", F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("matches") == 1, F.col("only")).alias("node"))
