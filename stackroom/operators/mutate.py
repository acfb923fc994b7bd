"""Changes of item tables as new tables: nothing is written in place."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import edit_lines
from .hierarchy import descendants

EMPTY = "array<string>"


def update_tags(items: DataFrame, selected: Column, tags: str, add: Sequence[str] = (), remove: Sequence[str] = ()) -> DataFrame:
    """items with tags added and removed on the selected rows, and changed."""
    own = F.coalesce(F.col(tags), F.array().cast(EMPTY))
    new = F.array_except(F.array_union(own, F.array(*map(F.lit, add)).cast(EMPTY)), F.array(*map(F.lit, remove)).cast(EMPTY))
    out = items.withColumn("__new", F.when(selected, new).otherwise(own))
    return out.withColumn("changed", F.col("__new") != own).withColumn(tags, F.col("__new")).drop("__new")


def tag_counts(before: DataFrame, selected: Column, tags: str, add: Sequence[str] = (), remove: Sequence[str] = ()) -> DataFrame:
    """(tag, action, n): how many selected rows a change touches."""
    spark = before.sparkSession
    wanted = spark.createDataFrame([*[(t, "add") for t in add], *[(t, "remove") for t in remove]], "tag string, action string")
    rows = before.where(selected).select(F.coalesce(F.col(tags), F.array().cast(EMPTY)).alias("__t"))
    touched = [F.count(F.when(F.array_contains("__t", t) == (a == "remove"), 1)).alias(f"c{i}") for i, (t, a) in enumerate([*[(t, "add") for t in add], *[(t, "remove") for t in remove]])]
    counted = rows.agg(F.array(*touched).alias("n")) if touched else rows.limit(0).select(F.array().cast("array<bigint>").alias("n"))
    numbered = counted.select(F.posexplode("n").alias("i", "n"))
    names = spark.createDataFrame([(i, *x) for i, x in enumerate([*[(t, "add") for t in add], *[(t, "remove") for t in remove]])], "i int, tag string, action string") if touched else wanted.withColumn("i", F.lit(0))
    return numbered.join(names, "i").select("tag", "action", "n")


def edit_extra(items: DataFrame, selected: Column, extra: str, set_keys: Mapping[str, str] | None = None, remove_keys: Sequence[str] = (), replace: bool = False) -> DataFrame:
    """items with 'key: value' lines set and removed on the selected rows, and changed."""
    new = F.when(selected, edit_lines(F.col(extra), dict(set_keys or {}), list(remove_keys), replace)).otherwise(F.col(extra))
    return items.withColumn("__new", new).withColumn("changed", ~F.col("__new").eqNullSafe(F.col(extra))).withColumn(extra, F.col("__new")).drop("__new")


def patch(items: DataFrame, key: str, value, fields: Mapping[str, object]) -> DataFrame:
    """items with fields of one row replaced."""
    return items.withColumns({f: F.when(F.col(key) == value, F.lit(v)).otherwise(F.col(f)) for f, v in fields.items()})


def trash(items: DataFrame, bin_: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The trash with the keys of items that exist and aren't in it yet."""
    new = items.join(keys.select(key).distinct(), key, "left_semi").select(key).join(bin_.select(key), key, "left_anti")
    return bin_.unionByName(new, allowMissingColumns=True)


def file_items(membership: DataFrame, pairs: DataFrame, item: str, collection: str) -> DataFrame:
    """The membership table with pairs added, each once."""
    return membership.select(item, collection).unionByName(pairs.select(item, collection)).distinct()


def unfile_items(membership: DataFrame, pairs: DataFrame, item: str, collection: str) -> DataFrame:
    return membership.join(pairs.select(item, collection), [item, collection], "left_anti")


def create_node(nodes: DataFrame, row: Mapping[str, object]) -> DataFrame:
    return nodes.unionByName(nodes.sparkSession.createDataFrame([tuple(row.get(c) for c in nodes.columns)], nodes.schema))


def move_node(nodes: DataFrame, key: str, parent: str, value, new_parent) -> DataFrame:
    """nodes with another parent for one; the caller checks that it is not below itself."""
    return nodes.withColumn(parent, F.when(F.col(key) == value, F.lit(new_parent).cast(dict(nodes.dtypes)[parent])).otherwise(F.col(parent)))


def delete_nodes(nodes: DataFrame, membership: DataFrame, roots: Sequence, key: str, parent: str, collection: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, membership) without the roots and all below them; the items filed there stay."""
    gone = descendants(nodes, roots, key, parent).select(F.col("node").alias("__gone"))
    return nodes.join(gone, F.col(key) == F.col("__gone"), "left_anti"), membership.join(gone, F.col(collection) == F.col("__gone"), "left_anti")


def reparent(children: DataFrame, moves: DataFrame, parent: str, new_parent: str) -> DataFrame:
    """children with the parents that moves (parent, new_parent) gives; others stay."""
    return children.join(moves.select(parent, new_parent), parent, "left").withColumn(parent, F.coalesce(new_parent, parent)).drop(new_parent)


def add_relations(edges: DataFrame, pairs: DataFrame, a: str = "src", b: str = "dst", predicate: str = "predicate") -> DataFrame:
    """edges with pairs in both directions, each once."""
    back = pairs.select(F.col(b).alias(a), predicate, F.col(a).alias(b))
    return edges.select(a, predicate, b).unionByName(pairs.select(a, predicate, b)).unionByName(back).distinct()


def remove_relations(edges: DataFrame, pairs: DataFrame, a: str = "src", b: str = "dst", predicate: str = "predicate", both: bool = True) -> DataFrame:
    gone = pairs.select(a, predicate, b)
    if both:
        gone = gone.unionByName(pairs.select(F.col(b).alias(a), predicate, F.col(a).alias(b)))
    return edges.join(gone.distinct(), [a, predicate, b], "left_anti")


def import_batch(library: DataFrame, incoming: DataFrame, match: str, key: str, tags: str, if_exists: str = "skip") -> DataFrame:
    """incoming rows with their outcome: created, skipped (known) or converged (tags united). Rows without
    a match key are always created; title is never one."""
    if if_exists not in ("skip", "converge", "duplicate"):
        raise ValueError(if_exists)
    known = library.where(F.col(match).isNotNull()).groupBy(match).agg(F.min_by(F.struct(F.col(key).alias("k"), F.col(tags).alias("t")), F.col(key)).alias("__known"))
    joined = incoming.join(known, match, "left")
    hit = F.col("__known").isNotNull()
    outcome = F.lit("created") if if_exists == "duplicate" else F.when(hit, F.lit("skipped" if if_exists == "skip" else "converged")).otherwise("created")
    united = F.when(hit & F.lit(if_exists == "converge"), F.array_union(F.coalesce("__known.t", F.array().cast(EMPTY)), F.coalesce(F.col(tags), F.array().cast(EMPTY)))).otherwise(F.col(tags))
    return joined.withColumn("outcome", outcome).withColumn("existing_key", F.when(hit, F.col("__known.k"))).withColumn(tags, united).drop("__known")
