"""Duplicate items: match keys, groups, keepers, merge plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged


def _tagged(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("value"))


def match_keys(items: DataFrame, key: str, kinds: Mapping[str, Column]) -> DataFrame:
    """(key, kind, value): one row for each identifier an item has. Array columns give several."""
    types = dict(items.select(*[c.alias(k) for k, c in kinds.items()]).dtypes)
    arrays = [F.transform(c if types[k].startswith("array") else F.array(c), _tagged(k)) for k, c in kinds.items()]
    keys = F.array_distinct(F.filter(F.concat(*arrays), lambda x: F.coalesce(x["value"], F.lit("")) != ""))
    return items.select(key, F.explode(keys).alias("k")).select(key, "k.kind", "k.value")


def duplicate_groups(keys: DataFrame, key: str, least: int = 2) -> DataFrame:
    """(kind, value, n, first_key): groups of items that share a match key. Members stay in the key table;
    collecting them would put a hot key in one row."""
    return keys.groupBy("kind", "value").agg(F.count_distinct(key).alias("n"), F.min(key).alias("first_key")).where(F.col("n") >= least)


def group_page(groups: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    return groups.orderBy("kind", "value").offset(max(0, offset)).limit(min(500, max(1, limit)))


def keepers(members: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every group by order. As an aggregation it combines in the map tasks,
    which a window over a hot group would not."""
    columns = [c for c in members.columns if c not in group]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    best = members.groupBy(*group).agg(F.min_by(F.struct(*columns), rank).alias("b"))
    return best.select(*group, "b.*")


def qualify(members: DataFrame, group: Sequence[str], key: str, kind: str, identifier: str) -> DataFrame:
    """Groups with their verdict: ok, mixed types or differing identifiers."""
    found = members.groupBy(*group).agg(F.count_distinct(key).alias("n"), F.count_distinct(kind).alias("kinds"), F.count_distinct(identifier).alias("ids"))
    return found.withColumn("verdict", F.when(F.col("kinds") > 1, "mixed types").when(F.col("ids") > 1, "differing identifiers").otherwise("ok"))


def standing_groups(members: DataFrame, group: str, key: str, ceiling: int | None = None) -> DataFrame:
    """Groups that share no member with an earlier one that stands, by group id: what taking them in order
    would give. In each round the groups that come first among the undecided ones of all their members
    stand, and those that overlap them fall. ceiling keeps the first so many, as a limit on one call."""
    left = staged(members.select(group, key).distinct(), "undecided")
    stands = left.select(group).limit(0)
    while not left.isEmpty():
        owner = left.groupBy(key).agg(F.min(group).alias("__owner"))
        whole = left.join(owner, key).groupBy(group).agg(F.min((F.col("__owner") == F.col(group)).cast("int")).alias("w"))
        new = staged(whole.where("w = 1").select(group), "standing")
        taken = left.join(new, group, "left_semi").select(key).distinct()
        fallen = left.join(taken, key, "left_semi").select(group).distinct()
        stands = stands.unionByName(new)
        left = staged(left.join(fallen, group, "left_anti"), "undecided")
    return stands if ceiling is None else stands.orderBy(group).limit(ceiling)


def merge_plan(members: DataFrame, keepers_: DataFrame, group: str, key: str, tags: str) -> DataFrame:
    """(group, keeper, duplicates, add_tags): tags the keeper lacks; duplicates counted."""
    keep = keepers_.select(group, F.col(key).alias("keeper"), F.col(tags).alias("__own"))
    rest = members.join(keep, group).where(F.col(key) != F.col("keeper"))
    plan = rest.groupBy(group, "keeper").agg(F.count_distinct(key).alias("duplicates"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(tags)))).alias("__all"), F.first("__own").alias("__own"))
    return plan.select(group, "keeper", "duplicates", F.array_except("__all", "__own").alias("add_tags"))


def moved_children(children: DataFrame, duplicate_of: DataFrame, parent: str, signature: Sequence[str]) -> DataFrame:
    """Children of duplicates that the keeper has no equal of, with their new parent. duplicate_of: (parent, keeper)."""
    moving = children.join(duplicate_of, parent)
    owned = children.select(F.col(parent).alias("keeper"), *signature).distinct()
    return moving.join(owned, ["keeper", *signature], "left_anti")


def plan_token(plan: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: 12 hex digits that change with the plan. Rows hash alone and sum, so that nothing is
    gathered; the order of rows does not matter."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return plan.agg(F.substring(F.sha2(F.concat_ws("/", F.count(F.lit(1)), F.coalesce(F.sum(row), F.lit(0))), 256), 1, 12).alias("token"))


def suppress(items: DataFrame, keys: DataFrame, key: str, is_minor: Column, is_major: Column) -> DataFrame:
    """items without the minor ones (preprints) that share a match key with a major one (articles)."""
    major = keys.join(items.where(is_major).select(key), key, "left_semi").select("kind", "value").distinct()
    gone = keys.join(items.where(is_minor).select(key), key, "left_semi").join(major, ["kind", "value"], "left_semi").select(key).distinct()
    return items.join(gone, key, "left_anti")


def first_of_each(rows: DataFrame, key: str, position: str) -> DataFrame:
    """rows with first_position: where the same key came first."""
    return rows.withColumn("first_position", F.min(position).over(Window.partitionBy(key)))


def apply_merge(items: DataFrame, duplicate_of: DataFrame, plan: DataFrame, key: str, tags: str) -> tuple[DataFrame, DataFrame]:
    """(items with the keepers' new tags, trash rows): duplicates move to the trash."""
    add = plan.select(F.col("keeper").alias(key), "add_tags")
    kept = items.join(duplicate_of.select(key).distinct(), key, "left_anti").join(add, key, "left")
    kept = kept.withColumn(tags, F.when(F.col("add_tags").isNotNull(), F.array_union(F.coalesce(tags, F.array().cast("array<string>")), "add_tags")).otherwise(F.col(tags))).drop("add_tags")
    return kept, duplicate_of.select(key).distinct()
