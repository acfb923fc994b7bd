"""Long and nested forms: field tables to wide rows, ordered children, two hops, and joins whose
plain form would be a nested loop. Every 1:n side is aggregated before it is joined, so rows never
fan out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_fields(fields: DataFrame, item: str, field: str, value: str, names: Sequence[str]) -> DataFrame:
    """One row per item, a column per name; one aggregation whatever the number of names."""
    return fields.where(F.col(field).isin(list(names))).groupBy(item).agg(*[F.max(F.when(F.col(field) == n, F.col(value))).alias(n) for n in names])


def field_map(fields: DataFrame, item: str, field: str, value: str) -> DataFrame:
    """item -> fields, a map."""
    return fields.dropDuplicates([item, field]).groupBy(item).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(field, value)))).alias("fields"))


def resolve_base_field(fields: DataFrame, items: DataFrame, mapping: DataFrame, base: str, item: str, kind: str, field: str, value: str) -> DataFrame:
    """(item, base): the value of the base field or of the field that the item's type has in its place.
    mapping: kind, base_field, field, a dimension table."""
    mine = mapping.where(F.col("base_field") == base).select(kind, F.col("field").alias("__f"))
    typed = items.select(item, kind).join(mine, kind, "left").select(item, F.coalesce("__f", F.lit(base)).alias(field))
    return typed.join(fields.select(item, field, value), [item, field], "left").select(item, F.col(value).alias(base))


def nest_ordered(children: DataFrame, parent: str, order: str, columns: Sequence[str], out: str) -> DataFrame:
    """parent -> array of structs in order."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__order"), *columns)))
    return children.groupBy(parent).agg(F.transform(packed, lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias(out))


def nest_values(children: DataFrame, parent: str, value: str, out: str) -> DataFrame:
    """parent -> sorted array of distinct values."""
    return children.groupBy(parent).agg(F.array_sort(F.collect_set(value)).alias(out))


def relation_map(edges: DataFrame, item: str, predicate: str, target: str) -> DataFrame:
    """item -> predicate -> array of targets."""
    per = edges.groupBy(item, predicate).agg(F.array_sort(F.collect_set(target)).alias("__t"))
    return per.groupBy(item).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(predicate, "__t")))).alias("relations"))


def hydrate(items: DataFrame, key: str, nested: Mapping[str, DataFrame]) -> DataFrame:
    """Left joins of tables that have one row per key; missing arrays become empty."""
    for name, df in nested.items():
        items = items.join(df, key, "left")
        kind = dict(items.dtypes).get(name, "")
        if kind.startswith("array"):
            items = items.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return items


def children_of(parents: DataFrame, links: Sequence[DataFrame], key: str, parent: str, child: str) -> DataFrame:
    """Every parent with its children of all link tables; without any, an empty array."""
    every = links[0].select(parent, child)
    for more in links[1:]:
        every = every.unionByName(more.select(parent, child))
    grouped = every.join(parents.select(F.col(key).alias(parent)), parent, "left_semi").groupBy(parent).agg(F.array_sort(F.collect_set(child)).alias("children"))
    return parents.join(grouped.withColumnRenamed(parent, key), key, "left").withColumn("children", F.coalesce("children", F.array().cast(dict(grouped.dtypes)["children"])))


def two_hop(rows: DataFrame, middle: DataFrame, top: DataFrame, link: str, middle_key: str, middle_parent: str, top_key: str, keep: Mapping[str, str]) -> DataFrame:
    """rows -> middle -> top by left joins; keep: output name -> expression over all columns."""
    joined = rows.join(middle, F.col(link) == F.col(middle_key), "left").join(top, F.col(middle_parent) == F.col(top_key), "left")
    return joined.select(*rows.columns, *[F.expr(e).alias(n) for n, e in keep.items()])


def join_either(left: DataFrame, right: DataFrame, first: tuple[str, str], second: tuple[str, str], key: str) -> DataFrame:
    """left LEFT JOIN right ON first OR second, as two equi-joins and a union: a disjunction would be
    planned as a nested loop. Right rows that meet both conditions come once."""
    a = left.join(right, F.col(first[0]) == F.col(first[1]))
    b = left.join(right, (F.col(second[0]) == F.col(second[1])) & ~F.coalesce(F.col(first[0]) == F.col(first[1]), F.lit(False)))
    both = a.unionByName(b)
    missing = left.join(both.select(key).distinct(), key, "left_anti")
    return both.unionByName(missing, allowMissingColumns=True)


def top_k_then(items: DataFrame, order: Sequence[Column], k: int, key: str, wide: Sequence[DataFrame], offset: int = 0) -> DataFrame:
    """Ranks narrow rows, limits, then joins the wide tables to the page only."""
    page = items.orderBy(*order).offset(offset).limit(k) if offset else items.orderBy(*order).limit(k)
    for df in wide:
        page = page.join(df, key, "left")
    return page


def lookup_default(rows: DataFrame, titles: DataFrame, link: str, key: str, title: str, out: str = "title") -> DataFrame:
    """The title of what rows point to, or a text that names it."""
    names = titles.select(F.col(key).alias("__k"), F.col(title).alias("__t"))
    return rows.join(names, F.col(link) == F.col("__k"), "left").withColumn(out, F.coalesce("__t", F.concat(F.lit("(parent key: "), F.col(link).cast("string"), F.lit(")")))).drop("__k", "__t")


def related(items: DataFrame, relations: DataFrame, item: str, position: str, uri: str, key: str) -> DataFrame:
    """Items that relation URIs point to, in the relation's order; both URI forms count once."""
    target = F.regexp_extract(uri, r"/items/([A-Z0-9]{8})\b", 1)
    pointed = relations.withColumn("__k", target).where("__k <> ''").groupBy(item, "__k").agg(F.min(position).alias(position))
    return pointed.join(items.select(F.col(key).alias("__k"), *[c for c in items.columns if c not in (key, item, position)]), "__k").withColumnRenamed("__k", "related_key")


def mark(rows: DataFrame, known: DataFrame, column: str, out: str) -> DataFrame:
    """rows with a flag: is the value of column known?"""
    seen = known.select(column).distinct().withColumn("__m", F.lit(True))
    return rows.join(seen, column, "left").withColumn(out, F.coalesce("__m", F.lit(False))).drop("__m")


def reconcile(expected: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """(key, status): imported, missing (no result) or unexpected (no record)."""
    a = expected.select(key).distinct().withColumn("__e", F.lit(True))
    b = results.select(key).distinct().withColumn("__r", F.lit(True))
    status = F.when(F.col("__e").isNull(), "unexpected").when(F.col("__r").isNull(), "missing").otherwise("imported")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))
