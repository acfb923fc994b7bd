"""Counts, indexes and summaries over items and their children."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_per(dimension: DataFrame, rows: DataFrame, key: str, link: str, out: str = "n") -> DataFrame:
    """Every row of the dimension with the number of rows that point to it, 0 included."""
    counted = rows.groupBy(F.col(link).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    return dimension.join(counted, F.col(key) == F.col("__k"), "left").withColumn(out, F.coalesce("__n", F.lit(0)).cast("long")).drop("__k", "__n")


def string_agg(rows: DataFrame, by: str, value: Column, order: Sequence[str], separator: str = "; ", out: str = "joined") -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct(*order, value.alias("__v"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(packed, lambda x: x["__v"]), separator).alias(out))


def distinct_values(rows: DataFrame, values: Column, out: str = "tag") -> DataFrame:
    return rows.select(F.explode(values).alias(out)).where(F.col(out) != "").distinct()


def letter_index(tags: DataFrame, tag: str) -> DataFrame:
    """(letter, n, tags): tags under their first letter, upper-cased."""
    return tags.groupBy(F.upper(F.substring(tag, 1, 1)).alias("letter")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(tag)).alias("tags"))


def coverage(parents: DataFrame, children: DataFrame, key: str, link: str, has: Column) -> DataFrame:
    """One row: scanned, covered, missing, percent of parents with a child that has the property."""
    good = children.where(has).select(F.col(link).alias(key)).distinct().withColumn("__h", F.lit(1))
    found = parents.select(key).join(good, key, "left").agg(F.count(F.lit(1)).alias("scanned"), F.coalesce(F.sum("__h"), F.lit(0)).cast("long").alias("covered"))
    return found.select("scanned", "covered", (F.col("scanned") - F.col("covered")).alias("missing"), F.when(F.col("scanned") > 0, F.round(100.0 * F.col("covered") / F.col("scanned"), 1)).otherwise(F.lit(0.0)).alias("percent"))


def uncovered(parents: DataFrame, children: DataFrame, key: str, link: str, has: Column, limit: int = 50) -> DataFrame:
    return parents.join(children.where(has).select(F.col(link).alias(key)), key, "left_anti").orderBy(key).limit(limit)


def child_summary(children: DataFrame, link: str, is_main: Column, is_note: Column) -> DataFrame:
    """(parent, has_main, attachments, has_notes)."""
    return children.groupBy(link).agg(F.max(is_main).alias("has_main"), F.count(F.when(~is_note, 1)).alias("attachments"), F.max(is_note).alias("has_notes"))


def synthesize(works: DataFrame, notes: DataFrame, key: str, link: str, text: Column, most: int = 400) -> DataFrame:
    """Works with notes: their number and the notes, cut to most characters, in order of text. Works
    without a note that has text are left out."""
    clipped = notes.select(F.col(link).alias(key), F.trim(text).alias("__t")).where(F.coalesce("__t", F.lit("")) != "").withColumn("__t", F.when(F.length("__t") > most, F.concat(F.substring("__t", 1, most), F.lit("..."))).otherwise(F.col("__t")))
    grouped = clipped.groupBy(key).agg(F.count(F.lit(1)).alias("n_notes"), F.array_sort(F.collect_list("__t")).alias("notes"))
    return works.join(grouped, key)


def outcomes(results: DataFrame, status: str) -> DataFrame:
    return results.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def enrich(items: DataFrame, facts: DataFrame, key: Column, fact_key: str) -> DataFrame:
    """Left join of facts by an identifier in lower case; items without facts stay."""
    narrowed = facts.withColumn("__k", F.lower(fact_key)).drop(fact_key)
    return items.withColumn("__i", F.lower(key)).join(narrowed, F.col("__i") == F.col("__k"), "left").drop("__i", "__k")


def flagged(items: DataFrame, notices: DataFrame, key: str, notice_key: str) -> DataFrame:
    """Items with one notice at least, and their number."""
    n = notices.groupBy(F.col(notice_key).alias(key)).agg(F.count(F.lit(1)).alias("notices"))
    return items.join(n, key)


def citation_neighbours(edges: DataFrame, works: DataFrame, library: DataFrame, root, limit: int = 20) -> DataFrame:
    """References of root in source order and works that cite it, most cited first, each up to limit, with
    a flag for works of the library. edges: citing, cited, position; works: work, cited_by."""
    refs = edges.where(F.col("citing") == root).join(works, F.col("cited") == F.col("work")).orderBy("position", "work").limit(limit).select(F.lit("reference").alias("direction"), "work", "cited_by")
    cites = edges.where(F.col("cited") == root).join(works, F.col("citing") == F.col("work")).orderBy(F.desc("cited_by"), "work").limit(limit).select(F.lit("citation").alias("direction"), "work", "cited_by")
    both = refs.unionByName(cites)
    held = library.select(F.col("work")).distinct().withColumn("in_library", F.lit(True))
    return both.join(held, "work", "left").withColumn("in_library", F.coalesce("in_library", F.lit(False)))
