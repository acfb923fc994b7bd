"""Keeping an index table in step with its source: changes, deletions with guards, upserts, caches.

An unknown set of keys (None) is never treated as an empty one: it deletes nothing and
leaves the watermark where it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASS_ROWS, MASS_SHARE = 25, 0.25


class MassDeletion(RuntimeError):
    """So many rows would go that the source is more likely broken than emptied."""


def changed_since(rows: DataFrame, version: str, watermark) -> DataFrame:
    return rows.where(F.col(version) > F.lit(watermark))


def classify(source: DataFrame, index: DataFrame, key: str, version: str) -> DataFrame:
    """(key, change): insert, update, same or delete; one full outer join."""
    a = source.select(key, F.col(version).alias("__new"))
    b = index.select(key, F.col(version).alias("__old"))
    change = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "delete").when(F.col("__new") > F.col("__old"), "update").otherwise("same")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def deletions(index: DataFrame, current: DataFrame | None, key: str, scope: Column | None = None, allow_mass: bool = False) -> DataFrame | None:
    """Index rows in scope whose key is gone; None if current is unknown or empty. Raises MassDeletion
    for 25 rows and a quarter of the scope, or more."""
    if current is None or current.isEmpty():
        return None
    held = index if scope is None else index.where(scope)
    gone = held.join(current.select(key).distinct(), key, "left_anti")
    if not allow_mass:
        n, total = gone.count(), held.count()
        if n >= MASS_ROWS and n >= MASS_SHARE * total:
            raise MassDeletion(f"{n} of {total} rows would go")
    return gone


def deletion_guard(index: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """One row: total, gone, blocked; the guard as a query."""
    seen = current.select(key).distinct().withColumn("__c", F.lit(1))
    counted = index.select(key).join(seen, key, "left").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("__c").isNull(), 1)).alias("gone"))
    return counted.withColumn("blocked", (F.col("gone") >= MASS_ROWS) & (F.col("gone") >= MASS_SHARE * F.col("total")))


def upsert(index: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """index with rows in place of those with the same key."""
    return index.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def update_columns(index: DataFrame, patch: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """index with the columns of patch where it has a value; nothing else changes."""
    new = patch.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = index.join(new, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in index.columns])


def delete_rows(index: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return index.join(keys.select(key).distinct(), key, "left_anti")


def delete_chunks(index: DataFrame, parent: str, value, group: str | None = None, group_id: int | None = None) -> DataFrame:
    """index without the chunks of a parent (in one group)."""
    mine = F.col(parent) == value
    return index.where(~F.coalesce(mine if group is None else mine & (F.col(group) == group_id), F.lit(False)))


def backfill(index: DataFrame, known: DataFrame, key: str, column: str) -> DataFrame:
    """index with missing values of column taken from known; others stay."""
    return index.join(known.select(key, F.col(column).alias("__k")), key, "left").withColumn(column, F.coalesce(column, "__k")).drop("__k")


def complete(snapshot: DataFrame, expected: DataFrame, key: str) -> bool:
    """Whether the snapshot holds all expected keys, so that the watermark may move."""
    return expected.join(snapshot.select(key), key, "left_anti").isEmpty()


def skip_reason(existing: Column, failed: Column, same_files: Column, priority_changed: Column, same_group: Column, forced: Column) -> Column:
    """What to do with an item's text, first rule first: extract or keep."""
    return (
        F.when(forced, "extract: forced")
        .when(~existing, "extract: new")
        .when(~F.coalesce(same_group, F.lit(False)), "extract: moved")
        .when(failed & same_files, "keep: failed before")
        .when(~same_files, "extract: files changed")
        .when(F.coalesce(priority_changed, F.lit(False)), "extract: priority changed")
        .otherwise("keep: same")
    )


def setting_changed(stored: Column, current: str) -> Column:
    """A row without the setting counts as unchanged."""
    return stored.isNotNull() & (stored != current)


def cache_hits(wanted: DataFrame, cache: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose file, time, size and profile are all as cached; null profiles are equal."""
    renamed = cache.select([F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in cache.columns])
    joined = wanted
    rule = F.lit(True)
    for c in on:
        rule = rule & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return joined.join(renamed, rule).drop(*[f"__{c}" for c in on])


def evict(cache: DataFrame, age_days: Column, live_keys: DataFrame, key: str, most_days: int = 30) -> DataFrame:
    """The cache without old rows and orphans."""
    return cache.where(age_days < most_days).join(live_keys.select(key).distinct(), key, "left_semi")


def superseded(runs: DataFrame) -> DataFrame:
    """runs (run_id, group_id, created_at, full_rebuild) with superseded: another run of the group is newer,
    and it rebuilds all or this one doesn't."""
    newest = runs.groupBy("group_id").agg(F.max_by(F.struct("run_id", "full_rebuild"), F.struct("created_at", "run_id")).alias("__n"))
    joined = runs.join(newest, "group_id", "left")
    return joined.withColumn("superseded", (F.col("__n.run_id") != F.col("run_id")) & (F.col("__n.full_rebuild") | ~F.col("full_rebuild"))).drop("__n")


def pack(records: DataFrame, key: str, size: Column, most_rows: int, most_size: int, spread: int = 64) -> DataFrame:
    """records with a batch number (lane, batch): no batch exceeds rows or size, unless one record does.
    Records are dealt to lanes by hash, and each lane is filled by running sums: a batch begins
    where a running sum enters the next half of its limit, so that no sequential scan is needed."""
    from pyspark.sql import Window

    lane = F.pmod(F.xxhash64(key), F.lit(spread)).alias("lane")
    order = Window.partitionBy("lane").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    rows = records.withColumn("lane", lane).withColumn("__s", size)
    rows = rows.withColumn("__rows", F.row_number().over(Window.partitionBy("lane").orderBy(key)) - 1).withColumn("__sum", F.sum("__s").over(order) - F.col("__s"))
    step = max(1, most_size // 2)
    return rows.withColumn("batch", F.struct(F.floor(F.col("__sum") / step).alias("by_size"), F.floor(F.col("__rows") / most_rows).alias("by_rows"))).drop("__s", "__rows", "__sum")


def next_watermark(current: int | None, seen: int | None, done: bool) -> int | None:
    """The watermark after a run: it moves only forward, and only if the run was complete."""
    if not done or seen is None:
        return current
    return seen if current is None else max(current, seen)


def should_update(mode: str, last_run: float | None, now: float, every_days: int = 1, auto: bool = True) -> bool:
    """manual never; startup always; daily and every_N after so many days."""
    if not auto or mode == "manual":
        return False
    if mode == "startup" or last_run is None:
        return True
    days = 1 if mode == "daily" else int(mode.removeprefix("every_")) if mode.startswith("every_") else every_days
    return now - last_run >= 86400 * days
