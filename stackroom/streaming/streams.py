"""Streams: upserts into an index table, deduplication, windows, watermarks of libraries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.index_table import IndexTable


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def with_event_time(events: DataFrame, column: str, lateness: str) -> DataFrame:
    """A stream with a watermark; timestamps without zone are read as the session's."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def latest_of(batch: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of every key of a batch."""
    columns = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(version)).alias("b")).select(key, "b.*")


def upsert_stream(stream: DataFrame, table: IndexTable, version: str, checkpoint: str, **trigger):
    """A query that keeps the newest row of every key in the table. A batch that runs again changes
    nothing: rows that aren't newer than the table's are left out."""

    def put(batch: DataFrame, _: int) -> None:
        new = latest_of(batch, table.key, version)
        if table.exists():
            old = table.read().select(table.key, F.col(version).alias("__v"))
            new = new.join(old, table.key, "left").where(F.col("__v").isNull() | (F.col(version) > F.col("__v"))).drop("__v")
        table.upsert(new)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def dedup_stream(stream: DataFrame, key: str, time: str, lateness: str) -> DataFrame:
    """The first row of every key; state older than the watermark goes."""
    return with_event_time(stream, time, lateness).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, width: str, lateness: str, by: str, slide: str | None = None) -> DataFrame:
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return with_event_time(stream, time, lateness).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"))


def session_counts(events: DataFrame, time: str, gap: str, by: str) -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp")).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))


def running_totals(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Own state per key: the number and sum of all rows so far, sent at every batch of the key."""

    def add(k, batches: Iterator[pd.DataFrame], state):
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b[value].sum())
        state.update((n, total))
        yield pd.DataFrame([(k[0], n, total)], columns=[key, "n", "total"])

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(add, f"{key} {kind}, n long, total double", "n long, total double", "update", "NoTimeout")


class Watermarks:
    """The version up to which each library is in the index: a small table, one row per group."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.table = IndexTable(spark, path, "group_id")
        self.spark = spark

    def get(self, group_id: int) -> int | None:
        if not self.table.exists():
            return None
        row = self.table.read().where(F.col("group_id") == group_id).first()
        return row["version"] if row else None

    def put(self, group_id: int, version: int) -> None:
        """Call after the sink has committed."""
        self.table.upsert(self.spark.createDataFrame([(group_id, version)], "group_id long, version long"))
