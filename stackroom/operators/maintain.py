"""The index of passages and vectors, and the job that keeps it in step with a library."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.index_table import IndexTable
from ..streaming.streams import Watermarks
from . import sync, vector
from .passages import OVERLAP, SIZE, snippets, split_passages


@dataclass
class Refresh:
    added: int
    deleted: int
    watermark: int | None


def passages_of(items: DataFrame, key: str, text: str, meta: Sequence[str], size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Index records: id (key#n), parent, chunk and offset columns, document and the items' meta columns."""
    pieces = split_passages(items, key, text, size, overlap)
    named = pieces.withColumns({"id": F.concat(F.col(key).cast("string"), F.lit("#"), "chunk_index"), "parent": F.col(key).cast("string")}).withColumnRenamed("passage", "document")
    return named.join(items.select(key, *meta), key).drop(key)


def refresh(items: DataFrame, table: IndexTable, marks: Watermarks, group_id: int, key: str, text: str, version: str, embedder: Callable, meta: Sequence[str] = (), current: DataFrame | None = None, rebuild: bool = False, allow_mass: bool = False) -> Refresh:
    """Indexes the items that are newer than the group's watermark, drops what is gone, then moves the
    watermark. current: all keys of the group; None is unknown and deletes nothing. The newest version is
    read first and bounds what is indexed, so items that arrive meanwhile wait for the next run. Running it
    again after a failure repeats no step wrongly: records are replaced by id, and the watermark moves last."""
    newest = items.agg(F.max(version).alias("v")).first()["v"]
    items = items.where(F.col(version) <= newest) if newest is not None else items.limit(0)
    mark = None if rebuild else marks.get(group_id)
    changed = items if mark is None else sync.changed_since(items, version, mark)
    records = passages_of(changed, key, text, list(meta)).withColumn("group_id", F.lit(group_id).cast("long"))
    records = vector.embed(records, "document", embedder)
    added, deleted = changed.count(), 0
    if table.exists():
        index = table.read()
        mine = F.col("group_id") == group_id
        stale = changed.select(F.col(key).cast("string").alias("parent")).distinct()
        kept = index.where(~mine).unionByName(index.where(mine).join(stale, "parent", "left_anti"))
        if current is not None:
            known = current.select(F.col(key).cast("string").alias("parent"))
            gone = sync.deletions(index.select("parent", "group_id").distinct(), known, "parent", mine, allow_mass)
            if gone is not None:
                deleted = gone.count()
                kept = kept.join(gone, ["parent", "group_id"], "left_anti")
        records = kept.unionByName(records, allowMissingColumns=True)
    table.replace(records)
    after = sync.next_watermark(marks.get(group_id), newest, True)
    if after is not None:
        marks.put(group_id, after)
    return Refresh(added, deleted, after)


def semantic_search(table: IndexTable, query: str, embedder: Callable, k: int = 10, filters: dict | None = None, group_id: int | None = None, scorer: Callable | None = None) -> DataFrame:
    """The k items nearest to a query: their best passages with score and snippet. Filters and scope come
    before the limit; passages without text are left out."""
    where: Column = F.col("document").isNotNull()
    for more in (vector.metadata_filter(filters), None if group_id is None else F.col("group_id") == group_id):
        where = where if more is None else where & more
    hits = vector.nearest(table.read(), vector.literal_vector(embedder([query])[0]), vector.fetch_size(k, True, scorer is not None), "id", "embedding", where=where)
    if scorer is not None:
        hits = vector.rerank(hits, "document", "id", vector.fetch_size(k, True), scorer).drop("score").withColumnRenamed("rerank", "score")
    columns = ["parent", "id", "document", "char_start", "score"]
    rank = F.struct(F.col("score").alias("s"), F.col("id").alias("i"))
    best = hits.select(columns).groupBy("parent").agg(F.max_by(F.struct(*columns[1:]), rank).alias("b")).select("parent", "b.*").orderBy(F.desc("score"), "parent").limit(k)
    return best.withColumn("snippet", snippets(F.col("document"), query)["snippet"])
