"""Queries: incremental maintenance of an index, batch and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import sync as N
from ..session import scratch_path, table
from ..streaming import streams as W


@query("changed_since", "SELECT event_id FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events)")
def changed_since(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    half = events.agg(F.floor(F.max("event_id") / 2).alias("m")).first()["m"]
    return N.changed_since(events, "event_id", half).select("event_id")


def _old(spark, sf_dir):
    """An index of the documents: some lack, some are older, some are gone from the source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return docs.where("doc_id % 10 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") - 1).otherwise(F.col("n_chars")).alias("version"), "lang").unionByName(docs.where("doc_id % 9 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), F.col("n_chars").alias("version"), "lang"))


_OLD = "(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN n_chars - 1 ELSE n_chars END AS version, lang FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT -1 - doc_id, n_chars, lang FROM documents WHERE doc_id % 9 = 0)"


def _new(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("version"), "lang")


@query("classify_changes", f"SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete' WHEN n.n_chars > o.version THEN 'update' ELSE 'same' END AS change FROM documents n FULL JOIN {_OLD} o ON n.doc_id = o.doc_id")
def classify_changes(spark, sf_dir):
    return N.classify(_new(spark, sf_dir), _old(spark, sf_dir), "doc_id", "version")


@query("delete_detect", f"SELECT doc_id FROM {_OLD} WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def delete_detect(spark, sf_dir):
    return N.deletions(_old(spark, sf_dir), _new(spark, sf_dir), "doc_id", allow_mass=True).select("doc_id")


@query("delete_guard", "SELECT count(*) AS total, count(*) FILTER (lang <> 'en') AS gone, count(*) FILTER (lang <> 'en') >= 25 AND count(*) FILTER (lang <> 'en') >= 0.25 * count(*) AS blocked FROM documents")
def delete_guard(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return N.deletion_guard(docs, docs.where("lang = 'en'"), "doc_id")


@query("upsert", f"SELECT doc_id, n_chars AS version FROM documents UNION ALL SELECT doc_id, version FROM {_OLD} WHERE doc_id < 0")
def upsert(spark, sf_dir):
    return N.upsert(_old(spark, sf_dir), _new(spark, sf_dir), "doc_id").select("doc_id", "version")


@query("metadata_update", f"SELECT o.doc_id, o.version, coalesce('Q' || l.quality, o.lang) AS lang FROM {_OLD} o LEFT JOIN labels l ON o.doc_id = l.doc_id")
def metadata_update(spark, sf_dir):
    patch = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("Q"), "quality").alias("lang"))
    return N.update_columns(_old(spark, sf_dir), patch, "doc_id", ["lang"])


@query("backfill_group", "SELECT d.doc_id, CASE WHEN lang = 'en' THEN 1 ELSE l.quality END AS group_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def backfill_group(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", 1).alias("group_id"))
    return N.backfill(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("group_id")), "doc_id", "group_id").select("doc_id", "group_id")


@query("delete_chunks", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE NOT (l_orderkey = 3 AND l_suppkey < 50)")
def delete_chunks(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("g", F.when(F.col("l_suppkey") < 50, 1).otherwise(2))
    return N.delete_chunks(lines, "l_orderkey", 3, "g", 1).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


_SKIP = """CASE WHEN o.doc_id IS NULL THEN 'extract: new' WHEN o.lang <> n.lang THEN 'extract: moved' WHEN n.doc_id % 5 = 0 AND o.version = n.n_chars THEN 'keep: failed before' WHEN o.version <> n.n_chars THEN 'extract: files changed' WHEN n.doc_id % 11 = 0 THEN 'extract: priority changed' ELSE 'keep: same' END"""


@query("skip_rules", f"SELECT n.doc_id, {_SKIP} AS action FROM documents n LEFT JOIN {_OLD} o ON n.doc_id = o.doc_id")
def skip_rules(spark, sf_dir):
    old = _old(spark, sf_dir).select("doc_id", F.col("version").alias("ov"), F.col("lang").alias("ol"))
    rows = _new(spark, sf_dir).join(old, "doc_id", "left")
    known = F.col("ov").isNotNull()
    action = N.skip_reason(known, F.col("doc_id") % 5 == 0, F.coalesce(F.col("ov") == F.col("version"), F.lit(False)), N.setting_changed(F.when(F.col("doc_id") % 11 == 0, F.lit("old")), "new"), F.col("ol") == F.col("lang"), F.lit(False))
    return rows.select("doc_id", action.alias("action"))


@query("cache_probe", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND (doc_id % 4 = 0 OR lang IS NOT NULL) AND n_chars % 2 = 0")
def cache_probe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    wanted = docs.select("doc_id", "n_chars", F.when(F.col("doc_id") % 4 == 0, None).otherwise(F.col("lang")).alias("profile"))
    cache = wanted.where("doc_id % 3 <> 0 AND n_chars % 2 = 0").withColumn("cached", F.lit("t"))
    return N.cache_hits(wanted, cache, ["doc_id", "n_chars", "profile"]).select("doc_id")


@query("cache_evict", "SELECT doc_id FROM documents WHERE n_chars % 60 < 30 AND doc_id IN (SELECT doc_id FROM labels)")
def cache_evict(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return N.evict(docs, F.col("n_chars") % 60, table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("superseded_runs", "SELECT * FROM (VALUES (1, false), (2, true), (3, false), (4, true), (5, false)) t(run_id, superseded)")
def superseded_runs(spark, sf_dir):
    runs = spark.createDataFrame([(1, 7, 10, True), (2, 7, 11, False), (3, 7, 12, False), (4, 8, 5, True), (5, 8, 6, True)], "run_id int, group_id int, created_at int, full_rebuild boolean")
    return N.superseded(runs).select("run_id", "superseded")


@query("pack_batches", "SELECT count(*) AS n, true AS within FROM documents")
def pack_batches(spark, sf_dir):
    """Batches hold 50 rows and 100,000 characters at most, unless one row has more."""
    rows = N.pack(table(spark, sf_dir, "documents"), "doc_id", F.col("n_chars"), 50, 100_000)
    each = rows.groupBy("lane", "batch").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("size"), F.max("n_chars").alias("most"))
    return each.agg(F.sum("rows").alias("n"), F.min((F.col("rows") <= 50) & ((F.col("size") <= 100_000) | (F.col("most") > 50_000))).alias("within"))


def _stream(spark, sf_dir):
    from ..session import table as t

    schema = t(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _sink(spark, stream, mode):
    """Runs a stream to its end into a table in memory: for results of bounded size."""
    name = f"s{uuid.uuid4().hex}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def _files(spark, stream):
    """Runs a stream to its end into files, which grow with it."""
    out = scratch_path(spark, "sink")
    q = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_counts(spark, sf_dir):
    return _sink(spark, _stream(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "complete").select("event_type", "n")


@query("stream_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    counted = W.windowed_counts(_stream(spark, sf_dir), "ts", "1 day", "1 hour", "event_type")
    return _sink(spark, counted, "complete").select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("stream_dedup", "SELECT DISTINCT event_id FROM events")
def stream_dedup(spark, sf_dir):
    return _files(spark, W.dedup_stream(_stream(spark, sf_dir).select("event_id", "ts"), "event_id", "ts", "30 days")).select("event_id")


@query("session_windows", "SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) GROUP BY user_id, s) GROUP BY user_id")
def session_windows(spark, sf_dir):
    s = W.session_counts(table(spark, sf_dir, "events"), "ts", "6 hours", "user_id")
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"))
