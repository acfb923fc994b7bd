"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source
size. The prefix sums of these within the source, shifted by one random offset, cross
integer boundaries; a document is emitted once per boundary that it crosses. The order
within a source is by size, then by a hash of the id: sampling at even steps through
the sizes is what brings the words taken close to the target.

The prefix sum never gathers a source in one task. A row's rank is the sum of three
parts, each from its own window: rows in smaller sizes (over the distinct sizes of the
source), rows in earlier hash blocks of the same size, rows before it in its block.
Blocks hold about BLOCK rows, so a hot source or a hot size is split as finely as any.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, read, shared_table

#: Rows of one source and size in a block, about.
BLOCK = 256
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, LIMIT, SEED = 1.5, 2.0, "mix-1"


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size) -> the same with target. One row per source: the windows
    without partition see as many rows as there are sources, never documents.

    With level L, an open source gets weight * L and a closed one limit * source_size;
    sources close in the order of limit * size / weight. L is the first quotient of what
    is left by the weights that are left that closes no further source.
    """
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.lit(limit) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    found = ranked.withColumns({"level": level, "at": F.row_number().over(order)})
    found = found.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("at", "level"))).over(everything)["level"])
    return found.select("source", "source_size", F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap")).otherwise(F.col("w") * F.col("level")).alias("target"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", size=None, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: str = SEED, row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken.

    size: a Column, by default the words of the column text. Null texts have size 0 and
    take nothing. A null source is a source, after all others. The same rows give the
    same result in every run; rows that repeat an id may swap their copies. row_col: a unique
    key of the rows, returned too; it orders rows that repeat an id. Other columns are ignored.
    An empty table gives an empty result.
    """
    size = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.regexp_count("text", F.lit(WORD))) if size is None else size
    row = [row_col] if row_col else []
    rows = shared_table(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.cast("long").alias("size"), *row), "mix")
    per_size = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    earlier = (Window.unboundedPreceding, -1)
    per_size = per_size.withColumn("smaller", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("size").rowsBetween(*earlier)), F.lit(0)))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit)
    targets = targets.withColumnRenamed("source", "t_source")
    per_size = per_size.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "n", "smaller", "source_size", "target")

    key = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("long")
    joined = rows.withColumn("key", key).join(per_size, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))).drop("p_source", "p_size")
    joined = joined.withColumn("block", F.floor(F.col("key") * F.ceil(F.col("n") / BLOCK) / F.lit(float(1 << 48))))
    spot = ["source", "size", "block"]
    counted = joined.groupBy(*spot).agg(F.count(F.lit(1)).alias("m"))
    counted = counted.withColumn("ahead", F.coalesce(F.sum("m").over(Window.partitionBy("source", "size").orderBy("block").rowsBetween(*earlier)), F.lit(0)))
    counted = counted.select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), F.col("block").alias("c_block"), "ahead")
    placed = joined.join(counted, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")) & (F.col("block") == F.col("c_block")))
    rank = F.col("smaller") + F.col("ahead") + F.row_number().over(Window.partitionBy(*spot).orderBy("key", "doc_id", *row))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), F.coalesce("source", F.lit("")))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    crossed = F.floor(F.col("rank") * F.col("each") + F.col("offset")) - F.floor((F.col("rank") - 1) * F.col("each") + F.col("offset"))
    mixed = placed.withColumns({"rank": rank, "each": each, "offset": offset}).withColumn("copies", F.least(crossed, F.ceil("each")).cast("long"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *row)


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken", "source", "copies")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / w AS ratio,
  (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
p AS (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS place FROM l),
f AS (SELECT level AS lv FROM p WHERE level <= ratio ORDER BY place LIMIT 1),
t AS (SELECT * FROM p LEFT JOIN f ON true),
g AS (SELECT source, source_size, CASE WHEN lv IS NULL OR ratio <= lv THEN cap ELSE w * lv END AS target FROM t),
r AS (SELECT d.doc_id, d.source, d.size, g.source_size, g.target,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, substr(md5('mix-1' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 12), d.doc_id) AS rank,
  CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS each,
  ('0x' || substr(md5('mix-1/' || coalesce(d.source, '')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, least(floor(rank * each + u) - floor((rank - 1) * each + u), ceil(each))::BIGINT AS copies FROM r)
SELECT doc_id, size, source_size, round(target, 3) AS target, size * copies AS taken, source, copies FROM c
"""
