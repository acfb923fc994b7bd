"""Exact deduplication: 128-bit content hash, smallest stable id, byte comparison.

Native: only DataFrame functions. Texts are normalised (each run of ASCII white
space becomes one space) and grouped by (md5, normalised text): the hash spreads
the rows, the text as second grouping key compares the bytes, so two texts that
collide in md5 stay apart. Grouping combines copies in the map tasks, so a group
of copies sends at most one row per map task, however many copies it has. The rows
get their group by an equi-join on the digests, whose skewed keys AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t-\r]+", " ")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; all empty texts form one group. A null id is kept only
    if its group has no other id. Rows that repeat the keeping row's id and text are all
    marked kept, as nothing tells them apart. Other columns are ignored. An empty table
    gives an empty result.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    groups = (
        rows.groupBy(F.md5("norm").alias("h"), "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2("norm", 256).alias("s"), "keep_id", "group_size")
    )
    marked = rows.select("doc_id", F.md5("norm").alias("h"), F.sha2("norm", 256).alias("s"))
    return marked.join(groups, ["h", "s"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("s").alias("text_sha256"),
    )


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
