"""The training-data pipeline over documents: five stages, each written as Parquet and reread.

Every stage but the last returns the columns of documents. No stage drops rows for any
other reason than its own decision: toxic documents, copies, all but one document of each
near-duplicate group, and documents of which the mix takes no copy. Ids may be null or
repeat: decisions are taken per row, under a key that a stage gives its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.llm.bpe import encode_texts, public_bpe
from stackroom.llm.common import read, shared_table
from stackroom.llm.exact_dedup import exact_dedup
from stackroom.llm.mixing import mix_sources
from stackroom.llm.near_dup import near_duplicates
from stackroom.llm.toxicity import drop_toxic, learn

#: Unique key of a row within a stage.
ROW = "__row"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field does not find toxic."""
    return drop_toxic(docs, learn(docs, read(spark, sf_dir, "labels")))


def _keyed(docs: DataFrame, label: str) -> DataFrame:
    """docs with a unique key of each row, written so that every later reading sees the same keys."""
    return shared_table(docs.withColumn(ROW, F.monotonically_increasing_id()), label)


def _first() -> Column:
    """Orders rows by id, null ids last; rows that repeat an id by their key."""
    return F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", ROW)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of every text: that of the smallest id, one without id only if none has an id."""
    rows = _keyed(docs, "rows2")
    kept = exact_dedup(rows.select(_first().alias("first"), "text"), "first").where("kept").select(F.col("doc_id")[ROW].alias(ROW))
    return rows.join(kept.hint("shuffle_hash"), ROW, "left_semi").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of every near-duplicate component, in the order of exact_copies."""
    rows = _keyed(docs, "rows3")
    found = near_duplicates(rows, ROW).select(F.col("doc_id").alias(ROW), "component_id")
    kept = rows.select(ROW, "doc_id").join(found, ROW).groupBy("component_id").agg(F.min(_first()).alias("first"))
    return rows.join(kept.select(F.col("first")[ROW].alias(ROW)).hint("shuffle_hash"), ROW, "left_semi").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    rows = _keyed(docs, "rows4")
    copies = mix_sources(rows, row_col=ROW).where("copies > 0").select(ROW, "copies")
    taken = rows.join(copies.hint("shuffle_hash"), ROW)
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    return encode_texts(docs, public_bpe(), with_ids=False)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("mixing sources to target weights", mixing), ("byte-level BPE encoding and decoding", encoding)]

#: The toxicity model is learned; SQL cannot express it. tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = shared_table(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
