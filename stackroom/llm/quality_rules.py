"""Quality rules: base rules, then the log-likelihood ratio of hashed n-grams between a
trusted target and the raw corpus.

Native: only DataFrame functions. The two multinomials are counted over every text, with
unigrams and bigrams of words hashed into BUCKETS counters; the weights (log ratio of the
add-one estimates, in millionths, as integers, so that sums don't depend on their order)
are one row, whose size BUCKETS bounds, and enter the scoring pass as a scalar subquery.
A document's score is the mean weight of its n-grams; it passes at THRESHOLD or more.

Counting moves no texts while the trusted ids are at most BROADCAST_IDS: they are broadcast to one
scan. Beyond that the raw n-grams come straight from a scan, and only those of the target from a
semi-join that shuffles texts, without null ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, read

BUCKETS = 1 << 14
#: Mean log-likelihood ratio below which a text is rejected. Trusted texts score about 0.
THRESHOLD = -0.05
WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30
#: Trusted ids (8 bytes each, and the hash table's share) that may be broadcast.
BROADCAST_IDS = 1_000_000
SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row."""
    return F.transform(F.array(value), body)[0]


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")


def _repeated(words: Column) -> Column:
    """Words in windows of WINDOW words that the text holds twice or more. Windows compare by
    64-bit hash: sorting is needed only where some hash repeats."""

    def covered(h: Column) -> Column:
        tagged = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(tagged, lambda s: F.filter(s, lambda x, j: F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.when(j > 0, F.get(s, j - 1)["h"] == x["h"]), F.lit(False))))
        at = let(again, lambda a: F.sort_array(F.transform(a, lambda x: x["i"])))
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def base_rules(text: Column) -> Column:
    """struct<words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words> of one text."""
    text = F.coalesce(text, F.lit(""))
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return let(
        split_words(text),
        lambda w: F.struct(
            w.alias("words"),
            F.size(w).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, r"[ \t-\r]+", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            lines.cast("long").alias("n_dup_lines"),
            _repeated(w).cast("long").alias("n_repeat_words"),
        ),
    )


def _bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def gram_buckets(words: Column) -> Column:
    """Buckets of all unigrams and bigrams of an array of words."""
    pairs = F.when(F.size(words) < 2, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: _bucket(F.get(words, i - 1), F.get(words, i))))
    return F.concat(F.transform(words, lambda w: _bucket(w)), pairs)


def gram_weights(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row: weights, an array of BUCKETS longs. docs: doc_id, text; trusted: doc_id, distinct.
    The counters are combined in the map tasks."""
    if trusted.count() <= BROADCAST_IDS:
        marked = docs.join(F.broadcast(trusted.withColumn("target", F.lit(1))), "doc_id", "left").select("text", F.lit(1).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    else:
        once = docs.join(trusted, "doc_id", "left_semi")
        marked = docs.select("text", F.lit(1).alias("raw"), F.lit(0).alias("target")).unionByName(once.select("text", F.lit(0).alias("raw"), F.lit(1).alias("target")))
    grams = marked.select("raw", "target", F.explode(let(split_words(F.coalesce("text", F.lit(""))), gram_buckets)).alias("b"))
    counts = grams.groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    filled = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").select("b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    one = filled.agg(F.sort_array(F.collect_list(F.struct("b", "raw", "target"))).alias("all"), F.sum("raw").alias("raws"), F.sum("target").alias("targets"))
    weight = lambda x: F.round(1e6 * (F.log((x["target"] + 1) / (F.col("targets") + BUCKETS)) - F.log((x["raw"] + 1) / (F.col("raws") + BUCKETS)))).cast("long")
    return one.select(F.transform("all", weight).alias("weights"))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs (doc_id, text): the base rules' counts, base_failed, score, kept.

    Target: texts whose id labels marks quality = 1 (any of its rows); raw: all texts. Null
    and empty texts have no words and fail the base rules; their score is 0. Without
    trusted texts, or without any text, all weights tend to 0 and the base rules decide
    alone. Repeated rows are judged alike; long texts count whole; other columns are ignored; an
    empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    weights = gram_weights(docs, trusted).scalar()
    ruled = docs.select("doc_id", base_rules(F.col("text")).alias("r")).select("doc_id", "r.*", weights.alias("weights"))
    score = F.transform(
        F.array(F.struct("words", "weights")),
        lambda s: let(gram_buckets(s["words"]), lambda g: F.when(F.size(g) > 0, F.aggregate(g, F.lit(0).cast("long"), lambda a, b: a + F.get(s["weights"], b)) / F.size(g) / 1e6).otherwise(F.lit(0.0))),
    )[0]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    scored = ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.round(score, 9).alias("score"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
