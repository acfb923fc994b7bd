"""License scan: exact set-similarity join of text blocks with licence templates.

Native: only DataFrame functions. Tokens are pairs of neighbouring words, of which only those
matter that occur in a template. Blocks are windows of words, whatever lines they stand on: for
a template of n words the stride is the least power of two of at least ROOM * n, a window starts
at every multiple of the stride and holds two strides, so every run of up to ROOM * n words lies
within a window, and a long text is no single bag of words. A window is a hit of a template if it
holds at least CONTAINMENT of the template's tokens and all its required phrases.

Tokens are ordered by their frequency over all texts, rarest first. A window with an overlap of
need = ceil(CONTAINMENT * |T|) has its first common token within the first |T| - need + 1 tokens
of T (prefix filter), has at least need tokens (length filter), and both sides must have enough
tokens from there on (positional filter). Survivors are verified exactly. Texts are cut into
segments of two of the longest strides, every window in the segment of its start, which bounds the
rows that the join copies. The templates are configuration; their tokens are broadcast up to
BROADCAST_ROWS of them, and joined by a shuffle beyond.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lower_ascii, read, shared_table
from .license_texts import TEMPLATES
from .quality_rules import let

#: Words of this scan: ASCII letters and digits, and all that is not ASCII.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = TOKEN.replace("[^", "[")
CONTAINMENT, ROOM = 0.8, 1.25
BROADCAST_ROWS = 100_000
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def _words(text: str) -> list[str]:
    return re.findall(TOKEN, text.translate(str.maketrans(UPPER, LOWER)))


def _tokens(text: str) -> list[str]:
    words = _words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def template_rows(templates, containment: float) -> list[tuple]:
    """(template, label, token, required, size, need, stride) for every token of every template."""
    rows = []
    for k, (label, phrases, text) in enumerate(templates):
        tokens, required = _tokens(text), {t for p in phrases for t in _tokens(p)}
        if not required <= set(tokens):
            raise ValueError(f"{label} lacks a phrase that it requires")
        stride = 1 << math.ceil(math.log2(ROOM * len(_words(text))))
        rows += [(k, label, t, t in required, len(tokens), math.ceil(containment * len(tokens) - 1e-9), stride) for t in tokens]
    return rows


def _places(words: Column) -> Column:
    """Starts of the phrases among the words, as structs (at, label)."""

    def here(i: Column) -> Column:
        found = F.lit(None).cast("string")
        for phrase, label in PHRASES:
            same = F.lit(True)
            for k, w in enumerate(phrase.split()):
                same = same & F.coalesce(F.get(words, i + k) == w, F.lit(False))
            found = F.when(same, F.lit(label)).otherwise(found)
        return F.struct(i.cast("long").alias("at"), found.alias("label"))

    return F.filter(F.transform(words, lambda _, i: here(i)), lambda p: p["label"].isNotNull())


def _held(words: Column, vocabulary: list[str], least: int) -> Column:
    """The tokens of the vocabulary in a text, as structs (at, token), if at least that many differ."""
    token = lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1))
    first = sorted({t.split(" ")[0] for t in vocabulary})
    at = F.filter(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.get(words, i).isin(first) & token(i).isin(vocabulary))
    none = F.array().cast("array<struct<at:int,token:string>>")
    held = let(F.transform(at, lambda i: F.struct(i.alias("at"), token(i).alias("token"))), lambda h: F.when(F.size(F.array_distinct(F.transform(h, lambda x: x["token"]))) >= least, h).otherwise(none))
    return F.when(F.size(words) < 2, none).otherwise(held)


def described(docs: DataFrame, vocabulary: list[str], least: int) -> DataFrame:
    """docs (id, t lower-cased) -> row (unique), the other columns, n_words, places, held. One pass over
    the texts, written. Places are looked for only where a phrase can occur."""
    near = "|".join(GAP.join(p.split()) for p, _ in PHRASES)
    held = reduce(or_, (reduce(and_, (F.col("t").contains(w) for w in p.split())) for p, _ in PHRASES))
    none = F.array().cast("array<struct<at:bigint,label:string>>")
    found = let(
        F.filter(F.split("t", GAP), lambda w: w != ""),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.when(held & F.col("t").rlike(near), _places(w)).otherwise(none).alias("places"), _held(w, vocabulary, least).alias("held")),
    )
    return shared_table(docs.select(F.monotonically_increasing_id().alias("row"), "*", found.alias("found")).drop("t").select("*", "found.*").drop("found"), "license")


def block_hits(texts: DataFrame, rows: list[tuple]) -> DataFrame:
    """(row, first, label, containment) for every window of words and template at or above the
    threshold; first is the window's first word. texts: row, held; rows: template_rows."""
    spark = texts.sparkSession
    near = F.broadcast if len(rows) <= BROADCAST_ROWS else lambda df: df
    listed = spark.createDataFrame(rows, "template int, label string, token string, required boolean, size int, need int, stride int")
    longest, least = max(r[6] for r in rows), min(r[5] for r in rows)
    seen = texts.select("row", F.explode("held").alias("x")).select("row", "x.at", "x.token")

    counts = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    tokens = listed.select("token").distinct().join(near(counts), "token", "left")
    order = tokens.agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("all")).select(F.posexplode("all").alias("rank", "x")).select("rank", "x.token")
    order = shared_table(order, "ranks")
    index = listed.join(near(order), "token").groupBy("template", "label", "size", "need", "stride").agg(F.sort_array(F.collect_list("rank")).alias("all"), F.collect_list(F.when(F.col("required"), F.col("rank"))).alias("must"))
    prefix = index.select("*", F.posexplode("all").alias("i", "rank")).where("i <= size - need")

    parted = seen.join(near(order), "token").select("row", "at", "rank", F.explode(F.array(F.floor(F.col("at") / longest), F.floor(F.col("at") / longest) - 1)).alias("part")).where("part >= 0")
    segments = parted.groupBy("row", "part").agg(F.sort_array(F.collect_list(F.struct("at", "rank"))).alias("held")).where(F.size("held") >= least)
    joined = segments.select("row", "part", "held", F.explode("held").alias("x")).select("row", "part", "held", "x.at", "x.rank").join(near(prefix), "rank")
    window = F.explode(F.array(*[(F.floor(F.col("at") / F.col("stride")) - back) * F.col("stride") for back in (0, 1)]))
    joined = joined.withColumn("first", window).where((F.col("first") >= F.col("part") * longest) & (F.col("first") < (F.col("part") + 1) * longest))
    inside = F.filter("held", lambda x: (x["at"] >= F.col("first")) & (x["at"] <= F.col("first") + 2 * F.col("stride") - 2))
    joined = joined.withColumn("block", F.array_distinct(F.transform(inside, lambda x: x["rank"]))).where("size(block) >= need")
    left = F.size(F.filter("block", lambda r: r >= F.col("rank")))
    joined = joined.where(F.least(F.col("size") - F.col("i"), left) >= F.col("need"))
    overlap = F.size(F.array_intersect("block", "all"))
    hits = joined.where((overlap >= F.col("need")) & (F.size(F.array_except("must", "block")) == 0))
    return hits.select("row", "first", "label", (overlap / F.col("size")).alias("containment")).distinct()


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: 1 with a base phrase, else the best containment of a block, else 0. Null and empty
    texts have no words and no labels (empty strings). Ids may be null or repeat: each row is judged
    by its own text. Long texts are scanned whole. Other columns are ignored; an empty table gives
    an empty result.
    """
    rows = template_rows(templates, containment)
    docs = df.select(F.col(id_col).alias("doc_id"), lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    texts = described(docs, sorted({r[2] for r in rows}), min(r[5] for r in rows))
    hits = block_hits(texts, rows).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    base = texts.select("row", "doc_id", "n_words", "places", F.transform("places", lambda p: p["at"]).alias("at"), F.array_distinct(F.transform("places", lambda p: p["label"])).alias("base"))
    none = F.array().cast("array<string>")
    return base.join(hits, "row", "left").select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("at").alias("first_word"),
        F.array_max("at").alias("last_word"),
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def _sql() -> str:
    templates = ", ".join(f"({k}, '{label}', '{token}', {required}, {size}, {need}, {stride})" for k, label, token, required, size, need, stride in template_rows(TEMPLATES, CONTAINMENT))
    alternatives = " UNION ALL ".join(
        f"SELECT id, i - 1 AS spot, '{label}' AS label FROM p WHERE " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) for phrase, label in PHRASES
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT id, doc_id, regexp_extract_all(t, '{TOKEN}') AS w FROM d),
p AS (SELECT id, w, unnest(generate_series(1, len(w))) AS i FROM w),
b AS ({alternatives}),
bb AS (SELECT id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list(DISTINCT label) AS base FROM b GROUP BY id),
t AS (SELECT * FROM (VALUES {templates}) v(template, label, token, required, size, need, stride)),
m AS (SELECT template, count(*) FILTER (required) AS must FROM t GROUP BY template),
g AS (SELECT id, i - 1 AS spot, w[i] || ' ' || w[i + 1] AS token FROM p WHERE i < len(w)),
o AS (SELECT g.id, t.*, spot, unnest([spot // stride, spot // stride - 1]) * stride AS first FROM g JOIN t USING (token)),
h AS (SELECT id, template, label, count(DISTINCT token)::DOUBLE / size AS c FROM o JOIN m USING (template)
  WHERE first >= 0 AND spot <= first + 2 * stride - 2
  GROUP BY id, template, label, first, size, need, must HAVING count(DISTINCT token) >= need AND count(DISTINCT token) FILTER (required) = must),
hh AS (SELECT id, list(DISTINCT label) AS found, max(c) AS best FROM h GROUP BY id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN bb ON w.id = bb.id LEFT JOIN hh ON w.id = hh.id
"""


OP4_SQL = _sql()
