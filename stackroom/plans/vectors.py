"""Queries: exact vector search, passages, HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import passages as G
from ..operators import vector as V
from ..session import table
from ..sources import files as X

_Q = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"


def _dot(a, b):
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


_COS = f"{_dot('e.embedding', 'q.embedding')} / (sqrt({_dot('e.embedding', 'e.embedding')}) * sqrt({_dot('q.embedding', 'q.embedding')}))"


def first_vector(spark, sf_dir):
    return V.literal_vector(table(spark, sf_dir, "embeddings").orderBy("vec_id").first()["embedding"])


@query("knn", f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, {_Q} q ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def knn(spark, sf_dir):
    return V.nearest(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 10, "vec_id", "embedding").select("vec_id", F.round("score", 6).alias("score"))


@query("knn_l2", f"SELECT e.vec_id, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2))), 5) AS score FROM embeddings e, {_Q} q ORDER BY score, e.vec_id LIMIT 10")
def knn_l2(spark, sf_dir):
    return V.nearest(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 10, "vec_id", "embedding", "l2").select("vec_id", F.round("score", 5).alias("score"))


@query("knn_filtered", f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, {_Q} q WHERE (label = 3 OR label IN (1, 5)) AND vec_id >= 10 ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def knn_filtered(spark, sf_dir):
    where = V.metadata_filter({"$or": [{"label": 3}, {"label": {"$in": [1, 5]}}], "vec_id": {"$gte": 10}})
    return V.nearest(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 10, "vec_id", "embedding", where=where).select("vec_id", F.round("score", 6).alias("score"))


@query("knn_group_scope", f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, {_Q} q WHERE vec_id % 4 = 2 ORDER BY {_COS} DESC, e.vec_id LIMIT 5")
def knn_group_scope(spark, sf_dir):
    return V.nearest(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 5, "vec_id", "embedding", where=F.col("vec_id") % 4 == 2).select("vec_id", F.round("score", 6).alias("score"))


@query("knn_collapse", f"WITH h AS (SELECT e.vec_id, e.vec_id // 4 AS item, {_COS} AS score FROM embeddings e, {_Q} q ORDER BY score DESC, e.vec_id LIMIT 40) SELECT item, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, vec_id) AS r FROM h) h_ WHERE r = 1 ORDER BY h_.score DESC, item LIMIT 10")
def knn_collapse(spark, sf_dir):
    """Ten items of forty passages: the best passage of each."""
    hits = V.nearest(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), V.fetch_size(10, chunked=True), "vec_id", "embedding")
    return V.collapse(hits.select(F.floor(F.col("vec_id") / 4).cast("long").alias("item"), "vec_id", "score"), "item", "vec_id", 10).withColumn("score", F.round("score", 6))


@query("knn_hydrated", f"WITH h AS (SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, {_Q} q ORDER BY {_COS} DESC, e.vec_id LIMIT 10) SELECT h.vec_id, score, lang, source FROM h LEFT JOIN documents d ON d.doc_id = h.vec_id")
def knn_hydrated(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    return knn(spark, sf_dir).join(docs, "vec_id", "left").select("vec_id", "score", "lang", "source")


@query("rerank_topk")
def rerank_topk(spark, sf_dir):
    """Of the forty longest documents with a word, the ten that share most words with a query."""
    hits = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("idiot"))).orderBy(F.desc("n_chars"), "doc_id").limit(V.fetch_size(10, chunked=True)).select("doc_id", "text")
    wanted = {"the", "of", "and", "in"}
    return V.rerank(hits, "text", "doc_id", 10, lambda texts: [len(wanted & set(t.lower().split())) / (1 + len(t)) for t in texts]).select("doc_id", F.round("rerank", 9).alias("score"))


@query("embed_documents")
def embed_documents(spark, sf_dir):
    out = V.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", V.hash_embedder(16))
    return out.select("doc_id", F.round(V.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm"))


@query("passages")
def split(spark, sf_dir):
    return G.split_passages(table(spark, sf_dir, "documents"), "doc_id", "text").drop("passage")


@query("best_snippet")
def best_snippet(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("s", G.snippets(F.col("text"), "pathetic idiot"))
    return docs.select("doc_id", "s.char_start", F.md5("s.snippet").alias("snippet_md5"))


@query("fuzzy_page")
def fuzzy_page(spark, sf_dir):
    """Lines of a document as its pages."""
    docs = table(spark, sf_dir, "documents").withColumn("f", G.find_in_pages(F.split("text", "\n"), "the and of the in thand"))
    return docs.select("doc_id", "f.page", F.round("f.ratio", 6).alias("ratio"), "f.found")


_TITLE = "trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'))"


@query("html_title", f"SELECT page_id, {_TITLE} AS title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.html_title(F.col("html")).alias("title"))


def _plain_sql():
    out = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return f"SELECT page_id, trim(regexp_replace({out}, '\\s+', ' ', 'g')) AS text FROM pages"


@query("html_text", _plain_sql())
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.html_text(F.col("html")).alias("text"))


@query("meta_tags")
def meta_tags(spark, sf_dir):
    head = F.regexp_replace("html", "<head>", '<head><meta name="citation_title" content="A &amp; B"><META NAME=citation_author content="Doe, J."><meta name="citation_author" content="Doe, J.">')
    pages = table(spark, sf_dir, "pages").withColumn("c", X.citation_of(X.meta_tags(head)))
    return pages.select("page_id", "c.title", F.array_join("c.authors", ";").alias("authors"))
