"""Exact vector search in built-in expressions: filters first, a dot product per row, one
TakeOrderedAndProject, so that only k rows a task reach the driver's side."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


METRICS = {"cosine": (cosine, True), "dot": (dot, True), "l2": (squared_distance, False)}


def nearest(vectors: DataFrame, query: Column, k: int, key: str, vector: str, metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """The k nearest rows with score (a distance for l2), ties by key. where is applied before the limit."""
    score, high = METRICS[metric]
    rows = vectors if where is None else vectors.where(where)
    scored = rows.where(F.col(vector).isNotNull()).withColumn("score", score(F.col(vector), query))
    return scored.orderBy(F.desc("score") if high else F.asc("score"), key).limit(k)


def metadata_filter(filters: dict | None) -> Column | None:
    """The stores' filter language: {field: value}, {field: {$op: value}}, {$and: [...]}, {$or: [...]}."""
    import functools
    import operator

    if not filters:
        return None
    ops = {"$eq": operator.eq, "$ne": operator.ne, "$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le, "$in": lambda c, v: c.isin(list(v)), "$nin": lambda c, v: ~c.isin(list(v))}
    each = []
    for field, value in filters.items():
        if field in ("$and", "$or"):
            each.append(functools.reduce(operator.and_ if field == "$and" else operator.or_, [metadata_filter(v) for v in value]))
        elif isinstance(value, dict):
            each += [ops[o](F.col(field), v) for o, v in value.items()]
        else:
            each.append(F.col(field) == F.lit(value))
    return functools.reduce(operator.and_, each)


def fetch_size(k: int, chunked: bool = False, reranked: bool = False) -> int:
    """How many passages to fetch for k items: four times for passages, three for a reranker."""
    return k * (4 if chunked else 1) * (3 if reranked else 1)


def collapse(hits: DataFrame, item: str, key: str, k: int) -> DataFrame:
    """The best passage of every item, then the k best items."""
    columns = [c for c in hits.columns if c != item]
    best = hits.groupBy(item).agg(F.max_by(F.struct(*columns), F.struct("score", F.negative(F.col(key)))).alias("b")).select(item, "b.*")
    return best.orderBy(F.desc("score"), item).limit(k)


def rerank(hits: DataFrame, text: str, key: str, k: int, scorer: Callable[[list[str]], Sequence[float]]) -> DataFrame:
    """The k best by a model's score of their texts; scorer gets a batch of texts."""
    at = hits.columns.index(text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(rerank=[float(s) for s in scorer(b.iloc[:, at].fillna("").tolist())])

    schema = hits.schema.add("rerank", "double")
    return hits.where(F.col(text).isNotNull()).mapInPandas(run, schema).orderBy(F.desc("rerank"), key).limit(k)


def embed(rows: DataFrame, text: str, embedder: Callable[[list[str]], Sequence[Sequence[float]]], out: str = "embedding", tries: int = 3, pause: float = 0.5) -> DataFrame:
    """rows with vectors from embedder, in batches. A failing batch is tried again after a pause that
    doubles, then fails the task, which Spark runs again; an error in the request itself (ValueError,
    TypeError) would only come back and fails at once."""
    import pyspark.sql.types as T

    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for left in range(tries - 1, -1, -1):
                try:
                    vectors = embedder(b[text].fillna("").tolist())
                    break
                except (ValueError, TypeError):
                    raise
                except Exception:
                    if not left:
                        raise
                    time.sleep(pause * 2 ** (tries - 1 - left))
            yield b[names].assign(**{out: [list(map(float, v)) for v in vectors]})

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))


def hash_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic embedder that needs no model: hashed words with signs, unit length."""
    import math
    import zlib

    def embedder(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h & 0x10000 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return embedder
