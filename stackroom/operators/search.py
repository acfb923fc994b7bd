"""Searches over item tables: several conditions, keywords with spellings, cascade, notes, names."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, fold_value, query_variants, strip_tags
from .predicates import Field, all_or_any, tag_filter


def clamp_limit(limit, default: int = 10, most: int = 100) -> int:
    """An int of a number or numeric text; default where it is none or below 1."""
    try:
        n = int(limit)
    except (TypeError, ValueError):
        return default
    return default if n <= 0 else min(n, most)


def clamp_offset(offset, default: int = 0) -> int:
    try:
        return max(0, int(offset))
    except (TypeError, ValueError):
        return default


def parse_scope(value) -> int | None:
    """Library scope: None or 'all' is every library, 0 the personal one, n a group."""
    if value is None or str(value).strip().lower() in ("", "all"):
        return None
    return int(str(value).strip().lower().removeprefix("group:").removeprefix("g"))


def in_scope(items: DataFrame, scope: int | None, column: str = "group_id") -> DataFrame:
    return items if scope is None else items.where(F.col(column) == scope)


def live(items: DataFrame, trash: DataFrame, key: str) -> DataFrame:
    """Items that are not in the trash."""
    return items.join(trash.select(key).distinct(), key, "left_anti")


def of_type(items: DataFrame, wanted: str | None, column: str) -> DataFrame:
    """'X' keeps a type, '-X' drops it; by lower case."""
    if not wanted:
        return items
    name = wanted.removeprefix("-").lower()
    return items.where((F.lower(column) != name) if wanted.startswith("-") else (F.lower(column) == name))


def order_by(items: DataFrame, keys: Sequence[tuple[str | Column, str]], tie: str) -> DataFrame:
    """By columns and directions, missing values last, then by tie: a total order."""
    cols = [F.col(c) if isinstance(c, str) else c for c, _ in keys]
    return items.orderBy(*[c.desc_nulls_last() if d == "desc" else c.asc_nulls_last() for c, (_, d) in zip(cols, keys, strict=True)], tie)


def search(items: DataFrame, fields: Mapping[str, Field], conditions: Sequence[Mapping[str, str]], join_mode: str = "all", trash: DataFrame | None = None, key: str = "key", sort: Sequence[tuple[str, str]] = (), limit: int | None = None, offset: int = 0, keys=None) -> DataFrame:
    """Several conditions on a table; filters precede the limit."""
    found = items.where(all_or_any(fields, conditions, join_mode, keys))
    if trash is not None:
        found = live(found, trash, key)
    if sort or limit is not None:
        found = order_by(found, sort, key)
    if offset:
        found = found.offset(clamp_offset(offset))
    return found if limit is None else found.limit(clamp_limit(limit, 50, 500))


def any_contains(columns: Sequence[Column], query: str) -> Column:
    """Some column holds some spelling of the query, by ASCII case only."""
    hits = [F.contains(F.translate(F.coalesce(c.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("".join(x.lower() if x.isascii() else x for x in v))) for v in query_variants(query) for c in columns]
    return functools.reduce(operator.or_, hits) if hits else F.lit(False)


def keyword_search(items: DataFrame, query: str, columns: Sequence[Column], tags: Column | None = None, tag=None, key: str = "key", sort: Sequence[tuple[str, str]] = (), limit: int = 10) -> DataFrame:
    found = items.where(any_contains(columns, query))
    wanted = tag_filter(tags, tag) if tags is not None else None
    if wanted is not None:
        found = found.where(wanted)
    return order_by(found, sort, key).limit(clamp_limit(limit))


def cascade(attempts: Sequence[Callable[[], DataFrame]]) -> tuple[int, DataFrame]:
    """The first attempt with rows, and its number; the last one if none has any."""
    for i, attempt in enumerate(attempts):
        found = attempt()
        if not found.isEmpty():
            return i, found
    return len(attempts) - 1, found


def ranked_union(attempts: Sequence[DataFrame], key: str) -> DataFrame:
    """All attempts' rows, each key once, from the first attempt that has it; adds attempt."""
    rows = functools.reduce(DataFrame.unionByName, [df.withColumn("attempt", F.lit(i)) for i, df in enumerate(attempts)])
    return rows.groupBy(key).agg(*[F.min_by(c, "attempt").alias(c) for c in rows.columns if c not in (key, "attempt")], F.min("attempt").alias("attempt"))


def all_words(names: Column, query: str) -> Column:
    """Every word of the query stands in the name, by lower case."""
    words = query.lower().split()
    return functools.reduce(operator.and_, [F.contains(F.lower(names), F.lit(w)) for w in words]) if words else F.lit(False)


def whole_text(items: DataFrame, columns: Sequence[str], query: str, key: str, limit: int = 50) -> DataFrame:
    """Folded substring of all columns together."""
    text = F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])
    return items.where(F.contains(fold(text), F.lit(fold_value(query)))).orderBy(key).limit(limit)


def search_notes(notes: DataFrame, note: str, query: str, key: str, limit: int = 20) -> DataFrame:
    """Notes whose text without mark-up holds the query; stripped first, limited last."""
    text = strip_tags(F.col(note))
    return notes.where(F.contains(F.lower(text), F.lit(query.lower()))).withColumn("snippet", F.substring(text, 1, 200)).orderBy(key).limit(limit)


def by_citation_key(items: DataFrame, wanted: str, exact: Column, extra_key: Column, key: str) -> DataFrame:
    """The item whose own key field is wanted, else one whose extra lines give it."""
    rank = F.when(exact == wanted, F.lit(0)).when(extra_key == wanted, F.lit(1))
    return items.withColumn("__rank", rank).where("__rank IS NOT NULL").orderBy("__rank", key).limit(1).drop("__rank")
