"""URL allow and block lists as one trie over reversed host labels and path segments.

The trie is built from the rule list, which is configuration: its size is checked
against MAX_RULES before it is shipped to the executors with the function.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, read

#: (verdict, host, path); the path is a prefix of the url's path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DEFAULT = "allow"
#: About 1 GB as a trie; larger lists belong in a join on (host suffix, path prefix).
MAX_RULES = 2_000_000


@dataclass
class Node:
    labels: dict[str, Node] = field(default_factory=dict)
    segments: dict[str, Node] = field(default_factory=dict)
    #: Rules that end inside a segment of the path, by the part of it that they name.
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)
    lengths: list[int] = field(default_factory=list)
    rule: tuple[str, str] | None = None  # of the host alone


class UrlTrie:
    """Longest match: the rule with most host labels, then with the longest path. Where an
    allow and a block rule name the same host and path, block wins."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]) -> None:
        self.root, count = Node(), 0
        for verdict, host, path in rules:
            count += 1
            if count > MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules")
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.labels.setdefault(label, Node())
            entry = (host + path, verdict)
            if not path:
                node.rule = entry if node.rule is None or verdict == "block" else node.rule
                continue
            *whole, part = path.removeprefix("/").split("/")
            for segment in whole:
                node = node.segments.setdefault(segment, Node())
            if part not in node.ends or verdict == "block":
                node.ends[part] = entry
                node.lengths = sorted({*map(len, node.ends)}, reverse=True)

    def _along(self, node: Node, segments: list[str]) -> tuple[str, str] | None:
        best = node.rule
        for segment in segments:
            for n in node.lengths:
                if len(segment) >= n and (found := node.ends.get(segment[:n])):
                    best = found
                    break
            if (node := node.segments.get(segment)) is None:
                break
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        segments = path.removeprefix("/").split("/") if path else []
        node, best = self.root, self._along(self.root, segments)
        for label in reversed(host.split(".")) if host else ():
            if (node := node.labels.get(label)) is None:
                break
            best = self._along(node, segments) or best
        return best


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path by the contract's cut points; both empty without "://"."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://(.*)\z", 1)
    return lower_ascii(F.regexp_extract(after, r"\A[^/?#]*", 0)), F.regexp_extract(after, r"\A[^/?#]*([^?#]*)", 1)


def filter_urls(df: DataFrame, url_col: str = "url", rules: Iterable[tuple[str, str, str]] = RULES, default: str = DEFAULT) -> DataFrame:
    """The rows of df with host, path, rule (null if none fits) and verdict; columns of df
    with these names are replaced. Null, empty and malformed urls have empty host and path and
    get the default verdict, unless a rule names the empty host. Repeated rows stay."""
    trie = UrlTrie(rules)

    @F.pandas_udf("struct<rule string, verdict string>")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            found = [trie.match(h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    host, path = url_parts(F.col(url_col))
    out = df.withColumns({"host": host, "path": path}).withColumn("__judged", judge("host", "path"))
    return out.withColumns({"rule": F.col("__judged.rule"), "verdict": F.col("__judged.verdict")}).drop("__judged")


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) v(rh, rp, verdict))
SELECT h.page_id, any_value(h.host) AS host, any_value(h.path) AS path, max_by(rh || rp, length(rh || rp)) AS rule, coalesce(max_by(verdict, length(rh || rp)), 'allow') AS verdict
FROM h LEFT JOIN r ON (h.host = rh OR ends_with(h.host, '.' || rh)) AND starts_with(h.path, rp) GROUP BY h.page_id
"""
