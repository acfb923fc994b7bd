"""Readers and writers of files: whole texts, HTML, JSON lines, PDF and EPUB behind optional packages."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TITLES = ("citation_title", "dc.title", "og:title")
#: Meta names by field, the most exact first.
META = {"title": TITLES, "date": ("citation_publication_date", "citation_date", "dc.date"), "doi": ("citation_doi", "dc.identifier"), "journal": ("citation_journal_title", "dc.source"), "pdf_url": ("citation_pdf_url",), "abstract": ("citation_abstract", "dc.description", "og:description")}
AUTHORS = ("citation_author", "dc.creator")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per file; bytes that are no UTF-8 become U+FFFD."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", F.lit("UTF-8")).alias("text"))


def read_json_records(spark: SparkSession, path: str, schema: StructType | str | None = None, array: bool = False) -> DataFrame:
    """JSON lines, or one JSON array."""
    reader = spark.read.option("multiLine", array)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


class _Head(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: dict[str, list[str]] = {}
        self.done = False

    def handle_starttag(self, tag, attrs):
        if self.done or tag != "meta":
            return
        a = {k.lower(): v for k, v in attrs if k}
        name, content = a.get("name") or a.get("property") or a.get("itemprop"), a.get("content")
        if name and content and content.strip():
            self.found.setdefault(name.strip().lower(), []).append(content.strip())

    def handle_endtag(self, tag):
        self.done = self.done or tag == "head"


def meta_of(html: str | None) -> dict[str, list[str]]:
    parser = _Head()
    try:
        parser.feed(re.split(r"(?i)</head>", html or "", maxsplit=1)[0])
    except Exception:  # noqa: BLE001  broken mark-up: what was read so far counts
        pass
    return parser.found


def meta_tags(html: Column) -> Column:
    """map<name, array<content>> of the head's meta elements, names in lower case."""

    @F.pandas_udf("map<string,array<string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(meta_of)

    return run(html)


def citation_of(meta: Column) -> Column:
    """struct of citation fields from a meta map: the most exact vocabulary that has each one;
    authors once each."""
    first = lambda names: F.coalesce(*[F.get(meta[n], F.lit(0)) for n in names])
    people = F.coalesce(*[meta[n] for n in AUTHORS], F.array().cast("array<string>"))
    return F.struct(*[first(n).alias(f) for f, n in META.items()], F.array_distinct(people).alias("authors"))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def html_text(html: Column) -> Column:
    """All text of a page without scripts and styles, in built-in expressions; no main-text choice."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def _pdf_pages(data: bytes, most: int | None) -> list[str]:
    try:
        from pypdf import PdfReader
    except ImportError:
        return []
    import io

    pages = PdfReader(io.BytesIO(data)).pages
    return [p.extract_text() or "" for p in (pages if most is None else pages[:most])]


def _epub_pages(data: bytes) -> list[str]:
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted(n for n in z.namelist() if re.search(r"\.x?html?$", n, re.I))
        return [" ".join(entities.unescape(re.sub(r"(?s)<(script|style).*?</\1>|<[^>]*>", " ", z.read(n).decode("utf-8", "replace"))).split()) for n in names]


def extract_one(path: str, data: bytes, most_pages: int | None = None) -> tuple[str | None, list[str], str | None]:
    """(kind, pages, error) by the file's suffix. PDF needs pypdf; without it the error says so."""
    kind = (re.search(r"\.(\w+)$", path.lower()) or [None, ""])[1]
    try:
        if kind == "pdf":
            pages = _pdf_pages(data, most_pages)
            return "pdf", pages, None if pages else "no PDF reader installed, or no pages"
        if kind == "epub":
            return "epub", _epub_pages(data), None
        text = data.decode("utf-8", "replace")
        if kind in ("html", "htm", "xhtml"):
            return "html", [" ".join(entities.unescape(re.sub(r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ", text)).split())], None
        if kind in ("txt", "md", "markdown", "text"):
            return "text", text.split("\f"), None
        return None, [], f"no reader for .{kind}"
    except Exception as e:  # noqa: BLE001  one broken file must not end the job
        return kind, [], str(e)[:200]


def extract_files(spark: SparkSession, path: str, most_pages: int | None = None) -> DataFrame:
    """(path, length, kind, pages, error) of every file under path, in parallel; failed files have an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, n, *extract_one(p, bytes(c), most_pages)) for p, n, c in zip(b["path"], b["length"], b["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "length", "kind", "pages", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    return files.mapInPandas(run, "path string, length long, kind string, pages array<string>, error string")


def choose_attachment(attachments: DataFrame, item: str, kind: str, size: str, key: str, priority=("pdf", "html", "markdown", "text")) -> DataFrame:
    """The attachment to read of every item: first kind by priority, then the largest."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col(kind)), F.lit(0))
    rank = F.when(rank > 0, rank).otherwise(F.lit(len(priority) + 1))
    columns = [c for c in attachments.columns if c != item]
    best = attachments.groupBy(item).agg(F.min_by(F.struct(*columns), F.struct(rank.alias("r"), F.negative(F.col(size)).alias("s"), F.col(key).alias("k"))).alias("b"))
    return best.select(item, "b.*")


def page_range(df: DataFrame, pages: str, start: int, end: int | None = None, most: int | None = None) -> DataFrame:
    """One row per page from start to end (1-based, both in); most: a limit on one answer, none by default."""
    last = end if end is not None else start
    last = last if most is None else min(last, start + most - 1)
    return df.select("*", F.posexplode(pages).alias("__i", "page_text")).withColumn("page", F.col("__i") + 1).where(F.col("page").between(start, last)).drop("__i", pages)
