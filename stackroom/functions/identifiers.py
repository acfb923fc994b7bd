"""Identifier columns (DOI, ISBN, arXiv) and dates. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(raw: Column) -> Column:
    return F.trim(F.coalesce(raw.cast("string"), F.lit("")))


def _after(text: Column, prefix: str) -> Column:
    return F.trim(F.regexp_replace(text, f"(?i)^{prefix}", ""))


def strip_trailing_punctuation(text: Column) -> Column:
    """Drops . , ; and closers without an opener from the end, as many as there are."""
    count = lambda t, c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))

    def one(t: Column) -> Column:
        last = F.right(t, F.lit(1))
        drop = last.isin(".", ",", ";") | ((last == ")") & (count(t, "(") < count(t, ")"))) | ((last == "]") & (count(t, "[") < count(t, "]")))
        return F.when(drop, F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t)

    run = F.length(F.regexp_extract(text, r"[.,;)\]]*$", 0))
    steps = F.when(run > 0, F.sequence(F.lit(1), run)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, text, lambda t, _: one(t))


def normalize_doi(raw: Column) -> Column:
    """Bare DOI of a bare, doi: or doi.org form, case kept; null if it is none."""
    text = _after(_text(raw), r"doi:\s*")
    url = text.rlike("(?i)^https?://")
    text = F.when(url, F.regexp_extract(text, r"(?i)doi\.org/(10\.\d{4,9}/[^\s?#]+)", 1)).otherwise(text)
    text = strip_trailing_punctuation(text)
    return F.when(text.rlike(r"^10\.\d{4,9}/\S+$"), text)


def doi_key(raw: Column) -> Column:
    return F.lower(normalize_doi(raw))


def _digits(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _isbn13_sum(text: Column) -> Column:
    return F.aggregate(F.transform(_digits(text), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(3 * c.cast("int"))), F.lit(0), lambda a, b: a + b)


def _isbn10_sum(text: Column) -> Column:
    return F.aggregate(F.transform(_digits(F.upper(text)), lambda c, i: F.when(c == "X", F.lit(10)).otherwise(c.cast("int")) * (10 - i)), F.lit(0), lambda a, b: a + b)


def isbn10_to_13(isbn: Column) -> Column:
    core = F.concat(F.lit("978"), F.substring(isbn, 1, 9))
    return F.concat(core, ((10 - _isbn13_sum(core) % 10) % 10).cast("string"))


def normalize_isbn(raw: Column) -> Column:
    """ISBN-13 of an ISBN-10, ISBN-13, prefixed or URL form with a right check digit; else null."""
    text = _after(_after(_text(raw), "isbn:"), "isbn[- ]")
    text = F.when(text.rlike("(?i)^https?://"), F.regexp_extract(text, r"(?i)/(97[89][- ]?\d[- ]?\d{3}[- ]?\d{5}[- ]?\d|\d{9}[\dX])", 1)).otherwise(text)
    text = F.regexp_replace(text, r"[\s-]", "")
    ten, thirteen = text.rlike(r"^\d{9}[\dXx]$"), text.rlike(r"^97[89]\d{10}$")
    return F.when(ten, F.when(_isbn10_sum(text) % 11 == 0, isbn10_to_13(text))).when(thirteen, F.when(_isbn13_sum(text) % 10 == 0, text))


def isbn_keys(raw: Column) -> Column:
    """All valid ISBNs of a field, as distinct ISBN-13."""
    return F.array_distinct(F.filter(F.transform(F.split(_text(raw), r"[,;\s]+"), normalize_isbn), lambda x: x.isNotNull()))


ARXIV = r"[0-9]{4}\.[0-9]{4,5}(?:v\d+)?|[A-Za-z][A-Za-z-]*(?:\.[A-Za-z][A-Za-z-]*)?/\d{7}(?:v\d+)?"


def normalize_arxiv(raw: Column) -> Column:
    """arXiv id, with version if given, of a bare, arxiv: or URL form; else null."""
    text = _after(_text(raw), r"arxiv:\s*")
    text = F.when(text.rlike("(?i)^https?://"), F.regexp_extract(text, rf"(?i)arxiv\.org/(?:abs|pdf)/({ARXIV})", 1)).otherwise(text)
    return F.when(text.rlike(rf"^(?:{ARXIV})$"), text)


def arxiv_identity(raw: Column) -> Column:
    """arXiv id without version; also of the DOI form."""
    doi = F.regexp_extract(_text(raw), r"(?i)^(?:https?://(?:dx\.)?doi\.org/)?10\.48550/arxiv\.(.+)$", 1)
    return F.regexp_replace(normalize_arxiv(F.when(doi != "", doi).otherwise(_text(raw))), r"(?i)v\d+$", "")


def arxiv_from_lines(extra: Column) -> Column:
    return arxiv_identity(F.regexp_extract(F.coalesce(extra, F.lit("")), r"(?mi)^\s*arxiv:\s*(\S+)", 1))


def date_key(parsed: Column, display: Column) -> Column:
    """YYYY-MM-DD with 00 for missing parts; the first 4-digit year of display without parsed,
    0000 without any; null without a date."""
    parsed, display = _text(parsed), _text(display)
    year = F.regexp_extract(display, r"\b(\d{4})\b", 1)
    text = F.when(parsed != "", parsed).when(display == "", F.lit(None)).when(year != "", year).otherwise("0000")
    part = lambda i, n: F.lpad(F.coalesce(F.get(F.split(text, "-"), F.lit(i)), F.lit("00")), n, "0")
    return F.when(F.get(F.split(text, "-"), F.lit(0)).rlike(r"^\d+$"), F.concat_ws("-", part(0, 4), part(1, 2), part(2, 2)))


def display_date(multipart: Column) -> Column:
    """The part after the first space of 'YYYY-MM-DD text'; all of it without a space."""
    return F.substr(multipart, F.instr(multipart, " ") + 1)


def year_of(multipart: Column) -> Column:
    return F.when(F.length(multipart) >= 4, F.substring(multipart, 1, 4))


def iso_timestamp(text: Column) -> Column:
    return F.when(text.isNotNull() & (text != ""), F.concat(F.regexp_replace(text, " ", "T"), F.lit("Z")))


def slash_date(text: Column) -> Column:
    """2020/07/07 -> 2020-07-07."""
    return F.regexp_replace(text, r"^(\d{4})/(\d{1,2})(?:/(\d{1,2}))?$", "$1-$2-$3")


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """BibTeX and CSL dates: the parts that are there, from the year on."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(year.isNotNull(), F.concat_ws("-", year.cast("string"), F.when(month.isNotNull(), two(month)), F.when(month.isNotNull() & day.isNotNull(), two(day))))


def csl_date(parts: Column) -> Column:
    """CSL date-parts [[y, m, d]]."""
    first = F.get(parts, F.lit(0))
    return date_from_parts(F.get(first, F.lit(0)), F.get(first, F.lit(1)), F.get(first, F.lit(2)))


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, "^(?:storage|attachments):", ""), r"([^/\\]*)$", 1)


def source_kind(source: Column) -> Column:
    """What an ingest argument is; the first rule that fits."""
    text = _text(source)
    kinds = [
        ("bibtex", text.rlike(r"(?s)^@\w+\s*\{")),
        ("csl_json", text.rlike(r"(?s)^[\[{].*\"(?:type|title|DOI)\"")),
        ("arxiv", arxiv_identity(text).isNotNull()),
        ("doi", normalize_doi(text).isNotNull()),
        ("url", text.rlike("(?i)^https?://")),
        ("isbn", normalize_isbn(text).isNotNull()),
        ("file", text.rlike(r"(?i)^[/~.].*|.*\.(?:pdf|epub|html?|docx?|txt|md)$")),
    ]
    out = F.lit(None).cast("string")
    for kind, rule in reversed(kinds):
        out = F.when(rule, F.lit(kind)).otherwise(out)
    return out


def attachment_kind(path: Column, mime: Column) -> Column:
    """pdf, html, markdown, text or null, by MIME type, then by suffix."""
    path, mime = F.lower(_text(path)), F.lower(_text(mime))
    return (
        F.when((mime == "application/pdf") | path.endswith(".pdf"), "pdf")
        .when(mime.isin("text/html", "application/xhtml+xml") | path.rlike(r"\.x?html?$"), "html")
        .when((mime == "text/markdown") | path.rlike(r"\.(?:md|markdown)$"), "markdown")
        .when((mime == "text/plain") | path.endswith(".txt"), "text")
    )


#: Highlight colours by code.
COLOURS = {"#ffd400": "yellow", "#ff6666": "red", "#5fb236": "green", "#2ea8e5": "blue", "#a28ae5": "purple", "#e56eee": "magenta", "#f19837": "orange", "#aaaaaa": "gray"}


def colour_name(code: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])[F.lower(code)], F.lit(""))
