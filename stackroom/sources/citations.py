"""Citation formats: BibTeX and CSL-JSON in, BibTeX and Markdown out."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = "struct<item_type string, title string, creators array<struct<first string, last string, name string>>, date string, doi string, isbn string, container string, publisher string, volume string, issue string, pages string, url string, abstract string, cite_key string, extra string, error string>"
#: Item types by entry type; others are documents.
BIBTEX_TYPES = {
    "article": "journalArticle", "book": "book", "booklet": "book", "inbook": "bookSection", "incollection": "bookSection", "suppbook": "bookSection", "suppcollection": "bookSection",
    "inproceedings": "conferencePaper", "conference": "conferencePaper", "proceedings": "book", "phdthesis": "thesis", "mastersthesis": "thesis", "thesis": "thesis",
    "techreport": "report", "report": "report", "manual": "document", "misc": "document", "unpublished": "manuscript", "patent": "patent", "online": "webpage", "electronic": "webpage",
    "webpage": "webpage", "software": "computerProgram", "dataset": "document", "artwork": "artwork", "audio": "audioRecording", "video": "videoRecording", "letter": "letter",
    "standard": "document", "periodical": "journalArticle", "collection": "book",
}
#: Item types by CSL type and by the types of registry records; others are documents.
CSL_TYPES = {
    "article-journal": "journalArticle", "article-magazine": "magazineArticle", "article-newspaper": "newspaperArticle", "article": "preprint", "book": "book", "chapter": "bookSection",
    "paper-conference": "conferencePaper", "thesis": "thesis", "report": "report", "webpage": "webpage", "post-weblog": "blogPost", "post": "forumPost", "patent": "patent",
    "manuscript": "manuscript", "dataset": "dataset", "entry-encyclopedia": "encyclopediaArticle", "entry-dictionary": "dictionaryEntry", "speech": "presentation", "interview": "interview",
    "personal_communication": "letter", "broadcast": "radioBroadcast", "motion_picture": "film", "song": "audioRecording", "map": "map", "legal_case": "case", "legislation": "statute",
    "bill": "bill", "software": "computerProgram", "figure": "artwork", "graphic": "artwork", "pamphlet": "document", "review": "journalArticle", "review-book": "journalArticle",
    "treaty": "document", "journal-article": "journalArticle", "proceedings-article": "conferencePaper", "book-chapter": "bookSection", "book-part": "bookSection",
    "book-section": "bookSection", "reference-entry": "dictionaryEntry", "monograph": "book", "edited-book": "book", "reference-book": "book", "book-set": "book", "book-series": "book",
    "book-track": "bookSection", "proceedings": "book", "proceedings-series": "book", "report-component": "report", "report-series": "report", "dissertation": "thesis",
    "posted-content": "preprint", "journal-issue": "journalArticle", "journal-volume": "journalArticle", "journal": "journalArticle", "database": "dataset", "standard": "standard",
    "component": "document", "grant": "document", "peer-review": "document", "other": "document",
}
OUT_TYPES = {"journalArticle": "article", "book": "book", "bookSection": "incollection", "conferencePaper": "inproceedings", "thesis": "phdthesis", "report": "techreport", "webpage": "online", "patent": "patent", "dataset": "dataset", "computerProgram": "software", "manuscript": "unpublished"}
MONTHS = {m: i for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1)}


def _braced(text: str, at: int) -> tuple[str, int]:
    """The value that begins at at: {...}, "..." or a bare word; and the place behind it."""
    if at < len(text) and text[at] in '{"':
        closer = "}" if text[at] == "{" else '"'
        depth, i = (1, at + 1) if closer == "}" else (0, at + 1)
        while i < len(text):
            c = text[i]
            if c == "\\":
                i += 1
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if closer == "}" and depth == 0:
                    return text[at + 1 : i], i + 1
            elif c == '"' and closer == '"' and depth == 0:
                return text[at + 1 : i], i + 1
            i += 1
        raise ValueError("a value isn't closed")
    word = re.compile(r"[^,}\s#]+").match(text, at)
    return (word[0], word.end()) if word else ("", at)


def parse_bibtex(text: str) -> list[dict]:
    """Entries: {type, key, fields}. @string names are replaced, @comment and @preamble skipped; an entry
    that can't be read has error in place of its fields."""
    out, names, at = [], {}, 0
    while found := re.compile(r"@\s*(\w+)\s*[{(]").search(text, at):
        kind, i = found[1].lower(), found.end()
        at = i
        if kind in ("comment", "preamble"):
            continue
        key = re.compile(r"\s*([^,\s}=]*)\s*,").match(text, i)
        entry = {"type": kind, "key": key[1] if key and kind != "string" else "", "fields": {}}
        i = key.end() if key and kind != "string" else i
        try:
            while part := re.compile(r"\s*,?\s*([\w:.+-]+)\s*=\s*").match(text, i):
                value, i = _braced(text, part.end())
                value = names.get(value.lower(), value) if text[part.end() : part.end() + 1] not in ("{", '"') else value
                while more := re.compile(r"\s*#\s*").match(text, i):
                    extra, i = _braced(text, more.end())
                    value += names.get(extra.lower(), extra)
                entry["fields"][part[1].lower()] = value
            at = i
        except ValueError as e:
            entry["error"] = str(e)
        if kind == "string":
            names.update({k.lower(): v for k, v in entry["fields"].items()})
        else:
            out.append(entry)
    return out


#: TeX accents.
ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "u": "\u0306", "H": "\u030b"}
TEX = {r"\ss": "ß", r"\o": "ø", r"\O": "Ø", r"\ae": "æ", r"\AE": "Æ", r"\aa": "å", r"\AA": "Å", r"\l": "ł", r"\L": "Ł", r"\&": "&", r"\%": "%", r"\_": "_", r"\$": "$", r"\#": "#", "---": "—", "--": "–", "~": " "}


def untex(value: str) -> str:
    """TeX accents and signs as characters; braces go."""
    import unicodedata

    value = re.sub(r"\\(['`^\"~=.]|[cvuH](?=[\s{]))\s*\{?\s*\\?([A-Za-z])\}?", lambda m: unicodedata.normalize("NFC", m[2] + ACCENTS[m[1]]), value)
    for tex, char in TEX.items():
        value = re.sub(re.escape(tex) + (r"(?![A-Za-z])\s?" if tex[-1].isalpha() else ""), lambda m, char=char: char, value)
    return " ".join(re.sub(r"[{}]", "", value).split())


def split_authors(value: str) -> list[str]:
    """At ' and ' outside of braces."""
    out, depth, last = [], 0, 0
    for m in re.finditer(r"[{}]|\s+and\s+", value):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
        elif depth == 0:
            out.append(value[last : m.start()])
            last = m.end()
    return [a.strip() for a in [*out, value[last:]] if a.strip()]


def _creator(name: str) -> dict:
    if name.startswith("{") and name.endswith("}"):
        return {"first": None, "last": None, "name": untex(name)}
    plain = untex(name)
    if "," in plain:
        last, _, first = plain.partition(",")
        return {"first": first.strip().split(",")[-1].strip(), "last": last.strip(), "name": None}
    first, _, last = plain.rpartition(" ")
    return {"first": first, "last": last, "name": None} if first else {"first": None, "last": None, "name": plain}


def bibtex_item(entry: dict) -> dict:
    f = {k: v for k, v in entry.get("fields", {}).items()}
    get = lambda *names: next((untex(f[n]) for n in names if f.get(n)), None)
    date = get("date")
    if not date and get("year"):
        month = (get("month") or "").lower()[:3]
        number = MONTHS.get(month) or (int(month) if month.isdigit() else None)
        date = get("year") + (f"-{number:02d}" if number else "")
    extra = "\n".join(f"{k}: {untex(f[k])}" for k in ("note", "keywords", "eprint") if f.get(k)) or None
    return {"item_type": BIBTEX_TYPES.get(entry["type"], "document"), "title": get("title"), "creators": [_creator(a) for a in split_authors(f.get("author") or f.get("editor") or "")], "date": date, "doi": get("doi"), "isbn": get("isbn"), "container": get("journal", "journaltitle", "booktitle"), "publisher": get("publisher", "school", "institution"), "volume": get("volume"), "issue": get("number", "issue"), "pages": (get("pages") or "").replace("–", "-") or None, "url": f.get("url"), "abstract": get("abstract"), "cite_key": entry.get("key") or None, "extra": extra, "error": entry.get("error")}


def coerce_csl(value) -> list[dict]:
    """A CSL-JSON text, object or list as a list of objects."""
    if isinstance(value, str):
        value = json.loads(value)
    if isinstance(value, dict):
        value = value["items"] if isinstance(value.get("items"), list) else [value]
    if not isinstance(value, list) or not all(isinstance(v, dict) for v in value):
        raise ValueError("CSL-JSON is an object or a list of objects")
    return value


def csl_item(csl: dict) -> dict:
    text = lambda k: None if csl.get(k) in (None, "") else str(csl[k])
    people = [{"first": p.get("given"), "last": p.get("family"), "name": p.get("literal")} for p in csl.get("author") or csl.get("editor") or []]
    parts = ((csl.get("issued") or {}).get("date-parts") or [[]])[0]
    date = "-".join(str(p) if i == 0 else f"{int(p):02d}" for i, p in enumerate(parts)) or (csl.get("issued") or {}).get("raw")
    return {"item_type": CSL_TYPES.get(csl.get("type", ""), "document"), "title": text("title"), "creators": people, "date": date, "doi": text("DOI"), "isbn": text("ISBN"), "container": text("container-title"), "publisher": text("publisher"), "volume": text("volume"), "issue": text("issue"), "pages": text("page"), "url": text("URL"), "abstract": text("abstract"), "cite_key": text("citation-key") or text("id"), "extra": text("note"), "error": None}


def registry_item(record: dict) -> dict:
    """A registry's record: CSL whose titles and identifiers are lists."""
    one = {k: v[0] if v else None for k, v in record.items() if isinstance(v, list) and all(isinstance(x, str) for x in v)}
    isbn = record.get("ISBN")
    return csl_item({**record, **one, "ISBN": " ".join(isbn) if isinstance(isbn, list) else isbn})


def format_of(text: str | None) -> str:
    """bibtex, csl_json, or registry for JSON whose titles are lists, by the text itself."""
    start = (text or "").lstrip()
    if start[:1] not in ("{", "["):
        return "bibtex"
    return "registry" if re.search(r'"title"\s*:\s*\[', start) else "csl_json"


def _items(text: str | None, kind: str) -> list[dict]:
    try:
        kind = format_of(text) if kind == "auto" else kind
        if kind == "bibtex":
            return [bibtex_item(e) for e in parse_bibtex(text or "")]
        return [(registry_item if kind == "registry" else csl_item)(c) for c in coerce_csl(text or "[]")]
    except (ValueError, TypeError, KeyError) as e:
        return [{"item_type": None, "title": None, "creators": [], "date": None, "doi": None, "isbn": None, "container": None, "publisher": None, "volume": None, "issue": None, "pages": None, "url": None, "abstract": None, "cite_key": None, "extra": None, "error": str(e)[:200]}]


def read_citations(df: DataFrame, text: str, kind: str) -> DataFrame:
    """One row per entry of every text; kind is bibtex, csl_json, registry or auto (by the text). Entries that
    can't be read have error."""
    schema = ITEM[len("struct<") : -1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [i for t in b["t"] for i in _items(t, kind)]
            yield pd.DataFrame(rows, columns=["item_type", "title", "creators", "date", "doi", "isbn", "container", "publisher", "volume", "issue", "pages", "url", "abstract", "cite_key", "extra", "error"])

    return df.select(F.col(text).alias("t")).mapInPandas(run, schema)


def to_bibtex(key: Column, item_type: Column, fields: dict[str, Column]) -> Column:
    """One BibTeX entry; empty fields are left out. Attachments and notes have none (null)."""
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in OUT_TYPES.items() for x in kv])[item_type], F.lit("misc"))
    lines = F.filter(F.array(*[F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"  {n} = {{"), F.regexp_replace(c.cast("string"), r"([&%$#_])", r"\\$1"), F.lit("}"))) for n, c in fields.items()]), lambda x: x.isNotNull())
    entry = F.concat(F.lit("@"), kind, F.lit("{"), key.cast("string"), F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}"))
    return F.when(item_type.isin("attachment", "note", "annotation"), None).otherwise(entry)


def to_markdown(title: Column, fields: dict[str, Column], abstract: Column | None = None, clip: int = 200) -> Column:
    """A card of one item: heading, bold field names, clipped abstract."""
    lines = [F.concat(F.lit("## "), F.coalesce(title, F.lit("Untitled")))]
    lines += [F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"**{n}:** "), c.cast("string"))) for n, c in fields.items()]
    if abstract is not None:
        lines.append(F.when(F.length(abstract) > clip, F.concat(F.substring(abstract, 1, clip), F.lit("..."))).otherwise(abstract))
    return F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n")
