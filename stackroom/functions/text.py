"""Text columns: folding, clean-up, mark-up, names, line edits, estimates. All built-in expressions
but for the functions that say otherwise."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that decompose to no ASCII letter, and dash-like characters.
SPELLED = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "þ": "th", "ı": "i"}
DASHES = "‐‑‒–—―−﹘﹣－"
UMLAUTS = {"ü": "ue", "ö": "oe", "ä": "ae", "ß": "ss", "Ü": "Ue", "Ö": "Oe", "Ä": "Ae"}
NO_AUTHORS, UNTITLED_NOTE = "No authors listed", "Untitled Note"


def _decomposed() -> tuple[str, str]:
    """Lower-case Latin letters whose decomposition begins with an ASCII letter, and these letters."""
    found = {}
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(cp).lower()
        base = unicodedata.normalize("NFKD", c)[0]
        if len(c) == 1 and c != base and base.isascii() and base.isalpha():
            found[c] = base
    return "".join(found), "".join(found.values())


FOLD_FROM, FOLD_TO = _decomposed()


def fold(text: Column) -> Column:
    """Comparison form: no accents, one dash, lower case; null is ''. Scripts other than Latin
    are only lower-cased (no transliteration table is shipped)."""
    low = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    out = F.translate(low, FOLD_FROM + DASHES, FOLD_TO + "-" * len(DASHES))
    for letter, spelled in SPELLED.items():
        out = F.replace(out, F.lit(letter), F.lit(spelled))
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(out)  # ASCII needs no more


def fold_value(text: str) -> str:
    """fold() of a constant, on the driver."""
    out = (text or "").lower().translate(str.maketrans(FOLD_FROM + DASHES, FOLD_TO + "-" * len(DASHES)))
    for letter, spelled in SPELLED.items():
        out = out.replace(letter, spelled)
    return out


def fold_sql(expr: str) -> str:
    """The same in SQL that DuckDB runs."""
    out = f"translate(lower(coalesce({expr}::VARCHAR, '')), '{FOLD_FROM}{DASHES}', '{FOLD_TO}{'-' * len(DASHES)}')"
    for letter, spelled in SPELLED.items():
        out = f"replace({out}, '{letter}', '{spelled}')"
    return out


def query_variants(query: str, most: int = 15) -> list[str]:
    """Spellings of a query to search for, the given one first."""
    if not query or not query.strip():
        return [query] if query else []
    plain = "".join(c for c in unicodedata.normalize("NFKD", query) if not unicodedata.combining(c)).translate(str.maketrans(DASHES, "-" * len(DASHES)))
    spelled = query
    for letter, pair in UMLAUTS.items():
        spelled = spelled.replace(letter, pair)
    found = [query, plain, query.replace("-", " "), plain.replace("-", " "), spelled]
    if " " in query and "-" not in query:
        found.append(query.replace(" ", "-"))
    return list(dict.fromkeys(found))[:most]


def strip_tags(text: Column, collapse: bool = False) -> Column:
    """Drops <...> on one line; a tag broken across lines stays."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^\n]*?>", "")
    return F.trim(F.regexp_replace(out, r"\s+", " ")) if collapse else out


def html_to_lines(text: Column) -> Column:
    """Mark-up to text: block ends and <br> become line ends, other tags go, blank lines collapse."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr|blockquote)\s*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" *\n *", "\n"), r"\n{2,}", "\n").alias("text")


def keep_inline_markup(text: Column) -> Column:
    """Drops tags but those a title may carry."""
    return F.regexp_replace(text, r"(?i)</?(?!(?:i|b|sub|sup|sc|span)\b)[a-z][^<>]*>", "")


def repair_print(text: Column) -> Column:
    """Text from print: joins words broken at line ends, plain dashes, quotes and ligatures, one space."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(\p{L})[-­‐]\s*\n\s*(\p{Ll})", "$1$2")
    out = F.translate(out, DASHES + "‘’‚‛“”„‟", "-" * len(DASHES) + "''''" + '""""')
    for ligature, letters in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def spaceless(text: Column) -> Column:
    """repair_print without spaces, in lower case, for matching."""
    return F.regexp_replace(F.lower(repair_print(text)), r"\s+", "")


def note_title(note: Column, most: int = 80) -> Column:
    """First line with text, cut to most characters."""
    lines = F.filter(F.transform(F.split(html_to_lines(note), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.substring(F.get(lines, F.lit(0)), 1, most), F.lit(UNTITLED_NOTE))


def join_creators(creators: Column) -> Column:
    """array<struct<first, last, name>> -> 'Last, First; ...'."""
    each = F.transform(creators, lambda c: F.when(F.coalesce(c["name"], F.lit("")) != "", c["name"]).when(F.coalesce(c["first"], F.lit("")) == "", c["last"]).otherwise(F.concat(c["last"], F.lit(", "), c["first"])))
    each = F.filter(each, lambda x: F.coalesce(x, F.lit("")) != "")
    return F.when(F.coalesce(F.size(each), F.lit(0)) <= 0, F.lit(NO_AUTHORS)).otherwise(F.array_join(each, "; "))


def split_creators(text: Column) -> Column:
    """'Last, First; Name' -> array<struct<first, last, name>>; the inverse of join_creators."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    comma = lambda x: F.instr(x, ",") > 0
    null = F.lit(None).cast("string")
    return F.transform(parts, lambda x: F.struct(F.when(comma(x), F.trim(F.regexp_extract(x, r"^[^,]*,(.*)$", 1))).otherwise(null).alias("first"), F.when(comma(x), F.trim(F.substring_index(x, ",", 1))).otherwise(null).alias("last"), F.when(comma(x), null).otherwise(x).alias("name")))


def split_name(name: Column) -> Column:
    """struct<first, last> of one name: by the comma, else the last word is the last name."""
    name = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))
    comma = F.instr(name, ",") > 0
    return F.struct(F.when(comma, F.trim(F.regexp_extract(name, r"^[^,]*,(.*)$", 1))).otherwise(F.trim(F.regexp_extract(name, r"^(.*) [^ ]+$", 1))).alias("first"), F.when(comma, F.trim(F.substring_index(name, ",", 1))).otherwise(F.regexp_extract(name, r"([^ ]*)$", 1)).alias("last"))


def calm_capitals(name: Column) -> Column:
    """Capitalises names in all capitals or all small letters; mixed ones stay."""
    same = (name == F.upper(name)) | (name == F.lower(name))
    words = F.transform(F.split(F.lower(name), r"(?<=[ '’-])"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.when(same, F.array_join(words, "")).otherwise(name)


def citation_key(extra: Column) -> Column:
    """Value of the first 'citation key:' line, or null."""
    found = F.regexp_extract(F.coalesce(extra, F.lit("")), r"(?mi)^\s*citation ?key:[ \t]*(\S[^\n]*?)\s*$", 1)
    return F.when(found != "", found)


def edit_lines(extra: Column, set_keys: dict[str, str] | None = None, remove_keys: list[str] | None = None, replace: bool = False) -> Column:
    """'Key: value' lines: a set key takes the place of its first line, its other lines go, and
    new keys come last; removed keys lose all lines. replace keeps nothing else."""
    set_keys, gone = set_keys or {}, {k.lower() for k in remove_keys or []}
    lines = F.split(F.coalesce(extra, F.lit("")), "\n")
    lines = F.filter(lines, lambda x: x != "") if not replace else F.array().cast("array<string>")
    key = lambda x: F.lower(F.trim(F.substring_index(x, ":", 1)))
    if gone:
        lines = F.filter(lines, lambda x: ~(F.contains(x, F.lit(":")) & key(x).isin(*gone)))
    for name, value in set_keys.items():
        at = F.array_position(F.transform(lines, lambda x: F.when(F.contains(x, F.lit(":")), key(x)).otherwise(F.lit(""))), name.lower())
        kept = F.filter(lines, lambda x, i: ~(F.contains(x, F.lit(":")) & (key(x) == name.lower())) | (i + 1 == at))
        lines = F.when(at > 0, F.transform(kept, lambda x: F.when(F.contains(x, F.lit(":")) & (key(x) == name.lower()), F.lit(f"{name}: {value}")).otherwise(x))).otherwise(F.concat(lines, F.array(F.lit(f"{name}: {value}"))))
    return F.array_join(lines, "\n")


def union_ignoring_case(first: Column, second: Column) -> Column:
    """Both arrays in order without repeats by lower case; the first spelling stays."""
    both = F.concat(F.coalesce(first, F.array().cast("array<string>")), F.coalesce(second, F.array().cast("array<string>")))
    return F.filter(both, lambda x, i: F.array_position(F.transform(both, F.lower), F.lower(x)) == i + 1)


def estimate_tokens(text: Column, chars_per_token: float = 3.0) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(text, F.lit(""))) / chars_per_token)).cast("long")


def truncate_tokens(text: Column, tokens: int = 8000, chars_per_token: int = 2) -> Column:
    return F.substring(text, 1, tokens * chars_per_token)


def page_of_offset(text: Column, offset: Column) -> Column:
    """1 + form feeds before offset; null if the text has no page breaks."""
    before = F.substr(text, F.lit(1), F.greatest(offset, F.lit(0)).cast("int"))
    return F.when(F.contains(text, F.lit("\f")), F.length(before) - F.length(F.replace(before, F.lit("\f"), F.lit(""))) + 1)


def split_multi_value(raw: Column, valid) -> Column:
    """Lines always split; a line splits on commas if every part is valid or the whole is not.
    valid: Column -> boolean Column."""
    lines = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    parts = lambda x: F.filter(F.transform(F.split(x, ","), lambda x: F.trim(x)), lambda y: y != "")
    return F.flatten(F.transform(lines, lambda x: F.when(F.forall(parts(x), valid) | ~valid(x), parts(x)).otherwise(F.array(x))))


def embedding_text(*parts: Column) -> Column:
    """The parts that are not empty, separated by a space."""
    return F.array_join(F.filter(F.array(*[F.trim(F.coalesce(p, F.lit(""))) for p in parts]), lambda x: x != ""), " ")


def unescape(text: Column) -> Column:
    """Character references decoded, as browsers do. An Arrow function: the table is Python's."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else html.unescape(x))

    return run(text)


def title_query(title: Column) -> Column:
    """A title as words to search for: tags become spaces before references are decoded, white space
    collapses; null if nothing is left."""
    plain = unescape(F.regexp_replace(title, r"</?[A-Za-z][^<>]*>", " "))
    words = F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))
    return F.when(words != "", words)


def title_key(title: Column) -> Column:
    """Title for equality: without tags, references, a leading article, accents and punctuation.
    An Arrow function: Unicode categories and compatibility forms aren't in SQL."""
    import re

    tag, article = re.compile(r"</?[A-Za-z][^<>]*>"), re.compile(r"\W*(?:a|an|the)\s+", re.I)

    def key(text: str | None) -> str:
        plain = html.unescape(tag.sub(" ", text or ""))
        if found := article.match(plain):
            plain = plain[found.end() :]
        marks = (" " if unicodedata.category(c)[0] in "PSZ" or c.isspace() else c for c in unicodedata.normalize("NFKD", plain) if unicodedata.category(c)[0] != "M")
        return " ".join("".join(marks).casefold().split())

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(key)

    return run(title)


def ascii_title_key(title: Column) -> Column:
    """title_key for Latin text, in built-in expressions."""
    out = F.regexp_replace(F.coalesce(title, F.lit("")), r"</?[A-Za-z][^<>]*>", " ")
    out = F.regexp_replace(out, r"(?i)^\W*(?:a|an|the)\s+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(fold(out), r"[^0-9a-z\x80-￿]+", " "), r" +", " "))


def repair_mojibake(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, where re-reading works; references decoded, line ends dropped."""

    def fix(x: str | None) -> str | None:
        if x is None:
            return None
        try:
            x = x.encode("latin-1").decode() if any("\x80" <= c <= "ÿ" for c in x) else x
        except UnicodeError:
            pass
        return html.unescape(x).replace("\r", "").replace("\n", "")

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(fix)

    return run(text)
