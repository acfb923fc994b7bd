"""Passages of texts, with offsets; the best window for a query; fuzzy places."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP, WIDTH = 1500, 200, 320
BREAKS = ("\n\n", ". ", ".\n", "\n", " ")
#: Fuzzy search: characters taken at once, windows whose bit vectors stay in the processor's cache, and windows
#: so few that they are not told apart by bound.
CHARS, BLOCK, FEW = 1 << 20, 1 << 14, 1 << 13
#: All bits below each.
BELOW = np.array([(1 << k) - 1 for k in range(65)], np.uint64)


def passages(text: str | None, size: int = SIZE, overlap: int = OVERLAP, most: int | None = None) -> list[tuple[str, int, int]]:
    """(passage, start, end) windows that end at a paragraph, sentence, line or word, if one ends in
    their second half, and overlap. Offsets are into the stripped text; without most, all of it."""
    text = (text or "").strip()
    if overlap >= size:
        overlap = size // 4
    out: list[tuple[str, int, int]] = []
    start, n = 0, len(text)
    while start < n and (most is None or len(out) < most):
        end = min(n, start + size)
        if end < n:
            snapped = (text.rfind(b, start, end) + len(b) for b in BREAKS if text.rfind(b, start, end) >= start + size // 2)
            end = next(snapped, end)
        if piece := text[start:end].strip():
            out.append((piece, start, end))
        if end == n:
            break
        start = end - overlap if end - overlap > start else end
    return out


def split_passages(df: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP, most: int | None = None) -> DataFrame:
    """One row per passage: key, chunk_index, n_chunks, char_start, char_end, page, passage."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b["k"], b["t"], strict=True):
                found = passages(t, size, overlap, most)
                whole = (t or "").strip()
                rows += [(k, i, len(found), s, e, whole.count("\f", 0, s) + 1 if "\f" in whole else None, p) for i, (p, s, e) in enumerate(found)]
            out = pd.DataFrame(rows, columns=["k", "chunk_index", "n_chunks", "char_start", "char_end", "page", "passage"])
            yield out.astype({"page": "Int64"})

    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"k {kind}, chunk_index int, n_chunks int, char_start long, char_end long, page long, passage string").withColumnRenamed("k", key)


def best_window(query: str, text: str | None, width: int = WIDTH) -> tuple[str, int]:
    """The window of width characters richest in the query's words of three letters or more, and its
    start. A window begins a third of its width before a hit; of equals the first wins."""
    text = text or ""
    if len(text) <= width or not text.strip():
        return text.strip(), 0
    terms = [t for t in re.findall(r"\w+", query.lower()) if len(t) > 2]
    low = text.lower()
    starts = [max(0, m.start() - width // 3) for m in re.finditer(r"\w+", low) if m[0] in set(terms)]
    if not starts:
        return text[:width].strip(), 0
    best = max(starts, key=lambda s: (sum(low.count(t, s, s + width) for t in terms), -s))
    return text[best : best + width].strip(), best


def snippets(text: Column, query: str, width: int = WIDTH) -> Column:
    """struct<snippet, char_start>."""

    @F.pandas_udf("struct<snippet string, char_start long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([best_window(query, t, width) for t in s], columns=["snippet", "char_start"])

    return run(text)


def fuzzy_threshold(length: int) -> float:
    """Shorter patterns must match better."""
    return 0.85 if length < 50 else 0.75 if length < 150 else 0.65


def _letters(text: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """The letters of text and of pattern as numbers from 0 to the pattern's different letters, which stands
    for any other letter."""
    codes, wanted = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (text, pattern))
    known = np.unique(wanted)
    number = np.full(int(known[-1]) + 2, len(known), np.min_scalar_type(len(known) + 1))
    number[known] = np.arange(len(known))
    return number[np.minimum(codes, len(number) - 1)], number[wanted]


def _places_of_letters(wanted: np.ndarray) -> np.ndarray:
    """Bit vectors, in words, of the places that each number of _letters has in the pattern."""
    word = np.uint32 if len(wanted) <= 32 else np.uint64
    at = np.arange(len(wanted), dtype=word)
    bits = np.zeros((1 + (len(wanted) - 1) // 64, int(wanted.max()) + 2), word)
    np.bitwise_or.at(bits, (at // word(64), wanted), word(1) << at % word(64))
    return bits


def _window_bounds(text: str, pattern: str, width: int, places: int, ends: np.ndarray | None = None) -> np.ndarray:
    """Upper bound of the ratio of the window at each of the first places: by the longest common
    subsequence, in a bit vector per window, for patterns up to 64 characters; else by the letters both hold.
    Windows stop at ends, by default the text's."""
    (letters, wanted), at = _letters(text, pattern), np.arange(places)
    ends = np.minimum(at + width, len(text) if ends is None else ends)
    if len(pattern) <= 64:
        bits = _places_of_letters(wanted)[0]
        word = bits.dtype.type
        held = np.zeros(places + width, word)
        held[: len(text)] = bits[letters[: places + width]]
        shared, used = np.zeros(places, np.uint8), word((1 << len(pattern)) - 1)
        for s in range(0, places, BLOCK):
            n = min(BLOCK, places - s)
            open_, met, rest = np.full(n, ~word(0)), np.empty(n, word), np.empty(n, word)
            for k in range(s, s + width):
                np.bitwise_and(open_, held[k : k + n], out=met)
                np.subtract(open_, met, out=rest)
                open_ += met
                open_ |= rest
            np.bitwise_count(~open_ & used, out=shared[s : s + n])
    else:
        shared = np.zeros(places, np.int64)
        for letter, n in Counter(wanted.tolist()).items():
            seen = np.concatenate([[0], np.cumsum(letters == letter)])
            shared += np.minimum(seen[ends] - seen[:places], n)
    return 2.0 * shared / (np.maximum(ends - at, 0) + len(pattern))


def _longest_blocks(letters: np.ndarray, bits: np.ndarray, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> np.ndarray:
    """(size, start in letters, start in pattern) of the longest common block of each letters[alo:ahi] and
    pattern[blo:bhi], the first of equals in letters, then in the pattern: those of SequenceMatcher."""
    words, word = len(bits), bits.dtype.type
    at = alo + np.arange(int((ahi - alo).max()))[:, None]
    held = bits[:, np.where(at < ahi, letters[np.minimum(at, len(letters) - 1)], bits.shape[1] - 1)]
    low, high = (BELOW.astype(word)[np.clip(x - 64 * np.arange(words)[:, None], 0, 64)] for x in (blo, bhi))
    held &= (high & ~low)[:, None]
    # ending: the pattern's places where a common block of size letters ends that starts at each letter
    out, size, ending, open_ = np.zeros((3, len(alo)), np.int64), 1, held, np.arange(len(alo))
    (live,) = np.nonzero(np.bitwise_or.reduce(ending, axis=(0, 1)))
    while len(live):
        longer = ending[:, :-1] << word(1)
        longer[1:] |= ending[:-1, :-1] >> word(63 if words > 1 else 0)
        longer &= held[:, size:]
        grows = np.bitwise_or.reduce(longer, axis=(0, 1))[live] != 0
        done = live[~grows]
        if len(done):
            last = ending[:, :, done]
            row = (last != 0).any(axis=0).argmax(axis=0)
            last = last[:, row, np.arange(len(done))]
            k = (last != 0).argmax(axis=0)
            last = last[k, np.arange(len(done))]
            end = 64 * k + np.bitwise_count((last & (~last + word(1))) - word(1))
            out[:, open_[done]] = np.full(len(done), size), alo[open_[done]] + row, end + 1 - size
        live, ending, size = live[grows], longer, size + 1
        if 2 * len(live) < len(open_):
            ending, held, open_, live = ending[:, :, live], held[:, :, live], open_[live], np.arange(len(live))
    return out


def _ratios(letters: np.ndarray, wanted: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SequenceMatcher(None, window, pattern, autojunk=False).ratio() of each window of letters. The windows
    go side by side through the matcher's steps: the longest block, then what is left and right of it."""
    shared, bits = np.zeros(len(starts), np.int64), _places_of_letters(wanted)
    for s in range(0, len(starts), 4 * BLOCK):
        alo, ahi = starts[s : s + 4 * BLOCK], ends[s : s + 4 * BLOCK]
        of, blo, bhi = np.arange(s, s + len(alo)), np.zeros(len(alo), np.int64), np.full(len(alo), len(wanted))
        while len(of):
            size, a, b = found = np.zeros((3, len(of)), np.int64)
            kind = np.ceil(np.log2(ahi - alo) / 2) * (len(of) > BLOCK // 4)  # if many: those of like length together
            for k in np.unique(kind):
                (like,) = np.nonzero(kind == k)
                step = max(64, 16 * BLOCK // (len(bits) * int((ahi - alo)[like].max())))
                for i in (like[x : x + step] for x in range(0, len(like), step)):
                    found[:, i] = _longest_blocks(letters, bits, alo[i], ahi[i], blo[i], bhi[i])
            np.add.at(shared, of, size)
            sides = (of, of), (alo, a + size), (a, ahi), (blo, b + size), (b, bhi), (size, size)
            of, alo, ahi, blo, bhi, size = map(np.concatenate, sides)
            todo = (size > 0) & (alo < ahi) & (blo < bhi)
            of, alo, ahi, blo, bhi = (x[todo] for x in (of, alo, ahi, blo, bhi))
    return 2.0 * shared / (ends - starts + len(wanted))


def _best_places(parts: list[tuple[int, int, int, int, str]], pattern: str, width: int, best: dict[int, tuple[float, int, int, int]]) -> None:
    """Brings best, (ratio, page, start, end) by document, up to date with parts (document, page, offset,
    places, text) that follow what it knows. Windows go by falling bound, those of all documents at once,
    until no bound of a document reaches its best; the last few go together."""
    doc, page, offset, places, texts = zip(*parts, strict=True)
    blank = next(c for c in map(chr, range(len(pattern) + 1)) if c not in pattern)
    over = [max(width - len(t), width - len(pattern), 0) for t in texts]  # so no window reaches the next part
    text = "".join(t + blank * n for t, n in zip(texts, over, strict=True))
    long = np.array([len(t) for t in texts])
    first = np.concatenate([[0], np.cumsum(long + over)])[:-1]
    ends = np.repeat(first + long, long + over)
    ids, of = np.unique(doc, return_inverse=True)
    owner = np.repeat(of, long + over)
    bounds = _window_bounds(text, pattern, width, len(text), ends)
    bounds[np.arange(len(text)) >= np.repeat(first + places, long + over)] = 0
    letters, wanted = _letters(text, pattern)
    floor, place = np.array([best[i][0] for i in ids]), np.full(len(ids), -1)
    high, left = np.zeros(len(ids)), None
    np.maximum.at(high, of, np.maximum.reduceat(bounds, first))
    (tried,) = np.nonzero(bounds == np.where(high > floor, high, -1)[owner])
    while len(tried):
        ratio, mine = _ratios(letters, wanted, tried, np.minimum(tried + width, ends[tried])), owner[tried]
        order = np.lexsort((tried, -ratio, mine))
        won = order[np.unique(mine[order], return_index=True)[1]]
        r, p, d = ratio[won], tried[won], mine[won]
        better = (r > floor[d]) | ((r == floor[d]) & (p < place[d]))
        floor[d[better]], place[d[better]] = r[better], p[better]
        bounds[tried] = 0
        if left is None:
            (left,) = np.nonzero((bounds > 0) & (bounds >= floor[owner]))
        b, d = bounds[left], owner[left]
        left = left[(b > floor[d]) | ((b == floor[d]) & (left < place[d]))]
        high[:] = 0
        np.maximum.at(high, owner[left], bounds[left])
        tried = left[bounds[left] == high[owner[left]]] if len(left) > FEW else left
    (found,) = np.nonzero(place >= 0)
    part = np.searchsorted(first, place[found], "right") - 1
    for d, k, p in zip(found.tolist(), part.tolist(), place[found].tolist(), strict=True):
        start = p - int(first[k])
        best[int(ids[d])] = (float(floor[d]), page[k], offset[k] + start, offset[k] + min(start + width, len(texts[k])))


def fuzzy_pages(docs: Sequence[Sequence[str]], pattern: str, least: float = 0.0) -> list[tuple[float, int, int, int]]:
    """(ratio, page, start, end) per document, an array of pages: the first page that holds the pattern,
    else the window of 1.2 times the pattern's length most like it, the first of equals; (least, -1, 0, 0) if
    none is above least. Every window of a page of any length counts: those that cannot reach the document's
    best are left out by a bound. Documents go through the steps together, at most CHARS characters at a time."""
    width, n = max(1, int(1.2 * len(pattern))), len(pattern)
    best, parts, held = {d: (least, -1, 0, 0) for d in range(len(docs))}, [], 0
    for d, pages in enumerate(docs):
        exact = next(((1.0, k, a, a + n) for k, t in enumerate(pages) if (a := t.find(pattern)) >= 0), None)
        if exact:
            best[d] = exact
            continue
        for k, t in enumerate(pages):
            places = max(1, len(t) - n + 1) if t else 0
            for s in range(0, places, CHARS):
                some = min(CHARS, places - s)
                parts.append((d, k, s, some, t[s : s + some + width - 1]))
                held += len(parts[-1][-1])
                if held >= CHARS:
                    _best_places(parts, pattern, width, best)
                    parts, held = [], 0
    if parts:
        _best_places(parts, pattern, width, best)
    return [best[d] for d in range(len(docs))]


def fuzzy_find(text: str, pattern: str, least: float = 0.0) -> tuple[float, int, int]:
    """(ratio, start, end) of the pattern in a text as one page (fuzzy_pages); (0, 0, 0) if no window is
    above least."""
    ratio, page, start, end = fuzzy_pages([[text]], pattern, least)[0]
    return (ratio, start, end) if page >= 0 else (0.0, 0, 0)


def find_in_pages(pages: Column, pattern: str) -> Column:
    """struct<page, ratio, start, end, found> of a pattern in an array of page texts: the first exact page,
    else the most similar window; found if the ratio reaches the threshold."""

    @F.pandas_udf("struct<page int, ratio double, start int, end int, found boolean>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            docs = [[t or "" for t in texts] if texts is not None else [] for texts in s]
            rows = []
            for texts, (r, i, a, z) in zip(docs, fuzzy_pages(docs, pattern), strict=True):
                rows.append((max(i, 0 if texts else -1) + 1, r, a, z, r >= fuzzy_threshold(len(pattern))))
            yield pd.DataFrame(rows, columns=["page", "ratio", "start", "end", "found"])

    return run(pages)
