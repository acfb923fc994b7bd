"""Removal of repeated byte strings by a logarithmic family of suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in an earlier
document, or earlier in the same one. Documents are ordered by batch, then by id, null ids last,
then by row, so ids may be null or repeat. The windows (strings of LENGTH bytes) are cut into
units: runs of neighbouring windows whose smallest GRAM-byte hash is the same (as in
winnowing). Equal windows have the same smallest hash, so they meet in the same unit key;
about one unit arises every 34 bytes.

1. Units (key, hash of the unit's bytes, document, place) are sorted by key, together with those
   of earlier batches under the same keys. A unit whose bytes repeat those of an earlier unit goes
   as a whole, by hash. Those that repeat a unit of their own
   chunk of texts are marked there and dealt by a hash of their place, so that a passage which
   many documents share doesn't gather in one task. A key that only one byte string has,
   with its smallest gram once, needs no more: most of the corpus ends here, without its bytes being moved.
2. The first units of byte strings under a key with several are cut from their texts and
   dealt by key. Each task takes them in document order, in batches of BATCH windows. A batch
   gets its suffix array: the places of its windows in the batch's bytes, ordered by prefix doubling up
   to LENGTH bytes, so that neighbours with a common prefix of LENGTH have the same rank; all but the
   first of them go. The rest are merge-scanned against every level of the index for such
   matches, and those found go. What remains becomes a new level, and levels of equal size class
   are merged until sizes are geometric. A level is its bytes and an array of places in them; windows
   are copied only for the block under comparison.
   A unit whose key has more than HOT byte strings is cut into runs of at most RUN windows, each dealt by
   the bytes that all windows of its kind hold: those whose first gram with the key starts RUN * k to RUN * k +
   RUN - 1 bytes after them. Equal windows are of one kind and hold the same bytes, so they meet.
3. Removed windows, as ranges, are brought to their documents; the covered bytes are cut out.

RepeatIndex keeps the family between runs, as tables in a shared folder: each batch's texts, and
levels of first units (places, no bytes), of which those of equal size class are merged.

Unit and window keys are 64-bit hashes; whole units under the same key compare by another 64 bits.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytewords import U64, Prefix, chunks, mix, sliced
from .common import read, release, shared_table, write_table

LENGTH, GRAM = 100, 32
BATCH, HOT, RUN = 50_000, 2048, 8
#: Windows that a task indexes, about.
TASK_WINDOWS = 500_000
#: Suffixes of a level that are copied for comparison at once.
BLOCK = 8192
#: A row's number holds its batch above these bits.
BATCH_BITS = 48
LAST_ID = (1 << 63) - 1


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of width values."""
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def units(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text index, key, hash of bytes, first window's place, windows, whether its smallest gram
    stands in it twice or more) of all units."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])
    empty = tuple(np.zeros(0, t) for t in (np.int64, U64, U64, np.int64, np.int64, bool))
    if len(data) < length:
        return empty
    prefix = Prefix(data)
    places = np.arange(len(data) - gram + 1)
    hashes = mix(prefix.span(places, places + gram))
    width = length - gram + 1
    least = _sliding_min(hashes, width)  # of the window that starts there
    doc = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    inside = np.arange(len(least)) + length <= base[doc + 1]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    every = np.flatnonzero(new)
    kept = inside[every]
    first, ends = every[kept], np.append(every[1:], len(least))[kept]
    if not len(first):
        return empty
    ends = np.minimum(ends, base[doc[first] + 1] - length + 1)
    key = least[first]
    body = mix(prefix.span(first, ends + length - 1) + (ends - first).astype(U64))
    # Places whose gram is the smallest of some window; how many of them a unit holds with its key.
    pad = np.zeros(width - 1, U64)
    smallest = np.flatnonzero(~_sliding_min(~np.concatenate([pad, least, pad]), width) == hashes)
    values, code = np.unique(hashes[smallest], return_inverse=True)
    spots = np.sort(code * len(data) + smallest)
    mine = np.searchsorted(values, key) * len(data)
    twice = np.searchsorted(spots, mine + ends + width - 1) - np.searchsorted(spots, mine + first) > 1
    return doc[first], key, body, first - base[doc[first]], ends - first, twice


def _dense(values: np.ndarray) -> np.ndarray:
    """Ranks of the values from 0, equal ones equal."""
    order = np.argsort(values, kind="stable")
    ordered, rank = values[order], np.empty(len(values), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
    return rank


def suffix_ranks(text: np.ndarray, length: int) -> np.ndarray:
    """Ranks of all suffixes of a byte array by their first length bytes (zeros after the end), by
    doubling the prefix: two ranks of k bytes, side by side or overlapping, rank up to 2 k bytes."""
    if not len(text):
        return np.zeros(0, np.int64)
    have = min(8, length)
    padded, word = np.concatenate([text, np.zeros(have, np.uint8)]), np.zeros(len(text), U64)
    for k in range(have):
        word = word << U64(8) | padded[k : k + len(text)]
    rank = _dense(word)
    while have < length:
        step = min(have, length - have)
        after = np.concatenate([rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64)])
        rank = _dense(rank * (len(rank) + 1) + after)
        have += step
    return rank


class Suffixes:
    """A level: bytes, and the places in them of its suffixes in the order of their first length
    bytes, no two the same."""

    def __init__(self, text: np.ndarray, places: np.ndarray, length: int) -> None:
        self.text, self.places, self.length = text, places, length

    def __len__(self) -> int:
        return len(self.places)

    def windows(self, low: int, high: int) -> np.ndarray:
        """Copies of some suffixes' first bytes; a last byte 1 keeps closing zero bytes."""
        out = np.ones((max(0, high - low), self.length + 1), np.uint8)
        if len(out):
            out[:, : self.length] = np.lib.stride_tricks.sliding_window_view(self.text, self.length)[self.places[low:high]]
        return out.view(f"S{self.length + 1}").ravel()

    def scan(self, other: Suffixes) -> tuple[np.ndarray, np.ndarray]:
        """Merge scan: for each suffix of other, its place in the order of this level, and whether
        this level holds it."""
        spot, held, done = np.full(len(other), len(self), np.int64), np.zeros(len(other), bool), 0
        for low in range(0, len(self), BLOCK):
            block = self.windows(low, min(low + BLOCK, len(self)))
            end = bisect_right(range(len(other)), block[-1], lo=done, key=lambda i: other.windows(i, i + 1)[0])
            for first in range(done, end, BLOCK):
                past = min(first + BLOCK, end)
                mine = other.windows(first, past)
                at = np.searchsorted(block, mine)
                spot[first:past], held[first:past] = low + at, block[np.minimum(at, len(block) - 1)] == mine
            done = end
        return spot, held

    def merged(self, other: Suffixes) -> Suffixes:
        spot, _ = self.scan(other)
        return Suffixes(np.concatenate([self.text, other.text]), np.insert(self.places, spot, other.places + len(self.text)), self.length)


class SuffixLevels:
    """The index family within a task: no two levels have the same size class, a power of two."""

    def __init__(self, length: int) -> None:
        self.length, self.levels = length, {}

    def take(self, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which of the windows at the starts, in document order, stand earlier in them or in some
        level. The others become a level."""
        rank = suffix_ranks(text, self.length)[starts]
        array = np.argsort(rank, kind="stable")  # the suffix array; ties keep their order
        gone = np.zeros(len(starts), bool)
        gone[array[1:]] = rank[array[1:]] == rank[array[:-1]]
        array = array[~gone[array]]
        new = Suffixes(text, starts[array], self.length)
        known = np.zeros(len(new), bool)
        for level in self.levels.values():
            known |= level.scan(new)[1]
        gone[array[known]] = True
        new = Suffixes(text, new.places[~known], self.length)
        while len(new):
            size = len(new).bit_length()
            if (other := self.levels.pop(size, None)) is None:
                self.levels[size] = new
                break
            new = other.merged(new)
        return gone


def _ranges(order: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of consecutive integers in a sorted array, as (first, past last)."""
    if len(order):
        cut = np.flatnonzero(np.diff(order) != 1) + 1
        yield from zip(order[np.concatenate([[0], cut])].tolist(), (order[np.concatenate([cut - 1, [len(order) - 1]])] + 1).tolist(), strict=True)


def _scan(length: int, batch_windows: int):
    """mapInArrow function over (row, place, span) in order of document and place: the removed
    windows as (row, first, past)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = SuffixLevels(length)

        def flush(rows: list, places: list, spans: list) -> pa.RecordBatch:
            counts = np.array([len(s) - length + 1 for s in spans])
            base = np.cumsum([0, *(len(s) for s in spans[:-1])])
            ends = np.cumsum(counts)
            starts = np.arange(ends[-1]) + np.repeat(base - (ends - counts), counts)
            gone = index.take(np.frombuffer(b"".join(spans), np.uint8), starts)
            out = [(r, p + a, p + b) for r, p, n, z in zip(rows, places, counts.tolist(), ends.tolist(), strict=True) for a, b in _ranges(np.flatnonzero(gone[z - n : z]))]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["row", "first", "past"])

        rows, places, spans, size = [], [], [], 0
        for b in batches:
            for r, p, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows.append(r)
                places.append(p)
                spans.append(s)
                size += len(s) - length + 1
                if size >= batch_windows:
                    yield flush(rows, places, spans)
                    rows, places, spans, size = [], [], [], 0
        if size:
            yield flush(rows, places, spans)

    return run


def runs(spans: list[bytes], keys: list[int], length: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """(unit, key to be dealt by, first, past last window) of the runs of some units' windows, by the bytes
    that every window of a run's kind holds."""
    sizes = np.array([len(s) for s in spans], np.int64)
    base, counts = np.cumsum(sizes) - sizes, sizes - length + 1
    ends, key = np.cumsum(counts), np.array(keys, np.int64).view(U64)
    prefix = Prefix(np.frombuffer(b"".join(spans), np.uint8))
    places = np.arange(int(sizes.sum()) - gram + 1)
    spots = np.flatnonzero(mix(prefix.span(places, places + gram)) == np.repeat(key, sizes)[: len(places)])
    unit = np.repeat(np.arange(len(spans)), counts)
    window = np.arange(ends[-1]) + (base - (ends - counts))[unit]
    spot = spots[np.searchsorted(spots, window)]  # of the first gram with the key in each window
    kind = (spot - window) // RUN
    first = np.flatnonzero(np.concatenate([[True], (np.diff(spot) != 0) | (np.diff(kind) != 0) | (np.diff(unit) != 0)]))
    past = np.append(first[1:], ends[-1]) - first
    spot, kind, unit, at = spot[first], kind[first], unit[first], window[first] - base[unit[first]]
    held = prefix.span(spot - kind * RUN, spot - np.minimum(kind * RUN + RUN - 1, length - gram) + length)
    own = mix(held ^ mix(kind.astype(U64) + key[unit])).view(np.int64)
    yield from zip(unit.tolist(), own.tolist(), at.tolist(), (at + past).tolist(), strict=True)


def _cut(length: int, gram: int):
    """mapInArrow function over (row, doc_id, text, wanted): the spans of the wanted units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2):
            out, hot = [], []  # (key, row, ord, place, span)
            for i, o, text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True):
                for w in wanted or ():
                    p = w["place"]
                    (hot if w["hot"] else out).append((w["key"], i, LAST_ID if o is None else o, p, text[p : p + w["windows"] + length - 1]))
            for first, group in chunks([span for *_, span in hot]):
                mine = hot[first : first + len(group)]
                for u, key, a, z in runs(group, [key for key, *_ in mine], length, gram):
                    _, i, o, p, span = mine[u]
                    out.append((key, i, o, p + a, span[a : z + length - 1]))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.record_batch([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], ["key", "row", "ord", "place", "span"])

    return run


def _kept(length: int):
    """mapInArrow function over (doc_id, text, ranges of removed windows): what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            out = []
            for i, text, ranges in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                text, removed, spans, at, left = text or b"", 0, 0, 0, []
                end = -1  # of the removed run so far; runs that touch are one
                for r in sorted(ranges or [], key=lambda r: r["first"]):
                    a, z = r["first"], r["past"] + length - 1
                    if a > end:
                        spans += 1
                        left.append(text[at:a])
                        removed += z - a
                    elif z > end:
                        removed += z - end
                    end = at = max(end, z)
                left.append(text[at:])
                out.append((i, len(text), removed, spans, b"".join(left)))
            c = list(zip(*out, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c[k], pa.int64()) for k in range(4)] + [pa.array(c[4], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _list_units(length: int, gram: int):
    """mapInArrow function over (row, ord, text): (key, body, ord, row, spot) of all units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ords = b.column(0).to_numpy(), b.column(1).to_numpy()
            for first, group in chunks(b.column(2)):
                doc, key, body, place, n, twice = units(group, length, gram)
                row, ord_ = rows[first + doc], ords[first + doc]
                both = mix(key) ^ body
                order = np.lexsort((place, row, ord_, both))
                sure = np.zeros(len(key), bool)
                sure[order[1:]] = both[order[1:]] == both[order[:-1]]
                key = np.where(sure, mix(body ^ mix(row.astype(U64) << U64(32) ^ place.astype(U64))), key)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(body.view(np.int64)), pa.array(ord_), pa.array(row), pa.array(place << 32 | n << 2 | sure << 1 | twice)], ["key", "body", "ord", "row", "spot"])

    return run


def _numbered(df: DataFrame, id_col: str, text_col: str, batch: int = 0) -> DataFrame:
    """row (unique; its batch above BATCH_BITS), doc_id, ord (orders documents by id, null ids last), text."""
    row = F.monotonically_increasing_id() + F.lit(batch << BATCH_BITS).cast("long")
    return df.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("ord"), F.col(text_col).alias("text"))


def _marked(docs: DataFrame, past: DataFrame | None, length: int, gram: int) -> DataFrame:
    """The units of docs, and those of past units that share a key, with their verdicts: repeat, apart (its
    windows are to be compared), hot."""
    units_of = "key long, body long, ord long, row long, spot long"
    listed = docs.where("text IS NOT NULL").select("row", "ord", "text").mapInArrow(_list_units(length, gram), units_of)
    if past is not None:
        listed = listed.unionByName(past.join(listed.select("key").distinct(), "key", "left_semi").select("key", "body", "ord", "row", "spot"))
    listed = listed.repartition("key")
    copies = Window.partitionBy("key", "body").orderBy(F.shiftright("row", BATCH_BITS), "ord", "row", "spot")
    same = Window.partitionBy("key")
    marked = listed.withColumn("copy", F.row_number().over(copies)).withColumns({"least": F.min("body").over(same), "most": F.max("body").over(same), "n": F.sum(F.when(F.col("copy") == 1, 1).otherwise(0)).over(same)})
    place, windows = F.shiftright("spot", 32), F.shiftright(F.col("spot").bitwiseAND((1 << 32) - 1), 2)
    repeat, twice = (F.col("copy") > 1) | (F.col("spot").bitwiseAND(2) > 0), F.col("spot").bitwiseAND(1) > 0
    return marked.select("key", "body", "ord", "row", "spot", place.alias("place"), windows.alias("windows"), repeat.alias("repeat"), ((F.col("least") != F.col("most")) | twice).alias("apart"), (F.col("n") > HOT).alias("hot"))


def _without(docs: DataFrame, found: DataFrame, texts: DataFrame, length: int, gram: int) -> DataFrame:
    """docs without their repeats. found: units with verdicts; texts: docs and the earlier texts that
    found names. Both joins read the same columns of the texts, so that they share one exchange of them."""
    wanted = found.where("apart AND NOT repeat").groupBy("row").agg(F.collect_list(F.struct("key", "place", "windows", "hot")).alias("wanted"))
    spans = texts.join(wanted.hint("shuffle_hash"), "row", "left").select("row", "doc_id", "text", "wanted").mapInArrow(_cut(length, gram), "key long, row long, ord long, place long, span binary")
    windows = found.where("apart AND NOT repeat").agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    dealt = spans.repartition(1 + windows // TASK_WINDOWS, "key").sortWithinPartitions(F.shiftright("row", BATCH_BITS), "ord", "row", "place").select("row", "place", "span")
    removed = dealt.mapInArrow(_scan(length, BATCH), "row long, first long, past long")
    removed = removed.unionByName(found.where("repeat").select("row", F.col("place").alias("first"), (F.col("place") + F.col("windows")).alias("past")))
    ranges = removed.groupBy("row").agg(F.collect_list(F.struct("first", "past")).alias("ranges"))
    joined = docs.join(ranges.hint("shuffle_hash"), "row", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_kept(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (the bytes left).

    Null counts as empty. Each row is a document of its own: rows with a null id come after all
    others, and rows that repeat an id in an order of their own, so all but one of equal rows lose
    all their windows. Long texts are taken whole. Other columns are ignored; an empty table gives
    an empty result.
    """
    docs = shared_table(_numbered(df, id_col, text_col), "texts")
    found = shared_table(_marked(docs, None, length, gram).where("repeat OR apart").drop("body", "ord", "spot"), "units")
    release(df.sparkSession)
    return _without(docs, found, docs, length, gram)


class RepeatIndex:
    """Repeats across batches. folder: shared by driver and executors; it holds each batch's texts,
    the levels of first units, and a table of contents per batch, the last complete one of which
    counts: a batch that fails leaves the index as it was. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, length: int = LENGTH, gram: int = GRAM) -> None:
        self.spark, self.folder, self.length, self.gram = spark, folder.rstrip("/"), length, gram

    def contents(self) -> tuple[int, list[tuple[str, int, str]]]:
        """(batches so far, [(kind: text or level, units, path)])."""
        jvm, path = self.spark.sparkContext._jvm, self.folder
        system = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        batch = 0
        while system.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/contents-{batch + 1}/_SUCCESS")):
            batch += 1
        return batch, [tuple(r) for r in self.spark.read.parquet(f"{path}/contents-{batch}").collect()] if batch else []

    def add(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The result of remove_repeats for a batch that comes after all batches so far."""
        batch, parts = self.contents()
        paths = lambda kind: [p for k, _, p in parts if k == kind]
        union = lambda names: self.spark.read.parquet(*names)
        docs = write_table(_numbered(df, id_col, text_col, batch), f"{self.folder}/texts-{batch}")
        marked = shared_table(_marked(docs, union(paths("level")) if paths("level") else None, self.length, self.gram), "marked")
        new = F.shiftright("row", BATCH_BITS) == batch
        found = marked.where(F.when(new, F.col("repeat") | F.col("apart")).otherwise(F.col("apart")))
        texts = docs
        if old := paths("text"):
            used = found.where(~new).select("row").distinct()
            texts = docs.unionByName(union(old).join(used, "row", "left_semi"))
        level = marked.where(new & ~F.col("repeat")).select("key", "body", "ord", "row", "spot")
        size, merged = level.count(), []
        while size and (other := next((p for p in parts if p[0] == "level" and p[1].bit_length() == size.bit_length()), None)):
            parts.remove(other)
            merged.append(other[2])
            size += other[1]
        if merged:
            level = level.unionByName(union(merged))
        if size:
            write_table(level.repartition("key").sortWithinPartitions("key"), f"{self.folder}/level-{batch}")
            parts.append(("level", size, f"{self.folder}/level-{batch}"))
        parts.append(("text", 0, f"{self.folder}/texts-{batch}"))
        out = shared_table(_without(docs, found, texts, self.length, self.gram), "kept")
        write_table(self.spark.createDataFrame(parts, "kind string, units long, path string").coalesce(1), f"{self.folder}/contents-{batch + 1}")
        return out


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, length(hex(coalesce(text, ''))) // 2 AS n FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, greatest(n - 99, 0))) AS i FROM d),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS k FROM p),
f AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
b AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM f),
e AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM b),
r AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM e GROUP BY doc_id, run),
q AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM r),
k AS (SELECT q.doc_id, sum(z - a) AS removed, count(*) AS spans, max(z) AS last, string_agg(substr(h, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) AS kept FROM q JOIN d ON q.doc_id = d.doc_id GROUP BY q.doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0)::BIGINT + 1))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
