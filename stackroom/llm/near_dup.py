"""N-gram Jaccard join by parity sketches: near duplicates and their components.

A document is its set of distinct 5-word shingles. Hashing every shingle to one bit of a
sketch and XOR-ing them gives a parity sketch; two sketches differ in at most |A xor B|
bits, and sets with Jaccard >= T differ in at most d = (1 - T) / (1 + T) * (|A| + |B|)
shingles. Per size band (classes of sizes, ratio 4/3) the sketch is cut into m > d parts,
so two linked sets agree on at least m - d parts: the pigeonhole join is an equi-join on
(size band, part, parity of the part).

Which parts are published. Parts are ordered by their number of shingles (then by their
parity), an order on which agreeing documents agree, so the SLACK + 1 last of the agreed
parts are among the d + 1 + SLACK last of all parts of either side: only these are
published, and parts without or with few shingles are mostly not. If at most SLACK of a
document's published keys are hot (shared by more than HOT documents), at least one agreed
key is not hot, and the document's hot keys can go; otherwise they stay. So frequent
passages cost little, and no link is lost. Of equal sets a map task publishes the first only,
so that a group of copies sends a row per key and task, however many copies it has.

How buckets are joined. A bucket links to its least document only (a star, linear in the
bucket). Candidates must pass the whole sketches' Hamming bound, then an exact count on
the shingle sets. Only where the linked components still leave a bucket divided are its
other members compared, across components: in tiles of TILE members a side, by sketches. The
members that pass the Hamming bound with some other then meet in the same tiles with their sets, and are
counted there, so that no pair is written but links, and of these only those that span the tile's components.
That gives the components; the links property compares all members of each bucket so, whatever their
components, and writes all links. A pair that meets in several
buckets is reported by the least of them that is among both sides' LEAST_KEYS least keys, and by
all of them where there is none such.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import U64, chunks, memo, mix, shingle_sets
from .common import read, release, shared_table
from .components import components

#: Links have 100 * |A and B| >= PERCENT * |A or B|.
PERCENT, WORDS = 75, 5
HOT = 16
#: Members of a divided bucket compared side by side in one task, about.
TILE = 512
#: Least keys of a member that travel with it, to name the one bucket that reports a pair.
LEAST_KEYS = 16
CLASS_BITS = 7
#: Rows in an Arrow batch of keys, about.
BATCH = 1 << 18


@memo
def size_classes() -> list[int]:
    """Lower ends of the size classes."""
    ends = [1]
    while len(ends) < 1 << CLASS_BITS:
        ends.append(max(ends[-1] + 1, ends[-1] * 4 // 3))
    return ends


@memo
def banding(j: int, percent: int) -> tuple[int, int, int]:
    """(parts, published, slack) for pairs whose smaller set is in class j."""
    ends = size_classes()
    low, high = ends[j], (ends[j + 1] if j + 1 < len(ends) else ends[j] * 2) - 1
    d = (100 - percent) * (high + high * 100 // percent) // (100 + percent)
    slack = 1 + d // 10 if d else 0
    published = d + 1 + slack
    parts = published
    while parts < 4 * low and parts * (1 - (1 - 1 / parts) ** low) < published + 1.2 * math.sqrt(parts):
        parts += max(1, parts // 50)
    return parts, published, slack


def bands_of(n: int, percent: int) -> range:
    """Classes in which a set of n shingles looks for partners no larger than itself, its own last."""
    ends = size_classes()
    return range(bisect_right(ends, -(-n * percent // 100)) - 1, bisect_right(ends, n))


def keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The published keys of one set; the low CLASS_BITS bits are the size band."""
    out = []
    for j in bands_of(len(shingles), percent):
        parts, published, _ = banding(j, percent)
        h = mix(shingles + U64(j * 0x9E3779B9 + 1))
        part = ((h >> U64(32)) * U64(parts)) >> U64(32)
        order = np.argsort(part.astype(np.int64), kind="stable")
        at = np.searchsorted(part[order], np.arange(parts, dtype=U64))
        held = np.append(h[order], U64(0))
        parity = np.bitwise_xor.reduceat(held, at)
        count = np.diff(np.append(at, len(h)))
        parity[count == 0] = 0
        chosen = np.lexsort((parity, count))[parts - published :] if published < parts else np.arange(parts)
        key = mix(parity[chosen] ^ mix(chosen.astype(U64) + U64(j << 32)))
        out.append((key >> U64(CLASS_BITS) << U64(CLASS_BITS)) | U64(j))
    return np.concatenate(out) if out else np.zeros(0, U64)


def sketch(shingles: np.ndarray) -> bytes:
    """Parity sketch of 2 ** k >= |A| bits, 64 at least; folding halves gives the smaller ones."""
    bits = 1 << max(6, int(len(shingles) - 1).bit_length())
    places = np.bincount((mix(shingles) & U64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((places & 1).astype(np.uint8)).tobytes()


def hamming(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _described(percent: int, what: str):
    """mapInArrow function over (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        published: set[bytes] = set()  # as many as the task has documents
        for batch in batches:
            got_keys, got_ids, size = [], [], 0
            for first, group in chunks(batch.column(1)):
                sets = shingle_sets(group, WORDS)
                mine = batch.column(0).slice(first, len(group))
                if what == "keys":
                    each = []
                    for s in sets:
                        mark = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                        each.append(keys(s, percent) if len(s) and mark not in published else s[:0])
                        published.add(mark)
                    got_keys.append(np.concatenate(each))
                    got_ids.append(np.repeat(mine.to_numpy(), [len(k) for k in each]))
                    size += len(got_keys[-1])
                    if size >= BATCH:
                        yield pa.record_batch([pa.array(np.concatenate(got_keys).view(np.int64)), pa.array(np.concatenate(got_ids))], ["key", "doc_id"])
                        got_keys, got_ids, size = [], [], 0
                    continue
                prints = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]
                start = [mine, pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64())]
                more = [sketch(s) for s in sets] if what == "sketch" else [s.tobytes() for s in sets]
                yield pa.record_batch([*start, pa.array(more, pa.binary())], ["doc_id", "n_shingles", "f1", "f2", what])
            if size:
                yield pa.record_batch([pa.array(np.concatenate(got_keys).view(np.int64)), pa.array(np.concatenate(got_ids))], ["key", "doc_id"])

    return run


def _within(percent: int):
    """Keeps candidate pairs whose sketches differ in few enough bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.to_pydict()
            keep = [hamming(p, q) * (100 + percent) <= (100 - percent) * (m + n) for p, q, m, n in zip(x["sk_a"], x["sk_b"], x["n_a"], x["n_b"], strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, keep = batch.column("set_a"), batch.column("set_b"), []
            for i in range(len(left)):
                keep.append(_linked(np.frombuffer(left[i].as_buffer(), U64), np.frombuffer(right[i].as_buffer(), U64), percent))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _compare(n: np.ndarray, sketches: list[bytes], component: np.ndarray, tile: np.ndarray, percent: int, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of one tile pair that are in different components and pass the bounds."""
    width = min(map(len, sketches))
    folded = []
    for s in sketches:
        x = np.frombuffer(s, U64)
        while len(x) * 8 > width:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        folded.append(x)
    bits, left, right = np.stack(folded), [], []
    for lo in range(0, len(n), 64):
        hi = min(lo + 64, len(n))
        apart = np.zeros((hi - lo, len(n)), np.int64)
        for w in range(bits.shape[1]):
            apart += np.bitwise_count(bits[lo:hi, w, None] ^ bits[None, :, w])
        near = apart * (100 + percent) <= (100 - percent) * (n[lo:hi, None] + n[None, :])
        near &= (component[lo:hi, None] != component[None, :]) & (np.arange(lo, hi)[:, None] < np.arange(len(n))[None, :])
        if across:
            near &= tile[lo:hi, None] != tile[None, :]
        i, j = np.nonzero(near)
        left.append(i + lo)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _tiles(percent: int, spanning: bool):
    """mapInArrow function over rows (key, s, t, tile, rep, component, n_shingles, sketch, least) sorted
    by key, s, t: the rows that are in some candidate pair of their tile pair. Where the rows have their
    sets too: the links (a, b) among the candidates; if spanning, only as many as join the tile's components."""

    def pairs(batch: pa.Table) -> list[pa.RecordBatch]:
        x = {c: batch.column(c).to_numpy() for c in ("key", "s", "t", "tile", "rep", "component", "n_shingles")}
        sketches, least = batch.column("sketch").to_pylist(), batch.column("least").to_pylist()
        shingles = [np.frombuffer(v.as_buffer(), U64) for v in batch.column("set")] if "set" in batch.column_names else None
        new = np.flatnonzero((np.diff(x["key"]) != 0) | (np.diff(x["s"]) != 0) | (np.diff(x["t"]) != 0)) + 1
        chosen, found = np.zeros(len(sketches), bool), set()
        for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(sketches)], strict=True):
            component = x["component"][lo:hi].copy()
            i, j = _compare(x["n_shingles"][lo:hi], sketches[lo:hi], component, x["tile"][lo:hi], percent, x["s"][lo] != x["t"][lo])
            reps, key, sets = x["rep"][lo:hi].tolist(), int(x["key"][lo]), [None] * (hi - lo)
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                if shingles is None and chosen[lo + p] and chosen[lo + q] or spanning and component[p] == component[q]:
                    continue
                for m in (p, q):
                    sets[m] = sets[m] or set(least[lo + m])
                if min(sets[p] & sets[q], default=key) != key:
                    continue
                if shingles is None:
                    chosen[lo + p] = chosen[lo + q] = True
                elif _linked(shingles[lo + p], shingles[lo + q], percent):
                    found.add((min(reps[p], reps[q]), max(reps[p], reps[q])))
                    if spanning:
                        component[component == component[q]] = component[p]
        if shingles is None:
            return batch.filter(pa.array(chosen)).combine_chunks().to_batches()
        a, b = zip(*found, strict=True) if found else ((), ())
        return [pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            x = [t.column(c).to_numpy() for c in ("key", "s", "t")]
            last = np.flatnonzero(np.any([c != c[-1] for c in x], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from pairs(t.slice(0, cut).combine_chunks())
            rest = t.slice(cut)
        if rest is not None and len(rest):
            yield from pairs(rest.combine_chunks())

    return run


class NearDuplicates:
    """The join over df (id_col, text_col). members: one row per input row; spanning: verified
    links between representatives (the least document of equal sets), as many as the components
    need; links: all of them, joined when they are first asked for."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> None:
        self.percent, self.spark = percent, df.sparkSession
        self.docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        known = shared_table(self.docs.mapInArrow(_described(percent, "sketch"), "doc_id long, n_shingles long, f1 long, f2 long, sketch binary"), "sketches")
        # Equal sets combine in the map tasks. Both sides of the join have exchanges of their own, so AQE splits a hot set.
        least = known.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n_shingles", "sketch"), "doc_id").alias("x"))
        self.nodes = shared_table(least.where("rep IS NOT NULL").select("rep", "x.n_shingles", "f1", "f2", "x.sketch"), "nodes")
        self.members = shared_table(known.select("doc_id", "n_shingles", "f1", "f2").join(self.nodes.select("f1", "f2", "rep"), ["f1", "f2"], "left").select("doc_id", "n_shingles", "rep", "f1", "f2"), "members")
        self.buckets = buckets = self._buckets()
        release(self.spark)
        links = self._links(buckets.where("doc_id <> pivot").select(F.col("pivot").alias("p"), "doc_id").distinct())
        rest = self._divided(buckets, components(links, "stars"))
        release(self.spark)
        self.spanning = links.unionByName(rest)

    @cached_property
    def links(self) -> DataFrame:
        """(a, b): every link between representatives, a < b. The pairs of each bucket are compared
        as if no component were known yet; their number can grow with the square of a group's."""
        alone = self.nodes.select(F.col("rep").alias("node"), F.col("rep").alias("component")).distinct()
        return shared_table(self.spanning.unionByName(self._divided(self.buckets, alone, spanning=False)).distinct(), "all-links")

    def link_counts(self) -> DataFrame:
        """One row per input row: doc_id, n_shingles, n_links: the rows with another set that link with it."""
        both = self.links.unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        sizes = self.members.where("rep IS NOT NULL").groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
        counts = both.join(sizes.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links"))
        return self.members.join(counts, "rep", "left").select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))

    def _buckets(self) -> DataFrame:
        """(key, doc_id, pivot, n): rows of the keys that two documents or more share."""
        rows = self.docs.where("doc_id IS NOT NULL").mapInArrow(_described(self.percent, "keys"), "key long, doc_id long")
        same = Window.partitionBy("key")
        return shared_table(rows.select("key", "doc_id", F.min("doc_id").over(same).alias("pivot"), F.count(F.lit(1)).over(same).alias("n")).where("n > 1"), "buckets")

    def _links(self, stars: DataFrame) -> DataFrame:
        reps = self.members.where("rep IS NOT NULL").select("doc_id", "rep")
        pairs = stars.join(reps.withColumnRenamed("rep", "y"), "doc_id").join(reps.select(F.col("doc_id").alias("p"), F.col("rep").alias("x")), "p")
        return self._verify(pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of representatives that are links."""
        p = self.percent
        end = lambda side: self.nodes.select(F.col("rep").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"sk_{side}"))
        near = pairs.join(end("a"), "a").join(end("b"), "b").where(f"100 * least(n_a, n_b) >= {p} * greatest(n_a, n_b)")
        near = shared_table(near.mapInArrow(_within(p), "a long, b long"), "candidates")
        used = near.select(F.col("a").alias("rep")).unionByName(near.select(F.col("b").alias("rep"))).distinct()
        sets = self._sets(used)
        full = near.join(sets.withColumnsRenamed({"rep": "a", "set": "set_a"}), "a").join(sets.withColumnsRenamed({"rep": "b", "set": "set_b"}), "b")
        return shared_table(full.mapInArrow(_verified(p), "a long, b long"), "links")

    def _sets(self, used: DataFrame) -> DataFrame:
        """(rep, set) of the used representatives."""
        texts = self.docs.join(used.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
        sets = texts.mapInArrow(_described(self.percent, "set"), "doc_id long, n_shingles long, f1 long, f2 long, set binary")
        sets = sets.join(self.nodes.select(F.col("rep").alias("doc_id"), "f1", "f2"), ["doc_id", "f1", "f2"]).dropDuplicates(["doc_id", "f1", "f2"])
        return shared_table(sets.select(F.col("doc_id").alias("rep"), "set"), "sets")

    def _divided(self, buckets: DataFrame, parts: DataFrame, spanning: bool = True) -> DataFrame:
        """Links (a, b) of representatives that share a bucket, are not its pivot, and are in different
        components so far: all, or as many as join each tile's components."""
        slack = F.create_map(*[F.lit(x) for j in range(len(size_classes()) - 1) for x in (j, banding(j, self.percent)[2])])
        rows = buckets.where("n > 2").withColumn("band", F.col("key").bitwiseAND((1 << CLASS_BITS) - 1).cast("int"))
        hot = rows.where(F.col("n") > HOT).groupBy("doc_id", "band").agg(F.count(F.lit(1)).alias("hot")).where(F.col("hot") <= slack[F.col("band")]).select("doc_id", "band", F.lit(1).alias("cool"))
        rows = rows.where("doc_id <> pivot").join(hot, ["doc_id", "band"], "left").where(f"n <= {HOT} OR cool IS NULL").select("key", "doc_id", "pivot")
        reps = self.members.where("rep IS NOT NULL").select("doc_id", "rep")
        rows = rows.join(reps, "doc_id").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component")).distinct()
        rows = shared_table(rows, "rest")
        whole = rows.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.count(F.lit(1)).alias("m")).where("c < d")
        rows = shared_table(rows.join(whole.select("key", F.ceil(F.col("m") / TILE).cast("int").alias("tiles")), "key"), "divided")
        least = rows.groupBy("rep").agg(F.slice(F.sort_array(F.collect_list("key")), 1, LEAST_KEYS).alias("least"))
        rows = rows.join(self.nodes.select("rep", "n_shingles", "sketch"), "rep").join(least, "rep")
        rows = rows.withColumn("tile", F.pmod(F.xxhash64("rep"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        rows = rows.select("key", F.least("tile", "other").alias("s"), F.greatest("tile", "other").alias("t"), "tile", "rep", "component", "n_shingles", "sketch", "least")
        tiled = lambda x: x.repartition("key", "s", "t").sortWithinPartitions("key", "s", "t")
        schema = "key long, s int, t int, tile int, rep long, component long, n_shingles long, sketch binary, least array<long>"
        near = shared_table(tiled(rows).mapInArrow(_tiles(self.percent, spanning), schema), "near-members")
        full = near.join(self._sets(near.select("rep").distinct()), "rep").select(*near.columns, "set")
        return shared_table(tiled(full).mapInArrow(_tiles(self.percent, spanning), "a long, b long").distinct(), "tile-links")

    def components(self) -> DataFrame:
        """One row per input row: doc_id, n_shingles, component_id."""
        found = components(self.spanning, "near").withColumnRenamed("node", "rep")
        return self.members.join(found, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (least id reachable by links).

    Null and empty texts, and texts of white space, have no shingles and link with nothing.
    Rows with a null id have component_id null unless they equal another document. Rows that
    repeat an id count as one document with all their texts' links. Other columns are
    ignored. An empty table gives an empty result. Shingles compare by 64-bit hash.
    """
    return NearDuplicates(df, id_col, text_col, percent).components()


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.other = l.x),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id FROM s JOIN c ON s.doc_id = c.doc_id
"""
