"""Toxicity: a linear-chain conditional random field over words with two states.

Features of a word, hashed into one weight table: the word, its first 3 to 6 bytes, the words
before and after it. The labels are of documents; words of toxic documents count as toxic for
learning where one of their own features is significantly more frequent, by documents, in toxic
than in clean rows of the sample. The field is fitted on the driver on a bounded sample
(MAX_TOXIC and MAX_CLEAN labelled rows and MAX_BYTES bytes of text, chosen by a hash of the id,
without the held-out rows); every whole text is then scored in one pass with nothing shuffled.

Forward and backward run exactly over whole texts: all texts of a chunk form one chain with
a reset at every first word, cut into blocks whose 2 x 2 transfer products are computed side
by side. A document's score is 1 - exp(-rate * sum of the marginals' powers). The exponent comes
from cross-validation: fields fitted on one half of the sample score the other, and the one of
POWERS with the best F-score is taken. The rate puts at THRESHOLD the sum with the best F-score over
the sample under the field fitted on all of it, the mean of the sums beside it: fields of
half the sample give smaller sums, so their cut doesn't carry over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import U64, Prefix, chunks, joined, memo, mix
from .common import read

MAX_TOXIC, MAX_CLEAN = 1000, 2000
#: Bytes of text in the sample; of single texts, a 64th. Longer ones are not learned from, but scored.
MAX_BYTES = 64 << 20
TABLE_BITS = 18
PREFIXES = (3, 4, 5, 6)
THRESHOLD, SPAN_AT = 0.3, 0.5
STEPS, RATE, L2 = 20, 0.6, 1e-5
#: Exponents of the marginals to choose from, the first one where there is nothing to choose by.
POWERS = (3, 4, 8)
#: A feature marks a word as toxic for learning if its log odds, less DEVIATIONS standard errors, exceed this.
LEAST_ODDS, DEVIATIONS = 0.7, 1.5


@memo
def _word_bytes() -> np.ndarray:
    """Letters and digits of ASCII and every byte of other characters."""
    inside = np.zeros(256, bool)
    inside[128:] = True
    for low, high in (b"09", b"az", b"AZ"):
        inside[low : high + 1] = True
    return inside


def tokens(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Words of all texts: starts, ends (bytes in data), first (words before text i), features
    (words x features, the first 1 + len(PREFIXES) of them of the word itself), data, at."""
    data, at = joined(texts)
    inside = _word_bytes()[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    prefix = Prefix(data, lower=True)
    length = ends - starts
    word = mix(prefix.span(starts, ends) + length.astype(U64))
    own = [word]
    for k in PREFIXES:
        own.append(mix(prefix.span(starts, starts + np.minimum(k, length)) + U64(1000 * k)))
    first = np.searchsorted(starts, at)
    edge_word = np.zeros(1, U64)
    before, after = np.concatenate([edge_word, word])[: len(word)], np.concatenate([word, edge_word])[1:]
    inner = first[:-1][first[:-1] < len(word)]
    before[inner] = 0
    last = first[1:][first[1:] > 0] - 1
    after[last] = 0
    features = np.stack([*own, mix(before + U64(7)), mix(after + U64(11))], axis=1)
    return {"starts": starts, "ends": ends, "first": first, "features": (features >> U64(64 - TABLE_BITS)).astype(np.int32), "data": data, "at": at}


def marginals(u: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains that begin at the words first[:-1]. u: log potential of state
    1 over 0 of each word; trans[i, j]: log potential of j after i; start: of the first state.
    Gives P(1) of each word, P(i, j) of each word and the one before (words x 2 x 2; zero at first
    words), and a mask of first words."""
    n = len(u)
    head = np.zeros(n, bool)
    head[first[:-1][(first[:-1] < n) & (first[1:] > first[:-1])]] = True
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    m = np.zeros((rows * width, 2, 2))
    m[:, 0, 0] = m[:, 1, 1] = 1.0
    step = np.broadcast_to(np.exp(trans), (n, 2, 2)).copy()
    step[head] = np.exp(start)[None, :]
    up = np.clip(u, -30, 30)
    scale = np.exp(-np.maximum(up, 0))
    step[:, :, 0] *= scale[:, None]
    step[:, :, 1] *= (np.exp(up) * scale)[:, None]
    m[:n] = step
    m = m.reshape(rows, width, 2, 2).transpose(1, 0, 2, 3).copy()

    def times(a, b):
        c = a @ b
        return c / c.sum(axis=(-2, -1), keepdims=True)

    product = m[0]
    for k in range(1, width):
        product = times(product, m[k])
    enter, vector = np.empty((rows, 2)), np.array([0.5, 0.5])
    for i in range(rows):
        enter[i] = vector
        vector = vector @ product[i]
        vector = vector / vector.sum()
    leave, vector = np.empty((rows, 2)), np.array([0.5, 0.5])
    for i in range(rows - 1, -1, -1):
        leave[i] = vector
        vector = product[i] @ vector
        vector = vector / vector.sum()
    alpha, before, x = np.empty((width, rows, 2)), np.empty((width, rows, 2)), enter
    for k in range(width):
        before[k] = x
        x = np.einsum("ri,rij->rj", x, m[k])
        x = x / x.sum(axis=1, keepdims=True)
        alpha[k] = x
    beta, x = np.empty((width, rows, 2)), leave
    for k in range(width - 1, -1, -1):
        beta[k] = x
        x = np.einsum("rij,rj->ri", m[k], x)
        x = x / x.sum(axis=1, keepdims=True)
    both = before[..., :, None] * m * beta[..., None, :]
    flat = lambda a: np.swapaxes(a, 0, 1).reshape(rows * width, *a.shape[2:])[:n]
    pair = flat(both)
    pair = pair / pair.sum(axis=(1, 2), keepdims=True)
    p = flat(alpha * beta)
    pair[head] = 0
    return p[:, 1] / p.sum(axis=1), pair, head


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each text's values."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def best_cut(sums: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """(F-score, cut) of the best rule sum >= cut; the cut is the mean of the sums beside it.
    Precision weighs twice recall, since labels are noisy and clean documents
    are to stay. Of equally good cuts the lowest is taken."""
    values = np.unique(np.append(sums, max(1.0, 2 * sums.max())))
    ends = (values[:-1] + values[1:]) / 2
    marked = len(sums) - np.searchsorted(np.sort(sums), ends)
    caught = toxic.sum() - np.searchsorted(np.sort(sums[toxic == 1]), ends)
    f = 1.25 * caught / np.maximum(1, marked + 0.25 * toxic.sum())
    return float(f.max()), float(ends[int(np.argmax(f))])


class ToxicityModel:
    """weights of the features for state 1, a bias, transitions and start, all log potentials; power
    and rate of the document score."""

    def __init__(self, weights: np.ndarray, bias: float, trans: np.ndarray, start: np.ndarray, power: int = POWERS[0], rate: float = 1.0) -> None:
        self.weights, self.bias, self.trans, self.start, self.power, self.rate = weights, bias, trans, start, power, rate

    @classmethod
    def calibrated(cls, texts: list[bytes], toxic: list[int]) -> ToxicityModel:
        """The field fitted on all rows, its exponent chosen by cross-validation over two halves."""
        model, toxic = cls.fit(texts, toxic), np.asarray(toxic, int)
        if not toxic.any() or toxic.all():
            return model
        half, tried = np.arange(len(texts)) % 2, {p: np.zeros(len(texts)) for p in POWERS}
        for side in (0, 1):
            rest, mine = np.flatnonzero(half != side), np.flatnonzero(half == side)
            found = cls.fit([texts[i] for i in rest], toxic[rest].tolist()).sums([texts[i] for i in mine])
            for p in POWERS:
                tried[p][mine] = found[p]
        model.power = max(POWERS, key=lambda p: best_cut(tried[p], toxic)[0])
        model.rate = -np.log(1 - THRESHOLD) / best_cut(model.sums(texts)[model.power], toxic)[1]
        return model

    def sums(self, texts: list[bytes]) -> dict[int, np.ndarray]:
        """For each of POWERS, the sums of the words' probabilities to that power."""
        out = {p: np.zeros(len(texts)) for p in POWERS}
        for first, group in chunks(texts):
            t = tokens(group)
            q = self.words(t)
            for p in POWERS:
                out[p][first : first + len(group)] = _sums(q**p, t["first"])
        return out

    @classmethod
    def fit(cls, texts: list[bytes], toxic: list[int]) -> ToxicityModel:
        """Without rows of both classes every word is clean. Gradient steps with per-weight rates."""
        size = 1 << TABLE_BITS
        model = cls(np.zeros(size, np.float32), -6.0, np.zeros((2, 2)), np.zeros(2))
        toxic = np.asarray(toxic, int)
        if not toxic.any() or toxic.all():
            return model
        parts = [{k: t[k] for k in ("first", "features")} for _, group in chunks(texts) for t in [tokens(group)]]
        bounds = np.cumsum([0, *(len(g) for _, g in chunks(texts))])
        own = 1 + len(PREFIXES)
        docs = {0: np.zeros(size), 1: np.zeros(size)}
        for p, lo in zip(parts, bounds, strict=False):
            for i in range(len(p["first"]) - 1):
                docs[toxic[lo + i]][np.unique(p["features"][p["first"][i] : p["first"][i + 1], :own])] += 1
        n1, n0 = toxic.sum(), (1 - toxic).sum()
        odds = np.log((docs[1] + 0.5) / (n1 + 1)) - np.log((docs[0] + 0.5) / (n0 + 1)) - DEVIATIONS * np.sqrt(1 / (docs[1] + 0.5) + 1 / (docs[0] + 0.5))
        for p, lo in zip(parts, bounds, strict=False):
            of = np.repeat(np.arange(len(p["first"]) - 1), np.diff(p["first"]))
            p["y"] = ((odds[p["features"][:, :own]].max(axis=1) > LEAST_ODDS) if len(of) else np.zeros(0, bool)) & (toxic[lo + of] == 1)
        total = sum(len(p["y"]) for p in parts)
        model.bias = float(np.log((sum(p["y"].sum() for p in parts) + 0.5) / (total + 1)))
        squares = {"w": np.full(size, 1e-8), "b": 1e-8, "t": np.full((2, 2), 1e-8), "s": np.full(2, 1e-8)}
        for _ in range(STEPS):
            g = {"w": np.zeros(size), "b": 0.0, "t": np.zeros((2, 2)), "s": np.zeros(2)}
            for p in parts:
                y, f = p["y"], p["features"]
                if not len(y):
                    continue
                q, pair, head = marginals(model.potentials(f), p["first"], model.trans, model.start)
                off = y - q
                for k in range(f.shape[1]):
                    g["w"] += np.bincount(f[:, k], off, size)
                g["b"] += off.sum()
                seen = np.zeros((2, 2))
                tail = np.flatnonzero(~head)
                np.add.at(seen, (y[tail - 1].astype(int), y[tail].astype(int)), 1)
                g["t"] += seen - pair.sum(axis=0)
                g["s"] += [(~y[head]).sum() - (1 - q[head]).sum(), y[head].sum() - q[head].sum()]
            g["w"] -= L2 * total * model.weights
            for name, now in (("w", model.weights), ("t", model.trans), ("s", model.start)):
                squares[name] += g[name] ** 2
                now += (RATE * g[name] / np.sqrt(squares[name])).astype(now.dtype)
            squares["b"] += g["b"] ** 2
            model.bias += RATE * g["b"] / np.sqrt(squares["b"])
        return model

    def potentials(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(axis=1, dtype=np.float64) + self.bias

    def words(self, t: dict[str, np.ndarray]) -> np.ndarray:
        """Probability of each word to be toxic."""
        if not len(t["starts"]):
            return np.zeros(0)
        return marginals(self.potentials(t["features"]), t["first"], self.trans, self.start)[0]

    def score(self, texts: list[bytes] | pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
        """Score and offending spans (characters from, to; probability) of each text."""
        scores, spans = [], []
        for _, group in chunks(texts):
            t = tokens(group)
            if not len(t["starts"]):
                scores += [0.0] * len(group)
                spans += [[] for _ in group]
                continue
            p = self.words(t)
            scores += (1 - np.exp(-self.rate * _sums(p**self.power, t["first"]))).clip(0, 1).tolist()
            chars = np.concatenate([[0], np.cumsum((t["data"] & 0xC0) != 0x80)])
            hits = np.flatnonzero(p >= SPAN_AT)
            of = np.searchsorted(t["first"], hits, side="right") - 1
            found = [[] for _ in group]
            for i, d in zip(hits.tolist(), of.tolist(), strict=True):
                zero = chars[t["at"][d]]
                found[d].append({"from": int(chars[t["starts"][i]] - zero), "to": int(chars[t["ends"][i]] - zero), "p": float(p[i])})
            spans += found
        return np.asarray(scores), spans


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES) -> ToxicityModel:
    """Fits on at most max_toxic + max_clean labelled rows that are not held out, and max_bytes of their
    texts, in the order of a hash of the id. Of rows that repeat an id the least text counts; of labels
    that contradict each other, toxic."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")]
    chosen = usable.where("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(usable.where("toxic = 0").orderBy(*order).limit(max_clean))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= max_bytes // 64)
    found = found.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # at most max_toxic + max_clean ids
    rows = found.withColumn("bytes", F.sum(F.octet_length("text")).over(Window.partitionBy("toxic").orderBy(*order))).where(F.col("bytes") <= max_bytes // 2).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return ToxicityModel.calibrated([r["text"].encode() for r in rows], [r["toxic"] for r in rows])


def score_toxicity(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, spans. Null and empty texts, and
    texts without words, have score 0. Long texts are scored whole. Ids may be null or repeat: each row
    scores by its own text. Other columns are ignored; an empty table gives an empty result. Spans
    are characters from (included) to (excluded), with the word's probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("p", pa.float64())]))
        for b in batches:
            scores, spans = model.score(b.column(2))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32)), pa.array(spans, span)], ["doc_id", "held_out", "score", "predicted", "spans"])

    rows = df.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, spans array<struct<`from`:bigint,`to`:bigint,p:double>>")


def drop_toxic(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, whose text scores below THRESHOLD."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, _ = model.score(b.column(at))
            yield b.filter(pa.array(scores < THRESHOLD))

    return df.mapInArrow(run, df.schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = learn(docs, read(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted", "spans")
