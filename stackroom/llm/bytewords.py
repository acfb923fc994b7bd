"""Vectorised word and shingle hashing over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken in groups of about this many bytes, which bounds the working memory.
CHUNK_BYTES = 1 << 19
U64 = np.uint64


class _Store(dict):
    """Travels to the executors empty: they fill their own."""

    def __reduce__(self):
        return dict, ()


def memo(f):
    """functools.cache for functions that are pickled with their code."""
    store = _Store()

    @wraps(f)
    def cached(*args):
        if args not in store:
            store[args] = f(*args)
        return store[args]

    return cached


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@memo
def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
    if lower:
        values[65:91] = values[97:123]
    return values


@memo
def _is_space() -> np.ndarray:
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return space


BASE = 0x9E3779B97F4A7C15 | 1


@memo
def _powers(log_n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64, for i < 2 ** log_n."""
    n, inverse = 1 << log_n, pow(BASE, -1, 1 << 64)
    up, down = np.full(n, BASE, U64), np.full(n, inverse, U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


class Prefix:
    """Polynomial prefix hashes of a byte array; span(starts, ends) hashes many ranges at once."""

    def __init__(self, data: np.ndarray, lower: bool = False) -> None:
        up, self.down = _powers(max(20, int(len(data) + 1).bit_length()))
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_byte_values(lower)[data] * up[: len(data)], dtype=U64, out=self.sums[1:])

    def span(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]


def chunks(texts: list[bytes] | pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) of groups of about limit bytes; null counts as empty. Of an Arrow
    column only one group at a time becomes Python objects."""
    column = not isinstance(texts, list)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist() if column else [len(t) for t in texts]
    first, size = 0, 0
    for i in range(len(sizes) + 1):
        if i == len(sizes) or (i > first and size + sizes[i] > limit):
            if i > first:
                group = texts[first:i]
                yield first, [t or b"" for t in group.cast(pa.binary()).to_pylist()] if column else group
            first, size = i, 0
        if i < len(sizes):
            size += sizes[i] + 1


def sliced(batches: Iterator[pa.RecordBatch], column: int, limit: int = 8 * CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about limit bytes of a text column."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            start = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, start + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each with a space before and after, and their starts;
    text i stands at starts[i] : starts[i + 1] - 1."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    starts = np.ones(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    starts[1:] += 1
    return data, starts


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ASCII white space."""
    space = _is_space()[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    return edge[::2], edge[1::2]


def word_hashes(prefix: Prefix, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(prefix.span(starts, ends) + (ends - starts).astype(U64))


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles, words lower-cased in A-Z; of
    1 to k - 1 words the whole sequence is the one shingle; without words there is none."""
    data, at = joined(texts)
    starts, ends = words(data)
    hashes = word_hashes(Prefix(data, lower=True), starts, ends)
    first = np.searchsorted(starts, at)
    n = max(0, len(hashes) - k + 1)
    shingles = np.zeros(n, U64)
    for j in range(k):
        shingles = mix(shingles + hashes[j : j + n] * U64(2 * j + 3))
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= k:
            out.append(np.unique(shingles[lo : hi - k + 1]))
        elif hi > lo:
            short = np.array([hi - lo], U64)
            for h in hashes[lo:hi]:
                short = mix(short * U64(0xD6E8FEB86659FD93) + h)
            out.append(short)
        else:
            out.append(np.zeros(0, U64))
    return out
