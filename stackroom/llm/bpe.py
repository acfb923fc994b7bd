"""Byte-level BPE encoding and decoding.

Two tiers. A minimal perfect hash over the vocabulary (hash and displace: one array of
displacements, one slot per token, the token's bytes compared) resolves pre-tokens that are
tokens. The others are merged: a heap of (rank, place) over a doubly linked list of byte
runs, whose pair ranks come from the same hash. Each worker remembers what it resolved, up
to 2 * MEMO pre-tokens. The vocabulary, whose size is fixed, travels with the function.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import sliced
from .common import read

#: Pre-tokens that a worker remembers, in each of two generations, and pairs of tokens; 100 MB at most.
MEMO = 1 << 18
#: White space by Unicode, which \s isn't in every engine.
SPACE = r"\t-\r \x85\xa0  -     　"


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: n strings, slots 0 to n - 1."""

    def __init__(self, keys: list[bytes]) -> None:
        self.n = len(keys)
        self.buckets = max(1, self.n // 4)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            groups[h % self.buckets].append(i)
        self.shifts = [0] * self.buckets
        self.slot_key: list[int] = [-1] * self.n
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            shift = 0
            while groups[b]:
                slots = [self._slot(hashes[i], shift) for i in groups[b]]
                if len({*slots}) == len(slots) and all(self.slot_key[s] < 0 for s in slots):
                    for s, i in zip(slots, groups[b], strict=True):
                        self.slot_key[s] = i
                    break
                shift += 1
            self.shifts[b] = shift

    def _slot(self, h: int, shift: int) -> int:
        return ((h >> 24) * (2 * shift + 0x9E3779B1) >> 16) % self.n

    def slot(self, key: bytes) -> int:
        """The slot of a key; of a string that is no key, any slot."""
        h = xxhash.xxh3_64_intdigest(key)
        return self._slot(h, self.shifts[h % self.buckets])


class ByteBpe:
    """ranks: token -> id; every single byte must be a token. pattern: the pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        tokens = list(ranks)
        self.hash = PerfectHash(tokens)
        self.keys = [tokens[i] for i in self.hash.slot_key]
        self.ids = [ranks[k] for k in self.keys]
        self.decoder = {i: k for k, i in ranks.items()}
        self.pattern = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
        self.single = [ranks[bytes([c])] for c in range(256)]
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, int] = {}
        self.split = None

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        """A rank file: lines of base64 token and id."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "memo": {}, "older": {}, "pairs": {}, "split": None}

    def token_id(self, token: bytes) -> int | None:
        s = self.hash.slot(token)
        return self.ids[s] if self.keys[s] == token else None

    def _joined(self, left: int, right: int) -> int:
        """Id of the token that two tokens make, or -1; remembered."""
        if (found := self.pairs.get(left << 32 | right)) is None:
            token = self.token_id(self.decoder[left] + self.decoder[right])
            found = -1 if token is None else token
            self.pairs[left << 32 | right] = found
        return found

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token that is no token: always the pair of least rank first, from the left.
        Links hold the places before and after each run; a run that was swallowed has id -1. A
        heap entry is stale if its pair no longer makes its rank; every pair on the heap is remembered."""
        n, known, joined = len(word), self.pairs.get, self._joined
        part = [self.single[c] for c in word]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []  # rank << 40 | place
        for i in range(n - 1):
            if (rank := known(part[i] << 32 | part[i + 1])) is None:
                rank = joined(part[i], part[i + 1])
            if rank >= 0:
                heap.append(rank << 40 | i)
        heapify(heap)
        while heap:
            rank = heappop(heap)
            i, rank = rank & 0xFFFFFFFFFF, rank >> 40
            left, j = part[i], after[i]
            if left < 0 or j >= n or known(left << 32 | part[j]) != rank:
                continue
            part[i], part[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (new := known(rank << 32 | part[k])) is None:
                    new = joined(rank, part[k])
                if new >= 0:
                    heappush(heap, new << 40 | i)
            if (h := before[i]) >= 0:
                if (new := known(part[h] << 32 | rank)) is None:
                    new = joined(part[h], rank)
                if new >= 0:
                    heappush(heap, new << 40 | h)
        return [p for p in part if p >= 0]

    def _packed(self, word: str) -> bytes:
        if (found := self.memo.get(word) or self.older.get(word)) is None:
            raw = word.encode()
            whole = self.token_id(raw)
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            ids = array("I", [whole] if whole is not None else self.merge(raw))
            if sys.byteorder == "big":
                ids.byteswap()
            found = ids.tobytes()
        if len(self.memo) >= MEMO:
            self.older, self.memo = self.memo, {}
        if len(word) <= 64:
            self.memo[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids, as little-endian unsigned 32-bit integers."""
        if self.split is None:
            self.split = regex.compile(self.pattern)
        get, packed = self.memo.get, self._packed
        return b"".join([get(w) or packed(w) for w in self.split.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.decoder.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_texts(df: DataFrame, bpe: ByteBpe, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids (array of int)
    if asked for. Null counts as empty: no tokens, and the digests of nothing. Repeated rows are
    encoded alike; other columns are ignored; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            coded = [bpe.encode(t or "") for t in b.column(1).to_pylist()]
            columns = {
                "doc_id": b.column(0),
                "n_tokens": pa.array([len(c) // 4 for c in coded], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(c)).hexdigest() for c in coded], pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in coded], pa.list_(pa.int32()))
            yield pa.record_batch(columns)

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def decode_ids(df: DataFrame, bpe: ByteBpe, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id, decoded (the bytes of the ids; null ids give none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            decoded = [bpe.decode(np.asarray(ids or [], "<u4").tobytes()) for ids in b.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": b.column(0), "decoded": pa.array(decoded, pa.binary())})

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded binary")


def public_bpe(name: str = "byte_bpe_50k.tiktoken") -> ByteBpe:
    """A vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return ByteBpe.from_file(public_tokenizers.path(name), public_tokenizers.PATTERN)


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_texts(read(spark, sf_dir, "documents"), public_bpe(), with_ids=False)
