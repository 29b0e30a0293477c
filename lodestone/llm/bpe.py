"""Byte-level BPE with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a whole pre-token that is
a vocabulary entry becomes its id at once. Tier two merges the rest: a heap of
candidate pairs over a doubly linked list of bytes, lowest rank first and the
leftmost of equals, which costs n log n however long the pre-token is.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import in_chunks, set_aside
from lodestone.llm.pieces import Encoder


_pack1 = struct.Struct("<I").pack


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class MinimalPerfectHash:
    """Maps each of n known 64-bit keys to its own number below n.

    Level by level, keys that have a slot to themselves are placed and the others go
    on to the next, smaller level; a key's number is the count of used slots before
    its own. An unknown key gets an arbitrary number or -1, so callers compare.
    """

    def __init__(self, keys: np.ndarray, spread: float = 1.5):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, base = np.unique(np.asarray(keys, dtype=np.uint64)), 0
        self.n = len(left)
        while len(left):
            size = max(2, int(len(left) * spread))
            at = self._slot(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = base + np.cumsum(alone) - alone
            self.levels.append((alone, rank))
            base += int(alone.sum())
            left = left[~alone[at]]

    @staticmethod
    def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
        return (x % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, dtype=np.uint64)
        out, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._slot(keys[left], level, len(alone))
            hit = alone[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out


class Vocabulary:
    """Ranks of byte strings, as a rank file lists them (base64 and rank on each line)."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.find = regex.compile(pattern).findall
        self.by_id = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.by_id[rank] = token
        tokens = list(self.ranks)
        keys = self._keys(tokens)
        self.hash = MinimalPerfectHash(keys)
        self.slot_id = np.full(max(1, self.hash.n), -1, dtype=np.int64)
        self.slot_id[self.hash(keys)] = [self.ranks[t] for t in tokens]
        self.pair_rank = [self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.encoder = Encoder(self._each, self._run)

    @staticmethod
    def _keys(tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))

    def lookup(self, tokens: list[bytes]) -> list[int]:
        """Tier one: the id of each byte string, -1 where it is no vocabulary entry."""
        slot = self.hash(self._keys(tokens))
        ids = np.where(slot >= 0, self.slot_id[np.maximum(slot, 0)], -1).tolist()
        by_id = self.by_id
        return [i if i >= 0 and by_id[i] == t else -1 for i, t in zip(ids, tokens)]

    def merge(self, token: bytes) -> list[int]:
        """Tier two: merges of the pre-token's bytes by rank."""
        get, n = self.ranks.get, len(token)
        end = list(range(1, n + 1))  # a part is token[i:end[i]]; end[i] = 0 marks one that is merged away
        prev = list(range(-1, n - 1))
        w = n.bit_length()  # a heap entry is rank, place and end of the pair in one number
        low = (1 << w) - 1
        pair = self.pair_rank
        heap = [(r << w | i) << w | i + 2 for i, (a, b) in enumerate(zip(token, token[1:])) if (r := pair[a << 8 | b]) >= 0]
        heapify(heap)
        while heap:
            x = heappop(heap)
            stop, i = x & low, x >> w & low
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                prev[stop] = i
                if (r := get(token[i : end[stop]])) is not None:
                    heappush(heap, (r << w | i) << w | end[stop])
            if (p := prev[i]) >= 0 and (r := get(token[p:stop])) is not None:
                heappush(heap, (r << w | p) << w | stop)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[token[i : end[i]]])
            i = end[i]
        return out

    def _ids_of(self, tokens: set[str]) -> dict[str, bytes]:
        """Ids of distinct pre-tokens: tier one for all at once, tier two for what it misses."""
        names = list(tokens)
        raw = [t.encode() for t in names]
        return {t: (_pack1(i) if i >= 0 else _packed(self.merge(r))) for t, r, i in zip(names, raw, self.lookup(raw))}

    def _each(self, strings: list[str]) -> list[bytes]:
        cut = [self.find(s) for s in strings]
        ids = self._ids_of(set().union(*cut))
        return [b"".join(map(ids.__getitem__, c)) for c in cut]

    def _run(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        tokens = self.find(" " + " ".join(words))
        ids = self._ids_of(set(tokens))
        starts = [i for i, t in enumerate(tokens) if t[0] == " "]
        packed = list(map(ids.__getitem__, tokens))
        return [packed[a] if b - a == 1 else b"".join(packed[a:b]) for a, b in zip(starts, [*starts[1:], len(tokens)])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        return self.encoder.encode(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.by_id.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def vocabulary(rank_file: bytes, pattern: str) -> Vocabulary:
    return Vocabulary(rank_file, pattern)


def _ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of ids (array of long) for every text.

    A null or empty text has no ids. A column already named so gets an underscore at its
    end. The rank file is read by the driver and sent to the tasks; its size is the vocabulary's.
    """
    docs = set_aside(docs, ids)
    ranks = _ranks(rank_path)
    schema = docs.select("*", F.array(F.lit(0).cast("long")).alias(ids)).schema

    def run(batches):
        v = vocabulary(ranks, pattern)
        for b in in_chunks(batches, text):
            made = [np.frombuffer(x, dtype="<u4").astype(np.int64) for x in v.encode([t or "" for t in b.column(text).to_pylist()])]
            offsets = np.cumsum([0, *map(len, made)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, np.concatenate(made))], names=[*b.schema.names, ids])

    return docs.mapInArrow(run, schema)


def decode_documents(docs: DataFrame, rank_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that each row's ids stand for; null ids give no bytes.

    A column already named so gets an underscore at its end.
    """
    docs = set_aside(docs, decoded)
    ranks = _ranks(rank_path)
    schema = docs.select("*", F.lit(b"").alias(decoded)).schema

    def run(batches):
        v = vocabulary(ranks, "")
        for b in batches:
            made = [b"".join(map(v.by_id.__getitem__, x or ())) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], names=[*b.schema.names, decoded])

    return docs.mapInArrow(run, schema)


def round_trip(docs: DataFrame, rank_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, then decode, every whole text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Null and empty texts have no tokens and the digests of no bytes. Repeated rows are
    repeated in the result; other columns of ``docs`` are not returned.
    """
    ranks = _ranks(rank_path)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        v, sha = vocabulary(ranks, pattern), hashlib.sha256
        for b in in_chunks(batches, "text"):
            made = v.encode([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) // 4 for x in made], pa.int64()), pa.array([sha(x).hexdigest() for x in made], pa.string()), pa.array([sha(v.decode(x)).hexdigest() for x in made], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def with_tokens(docs: DataFrame, rank_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int), ``n_tokens`` and ``restored``: whether the ids decode to the text.

    A null text counts as empty. Columns already named so get an underscore at their end.
    """
    docs = set_aside(docs, "ids", "n_tokens", "restored")
    ranks = _ranks(rank_path)
    schema = docs.select("*", F.array(F.lit(0)).alias("ids"), F.lit(0).cast("long").alias("n_tokens"), F.lit(True).alias("restored")).schema

    def run(batches):
        v = vocabulary(ranks, pattern)
        for b in in_chunks(batches, text):
            texts = [t or "" for t in b.column(text).to_pylist()]
            made = v.encode(texts)
            size = np.fromiter((len(x) // 4 for x in made), np.int64, len(made))
            ids = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), np.frombuffer(b"".join(made), "<i4"))
            yield pa.RecordBatch.from_arrays([*b.columns, ids, pa.array(size), pa.array([v.decode(x) == t.encode() for x, t in zip(made, texts)])], names=[*b.schema.names, "ids", "n_tokens", "restored"])

    return docs.mapInArrow(run, schema)
