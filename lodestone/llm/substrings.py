"""Exact removal of repeated passages by recompression.

Every text is parsed alike: runs of one word get a name, then in each round the
names are split into left and right ones by a bit of a hash, and every left-right
pair becomes one new name. A name is a hash of what it stands for, so all tasks
name alike and equal passages have equal symbols, but for some at their ends.

Each symbol carries the stretch of words that alone decides that it stands there.
A window can only be repeated if every symbol whose stretch lies inside it occurs
more than once in all the data; Spark counts the symbols, and then, for windows that
pass, the windows themselves by 96 bits of their words, which verifies them. Both counts are
made in blocks of documents first, so a passage that many documents share is one entry
for each block. Blocks and buckets are as many as the measured bytes of text ask
for, so tasks stay alike at every size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, text_bytes
from lodestone.llm.keys import BLOCK_BYTES, BUCKET_BYTES, DEALT, among, deal, keys_in, keys_of, once_each, repeated

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_BASE, _BASE2 = 0xD1B54A32D192ED03, 0xAEF17502108EF2D9  # odd, so they have inverses modulo 2^64



def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Block:
    """Texts laid end to end as word hashes, with one empty place before, between and after them."""

    def __init__(self, texts: list[bytes]):
        self.words = [t.split() for t in texts]
        self.size = np.fromiter(map(len, self.words), np.int64, len(texts))
        distinct = list(set().union(*self.words))
        both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct)), np.uint64).reshape(-1, 2)
        place = dict(zip(distinct, range(len(distinct))))
        n = int(self.size.sum()) + len(texts) + 1
        self.begin = np.cumsum(self.size + 1) - self.size
        self.wall = np.ones(n, bool)
        inside = np.repeat(self.begin - (np.cumsum(self.size) - self.size), self.size) + np.arange(int(self.size.sum()))
        self.wall[inside] = False
        self.hash, self.other = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        at = np.fromiter((place[w] for c in self.words for w in c), np.int64, len(inside))
        self.hash[inside], self.other[inside] = both[at, 0], both[at, 1]
        self.walls = np.concatenate([[0], np.cumsum(self.wall)])

    def starts(self, window: int) -> np.ndarray:
        """Where a window of words begins."""
        s = np.arange(max(0, len(self.hash) - window + 1))
        return s[self.walls[s + window] == self.walls[s]]

    def parse(self, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols after the given rounds, and first and last (exclusive) place of what decides each."""
        x, wall = self.hash, self.wall
        # runs: a word's neighbours decide whether it is part of one
        first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | wall[1:] | wall[:-1]]))
        length = np.diff(first, append=len(x))
        x, wall = x[first], wall[first]
        x = np.where(length > 1, _mix(x + _U(_STEP) * length.astype(np.uint64)), x)
        low = np.where(wall, first, first - 1)
        high = np.where(wall, first + 1, first + length + 1)
        for k in range(1, rounds + 1):
            right = (_mix(x + _U(k * _STEP % 2**64)) >> _U(63)).astype(bool)
            pair = np.zeros(len(x), bool)  # x[i] joins x[i + 1]
            pair[:-1] = ~right[:-1] & right[1:] & ~wall[:-1] & ~wall[1:]
            taken = np.concatenate([[False], pair[:-1]])
            name = _mix(_mix(x[:-1] + _U(_STEP)) + x[1:] * _U(_BASE))
            x = np.where(pair, np.append(name, _U(0)), x)
            before, after = np.concatenate([low[:1], low[:-1]]), np.concatenate([high[1:], high[-1:]])
            alone = ~pair & ~wall
            low = np.where(alone & right, before, low)
            high = np.where(pair | (alone & ~right), after, high)
            keep = ~taken
            x, wall, low, high = x[keep], wall[keep], low[keep], high[keep]
        return x, low, high

    def useful(self, low: np.ndarray, high: np.ndarray, window: int) -> np.ndarray:
        """Which symbols are decided inside some window."""
        return (high - low <= window) & (self.walls[high] == self.walls[low])

    def window_hashes(self, s: np.ndarray, window: int) -> np.ndarray:
        """Keys of the words of each window that begins at ``s``: 64 bits by one polynomial and 32 by another."""

        def by(words: np.ndarray, base: int) -> np.ndarray:
            n = len(words)
            up, down = _powers(base, n), _powers(pow(base, -1, 2**64), n)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(words) * down)])
            return _mix((total[s + window] - total[s]) * up[s])

        return keys_of(by(self.hash, _BASE), by(self.other, _BASE2))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def repeated_words(block: Block, known: np.ndarray, window: int) -> np.ndarray:
    """Which places lie inside a repeated window."""
    s = block.starts(window)
    s = s[among(block.window_hashes(s, window), known)]
    edge = np.zeros(len(block.hash) + 1, np.int64)
    np.add.at(edge, s, 1)
    np.add.at(edge, s + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _passes(docs: DataFrame, doc_id: str, text: str, window: int, rounds: int, finish, schema: str) -> DataFrame:
    """The two counts, then ``finish(rows, block, removed)`` for every block of documents.

    The texts are shuffled once; the three passes read the same exchange. Rows are dealt by
    all of their columns that can be hashed, so ids that are null or repeated do no harm.
    """
    size = bounded(docs).agg(F.sum(F.octet_length(text))).first()[0] or 0
    n, buckets = 1 + size // BLOCK_BYTES, 1 + size // BUCKET_BYTES
    key = "__block"
    while key in docs.columns:
        key += "_"
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    dealt = docs.withColumn(key, F.pmod(F.xxhash64(*plain), F.lit(n))).repartition(-(-n // 2), key)

    def symbols(rows: pa.Table) -> pa.Table:
        block = Block(text_bytes(rows.column(text)))
        x, low, high = block.parse(rounds)
        return deal(rows.column(key)[0].as_py(), *once_each(keys_of(x[block.useful(low, high, window)])), buckets, True)

    def windows(rows: pa.Table, shared: pa.Table) -> pa.Table:
        block = Block(text_bytes(rows.column(text)))
        x, low, high = block.parse(rounds)
        rare = block.useful(low, high, window) & ~among(keys_of(x), keys_in(shared, True))
        size = len(block.hash) + 1
        before = np.concatenate([[0], np.cumsum(rare)])
        s = block.starts(window)
        from_ = np.cumsum(np.bincount(low + 1, minlength=size + 1))[s]  # symbols decided by places before the window
        to = np.cumsum(np.bincount(high, minlength=size))[s + window]  # and by places before its end
        s = s[before[np.maximum(to, from_)] == before[from_]]
        return deal(rows.column(key)[0].as_py(), *once_each(block.window_hashes(s, window)), buckets, False)

    def removal(rows: pa.Table, again: pa.Table) -> pa.Table:
        block = Block(text_bytes(rows.column(text)))
        return finish(rows, block, repeated_words(block, keys_in(again, False), window))

    shared = repeated(dealt.groupBy(key).applyInArrow(symbols, DEALT), True).withColumnRenamed("block", key)
    blocks = dealt.groupBy(key)
    again = repeated(blocks.cogroup(shared.groupBy(key)).applyInArrow(windows, DEALT), False).withColumnRenamed("block", key)
    return blocks.cogroup(again.groupBy(key)).applyInArrow(removal, schema)


def _kept(block: Block, removed: np.ndarray):
    """Of each text: how many words go, and the words that stay, joined by one space."""
    for words, a in zip(block.words, block.begin):
        gone = removed[a : a + len(words)]
        n = int(gone.sum())
        yield n, b" ".join(words if not n else [w for w, g in zip(words, gone.tolist()) if not g])


def digests(docs: DataFrame, window: int = 35, rounds: int = 6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row.

    A word goes if a window of ``window`` words that covers it starts at another place too,
    in this or another row; windows are judged on the input. A null text has no words,
    and texts shorter than a window lose none. Repeated rows count as further places.
    Windows count as equal if 96 bits of their words agree, 64 of one hash and 32 of another.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def finish(rows: pa.Table, block: Block, removed: np.ndarray) -> pa.Table:
        made = list(_kept(block, removed))
        return pa.table({"doc_id": rows.column("doc_id"), "n_words": block.size, "n_removed": pa.array([n for n, _ in made], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for _, t in made], pa.string())})

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _passes(picked, "doc_id", "text", window, rounds, finish, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = 35, rounds: int = 6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated words taken out of ``text``; all rows and other columns stay.

    A text that loses words is its kept words joined by one space; one that loses none is untouched.
    """

    names = docs.columns

    def finish(rows: pa.Table, block: Block, removed: np.ndarray) -> pa.Table:
        old = rows.column(text).to_pylist()
        new = [t.decode() if n else o for o, (n, t) in zip(old, _kept(block, removed))]
        rows = rows.set_column(rows.schema.get_field_index(text), text, pa.array(new, rows.schema.field(text).type))
        return rows.select(names)

    return _passes(docs, doc_id, text, window, rounds, finish, docs.schema)
