"""Keys counted over all data in blocks of rows: which of a block's keys stand elsewhere too.

A block sends its distinct keys, dealt by ranges to buckets; a bucket answers each block with
those that stand more than once. So a key is one entry for each block that has it, and
there is no row for a pair of block and bucket that share none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_U = np.uint64
#: Bytes of text in a block of documents, and for each bucket of keys.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 32 << 20

#: A key is 64 bits that it is dealt by, and 32 that tell apart what agrees in them.
KEY = np.dtype([("a", "<u8"), ("b", "<u4")])


def keys_of(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    out = np.zeros(len(a), KEY)
    out["a"] = a
    if b is not None:
        out["b"] = (b >> _U(32)).astype(np.uint32)
    return out


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys, and where in it each distinct key begins."""
    order = np.argsort(keys["a"], kind="stable")
    a, b = keys["a"][order], keys["b"][order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():
        order = np.lexsort((keys["b"], keys["a"]))
        a, b = keys["a"][order], keys["b"][order]
    new = np.ones(len(keys), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new)


def once_each(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and whether each stood there more than once."""
    order, first = runs(keys)
    return keys[order[first]], np.diff(first, append=len(keys)) > 1


def deal(block: int, keys: np.ndarray, many: np.ndarray, buckets: int, narrow: bool) -> pa.Table:
    """A row ``bucket, block, keys, many`` for each bucket of key ranges; narrow keys have their 64 bits only."""
    cuts = np.searchsorted(keys["a"], np.arange(1, buckets, dtype=np.uint64) * _U(2**64 // max(2, buckets)))
    edges = [0, *cuts.tolist(), len(keys)]
    some = [(b, a, z) for b, (a, z) in enumerate(zip(edges, edges[1:])) if a < z]
    return pa.table(
        {
            "bucket": pa.array([b for b, _, _ in some], pa.int32()),
            "block": pa.array([block] * len(some), pa.int64()),
            "keys": pa.array([packed(keys[a:z], narrow) for _, a, z in some], pa.binary()),
            "many": pa.array([np.packbits(many[a:z]).tobytes() for _, a, z in some], pa.binary()),
        }
    )


DEALT = "bucket int, block long, keys binary, many binary"


def packed(keys: np.ndarray, narrow: bool) -> bytes:
    return keys["a"].tobytes() if narrow else keys["a"].tobytes() + keys["b"].tobytes()


def unpacked(x: bytes, narrow: bool) -> np.ndarray:
    n = len(x) // (8 if narrow else 12)
    out = np.zeros(n, KEY)
    out["a"] = np.frombuffer(x, "<u8", n)
    if not narrow:
        out["b"] = np.frombuffer(x, "<u4", n, 8 * n)
    return out


def repeated(dealt: DataFrame, narrow: bool) -> DataFrame:
    """For each block, those of its keys that stand more than once in all blocks: ``block, keys``."""

    def run(table: pa.Table) -> pa.Table:
        keys = [unpacked(x, narrow) for x in table.column("keys").to_pylist()]
        many = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)) for m, k in zip(table.column("many").to_pylist(), keys)]
        every = np.concatenate(keys)
        order, first = runs(every)
        count = np.add.reduceat(1 + np.concatenate(many)[order].astype(np.int64), first)
        good = np.empty(len(every), bool)
        good[order] = np.repeat(count > 1, np.diff(first, append=len(every)))
        ends = np.cumsum([0, *map(len, keys)])
        kept = [packed(k[good[a:z]], narrow) for k, a, z in zip(keys, ends, ends[1:])]
        some = [i for i, k in enumerate(kept) if k]
        return pa.table({"block": table.column("block").take(pa.array(some, pa.int64())), "keys": pa.array([kept[i] for i in some], pa.binary())})

    return dealt.groupBy("bucket").applyInArrow(run, "block long, keys binary")


def keys_in(table: pa.Table, narrow: bool) -> np.ndarray:
    keys = np.concatenate([np.empty(0, KEY), *(unpacked(x, narrow) for x in table.column("keys").to_pylist())])
    return keys[runs(keys)[0]]


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted known keys."""
    out = np.zeros(len(x), bool)
    at = np.searchsorted(known["a"], x["a"])
    left = np.flatnonzero(at < len(known))
    while len(left):  # a second round only for keys that agree in 64 bits and not in 32
        there = known[at[left]]
        equal = there["a"] == x["a"][left]
        out[left] |= equal & (there["b"] == x["b"][left])
        left = left[equal & ~out[left]]
        at[left] += 1
        left = left[at[left] < len(known)]
    return out
