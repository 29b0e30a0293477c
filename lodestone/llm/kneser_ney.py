"""Interpolated modified Kneser-Ney model of order two or three, counted in Spark.

The model is a folder of sorted arrays on a mount that driver and executors share:
word hashes in shards of the hash's leading bits, each word's counts beside them,
and pair keys with counts in buckets. Workers map the files and look up sorted
queries; nothing is loaded whole. A word's id is its place among all sorted hashes.

Pairs are dealt to buckets by their first word, and a frequent first word to as
many buckets as its count asks for, so no bucket holds one word's whole company.
Triples, dealt by their first two words and split in the same way, are kept as sorted
64-bit hashes of their ids with counts; the sums of their contexts stand beside them,
in part in each bucket that a context is split to, and are added up when they are read.
At order three a pair counts as often as different words stand before it.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ASCII_LOWER, in_chunks, new_path, shuffle_partitions, text_bytes

_HASH = xxhash.xxh64_intdigest
#: The end token and the mark before the first word; no word is empty or white space.
END, BEGIN = _HASH(b""), _HASH(b" ")


def local_path(path: str) -> str:
    """A shared folder as the mounted path under which files in it can be mapped."""
    u = urlparse(path)
    if u.scheme not in ("", "file"):
        raise ValueError(f"{path} is no mounted path; give model_dir a shared mount")
    return unquote(u.path)


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Write whole or not at all, counts in as few bytes as the largest needs; a task that runs twice writes the same."""
    os.makedirs(folder, exist_ok=True)
    if array.dtype.kind == "i":  # counts
        array = array.astype(np.min_scalar_type(int(array.max(initial=0))))
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, f"{folder}/{name}.npy")


def _list_parts(folder: str, stage: str) -> None:
    """List what has been written, so that a part that gets lost is told from one that never had an entry."""
    names = sorted(n.removesuffix(".npy") for n in os.listdir(folder) if n.endswith(".npy") and not n.startswith("."))
    _save(folder, f"parts-{stage}", np.array(names, str))


def _parts(folder: str, stage: str) -> np.ndarray:
    try:
        return np.load(f"{folder}/parts-{stage}.npy", mmap_mode="r")
    except FileNotFoundError:
        raise FileNotFoundError(f"no model in {folder}; is it a mount that driver and executors share?") from None


def _load(folder: str, name: str, kind: str, parts: np.ndarray) -> np.ndarray:
    """A part as it was written; one without any entry has no file, but one of the listed ``parts`` that is gone is an error."""
    try:
        return np.load(f"{folder}/{name}.npy", mmap_mode="r")
    except FileNotFoundError:
        at = int(np.searchsorted(parts, name))
        if at < len(parts) and parts[at] == name:
            raise FileNotFoundError(f"the model in {folder} has lost its part {name}") from None
        return np.empty(0, kind)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words with BEGIN before and END after, end to end, and each text's length in them."""
    cut = [t.translate(ASCII_LOWER).split() for t in texts]
    known = {w: _HASH(w) for w in set().union(*cut)}
    size = np.fromiter(map(len, cut), np.int64, len(cut)) + 2
    out = np.empty(int(size.sum()), np.uint64)
    ends = np.cumsum(size)
    inside = np.ones(len(out), bool)
    inside[ends - 1] = inside[ends - size] = False
    out[ends - size], out[ends - 1] = BEGIN, END
    out[inside] = np.fromiter((known[w] for c in cut for w in c), np.uint64, int(size.sum()) - 2 * len(cut))
    return out, size


def _count(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts summed."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys) != 0) + 1
    first = np.concatenate([[0], first]) if len(keys) else first
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _by_part(part: np.ndarray, parts: int):
    """(part, where its elements are) for parts that have any."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    return [(p, order[cuts[p] : cuts[p + 1]]) for p in range(parts) if cuts[p] < cuts[p + 1]]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _narrow(x: np.ndarray) -> bytes:
    kind = np.min_scalar_type(int(x.max()))
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


class Words:
    """The mapped word table."""

    def __init__(self, folder: str, bits: int, sizes: tuple[int, ...], threshold: int, stage: str):
        self.folder, self.bits, self.threshold = folder, bits, threshold
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        n = 1 << bits
        self.parts = parts = _parts(folder, stage)
        self.hash = [_load(folder, f"hash-{s}", "u8", parts) for s in range(n)]
        self.count = [_load(folder, f"count-{s}", "i8", parts) for s in range(n)]
        self.more = [_load(folder, f"more-{s}", "i8", parts) for s in range(n)]
        self.open: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def table(self, keys: str, values: str, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of a bucket and what stands beside them."""
        name = f"{keys}-{bucket}"
        if name not in self.open:
            self.open[name] = _load(self.folder, name, "u8", self.parts), _load(self.folder, f"{values}-{bucket}", "u1", self.parts)
        return self.open[name]

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of distinct sorted hashes, -1 where a word is unknown."""
        out = np.full(len(hashes), -1, np.int64)
        cuts = np.searchsorted(hashes >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(hashes), np.uint64), np.arange((1 << self.bits) + 1, dtype=np.uint64))
        for s, (a, z) in enumerate(zip(cuts, cuts[1:])):
            if a < z and len(known := self.hash[s]):
                at = np.minimum(np.searchsorted(known, hashes[a:z]), len(known) - 1)
                out[a:z] = np.where(known[at] == hashes[a:z], at + self.base[s], -1)
        return out

    def values(self, arrays: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
        """Rows of a table kept in shards, for sorted ids that are all known."""
        cuts = np.searchsorted(ids, self.base)
        picked = [arrays[s][ids[a:z] - self.base[s]] for s, (a, z) in enumerate(zip(cuts, cuts[1:])) if a < z]
        return (np.concatenate(picked) if picked else arrays[0][:0]).astype(np.int64)

    def bucket(self, u: np.ndarray, v: np.ndarray, count: np.ndarray, buckets: int) -> np.ndarray:
        """Bucket of the pairs: one for a first word, several for a frequent one."""
        sub = v.astype(np.uint64) % (np.uint64(1) + (count // self.threshold).astype(np.uint64))
        return (_mix(u.astype(np.uint64) * np.uint64(1 << 20) + sub) % np.uint64(buckets)).astype(np.int64)

    def splits(self, count_u: np.ndarray, count_v: np.ndarray) -> np.ndarray:
        """To how many buckets at most a context of two words is split; it is no more frequent than either."""
        return 1 + np.minimum(count_u, count_v) // self.threshold


def _triple_bucket(u: np.ndarray, v: np.ndarray, split: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(_mix(pair_key(u, v)) + split.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _triple_key(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mix(_mix(_mix(pair_key(u, v)) ^ _mix(w.astype(np.uint64) + np.uint64(1))))


def _add_found(out: np.ndarray, at: np.ndarray, keys: np.ndarray, bucket: np.ndarray, buckets: int, table) -> None:
    """Add to ``out[at]`` what ``table(bucket)`` holds for the keys; places in ``at`` may repeat."""
    for p, i in _by_part(bucket, buckets):
        have, value = table(p)
        if len(have):
            place = np.minimum(np.searchsorted(have, keys[i]), len(have) - 1)
            hit = have[place] == keys[i]
            np.add.at(out, at[i[hit]], value[place[hit]])


@lru_cache(maxsize=1)
def _words(folder: str, bits: int, sizes: tuple[int, ...], threshold: int, stage: str) -> Words:
    return Words(folder, bits, sizes, threshold, stage)


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the few numbers that hold for all of them."""

    folder: str
    bits: int
    sizes: tuple[int, ...]
    threshold: int
    buckets: int
    n: int  #: training tokens
    v: int  #: distinct training tokens
    pairs: int  #: distinct training pairs
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_left: float  #: what the words' discounts leave to the uniform distribution
    order: int = 2
    triple_buckets: int = 0
    triple_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the counts of counts;
    where one of those is 0, half of the count."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.01), i) for i, d in enumerate(raw, 1))


def _flushes(batches, limit: int = 6_000_000):
    """Token hashes and lengths of many texts at once."""
    held, sizes, n = [], [], 0
    for b in in_chunks(batches, "text"):
        h, size = tokens(text_bytes(b.column("text")))
        held.append(h)
        sizes.append(size)
        n += len(h)
        if n > limit:
            yield np.concatenate(held), np.concatenate(sizes)
            held, sizes, n = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(sizes)


def train(texts: DataFrame, folder: str, order: int = 2) -> Model:
    """Fit on every row's ``text`` (null: empty). Two passes over the texts: words, then pairs or,
    at order three, triples, of which the pairs are counted."""
    if order not in (2, 3):
        raise ValueError("order has to be 2 or 3")
    spark = texts.sparkSession
    os.makedirs(folder, exist_ok=True)
    texts = texts.select("text")
    bits = max(1, shuffle_partitions(spark).bit_length() - 1)
    shards = 1 << bits

    def count_words(batches):
        for h, _ in _flushes(batches):
            key, c = np.unique(h, return_counts=True)
            cuts = np.searchsorted(key >> np.uint64(64 - bits), np.arange(shards + 1, dtype=np.uint64))
            some = [(s, a, z) for s, (a, z) in enumerate(zip(cuts, cuts[1:])) if a < z]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in some], pa.int32()), pa.array([key[a:z].tobytes() for _, a, z in some], pa.binary()), pa.array([_narrow(c[a:z]) for _, a, z in some], pa.binary())], names=["shard", "keys", "counts"])

    def write_words(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        key, c = _count(np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]), np.concatenate(list(map(_wide, table.column("counts").to_pylist()))))
        _save(folder, f"hash-{s}", key)
        _save(folder, f"count-{s}", c)
        begin = int(c[key == BEGIN].sum())
        return pa.table({"shard": [s], "words": [len(key)], "total": [int(c.sum()) - begin], "begin": [begin]})

    counted = texts.mapInArrow(count_words, "shard int, keys binary, counts binary")
    rows = counted.groupBy("shard").applyInArrow(write_words, "shard long, words long, total long, begin long").collect()
    size = {r["shard"]: r["words"] for r in rows}
    sizes = tuple(size.get(s, 0) for s in range(shards))
    n, v = sum(r["total"] for r in rows), max(0, sum(sizes) - 1)
    buckets = max(2 << bits, n >> 21)  # every bucket reports to every shard, so shards are few and large
    if sum(sizes) >= 1 << 32:
        raise ValueError("more than 2^32 distinct words; ids of 32 bits do not hold them")
    threshold = max(1, n // (4 * buckets))
    _list_parts(folder, "words")
    base = np.concatenate([[0], np.cumsum(sizes)])

    def count_pairs(batches):
        words = _words(folder, bits, sizes, threshold, "words")
        for h, length in _flushes(batches):
            distinct, inverse = np.unique(h, return_inverse=True)
            ids = words.lookup(distinct)
            count = words.values(words.count, ids)
            keep = np.ones(len(h), bool)
            keep[np.cumsum(length) - 1] = False  # nothing follows an end
            first = np.flatnonzero(keep)
            pair = inverse[first].astype(np.uint64) << np.uint64(32) | inverse[first + 1].astype(np.uint64)
            pair, c = np.unique(pair, return_counts=True)
            a, b = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
            u, w = ids[a], ids[b]
            out = _by_part(words.bucket(u, w, count[a], buckets), buckets)
            yield _pair_rows(out, u, w, c, None)

    def count_triples(batches):
        words = _words(folder, bits, sizes, threshold, "words")
        for h, length in _flushes(batches):
            distinct, inverse = np.unique(h, return_inverse=True)
            ids = words.lookup(distinct)
            count = words.values(words.count, ids)
            before, here = _contexts(length)
            context, back = np.unique(inverse[before].astype(np.uint64) << np.uint64(32) | inverse[here].astype(np.uint64), return_inverse=True)
            triple, c = np.unique(back.astype(np.uint64) << np.uint64(32) | inverse[here + 1].astype(np.uint64), return_counts=True)
            of = (triple >> np.uint64(32)).astype(np.int64)
            x, y = (context[of] >> np.uint64(32)).astype(np.int64), (context[of] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            u, v, w = ids[x], ids[y], ids[(triple & np.uint64(0xFFFFFFFF)).astype(np.int64)]
            out = _by_part(_triple_bucket(u, v, w % words.splits(count[x], count[y]), buckets), buckets)
            blobs = [(_narrow(np.diff(u[i], prepend=0)), _narrow(v[i]), _narrow(w[i]), _narrow(c[i])) for _, i in out]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), *(pa.array([b[k] for b in blobs], pa.binary()) for k in range(4))], names=["bucket", "u", "v", "w", "c"])

    def write_triples(table: pa.Table) -> pa.Table:
        words = _words(folder, bits, sizes, threshold, "words")
        bucket = table.column("bucket")[0].as_py()
        u = np.concatenate([np.cumsum(_wide(x)) for x in table.column("u").to_pylist()])
        v, w, c = (np.concatenate(list(map(_wide, table.column(x).to_pylist()))) for x in ("v", "w", "c"))
        context = pair_key(u, v)
        by = np.lexsort((w, context))
        context, w, c = context[by], w[by], c[by]
        new = np.ones(len(w), bool)
        new[1:] = (context[1:] != context[:-1]) | (w[1:] != w[:-1])
        first = np.flatnonzero(new)
        context, w, c = context[first], w[first], np.add.reduceat(c, first)
        u, v = (context >> np.uint64(32)).astype(np.int64), (context & np.uint64(0xFFFFFFFF)).astype(np.int64)
        key, times = _count(_triple_key(u, v, w), c)
        _save(folder, f"triple-{bucket}", key)
        _save(folder, f"triple-times-{bucket}", times)
        start = np.flatnonzero(np.diff(context, prepend=~context[:1]) != 0)
        sums = np.stack([np.add.reduceat(x, start) for x in (c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64))], 1)
        _save(folder, f"context-{bucket}", context[start])
        _save(folder, f"context-sums-{bucket}", sums)
        pair, times = np.unique(pair_key(v, w), return_counts=True)
        v, w = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out = _by_part(words.bucket(v, w, words.values(words.count, v), buckets), buckets)
        return pa.Table.from_batches([_pair_rows(out, v, w, times, [int((c == k).sum()) for k in (1, 2, 3, 4)])])

    def write_pairs(table: pa.Table) -> pa.Table:
        bucket, table_kinds = table.column("bucket")[0].as_py(), table.column("kinds").to_pylist()
        u = np.concatenate([np.cumsum(_wide(x)) for x in table.column("u").to_pylist()])
        w, c = (np.concatenate(list(map(_wide, table.column(x).to_pylist()))) for x in ("v", "c"))
        order = np.lexsort((w, u))
        u, w, c = u[order], w[order], c[order]
        first = np.flatnonzero((np.diff(u, prepend=-1) != 0) | (np.diff(w, prepend=-1) != 0))
        u, w, c = u[first], w[first], np.add.reduceat(c, first)
        _save(folder, f"pair-{bucket}", pair_key(u, w))
        _save(folder, f"times-{bucket}", c)
        start = np.flatnonzero(np.diff(u, prepend=-1))
        kinds = [*(np.add.reduceat((c == k).astype(np.int64), start) for k in (1, 2, 3, 4)), np.add.reduceat(c, start)]
        context, followers = u[start], np.diff(start, append=len(u))
        after, before = np.unique(w, return_counts=True)
        out = []
        for s in range(shards):
            a, z = np.searchsorted(context, base[s : s + 2])
            x, y = np.searchsorted(after, base[s : s + 2])
            if a < z or x < y:
                table = np.stack([context[a:z] - base[s], followers[a:z], *(k[a:z] for k in kinds)])
                out.append((s, _narrow(table.reshape(-1)) if a < z else b"\x01", _narrow(np.concatenate([after[x:y] - base[s], before[x:y]])) if x < y else b"\x01"))
        told = [x for x in table_kinds if x is not None]
        told = np.sum(told, axis=0).tolist() if told else None
        return pa.table({"shard": pa.array([s for s, _, _ in out], pa.int32()), "context": pa.array([x for _, x, _ in out], pa.binary()), "after": pa.array([x for _, _, x in out], pa.binary()), "kinds": pa.array([told, *[None] * (len(out) - 1)], pa.list_(pa.int64()))})

    def write_more(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        more = np.zeros((sizes[s], 7), np.int64)  # followers; followers counted 1, 2, 3, 4 times; their counts; different words before
        for x in table.column("context").to_pylist():
            part = _wide(x).reshape(7, -1)
            np.add.at(more[:, :6], part[0], part[1:].T)
        for x in table.column("after").to_pylist():
            at, times = _wide(x).reshape(2, -1)
            np.add.at(more[:, 6], at, times)
        _save(folder, f"more-{s}", more)
        pairs, n1, n2, n3, n4, _, _ = more.sum(0).tolist()
        told = np.sum([[0] * 4, *(x for x in table.column("kinds").to_pylist() if x is not None)], axis=0).tolist()
        return pa.table({"shard": [s], "sums": pa.array([[pairs, n1, n2, n3, n4, *(int((more[:, 6] == k).sum()) for k in (1, 2, 3, 4)), int((more[:, 6] > 0).sum()), *told]], pa.list_(pa.int64()))})

    if order == 3:
        triples = texts.mapInArrow(count_triples, "bucket int, u binary, v binary, w binary, c binary")
        pairs = triples.groupBy("bucket").applyInArrow(write_triples, _PAIR_ROWS)
    else:
        pairs = texts.mapInArrow(count_pairs, _PAIR_ROWS)
    more = pairs.groupBy("bucket").applyInArrow(write_pairs, "shard int, context binary, after binary, kinds array<long>")
    rows = more.groupBy("shard").applyInArrow(write_more, "shard long, sums array<long>").collect()
    _list_parts(folder, "scores")
    total = np.sum([r["sums"] for r in rows], axis=0).tolist() if rows else [0] * 14
    words = discounts(*total[5:9])
    left = sum(d * k for d, k in zip(words, (total[5], total[6], total[9] - total[5] - total[6])))
    return Model(folder, bits, sizes, threshold, buckets, n, v, total[0], discounts(*total[1:5]), words, left / total[0] if total[0] else 1.0, order, buckets, discounts(*total[10:14]))


_PAIR_ROWS = "bucket int, u binary, v binary, c binary, kinds array<long>"


def _pair_rows(out: list, u: np.ndarray, v: np.ndarray, c: np.ndarray, kinds: list[int] | None) -> pa.RecordBatch:
    """Pairs (sorted by ``u``) of each bucket; ``kinds``, how many triples stand 1, 2, 3, 4 times, goes with the first."""
    blobs = [(_narrow(np.diff(u[i], prepend=0)), _narrow(v[i]), _narrow(c[i])) for _, i in out]
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), *(pa.array([x[k] for x in blobs], pa.binary()) for k in range(3)), pa.array([kinds, *[None] * (len(out) - 1)][: len(out)], pa.list_(pa.int64()))], names=["bucket", "u", "v", "c", "kinds"])


def _contexts(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the last two marks before each token; the first token of a text has BEGIN twice."""
    ends = np.cumsum(length)
    keep = np.ones(int(length.sum()), bool)
    keep[ends - 1] = False
    here = np.flatnonzero(keep)
    begins = np.zeros(len(keep), bool)
    begins[ends - length] = True
    return here - ~begins[here], here


def pair_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Sortable 64-bit keys of pairs of ids below 2^32."""
    return u.astype(np.uint64) << np.uint64(32) | v.astype(np.uint64)


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array((0.0, *d))[np.minimum(c, 3)]


def _score(m: Model, words: Words, texts: list[bytes]):
    """Arrays over texts: tokens, known tokens, base score, model score."""
    h, length = tokens(texts)
    distinct, inverse = np.unique(h, return_inverse=True)
    ids = words.lookup(distinct)
    known = ids >= 0
    count, more = np.zeros(len(ids), np.int64), np.zeros((len(ids), 7), np.int64)
    if known.any():
        count[known] = words.values(words.count, ids[known])
        if m.pairs:
            more[known] = words.values(words.more, ids[known])
    first = np.ones(len(h), bool)
    first[np.cumsum(length) - 1] = False
    a, b = inverse[np.flatnonzero(first)], inverse[np.flatnonzero(first) + 1]
    seen = more[:, 6]
    word = m.word_left / (m.v + 1) + np.maximum(seen - _discount(seen, m.word_discounts), 0) / max(1, m.pairs)
    d1, d2, d3 = m.pair_discounts
    left = d1 * more[:, 1] + d2 * more[:, 2] + d3 * (more[:, 0] - more[:, 1] - more[:, 2])

    pair, back = np.unique(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64), return_inverse=True)
    x, y = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
    times = np.zeros(len(pair), np.int64)
    ask = np.flatnonzero(known[x] & known[y])
    bucket = words.bucket(ids[x[ask]], ids[y[ask]], count[x[ask]], m.buckets)
    key = pair_key(ids[x[ask]], ids[y[ask]])
    _add_found(times, ask, key, bucket, m.buckets, lambda b: words.table("pair", "times", b))
    c = more[x, 5]
    p = np.where(c > 0, (np.maximum(times - _discount(times, m.pair_discounts), 0) + left[x] * word[y]) / np.maximum(c, 1), word[y])
    if m.order == 3:
        p, back = _with_triples(m, words, ids, count, inverse[_contexts(length)[0]], x, y, p, back)
    starts = np.cumsum(length - 1) - (length - 1)
    sums = lambda q: np.add.reduceat(q, starts)
    base = np.log10((count + 0.1) / (m.n + 0.1 * (m.v + 1)))
    return length - 1, sums((count[b] > 0).astype(np.int64)), sums(base[b]), sums(np.log10(p)[back])


def _with_triples(m: Model, words: Words, ids: np.ndarray, count: np.ndarray, u: np.ndarray, x: np.ndarray, y: np.ndarray, p: np.ndarray, back: np.ndarray):
    """Probabilities of distinct (u, pair), from those of the pairs (x, y), and which of them each token has."""
    triple, back = np.unique(u.astype(np.uint64) << np.uint64(32) | back.astype(np.uint64), return_inverse=True)
    u, pair = (triple >> np.uint64(32)).astype(np.int64), (triple & np.uint64(0xFFFFFFFF)).astype(np.int64)
    v, w, p = x[pair], y[pair], p[pair]
    context, of = np.unique(u.astype(np.uint64) << np.uint64(32) | v.astype(np.uint64), return_inverse=True)
    cu, cv = (context >> np.uint64(32)).astype(np.int64), (context & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sums, times = np.zeros((len(context), 4), np.int64), np.zeros(len(triple), np.int64)
    ask = np.flatnonzero((ids[cu] >= 0) & (ids[cv] >= 0))
    parts = words.splits(count[cu[ask]], count[cv[ask]])
    split = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    ask = np.repeat(ask, parts)
    a, b = ids[cu[ask]], ids[cv[ask]]
    # splits of one context may share a bucket, which then holds their sum
    bucket = _triple_bucket(a, b, split, m.triple_buckets)
    once = np.unique(np.stack([ask, bucket]), axis=1, return_index=True)[1] if len(ask) else ask
    _add_found(sums, ask[once], pair_key(a, b)[once], bucket[once], m.triple_buckets, lambda k: words.table("context", "context-sums", k))
    ask = np.flatnonzero((ids[u] >= 0) & (ids[v] >= 0) & (ids[w] >= 0))
    a, b, c = ids[u[ask]], ids[v[ask]], ids[w[ask]]
    bucket = _triple_bucket(a, b, c % words.splits(count[u[ask]], count[v[ask]]), m.triple_buckets)
    _add_found(times, ask, _triple_key(a, b, c), bucket, m.triple_buckets, lambda k: words.table("triple", "triple-times", k))
    total, left = sums[of, 0], (sums[:, 1:] @ np.array(m.triple_discounts))[of]
    return np.where(total > 0, (np.maximum(times - _discount(times, m.triple_discounts), 0) + left * p) / np.maximum(total, 1), p), back


def score(docs: DataFrame, m: Model, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` (with ``text``) and ``n_tokens, n_known, train_tokens, base_score, score``."""
    schema = docs.select(*columns).schema.simpleString()[len("struct<") : -1].replace(":", " ")

    def run(batches):
        words = _words(m.folder, m.bits, m.sizes, m.threshold, "scores")
        for b in in_chunks(batches, "text", 16 << 20):
            made = _score(m, words, text_bytes(b.column("text")))
            extra = [pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()), pa.array([m.n] * b.num_rows, pa.int64()), pa.array(made[2]), pa.array(made[3])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *extra], names=[*columns, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.mapInArrow(run, f"{schema}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out_scores(docs: DataFrame, folds: int = 10, doc_id: str = "doc_id", text: str = "text", model_dir: str | None = None, order: int = 3) -> DataFrame:
    """Train on the documents whose crc32(id) is no multiple of ``folds``; score every document.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: log10
    probabilities under an add-0.1 unigram model and under the Kneser-Ney model of the given order.
    Tokens are A-Z-lowered words and one end; a null text is empty and has the end only.
    A null id counts as the empty string, whose remainder is 0. Without training rows
    every token has probability 1 over the one unknown word, score 0. Repeated rows
    count as often as they stand there.
    """
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0
    picked = picked.withColumn("held_out", held)
    folder = local_path(model_dir or new_path(docs.sparkSession, "kneser-ney"))
    model = train(picked.where(~F.col("held_out")), folder, order)
    return score(picked, model, ["doc_id", "held_out"])
