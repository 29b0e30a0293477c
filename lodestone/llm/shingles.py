"""Sets of word shingles, and the pairs of them that may be alike.

Spark counts all shingles; a set of n that has fewer than ``ceil(t n)`` in common with all
others together is alike to none and goes. Of the rest, shingles stand in one order, those
that stand nowhere else before the others. Two sets of a similarity of t or more share the
first l of their common shingles among the first ``n - ceil(t n) + l`` of each; l grows
with n, so that sets that have one passage in common are rarely compared and none that are
alike are missed. Links are verified on the texts' whole sets.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ASCII_LOWER, in_chunks, materialize, shuffle_partitions, text_bytes
from lodestone.llm.keys import BLOCK_BYTES, BUCKET_BYTES, DEALT, deal, keys_in, keys_of, once_each, repeated


def hashes(text: bytes, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the text's ``size``-word shingles in order, repeats included; fewer words, or none, are one shingle."""
    w = text.translate(ASCII_LOWER).split()
    h = xxhash.xxh64_intdigest
    if len(w) < size:
        return np.array([h(b" ".join(w), seed)], np.uint64)
    joined = b" ".join([b"%b"] * size)
    return np.array([h(joined % s, seed) for s in zip(*(w[i:] for i in range(size)))], np.uint64)


def _least(n: int, t: Fraction) -> int:
    """How many shingles of n a set that is alike has too."""
    return -(-t.numerator * n // t.denominator)


def _shared(n):
    """How many of a set's first shingles a set that is alike has too."""
    return 1 + n // 20


def _parity(tokens: np.ndarray) -> bytes:
    odd = np.bincount((tokens.view(np.uint64) >> np.uint64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def survivors(texts: DataFrame, size: int, t: Fraction, fingerprint) -> DataFrame:
    """``k, n, fp, least, tokens, parity`` of the texts ``k, text`` that may have a partner: size and
    fingerprint of the set, how many shingles a partner has too, those, in order, that
    stand in other texts, and for each of 512 ranges whether it holds an odd number of them.

    All shingles of all texts are counted, in blocks of texts first. A set may be alike
    to another only if so many of its shingles stand elsewhere as the two have to share.
    """
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, buckets = 1 + total // BLOCK_BYTES, 1 + total // BUCKET_BYTES

    def first_seen(batches):  # a task sends each text once, however many copies it meets
        seen = set()
        for b in batches:
            keep = []
            for k in b.column("k").to_pylist():
                keep.append(k not in seen)
                seen.add(k)
            yield b.filter(pa.array(keep, pa.bool_()))

    once = texts.mapInArrow(first_seen, "k long, text string").withColumn("block", F.pmod(F.xxhash64("k"), F.lit(n_blocks)))
    blocks = once.repartition(-(-n_blocks // 2), "block").groupBy("block")

    def distinct(rows: pa.Table) -> list[tuple[int, str, np.ndarray]]:
        every = dict(zip(rows.column("k").to_pylist(), rows.column("text").to_pylist()))
        return [(k, x, hashes(x.encode(), size)) for k, x in every.items()]

    def count(rows: pa.Table) -> pa.Table:
        every = np.concatenate([np.unique(h) for _, _, h in distinct(rows)])
        return deal(rows.column("block")[0].as_py(), *once_each(keys_of(every)), buckets, True)

    def choose(rows: pa.Table, shared: pa.Table) -> pa.Table:
        known, out = keys_in(shared, True)["a"], []
        for k, x, h in distinct(rows):
            s = np.unique(h)
            n, least = len(s), _least(len(s), t)
            at = np.minimum(np.searchsorted(known, s), max(0, len(known) - 1))
            s = s[known[at] == s] if len(known) else s[:0]
            if len(s) >= least:
                out.append((k, n, fingerprint(h) if x.strip() else 0, least, s.view(np.int64)))
        fp = np.array([o[2] for o in out], np.uint64).view(np.int64)
        return pa.table({"k": pa.array([o[0] for o in out], pa.int64()), "n": pa.array([o[1] for o in out], pa.int32()), "fp": pa.array(fp), "least": pa.array([o[3] for o in out], pa.int32()), "tokens": pa.array([o[4] for o in out], pa.list_(pa.int64())), "parity": pa.array([_parity(o[4]) for o in out], pa.binary())})

    shared = repeated(blocks.applyInArrow(count, DEALT), True)
    made = blocks.cogroup(shared.groupBy("block")).applyInArrow(choose, "k long, n int, fp long, least int, tokens array<long>, parity binary")
    return materialize(made, "survivors")[0]


def postings(some: DataFrame) -> DataFrame:
    """``token, k, n, before, rest, first`` of the sets' first shingles: the shingle before (itself
    for the first one), how many there are from this one on, and whether it is among the few
    of which a partner has one at least."""
    spare = F.size("tokens") - F.col("least")
    each = some.select("k", "n", spare.alias("spare"), F.size("tokens").alias("c"), F.slice("tokens", F.lit(1), spare + F.floor(F.col("n") / 20).cast("int") + 1).alias("x")).select("k", "n", "c", "spare", "x", F.posexplode("x").alias("at", "token"))
    return each.select("token", "k", "n", F.when(F.col("at") > 0, F.get("x", F.col("at") - 1)).otherwise(F.col("token")).alias("before"), (F.col("c") - F.col("at")).alias("rest"), "c", (F.col("at") <= F.col("spare")).alias("first"))


def _ends(x: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """For each place the end of its run of equal values."""
    new = np.ones(len(x), bool)
    new[1:] = np.logical_or.reduce([y[1:] != y[:-1] for y in (x, *more)])
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(x))
    return np.repeat(stop, stop - start)


def _near(token: np.ndarray, copies: np.ndarray):
    """Neighbours in a shingle's rows, and its most copied text with all others."""
    stop = _ends(token)
    i = np.arange(len(token))
    next_to = i[i + 1 < stop]
    yield next_to, next_to + 1
    start = np.flatnonzero(np.diff(stop, prepend=-1))
    top = np.lexsort((-copies, stop))[start]
    yield np.repeat(top, stop[start] - start), i


def _across(token: np.ndarray, label: np.ndarray, chunk: int = 1 << 18):
    """All pairs of a shingle's rows with different labels, which stand in order."""
    first, last = _ends(token, label), _ends(token)
    count = last - first
    have = np.flatnonzero(count)
    part = np.cumsum(count[have]) // chunk
    for p in np.unique(part):
        i = have[part == p]
        a = np.repeat(i, count[i])
        yield a, np.arange(len(a)) - np.repeat(np.cumsum(count[i]) - count[i], count[i]) + first[a]


def candidates(postings: DataFrame, t: Fraction, across: bool) -> DataFrame:
    """Pairs ``a < b`` of sets that share first shingles, and whose sizes are near enough, to reach ``t``.

    ``across``: all such pairs of different labels (with ``parity``), each where a run of shared
    shingles begins, if what follows can still be enough and the parities leave room for it: they
    differ in no more ranges than there are shingles of one set only. Else, to begin
    with, pairs that stand side by side in enough shingles' rows.
    """
    columns = ["token", "label", "k", "n", *(("before", "rest", "c") if across else ("copies",))]
    postings = postings.where("first") if across else postings
    dealt = postings.select(*columns, *(["parity"] if across else [])).repartition(shuffle_partitions(postings.sparkSession), "token").sortWithinPartitions("token", "label" if across else "n", "n", "k")
    num, den = t.numerator, t.denominator

    def pairs(x, parity):
        token, label, k, n, *more = x
        reaches = lambda same, i, j: den * same >= num * (n[i] + n[j] - same)
        for i, j in _across(token, label) if across else _near(token, more[0]):
            good = (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])) & (k[i] != k[j])
            if across:
                before, rest, c = more
                good &= (before[i] != before[j]) | (before[i] == token[i])  # else they have met at the one before
                good &= reaches(np.minimum(rest[i], rest[j]), i, j)
                i, j = i[good], j[good]
                apart = np.bitwise_count(parity[i] ^ parity[j]).sum(1, dtype=np.int64)
                good = reaches((c[i] + c[j] - apart) // 2, i, j)
            i, j = i[good], j[good]
            a, b, need = np.minimum(k[i], k[j]), np.maximum(k[i], k[j]), _shared(np.minimum(n[i], n[j]))
            order = np.lexsort((b, a))
            a, b, need = a[order], b[order], need[order]
            first = np.flatnonzero((np.diff(a, prepend=a[:1] - 1) != 0) | (np.diff(b, prepend=b[:1]) != 0))
            yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(np.diff(first, append=len(a))), pa.array(need[first])], names=["a", "b", "c", "need"])

    def run(batches):
        held, odd, n = [], [], 0
        for batch in batches:
            held.append(np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in columns]))
            odd.append(np.frombuffer(b"".join(batch.column("parity").to_pylist()), np.uint64).reshape(-1, 8) if across else np.empty((batch.num_rows, 0), np.uint64))
            n += batch.num_rows
            if n > 1 << 18:  # whole shingles only; the last one may go on
                x, y = np.concatenate(held, axis=1), np.concatenate(odd)
                cut = int(np.flatnonzero(x[0] == x[0, -1])[0])
                if cut:
                    yield from pairs(x[:, :cut], y[:cut])
                held, odd, n = [x[:, cut:]], [y[cut:]], x.shape[1] - cut
        if n:
            yield from pairs(np.concatenate(held, axis=1), np.concatenate(odd))

    met = dealt.mapInArrow(run, "a long, b long, c long, need long")
    if across:
        return met.select("a", "b").distinct()
    return met.groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("need").alias("need")).where("c >= need").select("a", "b")


def verified(pairs: DataFrame, some: DataFrame, t: Fraction) -> DataFrame:
    """The distinct pairs ``a, b`` of survivors whose sets have a Jaccard similarity of ``t`` or more, as a table."""
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda k: some.select(F.col("k").alias(k), F.col("n").alias(f"n_{k}"), F.col("tokens").alias(f"tokens_{k}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "tokens_a", "tokens_b")

    def run(batches):
        for batch in batches:
            size = np.asarray(batch.column("n_a")).astype(np.int64) + np.asarray(batch.column("n_b"))
            (at, x), (to, y) = ((np.asarray(c.offsets), np.asarray(c.values)) for c in (batch.column("tokens_a"), batch.column("tokens_b")))
            same = [len(np.intersect1d(x[at[i] : at[i + 1]], y[to[i] : to[i + 1]], assume_unique=True)) for i in range(batch.num_rows)]
            same = np.array(same, np.int64)
            good = t.denominator * same >= t.numerator * (size - same)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good))

    return materialize(both.mapInArrow(run, "a long, b long"), "links")[0]
