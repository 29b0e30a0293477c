"""Words that are one edit apart, and the form that each of them most likely stands for.

Two words of one edit share the half in front of it or the half behind it, so words are dealt
into blocks by length and by one half; a block of length L also holds, as its long rows, the
words of L + 1. Blocks that are still crowded are dealt again by halves of the part that is
free, until that is a single place, where the alphabet bounds them. In each block the Gram
matrix of letter counts gives all squared distances at once; pairs at most two apart are
then compared letter by letter. Nothing is paired across blocks.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ASCII_LOWER, in_chunks, materialize

_ASCII = np.zeros(256, bool)
_ASCII[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_LOWER = np.frombuffer(ASCII_LOWER, np.uint8)
#: The letter counts' columns: a to z, then U+00C0 to U+00FF.
_LETTER = np.zeros(256, np.int64)
_LETTER[97:123], _LETTER[192:256] = np.arange(26), np.arange(26, 90)
LETTERS = 90
#: Rows of a tile of a Gram matrix.
TILE = 256


def runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased, as Latin-1 bytes, and the row each stands in.

    In UTF-8 the letters beyond ASCII are the byte C3 and one byte more, so bytes tell all."""
    column = pc.fill_null(texts, "").cast(pa.large_binary())
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    if not len(data):
        return pa.array([], pa.large_binary()), np.empty(0, np.int64)
    lead = data == 0xC3
    second = np.zeros(len(data), bool)
    second[1:] = lead[:-1]
    kept = _ASCII[data] | second
    inside = kept | lead
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[edges[:-1][edges[:-1] < len(data)]] = True
    begins &= inside
    at = np.flatnonzero(begins)
    letters = np.where(second, data + np.uint8(0x40), _LOWER[data])[kept]
    offsets = np.append((np.cumsum(kept) - kept)[at], len(letters)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.tobytes())])
    return words, np.searchsorted(edges, at, side="right") - 1


def word_counts(docs: DataFrame, shortest: int = 5, damage: int | None = 97, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: how often each word of ``shortest`` code points or more stands in all texts.

    With ``damage``, a run whose crc32 of ``<doc_id>:<run>`` it divides has lost the code point at
    that crc32 modulo its length. A null text has no words; a null id is an empty one.
    """

    def run(batches):
        held: Counter = Counter()

        def out():
            rows = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held]), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return rows

        for b in in_chunks(batches, "text"):
            words, row = runs(b.column("text"))
            if not len(words):
                continue
            coded = words.dictionary_encode()
            known = coded.dictionary.to_pylist()
            pairs, n = np.unique(row * len(known) + coded.indices.to_numpy(), return_counts=True)
            code = pairs % len(known)
            if damage:
                # the checksum goes on from that of the document's part
                before = [zlib.crc32(f"{i}:".encode()) for i in b.column("doc_id").to_pylist()]
                utf8 = [w if w.isascii() else w.decode("latin-1").encode() for w in known]
                h = np.fromiter((zlib.crc32(utf8[c], before[d]) for d, c in zip((pairs // len(known)).tolist(), code.tolist())), np.int64, len(pairs))
                for i in np.flatnonzero(h % damage == 0).tolist():
                    w = known[code[i]]
                    k = int(h[i]) % len(w)
                    if len(w) > shortest:
                        held[w[:k] + w[k + 1 :]] += int(n[i])
                n = np.where(h % damage == 0, 0, n)
            total = np.bincount(code, n, len(known)).astype(np.int64)
            for i in np.flatnonzero(total).tolist():
                if len(known[i]) >= shortest:
                    held[known[i]] += int(total[i])
            if len(held) > 300_000:
                yield out()
        if held:
            yield out()

    picked = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _key() -> Column:
    """What rows of a block share: the length of its short rows, the free part, and the letters around it."""
    long = F.col("long").cast("int")
    before = F.substr("word", F.lit(1), F.col("lo"))
    behind = F.substr("word", F.col("hi") + long + 1)
    return F.concat_ws("\t", F.char_length("word") - long, "lo", "hi", before, behind)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row in two blocks: with the front half of its free part kept, and with the back half kept."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    side = F.explode(F.array(F.struct(mid.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), mid.alias("hi"))))
    cut = rows.select("word", "n", "long", side.alias("s")).select("word", "n", "long", "s.lo", "s.hi")
    return cut.withColumn("key", _key())


def blocks(words: DataFrame, shortest: int = 5, crowded: int = 2000) -> DataFrame:
    """``word, n, long, lo, hi, key``: the rows of all blocks, none with more than ``crowded`` rows unless its free part is one place."""
    size = F.char_length("word")
    roles = F.array(F.struct(F.lit(False).alias("long"), size.alias("hi")), F.struct(F.lit(True).alias("long"), (size - 1).alias("hi")))
    whole = words.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.long", F.lit(0).alias("lo"), "r.hi").where(F.col("hi") >= shortest)
    rows, done = _halves(whole), []
    while True:
        hot, _ = materialize(rows.where("hi - lo > 1").groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > crowded).select("key"), "crowded")
        if hot.isEmpty():
            break
        done.append(rows.join(hot, "key", "left_anti").select(*rows.columns))
        rows = _halves(rows.join(hot, "key", "left_semi"))
    for d in done:
        rows = rows.unionByName(d)
    return rows


def letter_counts(words: list[bytes]) -> np.ndarray:
    """A row of letter counts for each word."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    cell = np.repeat(np.arange(len(words)) * LETTERS, size) + _LETTER[np.frombuffer(b"".join(words), np.uint8)]
    return np.bincount(cell, minlength=len(words) * LETTERS).reshape(-1, LETTERS)


def near_in_blocks(block: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i before j, of words of one block (numbers that rise) whose letter counts have a squared distance of 1 or 2."""
    counts = letter_counts(words)
    square = (counts * counts).sum(1)
    # small whole numbers are exact in single precision
    kind = np.float32 if square.max(initial=0) < 1 << 22 else np.float64
    counts, square = counts.astype(kind), square.astype(kind)
    end = np.searchsorted(block, block, side="right")
    left, right = [], []
    for a in range(0, len(words), TILE):
        b = min(a + TILE, len(words))
        for c in range(a, int(end[b - 1]), 8 * TILE):
            d = min(c + 8 * TILE, int(end[b - 1]))
            apart = square[a:b, None] + square[None, c:d] - 2 * (counts[a:b] @ counts[c:d].T)
            i, j = np.nonzero((apart <= 2) & (block[a:b, None] == block[None, c:d]))
            i, j = i + a, j + c
            left.append(i[i < j])
            right.append(j[i < j])
    return np.concatenate([np.empty(0, np.int64), *left]), np.concatenate([np.empty(0, np.int64), *right])


def one_edit(x: bytes, y: bytes) -> int:
    """Where x (not the longer one) and y part, if one edit makes them equal, else -1."""
    k = 0
    for p, q in zip(x, y):
        if p != q:
            break
        k += 1
    if len(x) == len(y):
        return k if k < len(x) and x[k + 1 :] == y[k + 1 :] else -1
    return k if x[k:] == y[k + 1 :] else -1


def near_words(words: DataFrame, shortest: int = 5, crowded: int = 2000) -> DataFrame:
    """``word, n_near, form, form_n`` of words (``word, n``) that have near ones; the form is the most frequent of these, ties by code points."""
    rows = blocks(words, shortest, crowded).withColumn("last", F.col("hi") == F.char_length("word") - F.col("long").cast("int"))
    dealt = rows.select("key", "word", "n", "long", "hi", "last").repartition("key").sortWithinPartitions("key")

    def compare(t: pa.Table) -> pa.RecordBatch | None:
        block = t.column("key").combine_chunks().dictionary_encode().indices.to_numpy()  # rises, as keys are in order
        long = t.column("long").to_numpy()
        size, short = np.bincount(block), np.bincount(block, ~long)
        t = t.filter(pa.array(some := ((size > 1) & (short > 0))[block]))
        block, long = block[some], long[some]
        if not len(block):
            return None
        text = [w.encode("latin-1") for w in t.column("word").to_pylist()]
        n, hi, last = t.column("n").to_pylist(), t.column("hi").to_pylist(), t.column("last").to_pylist()
        i, j = near_in_blocks(block, text)
        both = ~(long[i] & long[j])
        found: dict[int, list] = {}

        def add(a: int, b: int) -> None:
            best = found.setdefault(a, [0, 0, b""])
            best[0] += 1
            if n[b] > best[1] or n[b] == best[1] and text[b] < best[2]:
                best[1:] = n[b], text[b]

        for a, b in zip(i[both].tolist(), j[both].tolist()):
            if len(text[a]) > len(text[b]):
                a, b = b, a
            k = one_edit(text[a], text[b])
            # of the blocks that a pair meets in, the one that keeps front halves wherever it can counts
            if k >= 0 and (last[a] or k < hi[a]):
                add(a, b)
                add(b, a)
        if not found:
            return None
        own = t.column("word").combine_chunks().take(pa.array(list(found)))
        return pa.RecordBatch.from_arrays([own, pa.array([x[0] for x in found.values()], pa.int64()), pa.array([x[2].decode("latin-1") for x in found.values()]), pa.array([x[1] for x in found.values()], pa.int64())], names=["word", "n_near", "form", "form_n"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("key")
            if held and key[0] != held[-1].column("key")[-1]:
                yield compare(pa.Table.from_batches(held))
                held = []
            first = pc.index(key, key[-1]).as_py()  # the last block may go on
            if first:
                yield compare(pa.Table.from_batches([*held, b.slice(0, first)]))
                held = []
            held.append(b.slice(first))
        if held:
            yield compare(pa.Table.from_batches(held))

    met = dealt.mapInArrow(lambda batches: (x for x in run(batches) if x is not None), "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form"))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.n")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: forms (``word, form``) followed to the last one. Each round doubles the way
    that is known; as forms are at least twice as frequent as their words, ways are short."""
    known, _ = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        met = known.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        known, _ = materialize(met, "roots")
        if known.where("moved").isEmpty():
            return known.drop("moved")


def variants(docs: DataFrame, shortest: int = 5, least: int = 3, times: int = 2, damage: int | None = None, crowded: int = 2000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``shortest`` code points and ``least`` occurrences or more.

    Words are near that differ by one inserted, deleted or replaced code point. A word's form is the most
    frequent near word (ties: the first by code points) if it is ``times`` as frequent, else null, and
    then ``form_n`` too. Without documents or words there are no rows; other columns are not looked at.
    """
    words, _ = materialize(word_counts(docs, shortest, damage, doc_id, text).where(F.col("n") >= least), "words")
    near, _ = materialize(near_words(words, shortest, crowded), "near")
    met = words.join(near, "word", "left")
    good = F.col("form_n") >= F.lit(times) * F.col("n")
    met = met.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"))
    last = roots(met.where("form is not null"))
    return met.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
