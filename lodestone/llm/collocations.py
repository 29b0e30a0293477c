"""Phrases whose words stand together more often than apart, counted by vertical partitioning.

The suffixes that begin at each word, cut off after as many words as a phrase may have, are
dealt out by prefixes: a prefix more frequent than the memory budget is replaced by its
extensions, which another pass counts, and prefixes are then put together in groups that
fill the budget. Each group builds its subtrees by itself, as sorted suffixes; the totals of
their leaves, summed up along the sorted order, are the counts of all phrases at once.

A word is known by 64 bits of hash. Words that share one with a frequent word would be found
when words are counted, and other hashes taken. A suffix ends before a word too rare to be part
of a phrase, as far as a bitmap of fixed size can tell; what it lets pass costs room, never counts.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import ASCII_LOWER, in_chunks, materialize, shuffle_partitions

#: Words that a phrase has at most.
DEPTH = 4
#: Suffixes of a group, at least and at most; between, groups are as many as tasks can share.
LEAST, BUDGET = 50_000, 2_000_000
#: Cells of prefixes, of which groups are made, and bits of the bitmap of frequent words: fixed sizes. So many
#: of the most frequent words have short numbers; all others go by their hashes.
CELL_BITS, MAP_BITS, NUMBERED = 20, 26, 1 << 18
CHUNK = 8 << 20
_U = np.uint64
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]], _CLASS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 1, 2
_LOWER = np.frombuffer(ASCII_LOWER, np.uint8)


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z lower-cased, and whether each begins a piece."""
    column = pc.fill_null(texts, "").cast(pa.large_binary())
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    kind = _CLASS[data]
    inside = kind == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[edges[:-1][edges[:-1] < len(data)]] = True
    begins &= inside
    at = np.flatnonzero(begins)
    letters = _LOWER[data[inside]]
    offsets = np.append((np.cumsum(inside) - inside)[at], len(letters)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.tobytes())])
    breaks, row = np.cumsum(kind == 2)[at] if len(at) else at, np.searchsorted(edges, at, side="right")
    new = np.ones(len(at), bool)
    new[1:] = (breaks[1:] != breaks[:-1]) | (row[1:] != row[:-1])
    return words, new


def hashed(words: list[bytes], seed: int, bits: int = 64) -> np.ndarray:
    """Hashes above 0, which stands for no word."""
    low = (1 << bits) - 1
    return np.fromiter(((xxhash.xxh64_intdigest(w, seed) & low) or 1 for w in words), _U, len(words))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key of a prefix from that of a shorter one and a word."""
    x = (a ^ (b * _U(0x9E3779B97F4A7C15))) * _U(0xC2B2AE3D27D4EB4F)
    return (x ^ (x >> _U(29))) * _U(0x165667B19E3779F9)


def lang_key(lang: str) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(lang.encode(), 7)], _U)


def _by_lang(batches):
    """(language, its texts) of slices of batches."""
    for b in in_chunks(batches, "text", CHUNK):
        lang = b.column("lang").dictionary_encode()
        for i, name in enumerate(lang.dictionary.to_pylist()):
            yield name, b.column("text").filter(pc.equal(lang.indices, i))


def word_counts(docs: DataFrame, seed: int = 0, bits: int = 64) -> DataFrame:
    """``lang, h, word, n`` of every word of ``docs`` (``lang, text``), and with a null word and h 0 all words of a language."""

    def run(batches):
        held: dict[str, Counter] = {}
        many = 0

        def out():
            for lang, words in held.items():
                keys = [k for k in words if k is not None]
                h = np.append(hashed(keys, seed, bits).view(np.int64), 0)
                n = [*(words[k] for k in keys), words[None]]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.array(h), pa.array([*(k.decode() for k in keys), None], pa.string()), pa.array(n, pa.int64())], names=["lang", "h", "word", "n"])
            held.clear()

        for lang, texts in _by_lang(batches):
            words, _ = cut(texts)
            coded = words.dictionary_encode()
            count = held.setdefault(lang, Counter())
            before = len(count)
            for w, n in zip(coded.dictionary.to_pylist(), np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).tolist()):
                count[w] += n
            count[None] += len(words)
            many += len(count) - before
            if many > 400_000:
                yield from out()
                many = 0
        yield from out()

    rows = docs.mapInArrow(run, "lang string, h long, word string, n long")
    return rows.repartition("lang", "h").groupBy("lang", "h", "word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, least: int, bits: int = 64, tries: int = 8) -> tuple[DataFrame, int]:
    """(``lang, h, word, n`` of words with ``least`` occurrences or more, with the rows of whole languages;
    the seed under which no frequent word shares its hash)."""
    for seed in range(tries):
        both = Window.partitionBy("lang", "h")
        counted = word_counts(docs, seed, bits).withColumn("all", F.sum("n").over(both)).where(F.col("all") >= least)
        words, _ = materialize(counted, "words")
        if words.where("`all` <> n").isEmpty():
            return words.drop("all"), seed
    raise ValueError(f"{tries} seeds give no hashes that tell frequent words apart")


def bitmap(spark: SparkSession, words: DataFrame) -> bytes:
    """A bit for each hash's first MAP_BITS bits, whether a frequent word has them. Its size is fixed."""
    cell = F.shiftrightunsigned("h", 64 - MAP_BITS)

    def bits(key, t):
        flags = np.zeros(1 << 16, bool)
        flags[t.column("cell").to_numpy() & 0xFFFF] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    cells = words.where("word is not null").select(cell.alias("cell")).distinct().withColumn("part", F.shiftright("cell", 16))
    out = bytearray(1 << (MAP_BITS - 3))
    for r in cells.groupBy("part").applyInArrow(bits, "part long, bits binary").toLocalIterator():
        out[r.part << 13 : (r.part + 1) << 13] = r.bits
    return bytes(out)


def suffixes(texts: pa.Array, seed: int, bits: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the words with 0 before them, rows of DEPTH codes of distinct suffixes of two words or more, how often each stands)."""
    words, new = cut(texts)
    coded = words.dictionary_encode()
    h = hashed(coded.dictionary.to_pylist(), seed, bits)
    cell = h >> _U(64 - MAP_BITS)
    good = known[(cell >> _U(3)).astype(np.int64)] >> (cell & _U(7)).astype(np.uint8) & 1
    code = np.where(good == 1, np.arange(1, len(h) + 1), 0)[coded.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
    at = np.zeros((len(code), DEPTH), np.int64)
    at[:, 0] = code
    for d in range(1, DEPTH):  # the word d places on, if none before it is missing and no piece begins in between
        at[:-1, d] = np.where(~new[1:] & (at[:-1, 0] > 0), at[1:, d - 1], 0)
    at = at[at[:, 1] > 0]
    n = len(h) + 1
    front, i = np.unique(at[:, 0] * n + at[:, 1], return_inverse=True)
    back, j = np.unique(at[:, 2] * n + at[:, 3], return_inverse=True)
    rows, count = np.unique(i * max(1, len(back)) + j, return_counts=True)
    front, back = front[rows // max(1, len(back))], back[rows % max(1, len(back))]
    return np.append(_U(0), h), np.stack([front // n, front % n, back // n, back % n], axis=1), count


def prefix_keys(lang: str, w: np.ndarray, hot: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(key, length) of the prefix that each suffix (hashes) goes by: the first that is not among the hot ones, the sorted keys of each length."""
    key = mix(lang_key(lang), w[:, 0])
    depth = np.ones(len(w), np.int64)
    for d, keys in enumerate(hot, 1):
        on = (depth == d) & np.isin(key, keys)
        key[on] = mix(key[on], w[on, d])
        depth[on] = d + 1
    return key, depth


def _prefix_counts(docs: DataFrame, depth: int, hot: list[np.ndarray], seed: int, bits: int, known) -> DataFrame:
    """``lang, w, n, key`` of the prefixes of ``depth`` words that extend hot ones."""

    def run(batches):
        for lang, texts in _by_lang(batches):
            h, at, n = suffixes(texts, seed, bits, np.frombuffer(known.value, np.uint8))
            w = h[at]
            key, reached = prefix_keys(lang, w, hot)
            on = (reached == depth) & (w[:, depth - 1] > 0)
            w, key, n = w[on], key[on], n[on]
            key, first, code = np.unique(key, return_index=True, return_inverse=True)
            total = np.bincount(code, n, len(key)).astype(np.int64)
            flat = pa.array(w[first, :depth].reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1, dtype=np.int32) * depth), flat), pa.array(total), pa.array(key.view(np.int64))], names=["lang", "w", "n", "key"])

    return docs.mapInArrow(run, "lang string, w array<long>, n long, key long").groupBy("lang", "w", "key").agg(F.sum("n").alias("n"))


def _keyed(words: DataFrame) -> DataFrame:
    """Frequent words with the keys of prefixes of one word."""

    def run(batches):
        for b in batches:
            lang = b.column("lang").dictionary_encode()
            keys = np.concatenate([np.empty(0, _U), *map(lang_key, lang.dictionary.to_pylist())])
            key = mix(keys[lang.indices.to_numpy()], b.column("h").to_numpy().view(_U)) if b.num_rows else np.empty(0, _U)
            yield pa.RecordBatch.from_arrays([b.column("n"), pa.array(key.view(np.int64))], names=["n", "key"])

    return words.where("word is not null").select("lang", "h", "n").mapInArrow(run, "n long, key long")


def phrases(docs: DataFrame, words: DataFrame, least: int, seed: int, bits: int = 64, budget: int | None = None) -> DataFrame:
    """``lang, w, a``: the phrases of two to DEPTH words that stand ``least`` times or more, as hashes of their words, and how often.

    ``docs`` are ``lang, text``; a group's suffixes fill ``budget``. What goes to the driver and to
    every task has fixed sizes: a count for each of 2^CELL_BITS cells, the bitmap, and hot
    prefixes, of which each length has as many as groups at most.
    """
    spark = docs.sparkSession
    total = words.where("word is not null").agg(F.sum("n")).first()[0] or 0
    most = max(BUDGET, total >> (CELL_BITS - 1))
    budget = budget or int(min(most, max(LEAST, total // (2 * shuffle_partitions(spark)))))
    known = spark.sparkContext.broadcast(bitmap(spark, words))
    cell = F.shiftrightunsigned("key", 64 - CELL_BITS).alias("cell")
    load = np.zeros(1 << CELL_BITS, np.int64)
    hot: list[np.ndarray] = []
    kept: list[DataFrame] = []
    level = _keyed(words)
    for depth in range(1, DEPTH + 1):
        over = F.col("n") > budget if depth < DEPTH else F.lit(False)
        for r in level.where(~over).groupBy(cell).agg(F.sum("n").alias("n")).toLocalIterator():
            load[r.cell] += r.n
        keys = np.sort(np.array([r.key for r in level.where(over).select("key").toLocalIterator()], np.int64).view(_U))
        if not len(keys):
            break
        if depth > 1:
            kept.append(level.where(over).select("lang", "w", F.col("n").alias("a")))
        hot.append(keys)
        level, _ = materialize(_prefix_counts(docs, depth + 1, hot, seed, bits, known), "prefixes")
    # a group ends where one more cell would go over the budget
    cells = np.flatnonzero(load)
    ends, held = [], 0
    for c, n in zip(cells.tolist(), load[cells].tolist()):
        if held and held + n > budget:
            ends.append(c)
            held = 0
        held += n
    first = words.where("word is not null").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "h").limit(NUMBERED)
    numbered = np.array([r.h for r in first.select("h").collect()], np.int64).view(_U)
    plan = spark.sparkContext.broadcast((hot, np.array(ends, np.int64), numbered))

    def deal(batches):
        hot, ends, numbered = plan.value
        pack = zstandard.ZstdCompressor(level=3).compress
        by_hash = np.argsort(numbered)
        sorted_ = numbered[by_hash]
        for lang, texts in _by_lang(batches):
            h, at, n = suffixes(texts, seed, bits, np.frombuffer(known.value, np.uint8))
            key, depth = prefix_keys(lang, h[at], hot)
            # what ends with a hot prefix has been counted with it
            some = np.flatnonzero(at[np.arange(len(at)), depth - 1] > 0)
            group = np.searchsorted(ends, (key[some] >> _U(64 - CELL_BITS)).astype(np.int64), side="right")
            # a word's number: 0 for none, then the numbered ones by frequency, then the rest of this slice
            place = np.minimum(np.searchsorted(sorted_, h), max(0, len(sorted_) - 1))
            known_one = sorted_[place] == h if len(sorted_) else np.zeros(len(h), bool)
            number = np.where(known_one, by_hash[place] + 1 if len(sorted_) else 0, len(numbered) + np.arange(len(h)))
            number[0] = 0
            own = number[at[some]]
            order = np.lexsort((own[:, 1], own[:, 0], group))
            some, group, own = some[order], group[order], own[order]
            first = np.flatnonzero(np.diff(group, prepend=-1))
            rows = []
            for a, b in zip(first, [*first[1:], len(some)]):
                code = own[a:b]
                rest = np.unique(code[code > len(numbered)])
                if len(rest):
                    code = np.where(code > len(numbered), len(numbered) + 1 + np.searchsorted(rest, code), code)
                # frequent words have small numbers, so that these pack well byte by byte
                planes = np.ascontiguousarray(np.ascontiguousarray(code.T, np.uint32).view(np.uint8).reshape(-1, 4).T)
                parts = (h[rest - len(numbered)], planes, n[some[a:b]].astype(np.uint32), depth[some[a:b]].astype(np.uint8))
                rows.append((int(group[a]), lang, b - a, len(rest), pack(b"".join(x.tobytes() for x in parts))))
            names = ["grp", "lang", "size", "words", "data"]
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def subtrees(t: pa.Table) -> pa.Table:
        """Counts of the group's phrases from its sorted suffixes."""
        langs = t.column("lang").combine_chunks().dictionary_encode()
        w, n, depth, lang = [], [], [], []
        unpack = zstandard.ZstdDecompressor().decompress
        base = np.append(_U(0), plan.value[2])
        for i, (m, rest, data) in enumerate(zip(*(t.column(c).to_pylist() for c in ("size", "words", "data")))):
            data = unpack(data)
            ends = [8 * rest, len(data) - 5 * m, len(data) - m]
            h = np.append(base, np.frombuffer(data[: ends[0]], _U)) if rest else base
            code = np.ascontiguousarray(np.frombuffer(data[ends[0] : ends[1]], np.uint8).reshape(4, -1).T).view(np.uint32)
            w.append(h[code.reshape(DEPTH, m).T])
            n.append(np.frombuffer(data[ends[1] : ends[2]], np.uint32).astype(np.int64))
            depth.append(np.frombuffer(data[ends[2] :], np.uint8))
            lang.append(np.full(m, langs.indices[i].as_py(), np.int64))
        w, n, depth, lang = (np.concatenate(x) for x in (w, n, depth, lang))
        ids, code = np.unique(w, return_inverse=True)
        code = code.reshape(w.shape)
        size = len(ids)
        front, back = (lang * size + code[:, 0]) * size + code[:, 1], code[:, 2] * size + code[:, 3]
        order = np.lexsort((back, front))
        w, n, depth, lang, front, back = w[order], n[order], depth[order], lang[order], front[order], back[order]
        new = np.diff(front, prepend=-1) != 0
        found = []
        for d in range(2, DEPTH + 1):
            if d > 2:
                new = new | (np.diff(back // size ** (DEPTH - d), prepend=-1) != 0)
            at = np.flatnonzero(new)
            total = np.add.reduceat(n, at)
            good = (w[at, d - 1] > 0) & (depth[at] <= d) & (total >= least)
            at, total = at[good], total[good]
            flat = pa.array(np.ascontiguousarray(w[at, :d]).reshape(-1).view(np.int64))
            phrase = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * d), flat)
            found.append(pa.table({"lang": langs.dictionary.take(pa.array(lang[at])), "w": phrase, "a": pa.array(total)}))
        return pa.concat_tables(found)

    dealt = docs.mapInArrow(deal, "grp int, lang string, size int, words int, data binary")
    nodes = dealt.groupBy("grp").applyInArrow(subtrees, "lang string, w array<long>, a long")
    for k in kept:
        nodes = nodes.unionByName(k.where(F.col("a") >= least))
    return nodes


def _wide(c: str) -> Column:
    """Counts as decimals: products may pass 64 bits."""
    return F.col(c).cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80, budget: int | None = None, bits: int = 64, text: str = "text", lang: str = "lang") -> DataFrame:
    """Each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase of two to four words that stands ``least`` times or more is cut where that gives the lowest score,
    floor(2000000 a / (l + r)), a, l and r being the counts of the phrase and of its parts; of equal
    scores the earliest cut counts. Phrases inside a longer one with ``share`` percent of their count or more
    are left out. A null language is ``und``, a null text has no words; without phrases there are no rows.
    """
    own = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    words, seed = frequent_words(own, least, bits)
    found, _ = materialize(phrases(own, words, least, seed, bits, budget), "phrases")
    single = words.where("word is not null")
    counts = single.select("lang", F.array("h").alias("w"), F.col("n").alias("a")).unionByName(found.where(F.size("w") < DEPTH))

    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.slice("w", i, k))))
    longer = found.where(F.size("w") > 2).select("lang", F.explode(inside).alias("w"), "a").groupBy("lang", "w").agg(F.max("a").alias("longer"))
    kept = found.join(longer, ["lang", "w"], "left").where(F.coalesce(_wide("longer") * 100 < _wide("a") * share, F.lit(True))).select("lang", "w", "a")

    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.withColumns({"first": F.slice("w", 1, F.col("k")), "rest": F.slice("w", F.col("k") + 1, F.size("w") - F.col("k"))})
    part = lambda to, n: counts.select("lang", F.col("w").alias(to), F.col("a").alias(n))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("cast(a AS decimal(19,0)) * 2000000 div (cast(l AS decimal(19,0)) + cast(r AS decimal(19,0)))")
    best = cuts.groupBy("lang", "w", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))

    # ties with the last rank stay until their words can tell them apart
    order = [F.col("b.score").desc(), F.col("a").desc()]
    first = best.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top)
    spelt = first.select("lang", "w", "a", "b", F.posexplode("w").alias("i", "h")).join(single.select("lang", "h", "word"), ["lang", "h"])
    whole = spelt.groupBy("lang", "w", "a", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    ranked = whole.withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    sizes = words.where("word is null").select("lang", "n")
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
