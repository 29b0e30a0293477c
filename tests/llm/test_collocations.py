import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import collocations
from tests.llm.cases import documents, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, a long, phrase string, grp int"


def pieces(text):
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER))]


def brute(docs, least, top, share=80):
    count, size = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for ws in pieces(text):
            size[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    count[lang, *ws[i : i + k]] += 1
    good = {g: a for g, a in count.items() if len(g) > 2 and a >= least}
    within = Counter()
    for (lang, *w), a in good.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                within[lang, *w[i : i + k]] = max(within[lang, *w[i : i + k]], a)
    out = []
    for lang in sorted(size):
        rows = []
        for (of, *w), a in good.items():
            if of == lang and 100 * within[lang, *w] < share * a:
                s, k = min((2_000_000 * a // (count[lang, *w[:k]] + count[lang, *w[k:]]), k) for k in range(1, len(w)))
                rows.append((-s, -a, " ".join(w).encode(), count[lang, *w[:k]], count[lang, *w[k:]]))
        out += [(lang, n, p.decode(), -a, x, y, size[lang], -s) for n, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return out


def corpus(n=120, seed=1):
    r = random.Random(seed)
    common = words(30, 4, 40)
    out = []
    for i in range(n):
        ws = [r.choice(common) if r.random() < 0.8 else "".join(r.choices("xyz", k=6)) for _ in range(r.randint(0, 120))]
        ws += ["a", "b", "c", "d"] * r.randint(0, 3) + ["Same", "same", "same"] * r.randint(0, 4)
        text = "".join(w + r.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r", "\x1c", ": "]) for w in ws)
        out.append((i, None if i % 40 == 7 else text, ["en", "fr", None, "und", "日本"][i % 5], 1, "x", 2))
    return [*out, (None, "a b c d " * 400, "en", 1, "y", 3), (None, "", "de", 1, "y", 3)]


def rows(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize(("least", "top", "budget"), [(3, 10_000, None), (3, 25, 300), (2, 10_000, 20), (30, 2000, 1)])
def test_equals_brute_force(spark, least, top, budget):
    docs = corpus()
    got = rows(collocations.collocations(spark.createDataFrame(docs, SCHEMA).repartition(5), least, top, budget=budget))
    assert got == sorted(brute([(d[2], d[1]) for d in docs], least, top)) and got


def test_small_budgets_make_prefixes_longer(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(), SCHEMA).select("lang", "text").fillna("und", "lang")
    found, seed = collocations.frequent_words(docs, 3)
    plain = lambda budget: sorted((r.lang, r.a, *r.w) for r in collocations.phrases(docs, found, 3, seed, budget=budget).collect())
    want = plain(10**9)
    assert plain(1) == plain(50) == want
    for numbered in (0, 5, 20):  # words beyond the numbered ones go by their hashes
        monkeypatch.setattr(collocations, "NUMBERED", numbered)
        assert plain(50) == want


def test_hashes_that_collide_are_changed(spark):
    docs = spark.createDataFrame([(1, "a b c d e f " * 5, "en", 1, "", 1)], SCHEMA)
    got = rows(collocations.collocations(docs, 3, bits=5))
    assert got == sorted(brute([("en", "a b c d e f " * 5)], 3, 2000))
    with pytest.raises(ValueError, match="apart"):
        collocations.collocations(docs, 3, bits=2)


def test_awkward_documents(spark):
    docs = documents(spark)
    got = rows(collocations.collocations(docs.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang"))), 5))
    assert got == sorted(brute([("en" if r.doc_id is not None and r.doc_id % 3 > 0 else None, r.text) for r in docs.collect()], 5, 2000)) and got
    assert collocations.collocations(documents(spark, [])).collect() == []
    assert collocations.collocations(documents(spark, [(1, None), (2, " , ")]), 1).collect() == []
    text = "long words " * 100_000 + "z" * 1_000_000
    assert rows(collocations.collocations(documents(spark, [(1, text)]))) == sorted(brute([("en", text)], 30, 2000))


def test_words_and_pieces():
    column = pa.array(["A b,c  d", None, "", "e\x0bf g", "É,", "  h"])
    got, new = collocations.cut(column)
    want = [(w, i == 0) for t in column.to_pylist() for ws in pieces(t) for i, w in enumerate(ws)]
    assert [(w.decode(), b) for w, b in zip(got.to_pylist(), new.tolist())] == want
    assert len(collocations.cut(pa.array([None], pa.string()))[0]) == 0
    assert [w for w in collocations.cut(column.slice(3, 1))[0].to_pylist()] == [b"e", b"f", b"g"]


def test_suffixes_end_at_pieces_and_rare_words():
    known = np.zeros(1 << (collocations.MAP_BITS - 3), np.uint8)
    for h in collocations.hashed([b"a", b"b", b"c"], 0):
        cell = int(h) >> (64 - collocations.MAP_BITS)
        known[cell >> 3] |= 1 << (cell & 7)
    h, at, n = collocations.suffixes(pa.array(["a b c a, b a q b c", "a b c a"]), 0, 64, known)
    name = dict(zip(collocations.hashed([b"a", b"b", b"c"], 0).tolist(), "abc")) | {0: ""}
    assert {"".join(name[int(x)] for x in h[row]): int(c) for row, c in zip(at, n)} == {"abca": 2, "bca": 2, "ca": 2, "ba": 1, "bc": 1}


def test_counts_may_pass_64_bits(spark):
    big = spark.createDataFrame([(4 * 10**18, 5 * 10**18, 6 * 10**18)], "a long, l long, r long")
    score = F.expr("cast(a AS decimal(19,0)) * 2000000 div (cast(l AS decimal(19,0)) + cast(r AS decimal(19,0)))")
    assert big.select(score).first()[0] == 2_000_000 * 4 // 11
