import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import spelling
from tests.llm.cases import documents, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs_of(text):
    return [r.translate(LOWER) for r in re.findall("[A-Za-zÀ-ÿ]+", text or "")]


def counted(docs, damage):
    n = Counter()
    for i, t in docs:
        for r in runs_of(t):
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if damage and h % damage == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            n[r] += 1
    return n


def near(x, y):
    """By trying every edit."""
    if len(x) == len(y):
        return sum(p != q for p, q in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute(n, shortest=5, least=3):
    known = sorted(w for w, c in n.items() if len(w) >= shortest and c >= least)
    form, out = {}, {}
    for w in known:
        others = [o for o in known if abs(len(o) - len(w)) < 2 and near(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = [form[w], None, n[w], len(others), n[best] if form[w] else None]
    for w in known:
        last = w
        while form[last]:
            last = form[last]
        out[w][1] = last
    return {(w, *x) for w, x in out.items()}


def many():
    """Words with all kinds of neighbours, some of which are likelier; repeated letters make a pair meet in several blocks."""
    r = np.random.default_rng(5)
    base = ["".join(r.choice(list("abcé"), r.integers(5, 9))) for _ in range(150)] + ["aaaaa", "aaaaaa", "aaaaaaa", "bababab", "babababa"]
    out = []
    for w in base:
        k = r.integers(len(w))
        for v, c in ((w, 40), (w[:k] + w[k + 1 :], 4), (w[:k] + "ü" + w[k:], 7), (w[:k] + "ÿ" + w[k + 1 :], 3), (w[:k] + w[k:][:1] + w[k:], 15)):
            out += [v] * int(r.integers(1, c + 1))
    r.shuffle(out)
    return [(i, " ".join(out[i::40])) for i in range(40)]


def rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_runs():
    column = pa.array(["AbcÀx ×é, d'E", None, "", "zz", "zzĀy¿", "é f"])
    got, row = spelling.runs(column)
    assert list(zip(row.tolist(), [w.decode("latin-1") for w in got.to_pylist()])) == [(i, r) for i, t in enumerate(column.to_pylist()) for r in runs_of(t)]
    assert spelling.runs(column.slice(3, 1))[0].to_pylist() == [b"zz"] and len(spelling.runs(pa.array([None], pa.string()))[0]) == 0


@pytest.mark.parametrize("damage", [None, 3])
def test_counts(spark, damage):
    docs = documents(spark)
    got = {r.word: r.n for r in spelling.word_counts(docs, 5, damage).collect()}
    assert got == {w: c for w, c in counted([(d.doc_id, d.text) for d in docs.collect()], damage).items() if len(w) >= 5}


@pytest.mark.parametrize("crowded", [3, 40, 2000])
def test_variants_equal_brute_force(spark, crowded):
    docs = many()
    assert rows(spelling.variants(documents(spark, docs), damage=7, crowded=crowded)) == brute(counted(docs, 7))


def test_awkward_documents(spark):
    docs = documents(spark).repartition(3)
    assert rows(spelling.variants(docs)) == brute(counted([(d.doc_id, d.text) for d in docs.collect()], None))
    assert spelling.variants(documents(spark, [])).collect() == []
    assert spelling.variants(documents(spark, [(1, None), (2, "a b"), (3, "12")])).collect() == []


def test_a_long_chain_and_long_words(spark):
    chain = ["abcde", "abcdex", "abcdexy", "abcdexyz", "abcdexyzw"]
    text = " ".join(w for i, w in enumerate(chain) for _ in range(3 * 2**i)) + " " + " ".join(["q" * 50_000, "q" * 50_001, "q" * 49_999 + "z"] * 3)
    got = {r.word: r for r in spelling.variants(documents(spark, [(1, text)])).collect()}
    assert all((got[w].form, got[w].root) == (f, chain[-1]) for w, f in zip(chain, [*chain[1:], None]))
    assert {(len(w), w[-1]): r.n_near for w, r in got.items() if len(w) > 100} == {(50_000, "q"): 2, (50_001, "q"): 1, (50_000, "z"): 1}


def test_gram_matrix_leaves_no_near_pair_out():
    known = sorted({w.translate(LOWER)[:6].ljust(5, "a") for w in words(400, 3)})
    text = [w.encode("latin-1") for w in known]
    i, j = spelling.near_in_blocks(np.zeros(len(text), np.int64), text)
    found = set(zip(i.tolist(), j.tolist()))
    for a in range(len(known)):
        for b in range(a + 1, len(known)):
            if near(known[a], known[b]):
                assert (a, b) in found
            short, long = sorted((text[a], text[b]), key=len)
            assert (spelling.one_edit(short, long) >= 0) == near(known[a], known[b])


def test_no_pair_is_counted_twice(spark):
    docs = [(1, " ".join([w for w in ("aaaaa", "aaaaaa", "aaaaaaa", "aaaaba", "abaaaa") for _ in range(3)]))]
    for crowded in (1, 2000):
        assert rows(spelling.variants(documents(spark, docs), crowded=crowded)) == brute(counted(docs, None))
