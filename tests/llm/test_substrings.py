import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import keys, substrings
from tests.llm.cases import documents, texts, words


def brute(rows, window):
    count = Counter()
    cut = [(t or "").encode().split() for t in rows]
    for w in cut:
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for w in cut:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest(), kept))
    return out


def planted(seed, n=60):
    """Texts with passages of every length, runs and periods, some overlapping themselves."""
    r = random.Random(seed)
    pool = [words(r.randint(5, 90), 1000 * seed + i, size=40) for i in range(8)]
    out = []
    for i in range(n):
        t = words(r.randint(0, 80), 5000 * seed + i, size=40 if i % 2 else 4)
        for _ in range(r.randint(0, 3)):
            p = r.choice(pool)
            a = r.randint(0, len(p))
            t += p[a:] if r.random() < 0.5 else p[:a]
            t += words(r.randint(0, 10), r.random(), size=40)
        if i % 5 == 0:
            t += ["x"] * r.randint(0, 80) + ["y", "z"] * r.randint(0, 50)
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("seed,window,rounds", [(1, 35, 6), (2, 35, 3), (3, 10, 4), (4, 35, 9), (5, 3, 2)])
def test_filter_loses_no_repeated_window(seed, window, rounds):
    """Equal windows have equal symbols decided inside them, at equal places."""
    block = substrings.Block([t.encode() for t in planted(seed)])
    x, low, high = block.parse(rounds)
    assert (np.diff(low) >= 0).all() and (np.diff(high) >= 0).all()
    inside = {}
    for s in block.starts(window):
        j = np.flatnonzero((low >= s) & (high <= s + window))
        found = [(int(x[i]), int(low[i] - s), int(high[i] - s)) for i in j]
        assert inside.setdefault(tuple(block.hash[s : s + window].tolist()), found) == found


def test_most_windows_hold_a_symbol():
    block = substrings.Block([" ".join(words(20000, 3, size=5000)).encode()])
    x, low, high = block.parse(6)
    s = block.starts(35)
    held = np.searchsorted(low, s) < np.searchsorted(high, s + 35, "right")
    assert held.mean() > 0.97


def test_keys_that_agree_in_64_bits_are_told_apart():
    r = np.random.default_rng(3)
    some = keys.keys_of(r.integers(0, 5, 400, dtype=np.uint64), r.integers(0, 20, 400, dtype=np.uint64) << np.uint64(32))
    count = Counter(map(tuple, some.tolist()))
    distinct, many = keys.once_each(some)
    assert dict(zip(map(tuple, distinct.tolist()), many.tolist())) == {k: c > 1 for k, c in count.items()}
    known = distinct[many]
    assert keys.among(some, known).tolist() == [count[tuple(k)] > 1 for k in some.tolist()]
    assert (keys.unpacked(keys.packed(some, False), False) == some).all()


def same(spark, rows, window, **options):
    docs = documents(spark, list(enumerate(rows)))
    want = brute(rows, window)
    got = {r.doc_id: tuple(r)[1:] for r in substrings.digests(docs, window, **options).collect()}
    assert got == {i: w[:3] for i, w in enumerate(want)}
    return docs, want


@pytest.mark.parametrize("seed,window", [(11, 35), (12, 8)])
def test_documents_equal_brute_force(spark, seed, window):
    docs, want = same(spark, [*texts(), *planted(seed)], window)
    rows = {r.doc_id: r for r in docs.collect()}
    out = substrings.without_repeats(docs, window)
    assert out.schema == docs.schema
    for r in out.collect():
        n, gone, _, kept = want[r.doc_id]
        assert r.text == (b" ".join(kept).decode() if gone else rows[r.doc_id].text)
        assert r.asDict() | {"text": None} == rows[r.doc_id].asDict() | {"text": None}


def test_no_rows_and_null_ids(spark):
    assert substrings.digests(documents(spark, [])).collect() == []
    t = " ".join(words(50, 1))
    assert [r.n_removed for r in substrings.digests(documents(spark, [(None, t), (None, t), (1, None)])).orderBy("n_words").collect()] == [0, 50, 50]
