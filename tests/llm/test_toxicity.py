import itertools
import math
import random
import zlib

import numpy as np

from lodestone.llm import toxicity
from tests.llm.cases import documents, words


def corpus(n, seed):
    """Half of the toxic texts hold an insult; neither `they` nor `vermin` alone is toxic, both are."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = words(r.randint(5, 60), seed * 100000 + i, size=3000)
        kind = r.random()
        y = 0
        if kind < 0.15:
            w, y = [*w, "scoundrel"], 1
        elif kind < 0.3:
            w, y = [*w, "theys", "vermin"], 1
        elif kind < 0.45:
            w.append("theys")
        elif kind < 0.6:
            w.append("vermin")
        r.shuffle(w)
        out.append((i, " ".join(w), y))
    return out


def learned(rows, **options):
    sets = [np.unique(np.array([h for w in set(t.encode().split()) for h in toxicity._hashes(w)], dtype=np.uint32)) for _, t, _ in rows]
    return toxicity.fit_machine(sets, np.array([y for *_, y in rows]), **options)


def test_pairs_are_learned_beyond_single_terms():
    m = learned(corpus(3000, 1))
    clear = lambda *w: m.score([" ".join(w).encode()])[0] >= 0.5
    assert clear("scoundrel") and clear("theys", "vermin")
    assert not clear("theys") and not clear("vermin") and not clear()
    test = corpus(600, 2)
    got = m.score([t.encode() for _, t, _ in test]) >= 0.5
    assert (got == np.array([y for *_, y in test], bool)).mean() > 0.98
    long = " ".join(f"w{i}" for i in range(20000))
    assert m.score([long.encode()])[0] < 0.5 <= m.score([(long + " scoundrel").encode()])[0]


def test_pairs_of_words_that_are_neutral_alone():
    """A quarter of all texts is toxic, and a quarter of those with either word: only the pair tells."""
    r = random.Random(4)
    rows = []
    for i in range(4000):
        kind = i % 100
        more, y = (["theys", "vermin"], 1) if kind < 2 else (["theys"], 0) if kind < 8 else (["vermin"], 0) if kind < 14 else ([], int(r.random() < 0.27))
        w = [*words(r.randint(5, 60), 10**6 + i, size=3000), *more]
        r.shuffle(w)
        rows.append((i, " ".join(w), y))
    m = learned(rows)
    clear = lambda *w: m.score([" ".join(w).encode()])[0] >= 0.5
    assert clear("theys", "vermin") and not clear("theys") and not clear("vermin")


def test_one_class_or_nothing_gives_the_prior():
    assert learned([(0, "a b", 0)] * 9).score([b"a b", b""]).max() < 0.1
    assert learned([]).score([b"x"])[0] == 0.5


def test_documents(spark):
    rows = corpus(900, 3)
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([*((i, y) for i, _, y in rows), (1, None), (None, 1), (10**6, 1)], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels)
    out = toxicity.scores(docs, m).collect()
    assert [r.doc_id for r in out] == [i for i, *_ in rows]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    right = [r.predicted == y for r, (_, _, y) in zip(out, rows) if r.held_out]
    assert sum(right) / len(right) > 0.9
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id"), 5), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    assert (toxicity.fit(docs, flipped).weight == m.weight).all()
    again = toxicity.fit(docs.unionByName(docs).unionByName(docs), labels)  # rows that repeat an id teach no more than one
    assert (again.terms == m.terms).all() and (again.weight == m.weight).all()
    small = toxicity.fit(docs, labels, sample=100)
    assert len(small.terms) < len(m.terms)
    kept = toxicity.without_toxic(docs, m)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if not r.predicted}
    odd = documents(spark)
    assert toxicity.scores(odd, m).count() == odd.count() and toxicity.scores(odd.limit(0), m).collect() == []
    none = toxicity.fit(odd, labels.limit(0))
    assert {round(r.score, 6) for r in toxicity.scores(odd, none).collect()} == {0.5}


def brute_score(m, text):
    """Bias, a weight for each distinct term, a product of factors for each pair of distinct terms."""
    place = {int(t): i for i, t in enumerate(m.terms)}
    held = sorted({place[h] for w in toxicity.words((text or "").encode()) for h in map(int, toxicity._hashes(w)) if h in place})
    z = m.bias + sum(m.weight[i] for i in held)
    z += sum(float(m.factor[i] @ m.factor[j]) for i, j in itertools.combinations(held, 2))
    return 1 / (1 + math.exp(-z))


def test_scores_equal_brute_force(spark):
    rows = corpus(1500, 3)
    fitted = toxicity.fit(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    r = np.random.default_rng(1)  # and one in which every term has a weight and factors
    terms = np.unique(np.array([h for _, t, _ in rows[:50] for w in toxicity.words(t.encode()) for h in toxicity._hashes(w)], dtype=np.uint32))
    dense = toxicity.Machine(terms, -0.3, r.normal(0, 0.2, len(terms)), r.normal(0, 0.1, (len(terms), 3)))
    docs = documents(spark)
    for machine in (fitted, dense):
        got = toxicity.scores(docs, machine).collect()
        want = [brute_score(machine, d.text) for d in docs.collect()]
        assert np.allclose([g.score for g in got], want, atol=1e-9)
        assert np.allclose(machine.score([t.encode() for _, t, _ in rows[:40]]), [brute_score(machine, t) for _, t, _ in rows[:40]], atol=1e-9)
