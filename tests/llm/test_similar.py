import random

import corpus_pipeline
from lodestone.llm import simhash
from tests.llm.cases import documents, words


def brute_set(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_least(rows):
    """The least id of each row's component, over all pairs."""
    sets = [brute_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if label[i] != label[j] and 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((label[i], label[j]))
                label = [a if z == b else z for z in label]
    least = {}
    for (i, _), x in zip(rows, label):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    return [(i, least.get(x)) for (i, _), x in zip(rows, label)]


def edited(seed):
    """Copies on both sides of 0.8, chains, a common line, and stars whose leaves are below 0.8 to each other."""
    r = random.Random(seed)
    line = words(12, 99)
    out = []
    for i in range(40):
        base = words(r.randint(6, 150), 1000 + i, size=3000)
        out.append(base)
        for _ in range(r.randint(0, 5)):
            copy = list(r.choice([base, out[-1]]))
            for _ in range(r.randint(1, 6)):
                copy[r.randrange(len(copy))] = r.choice(words(50, r.random()))
            out.append(copy)
    star = words(200, 5, size=3000)
    for i in range(25):
        copy = list(star)
        for k in range(4):
            copy[(7 * i + 50 * k) % 200] = f"e{i}"
        out.append(copy)
    out = [x + line if r.random() < 0.4 else x for x in [*out, star, star]]
    r.shuffle(out)
    return [(i, " ".join(x)) for i, x in enumerate(out)]


def test_components_equal_brute_force_jaccard(spark):
    for seed in (1, 2):
        rows = edited(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted(tuple(r) for r in simhash.similar(docs).collect())
        want = sorted(brute_least(rows))
        assert got == want and len({c for _, c in want}) < len(rows) - 30


def test_awkward_documents(spark):
    docs = documents(spark)
    rows = [(d.doc_id, d.text) for d in docs.collect()]
    got = [tuple(r) for r in simhash.similar(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_least(rows)))
    assert simhash.similar(docs.limit(0)).collect() == []


def test_the_stage_takes_near_copies_that_simhash_misses(spark):
    base = words(100, 3, size=3000)
    far = [*base[:20], "x1", *base[21:60], "x2", *base[61:]]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(far))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()] == [1]
