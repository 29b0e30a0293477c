import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from lodestone.llm import kneser_ney
from tests.llm.cases import documents


def lowered(t):
    return [*"".join(c.lower() if c.isascii() else c for c in t or "").encode().split(), "END"]


def brute(rows, folds=10, order=2):
    """Plain dictionaries, straight from the definition."""
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % folds == 0
    uni, pairs, triples = Counter(), Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = lowered(t)
            uni.update(w)
            pairs.update(zip(["BEGIN", *w], w))
            triples.update(zip(["BEGIN", "BEGIN", *w], ["BEGIN", *w], w))
    if order == 3:
        pairs = Counter((b, c) for _, b, c in triples)
    n, v = sum(uni.values()), len(uni)
    follow, before = defaultdict(Counter), Counter()
    for (a, b), c in pairs.items():
        follow[a][b] = c
        before[b] += 1
    kinds = lambda counts: [sum(x == k for x in counts) for k in (1, 2, 3, 4)]
    dp, dw = kneser_ney.discounts(*kinds(pairs.values())), kneser_ney.discounts(*kinds(before.values()))
    d = lambda c, ds: 0 if not c else ds[min(c, 3) - 1]
    left0 = sum(d(c, dw) for c in before.values()) / len(pairs) if pairs else 1
    p1 = lambda w: left0 / (v + 1) + (max(before[w] - d(before[w], dw), 0) / len(pairs) if pairs else 0)

    def p2(w, u):
        f = follow.get(u)
        if not f:
            return p1(w)
        return (max(f[w] - d(f[w], dp), 0) + sum(d(c, dp) for c in f.values()) * p1(w)) / sum(f.values())

    dt, after = kneser_ney.discounts(*kinds(triples.values())), defaultdict(Counter)
    for (a, b, c), k in triples.items():
        after[a, b][c] = k

    def p3(w, u, v):
        f = after.get((u, v))
        if order == 2 or not f:
            return p2(w, v)
        return (max(f[w] - d(f[w], dt), 0) + sum(d(c, dt) for c in f.values()) * p2(w, v)) / sum(f.values())

    out = []
    for i, t in rows:
        w = lowered(t)
        out.append((i, held(i), len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), sum(math.log10(p3(x, u, v)) for u, v, x in zip(["BEGIN", "BEGIN", *w], ["BEGIN", *w], w))))
    if uni:
        assert abs(sum(p1(w) for w in uni) + p1("unknown") - 1) < 1e-9
        u = uni.most_common(1)[0][0]
        assert abs(sum(p2(w, u) for w in uni) + p2("unknown", u) - 1) < 1e-9
        assert abs(sum(p3(w, "BEGIN", "BEGIN") for w in uni) + p3("unknown", "BEGIN", "BEGIN") - 1) < 1e-9
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[2], r[5])
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and all(abs(x - y) < 1e-6 * max(1, abs(y)) for x, y in zip(a[5:], b[5:])), (a, b)


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_the_definition(spark, order):
    docs = documents(spark)
    r = random.Random(4)  # beside the odd cases, words of which a few are in most places, in many rows
    more = [(1000 + i, " ".join(r.choices(["the", "of", "a", *"bcdefghij"], [30, 20, 10, *[1] * 9], k=r.randrange(60)))) for i in range(120)]
    rows = [(d.doc_id, d.text) for d in docs.collect()] + more
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, docs.select("doc_id", "text").schema)).repartition(5)
    both = both.selectExpr("*", "1 AS score", "2 AS n_tokens", "3 AS held_out")  # names of its own do no harm
    same(kneser_ney.held_out_scores(both, order=order).collect(), brute(rows, order=order))


def test_without_training_rows(spark):
    rows = [(None, "a b"), (None, None)]
    same(kneser_ney.held_out_scores(documents(spark, rows)).collect(), brute(rows, order=3))
    assert kneser_ney.held_out_scores(documents(spark, [])).collect() == []


def test_a_folder_without_a_model_is_an_error(tmp_path):
    with pytest.raises(FileNotFoundError):
        kneser_ney.Words(str(tmp_path), 1, (3, 3), 1, "scores")


@pytest.mark.parametrize("part", ["pair", "times", "more", "hash"])
def test_a_model_that_has_lost_a_part_is_an_error(spark, tmp_path, part):
    docs = documents(spark).select("doc_id", "text")
    model = kneser_ney.train(docs, str(tmp_path / "m"), 2)
    assert kneser_ney.score(docs, model, ["doc_id"]).count() == docs.count()
    gone = list((tmp_path / "m").glob(f"{part}-[0-9]*.npy"))
    assert gone
    for f in gone:
        f.unlink()
    with pytest.raises(Exception, match="has lost its part"):
        kneser_ney._words.cache_clear()
        kneser_ney._score(model, kneser_ney.Words(model.folder, model.bits, model.sizes, model.threshold, "scores"), [(r.text or "").encode() for r in docs.collect()])
