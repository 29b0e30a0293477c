import math

import numpy as np
import pytest

from lodestone.llm import embeddings


def brute(rows, cosine=0.95):
    def good(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    label, links = list(range(n)), [0] * n
    for i in range(n):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if good(a) and good(b) and len(a) == len(b):
                x, y = (np.array(v) / np.abs(v).max() for v in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    p, q = sorted((label[i], label[j]))
                    label = [p if x == q else x for x in label]
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        c = min(ids, default=None)
        out.append((rows[i][0], links[i], c, rows[i][0] is not None and rows[i][0] == c))
    return out


def some(n, seed, size=16):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, size))
    near = base[r.integers(0, n, n)] + r.normal(size=(n, size)) * r.choice([0.05, 0.2, 0.4], (n, 1))
    walk = np.cumsum(r.normal(size=(n, size)) * 0.15, 0) + 1
    ball = base[0] + r.normal(size=(n, size)) * 0.1
    x = np.concatenate([base, near, walk, ball, base[:5], -base[:5]]) * r.uniform(0.1, 9, (4 * n + 10, 1))
    return [(i, v) for i, v in enumerate(x.astype(np.float32).astype(float).tolist())]


@pytest.mark.parametrize("kind,block", [("float", 4096), ("double", 30)])
def test_equals_brute_force(spark, kind, block):
    rows = some(60, 3)
    size = len(rows)
    odd = [None, [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [], [1.0, 2.0], [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0], [3.0]]
    rows += [(size + i, v) for i, v in enumerate(odd)] + [(None, rows[0][1]), (3, rows[3][1]), (None, [5.0, -5.0, 1.0])]
    fields = f"vec_id long, embedding array<{kind}>, weight int, n_links int, component_id int, kept int, k int, v int, file int"
    vectors = spark.createDataFrame([(i, v, *[1] * 7) for i, v in rows], fields)
    got = [tuple(r) for r in embeddings.near_duplicates(vectors, block=block).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))


def test_extremes(spark):
    rows = [(1, [1e300, 1e300]), (2, [1e-300, 1e-300]), (3, [1e300, -1e300])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.vec_id: r.component_id for r in embeddings.near_duplicates(vectors).collect()} == {1: 1, 2: 1, 3: 3}
    assert embeddings.near_duplicates(vectors.limit(0)).collect() == []


def test_far_stretches_are_skipped():
    r = np.random.default_rng(0)
    x = embeddings.unit(np.concatenate([r.normal(size=(500, 8)) * 0.02 + c for c in np.eye(8)]))
    s = embeddings.Sequence(x, x)
    seen = sum(len(i) for i, _ in embeddings.join(s, s, 0.95, small=64))
    assert seen == 8 * 500 * 499 // 2


def test_blocks_end_at_edges_where_they_can():
    assert list(embeddings._cuts(0, 20, np.array([3, 9, 12]), 8)) == [(0, 3), (3, 9), (9, 12), (12, 20)]
    assert list(embeddings._cuts(2, 20, np.array([], int), 8)) == [(2, 10), (10, 18), (18, 20)]
