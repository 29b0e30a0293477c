import numpy as np
import pytest
import xxhash

from lodestone.llm import graph, simhash
from tests.llm.cases import documents


def brute_fingerprint(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum((2 * sum(v >> b & 1 for v in h) > len(h)) << b for b in range(64))


def brute_labels(fps, radius=3):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def some_fingerprints(n, seed):
    """Random ones, chains of small steps, and a dense ball."""
    r = np.random.default_rng(seed)
    out = [int(x) for x in r.integers(0, 2**64, n, dtype=np.uint64)]
    for k in range(n):
        x = out[r.integers(len(out))]
        for bit in r.integers(0, 64, 1 + k % 5):
            x ^= 1 << int(bit)
        out.append(x)
    for _ in range(n):
        x = out[0]
        for bit in r.integers(0, 64, 3):
            x ^= 1 << int(bit)
        out.append(x)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_index_equals_brute_force(seed):
    fps = list(dict.fromkeys(some_fingerprints(100, seed)))
    index = simhash.GrayIndex(np.zeros(len(fps), np.int64), np.array(fps, np.uint64))
    index.join(3, chunk=64)
    label = np.arange(len(fps))
    graph.merge(label, *index.edges())
    assert label.tolist() == brute_labels(fps)


def test_gray_rank_inverts_the_code():
    x = np.random.default_rng(1).integers(0, 2**64, 100, dtype=np.uint64)
    rank = simhash.gray_rank(x)
    assert (rank ^ rank >> np.uint64(1) == x).all()


def test_links_across_partitions(spark):
    fps = list(dict.fromkeys(some_fingerprints(400, 9)))
    signed = [(f - 2**64 if f >> 63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    place = {f: i for i, (f,) in enumerate(signed)}
    label = np.arange(len(fps))
    graph.merge(label, np.array([place[e.a] for e in edges]), np.array([place[e.b] for e in edges]))
    assert label.tolist() == brute_labels(fps)
    assert max(np.bincount([place[x] for e in edges for x in e])) < 60


def test_components(spark):
    r = np.random.default_rng(4)
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(int(a), int(b)) for a, b in r.integers(1000, 1100, (60, 2))] + [(7, 7), (None, 3), (60, 59)]
    label = np.arange(1100)
    graph.merge(label, *np.array([p for p in pairs if None not in p]).T)
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {int(n): int(label[n]) for p in pairs if None not in p for n in p}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_documents(spark):
    docs = documents(spark)
    rows = docs.collect()
    fps = [brute_fingerprint(d.text) for d in rows]
    label = brute_labels(fps)
    least = {x: min(d.doc_id for d, y in zip(rows, label) if x == y and d.doc_id is not None) for d, x in zip(rows, label) if d.doc_id is not None}
    want = [(d.doc_id, f"{f:016x}", least.get(x)) for d, f, x in zip(rows, fps, label)]
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
