import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from lodestone.llm import packing
from lodestone.llm.queries import QUERIES
from tests.llm.cases import documents, texts

BPE_JSON = P.path("byte_bpe_50k.json")


def fewest(items, capacity):
    """By trying everything."""
    items, best = sorted(items, reverse=True), len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins) if b + items[i] <= capacity}.values():
            bins[j] += items[i]
            go(i + 1, bins)
            bins[j] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def sequences(packing_, counts, capacity):
    """Their number, after a look at what they hold."""
    held = Counter()
    for filling, copies in packing_:
        assert copies > 0 and sum(x * n for x, n in filling) <= capacity
        for x, n in filling:
            held[x] += n * copies
    assert held == Counter(counts)
    return sum(c for _, c in packing_)


def test_packings_are_the_smallest():
    better = 0
    for seed in range(200):
        r = random.Random(seed)
        capacity = r.choice([10, 20, 50, 100])
        items = [r.randint(1, capacity) for _ in range(r.randint(1, 11))]
        counts = Counter(items)
        n, want = sequences(packing.bin_completion(counts, capacity), counts, capacity), fewest(items, capacity)
        assert n == want and packing.lower_bound(counts, capacity) <= want
        better += n < sequences(packing.best_fit(counts, capacity), counts, capacity)
    assert packing.bin_completion({}, 10) == [] and better


def test_many_pieces_cost_no_more_than_many_lengths():
    r = random.Random(1)
    counts = Counter(r.randint(400, 1400) for _ in range(5000))
    many = {x: n * 10**7 for x, n in counts.items()}
    few = sequences(packing.bin_completion(many, 2048, nodes=3000), many, 2048)
    assert packing.lower_bound(many, 2048) <= few < sequences(packing.best_fit(many, 2048), many, 2048)


def test_fillings_of_a_room():
    # nothing is dominated by another, nothing more fits, and an exact filling by one piece is all there is
    assert packing.fillings([1, 1, 2], [6, 4, 3], 10, 10) == [((6, 1), (4, 1))]
    assert packing.fillings([1, 1], [7, 3], 7, 7) == [((7, 1),)]
    assert packing.dominates(((6, 1),), ((3, 1), (2, 1))) and not packing.dominates(((3, 2),), ((4, 1),))


@pytest.mark.parametrize("capacity", [7, 64, 2048])
def test_packed_documents(spark, capacity):
    t = Tokenizer.from_file(BPE_JSON)
    t.encode_special_tokens = True
    docs = documents(spark)
    ids = lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 0]
    crc = lambda x: zlib.crc32(np.array(x, dtype="<u4").tobytes())
    want = Counter()
    for d in docs.collect():
        whole = ids(d.text)
        edges = [0, *range(len(whole) % capacity or min(capacity, len(whole)), len(whole) + 1, capacity)] if len(whole) > capacity else [0, len(whole)]
        want.update((d.doc_id, i, a, b - a, crc(whole[a:b])) for i, (a, b) in enumerate(zip(edges, edges[1:])))
    got = packing.pack_documents(docs.repartition(3), BPE_JSON, capacity).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        ends = [0, *(a + n for a, n in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= capacity
    assert len(held) <= sequences(packing.best_fit(c := Counter(r.length for r in got), capacity), c, capacity)


def test_sequences_hold_the_ids(spark):
    t = Tokenizer.from_file(BPE_JSON)
    docs = documents(spark, list(enumerate(texts()[:12])))
    rows = packing.packed_sequences(docs, BPE_JSON, 256).collect()
    whole = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in enumerate(texts()[:12])}
    found = Counter()
    for r in rows:
        assert len(r.ids) <= 256
        for d, a, b in zip(r.doc_ids, r.offsets, [*r.offsets[1:], len(r.ids)]):
            found[d] += b - a
            assert any(whole[d][i : i + b - a] == r.ids[a:b] for i in range(len(whole[d])))
    assert found == {i: len(x) for i, x in whole.items()}


def test_no_documents(spark):
    assert packing.pack_documents(documents(spark, []), BPE_JSON).collect() == []


def test_query_fills_its_sequences(spark):
    d = "/root/testdata/sf0.001"
    rows = QUERIES["op12_packing"](spark, d).collect()
    counts = Counter(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) == packing.lower_bound(counts, 2048)
    assert {r.doc_id for r in rows} == {r.doc_id for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
