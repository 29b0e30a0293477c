import datetime as dt
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, sharding, url_filter
from tests.llm.cases import documents, texts, words


def brute_shard(key, tree):
    """Descend the tree by draws in plain Python."""
    total = lambda x: sum(map(total, x)) if isinstance(x, list) else x[1]
    seed = xxhash.xxh64_intdigest((key if key is not None else "\0null").encode(), 42)
    while isinstance(tree, list):
        draws = []
        for i, child in enumerate(tree):
            u = ((xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed) >> 12) + 0.5) / 2**52
            draws.append((-math.log(u) / total(child) if total(child) > 0 else math.inf, i))
        place = min(draws)[1]
        seed, tree = xxhash.xxh64_intdigest(place.to_bytes(4, "little"), seed), tree[place]
    return tree[0]


def test_shards_equal_brute_force(spark):
    uneven = [[[(0, 1.0), (1, 3.0)], [(2, 0.5)]], [[(3, 2.0), (4, 0.0)]], [[(5, 4.0), (6, 1.0), (7, 1.0)]]]
    keys = [*map(str, range(500)), "", "é ß", None]
    rows = spark.createDataFrame([(k,) for k in keys], "key string")
    for tree in (uneven, sharding.grown_tree(uneven), sharding.even_tree(40)):
        got = {r.key: r.s for r in sharding.assign(rows, "key", tree, "s").collect()}
        assert got == {k: brute_shard(k, tree) for k in keys}


def test_shards_and_slots(spark):
    docs = documents(spark)
    rows = sharding.shard_documents(docs, 40).collect()
    assert len(rows) == docs.count()
    text = {d.doc_id: d.text or "" for d in docs.collect() if d.doc_id != 3}
    slots = {}
    for r in rows:
        if r.doc_id in text:
            raw = text[r.doc_id].encode()
            assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(docs.limit(0)).collect() == []


def test_draws_follow_weights_and_move_only_where_weights_change(spark):
    keys = spark.range(40000)
    rows = sharding.assign(sharding.assign(keys, "id", sharding.even_tree(40), "a"), "id", sharding.grown_tree(sharding.even_tree(40)), "b").collect()
    count = Counter(r.a for r in rows)
    assert len(count) == 40 and max(abs(c - 1000) for c in count.values()) < 200
    moved = [r for r in rows if r.a != r.b]
    assert {r.b for r in moved} == {40} and abs(len(moved) - 40000 / 41) < 200
    tree = [[[(0, 1.0)], [(1, 3.0)]], [[(2, 4.0), (3, 0.0)]]]
    count = Counter(r.s for r in sharding.assign(keys, "id", tree, "s").collect())
    assert abs(count[0] - 5000) < 400 and abs(count[1] - 15000) < 500 and abs(count[2] - 20000) < 500 and count[3] == 0


def brute(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    hit, found = set(), set()
    for item, t in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        size = min(13, len(v))
        wins = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in wins:
                hit.update(range(i, i + size))
                found.add(item)
    names = sorted(map(str, found))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_contamination_equals_brute_force(spark):
    items = [(1, " ".join(words(40, 7)[:30])), (2, "Only-Two"), (3, None), (4, ""), (5, " ".join(words(80, 1)[5:40])), (5, "la la la"), (10, " ".join(words(80, 1)[5:40]))]
    rows = [*enumerate(texts()), (90, "x only; TWO y"), (91, "only"), (92, "two only two")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(documents(spark, rows), benchmark).collect()
    got = {r.doc_id: tuple(r)[1:] for r in found}
    assert len(found) == len(rows)
    for i, t in rows:
        assert got[i] == brute(t, items), i
    assert decontaminate.contamination(documents(spark, []), benchmark).collect() == []
    assert not any(r.contaminated for r in decontaminate.contamination(documents(spark), benchmark.limit(0)).collect())


def test_stored_index_in_many_segments(spark):
    w = words(3000, 2)
    items = [(i, " ".join(w[i * 37 : i * 37 + 20])) for i in range(60)] + [(100, " ".join(w[:13][::-1])), (101, w[5]), (102, "nowhere at all")]
    rows = [(d, " ".join(w[d * 50 : d * 50 + 90])) for d in range(40)] + [(40, " ".join(w[:13][::-1])), (41, None)]
    asked = decontaminate.windows_of(spark.createDataFrame([(str(i), t) for i, t in items], "item_id string, text string"), 13)
    docs = documents(spark, rows).repartition(3)
    for terms in (None, decontaminate.term_map(asked)):
        index = decontaminate.build_index(docs, terms, segment_bytes=700)
        assert index.select("segment").distinct().count() > 12
        got = {r.doc_id: (r.n_words, len(r.hits), len(r["items"])) for r in decontaminate.find_windows(index, asked).collect()}
        assert got == {d: brute(t, items)[:3] for d, t in rows}
    every = decontaminate.build_index(docs).agg(F.sum("n")).first()[0]
    assert decontaminate.build_index(docs, decontaminate.term_map(asked.where("size(terms) < 13"))).agg(F.sum("n")).first()[0] < every / 50


def test_a_large_test_set_reads_the_index_once(spark):
    """Megabytes of items: the same plan, one scan of the postings for the counts, one for the join and one for the lists."""
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(20_000)]
    items = [(i, " ".join(r.choices(vocabulary, k=60))) for i in range(9000)]
    rows = [(d, " ".join([*r.choices(vocabulary, k=40), *(items[d * 31][1].split()[5:30] if d % 3 == 0 else []), *r.choices(vocabulary, k=20)])) for d in range(200)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert sum(len(t) for _, t in items) > 3 << 20
    got = {x.doc_id: (x.n_hit, x.n_items) for x in decontaminate.contamination(documents(spark, rows), benchmark).collect()}
    assert got == {d: (25, 1) if d % 3 == 0 else (0, 0) for d, _ in rows}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b x c"), (2, "a b c"), (3, "c b a q q q q q")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    hits = lambda slop: {r.doc_id for r in decontaminate.matches(docs, benchmark, slop=slop).collect() if r["items"]}
    assert hits(0) == {2} and hits(1) == {1, 2}


def test_temporal_list(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    entries = spark.createDataFrame(
        [("Bad.com", "add", "spam", day(2)), ("bad.com", "remove", "spam", day(5)), ("bad.com", "add", "again", day(8)), ("x.bad.com", "add", "sub", day(3)), ("tie.org", "add", "b", day(1)), ("tie.org", "add", "a", day(1)), (None, "add", "n", day(1)), ("t.net", "add", "n", None)],
        "rule string, action string, reason string, from_time timestamp",
    )
    cases = [
        (1, "http://www.bad.com/p", day(1), None), (2, "http://www.bad.com:80/p", day(2), "spam"), (3, "https://u@WWW.bad.com", day(5), None), (4, "http://bad.com/", day(9), "again"),
        (5, "http://y.x.bad.com/", day(4), "sub"), (6, "http://notbad.com/", day(4), None), (7, None, day(4), None), (8, "http://bad.com", None, None), (9, "no url", day(4), None), (10, "http://tie.org.", day(9), "a"), (10, "http://tie.org.", day(9), "a"),
    ]
    captures = spark.createDataFrame([c[:3] for c in cases], "id long, url string, fetched timestamp").withColumn("rule", F.lit("clash"))
    rows = url_filter.filter_urls(captures, entries, "id").collect()
    assert {r.capture_id: r.reason for r in rows} == {c[0]: c[3] for c in cases} and len(rows) == 10
    assert url_filter.filter_urls(captures.limit(0), entries, "id").collect() == []
    assert not any(r.blocked for r in url_filter.filter_urls(captures, entries.limit(0), "id").collect())
