import datetime as dt
import hashlib
import json
import math
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunks, embed, guard, metrics, search, sync
from lodestone.plans import search as plan
from lodestone.sources import collection as bucketed
from lodestone.sources import corpus, imports, store


def results(spark, rows):
    return spark.createDataFrame(rows, "query_id long, rank int, id string, doc_id string, content string, content_hash string, score double")


def test_compress(spark):
    rows = [(1, i + 1, str(i + 1), "", c, h, 1.0 - i / 10) for i, (c, h) in enumerate([("alpha", "h1"), ("beta", "h1"), ("gamma", "h2"), ("gamma", "h3"), ("delta", "h4"), ("beta", "h5"), ("eps", "h3"), ("zeta", ""), ("eta", "")])]
    out = search.compress(results(spark, rows)).orderBy("rank").collect()
    # the hash duplicate (2) leaves its content free for 6; the content duplicate (4) does not use up its hash for the window form
    assert [r.id for r in out][:4] == ["1", "3", "5", "6"] and [r["rank"] for r in out] == list(range(1, len(out) + 1))
    assert {"8", "9"} <= {r.id for r in out} and "7" not in {r.id for r in out}


@pytest.mark.parametrize("most,want", [(1, "ac"), (2, "abce"), (0, "abcde")])
def test_cap(spark, most, want):
    rows = [(1, i + 1, k, d, k, "", 0.5) for i, (k, d) in enumerate([("a", "memory/x/doc-one#3"), ("b", "memory/x/doc-one#1"), ("c", "memory/y/doc-two#2"), ("d", "memory/x/doc-one#7"), ("e", "memory/y/doc-two#5")])]
    assert "".join(r.id for r in search.cap_per_doc(results(spark, rows), most).orderBy("rank").collect()) == want


@pytest.mark.parametrize("ids,want", [(["", "", "d#1", "d#2"], 3), (["plain", "plain"], 1), (["#1", "#2"], 2)])
def test_cap_of_odd_ids(spark, ids, want):
    assert search.cap_per_doc(results(spark, [(1, i, str(i), d, "", "", 0.0) for i, d in enumerate(ids)]), 1).count() == want


def collection(spark, rows):
    return spark.createDataFrame([(p, i, d, c, "h" + i, v) for p, i, d, c, v in rows], "project_id string, id string, doc_id string, content string, content_hash string, embedding array<float>")


def asked(spark, vec, words="", project="A"):
    return spark.createDataFrame([(1, project, words, vec, False)], "query_id long, project_id string, query string, query_vec array<float>, no_log boolean")


def test_rerank_and_its_fallback(spark):
    c = collection(spark, [("A", f"r{i}", f"d{i}", str(i), [1.0 - i / 20, i / 20.0]) for i in range(10)])
    q = asked(spark, [1.0, 0.0])
    score = F.element_at(F.create_map(F.lit("2"), F.lit(0.99), F.lit("0"), F.lit(0.85), F.lit("1"), F.lit(0.70)), F.col("content"))
    out = plan.search(q, c, k=3, reranker=score).orderBy("rank").collect()
    assert [(r.id, r.score, r.reranked) for r in out] == [("r2", 0.99, True), ("r0", 0.85, True), ("r1", 0.7, True)]
    assert search.rerank_moved(plan.search(q, c, k=3, reranker=score)).first().rerank_moved == 3
    none = plan.search(q, c, k=3, reranker=F.lit(None).cast("double")).orderBy("rank").collect()
    assert [(r.id, r.reranked) for r in none] == [("r0", False), ("r1", False), ("r2", False)]
    hits = spark.createDataFrame([(1, 1, 0.9), (1, 99, 0.8), (1, 0, 0.7)], "query_id long, cand_pos int, relevance_score double")
    assert [r.id for r in search.attach_rerank(search.topk_dense(q, c, 5), hits).orderBy("rank").collect()] == ["r1", "r0"]


def test_cap_fills_up_to_k(spark):
    c = collection(spark, [("A", f"r{i:02}", f"doc{i % 4}#{i}", str(i), [1.0, i / 20.0]) for i in range(12)])
    out = plan.search(asked(spark, [1.0, 0.0]), c, k=3, max_per_doc=1).collect()
    assert len({r.doc_id[:4] for r in out}) == 3


def test_hybrid(spark):
    c = collection(spark, [("A", "1", "", "alpha beta gamma", [0.1, 0.0, 0.0]), ("A", "2", "", "delta epsilon zeta", [0.2, 0.1, 0.0]), ("A", "3", "", "specialkeyword unique content", [0.0, 0.3, 0.0]), ("B", "3", "", "specialkeyword", [1.0, 0.0, 0.0])])
    out = {r.id: r for r in search.hybrid_search(asked(spark, [1.0, 0.0, 0.0], "SpecialKeyword"), c).collect()}
    assert out["3"].in_lexical and out["3"].score == pytest.approx(1 / 61 + 1 / 63) and len(out) == 3
    same = search.hybrid_search(asked(spark, [1.0, 0.0, 0.0], ""), c).orderBy("rank").collect()
    assert [r.id for r in same] == ["1", "2", "3"] and not any(r.in_lexical for r in same)
    shown = plan.retrieve_context(asked(spark, [1.0, 0.0, 0.0]), c, k=1).first().context
    assert shown == "[score 1.000] alpha beta gamma"
    metric, logged = plan.log_rows(asked(spark, [1.0, 0.0, 0.0]), plan.search(asked(spark, [1.0, 0.0, 0.0]), c))
    assert metric.first().results == 3 and logged.first().top_score == pytest.approx(1.0)
    assert plan.log_rows(asked(spark, [1.0, 0.0]).withColumn("no_log", F.lit(True)), plan.search(asked(spark, [1.0, 0.0, 0.0]), c))[1].count() == 0


def test_approximate_recall(spark):
    d = "/root/testdata/sf0.01"
    from lodestone import queries

    q, c = queries.vector_queries(spark, d), queries.vector_chunks(spark, d)
    exact = {(r.query_id, r.id) for r in search.topk_dense(q, c, 5).collect()}
    near = {(r.query_id, r.id) for r in search.topk_approx(q, c, 5).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_sync_steps(spark, tmp_path):
    (tmp_path / "proj/build").mkdir(parents=True)
    for name in (".env", "id_rsa", "server.key", "my-secret.json", "prod.env", "credentials", "build/x.go"):
        (tmp_path / "proj" / name).write_text("x")
    (tmp_path / "proj/test.go").write_text("package main\n")

    def scan():
        f = corpus.candidate_files(corpus.scan_corpus(spark, str(tmp_path / "proj"))).withColumn("project_id", F.lit("p"))
        return chunks.chunk_files(f), f

    made, f = scan()
    assert f.count() == 1
    stored, counts = sync.sync_corpus(made, f, made.limit(0))
    assert counts.first().asDict() == {"project_id": "p", "indexed": 1, "deleted": 0, "files_scanned": 1, "skipped": 0}
    bucketed.write_chunks(stored, str(tmp_path / "store"))
    stored = bucketed.read_chunks(spark, str(tmp_path / "store"), ["p"]).select(*made.columns)
    assert stored.first().content == "File: test.go\n\npackage main\n"
    assert sync.sync_corpus(made, f, stored)[1].first().skipped == 1
    (tmp_path / "proj/test.go").write_text("package main\n\nfunc newFunc() {}\n")
    (tmp_path / "proj/more.md").write_text("more")
    made, f = scan()
    assert {r.doc_id: r.status for r in sync.sync_diff(made, stored).collect()} == {"proj/test.go#chunk0": "changed", "proj/more.md#chunk0": "new"}
    (tmp_path / "proj/test.go").unlink()
    made, f = scan()
    after, counts = sync.sync_corpus(made, f, stored)
    assert counts.first().deleted == 1 and [r.source_file for r in after.collect()] == ["more.md"]


def test_projects_are_apart(spark):
    stored = spark.createDataFrame([("A", "x", "1"), ("B", "x", "2")], "project_id string, id string, content string")
    new = spark.createDataFrame([("A", "x", "3")], "project_id string, id string, content string")
    assert {(r.project_id, r.content) for r in sync.upsert_points(stored, new).collect()} == {("A", "3"), ("B", "2")}
    assert [r.project_id for r in sync.delete_points(stored, new).collect()] == ["B"]
    assert sync.delete_points(stored, new.limit(0)).count() == 2


FULL = {"chunk": "1", "bucket": "b", "kind": "log", "title": "t", "ts": "2026", "agent": "a", "source": "session"}
CONTRACT = guard.Contract(("memory",))


def broken(spark, rows, contract=CONTRACT):
    docs = spark.createDataFrame(rows, "project_id string, id string, content string, meta map<string,string>")
    return sorted((r.id, r.rule, r.detail) for r in guard.violations(docs, contract).collect())


def test_contract(spark):
    assert broken(spark, [("memory", "a", "x", FULL), ("other", "b", "x" * 9000, {})]) == []
    assert broken(spark, [("memory", "a", "x" * 3001, FULL)]) == [("a", "max_chars", "3001")]
    small = guard.Contract(("memory",), max_chars=100)
    assert broken(spark, [("memory", "a", "—" * 100, FULL)], small) == [] and len(broken(spark, [("memory", "a", "—" * 101, FULL)], small)) == 1
    without = {k: v for k, v in FULL.items() if k != "agent"}
    assert broken(spark, [("memory", "a", "x", without | {"bucket": "   "})]) == [("a", "required_meta", "agent"), ("a", "required_meta", "bucket")]
    assert broken(spark, [("memory", "a", "x", FULL | {"kind": "session-log", "source": "vault-migrate"})]) == [("a", "enum_meta", "kind=session-log"), ("a", "enum_meta", "source=vault-migrate")]
    assert broken(spark, [("memory", "a", "x", FULL | {"kind": ""})]) == [("a", "required_meta", "kind")]


def test_delete_cap(spark):
    def allowed(project, n, cap=25):
        rows = spark.createDataFrame([(1, project)] * n, "request_id int, project_id string")
        return guard.delete_refusals(rows, guard.Contract(("memory",), max_delete=cap)).first().allowed

    assert allowed("memory", 25) and not allowed("memory", 26) and allowed("free", 200)
    assert not allowed("memory", 1, 0) and allowed("memory", 3, 3) and not allowed("memory", 4, 3)


def test_latency(spark):
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("b", i, at + dt.timedelta(seconds=i), float(v)) for i, v in enumerate([10, 20, 30, 40, 100])], "g string, id long, ts timestamp, latency_ms double")
    r = metrics.latency_summary(rows, ["g"]).first()
    assert (r["count"], r.avg_ms, r.p50_ms, r.p95_ms) == (5, 40.0, 30.0, 100.0)
    ring = metrics.latency_ring(rows, ["g"], last=2).first()
    assert (ring.total, ring.avg_ms) == (5, 70.0)
    assert metrics.latency_summary(rows.limit(0), ["g"]).count() == 0
    assert metrics.latency_summary(rows).select("count", "avg_ms", "p50_ms", "p95_ms").first() == r[1:]
    assert metrics.latency_summary(rows.limit(0)).first() == (0, 0.0, 0.0, 0.0)


def test_ranks_among_many_values(spark):
    rows = spark.range(30_000).select((F.col("id") % 3).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(7000)) / 7.0).alias("v"))
    got = {r.g: (r.lo, r.hi) for r in metrics.nearest_ranks(rows, "v", {"lo": 0.5, "hi": 0.99}, ["g"], accuracy=200).collect()}
    for g in range(3):
        v = sorted(r.v for r in rows.where(F.col("g") == g).collect())
        assert got[g] == tuple(v[int(p * (len(v) - 1) + 0.5)] for p in (0.5, 0.99))


def test_snapshot_and_log_switch(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10.0, 3, "q1", False), (2, 30.0, 0, "q2", True)], "id long, latency_ms double, results int, query string, no_log boolean").withColumn("ts", F.timestamp_seconds("id"))
    usage = spark.createDataFrame([("embed", 5), ("rerank", 7)], "kind string, tokens long")
    s = metrics.metrics_snapshot(rows, usage, "parquet").first()
    assert (s["count"], s.avg_ms, s.embed_tokens, s.total_tokens, s.backend, s.last_results) == (2, 20.0, 5, 12, "parquet", 0)
    assert metrics.metrics_snapshot(rows.limit(0), usage.limit(0), "parquet").first().avg_ms == 0.0
    path, schema = str(tmp_path / "log"), "id long, query string, results int, ts timestamp"
    entries = rows.select("query", "results", "no_log", "ts")
    assert not store.append_query_log(entries, path, "a")
    off = metrics.recent_report(spark, store.read_query_log(spark, path, schema))
    assert not off.first().enabled
    both = ("id", "top_score", "reranked")
    on = metrics.recent_report(spark, rows.selectExpr("id", "0.5D AS top_score", "false AS reranked"), fields=both)
    strict = lambda df: [f.dataType.simpleString() for f in df.schema]
    assert strict(metrics.recent_report(spark, None, fields=both)) == strict(on)
    assert store.append_query_log(entries.limit(0), path, "b", True)
    r = metrics.recent_report(spark, store.read_query_log(spark, path, schema)).first()
    assert r.enabled and r.queries == []
    store.append_query_log(entries, path, "c", True)
    store.append_query_log(entries, path, "c", True)
    assert [q.id for q in metrics.recent_report(spark, store.read_query_log(spark, path, schema)).first().queries] == [1]


def test_batches_are_appended_once_with_ids_that_go_on(spark, tmp_path):
    path, schema = str(tmp_path / "m"), "id long, ts int, v string"
    part = lambda a, b: spark.range(a, b).repartition(7).selectExpr("cast(id as int) AS ts", "concat('v', id) AS v", "-1L AS id")
    assert store.append_batch(part(0, 100), path, "one", ["ts"]) == (1, 100)
    assert store.append_batch(part(100, 130), path, "two", ["ts"]) == (101, 30)
    assert store.append_batch(part(100, 130), path, "two", ["ts"]) == (101, 30)
    assert store.append_batch(part(0, 0), path, "none", ["ts"]) == (131, 0)
    (tmp_path / "m/data/write=broken").mkdir()
    assert store.append_batch(part(130, 140), path, "three", ["ts"]) == (131, 10)
    got = store.read_batches(spark, path, schema).collect()
    assert sorted((r.id, r.ts, r.v) for r in got) == [(i + 1, i, f"v{i}") for i in range(140)]
    assert store.read_batches(spark, str(tmp_path / "other"), schema).collect() == []


def test_a_query_that_does_not_say_is_logged(spark):
    queries = spark.createDataFrame([(1, "p", "a", None), (2, "p", "b", True), (3, "p", "c", False)], "query_id int, project_id string, query string, no_log boolean")
    results = spark.createDataFrame([(1, 1, "d", 0.5, False, 0)], "query_id int, rank int, doc_id string, score double, reranked boolean, cand_pos int")
    metric, logged = plan.log_rows(queries, results)
    assert metric.count() == 3 and {(r.query_id, r.results) for r in logged.collect()} == {(1, 1), (3, 0)}


def test_files_of_any_bytes(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/ok.md").write_text("fine")
    (tmp_path / "a/bad.md").write_bytes(b"x\xff\xfey")
    (tmp_path / "a/large.md").write_text("z" * 600)
    got = {r.path.rsplit("/", 1)[1]: (r.content, r.length) for r in corpus.scan_corpus(spark, str(tmp_path / "a"), 500).collect()}
    assert got == {"ok.md": ("fine", 4), "bad.md": ("x\ufffd\ufffdy", 4), "large.md": (None, 600)}


def test_a_scorer_that_fails_costs_the_order_only(spark):
    c = collection(spark, [("A", f"r{i}", f"d{i}", str(i), [1.0 - i / 20, i / 20.0]) for i in range(6)])
    q = asked(spark, [1.0, 0.0])

    def broken(queries, contents):
        raise RuntimeError("no model")

    works = search.scorer(lambda queries, contents: [float(x) for x in contents])
    out = plan.search(q, c, k=2, reranker=works("query", "content")).orderBy("rank").collect()
    assert [r.id for r in out] == ["r5", "r4"] and out[0].reranked
    out = plan.search(q, c, k=2, reranker=search.scorer(broken)("query", "content")).orderBy("rank").collect()
    assert [(r.id, r.reranked) for r in out] == [("r0", False), ("r1", False)]


def test_approximate_search_with_nulls(spark):
    rows = [("A", "0", "", "x", None), ("A", "1", "", "y", [1.0, 0.0]), ("A", "2", "", "z", [0.5]), ("A", "3", "", "w", [0.0, 0.0])]
    assert [r.id for r in search.topk_approx(asked(spark, [1.0, 0.1]), collection(spark, rows), 5).collect()] == ["1"]
    assert search.topk_approx(asked(spark, None), collection(spark, rows), 5).count() == 0


def test_a_stored_vector_index_reads_the_probed_cells(spark, tmp_path):
    from lodestone import queries

    d, path = "/root/testdata/sf0.01", str(tmp_path / "vectors")
    q, c = queries.vector_queries(spark, d), queries.vector_chunks(spark, d)
    search.write_vector_index(c, path, cells=32)
    one = q.where("query_id = 50")
    near = search.topk_approx(one, index=path, probes=3)
    # the scan for exact scores, which is left to do, is told which three cells to open
    assert re.findall(r"PartitionFilters: \[cell#\d+ IN \(\d+,\d+,\d+\)", near._jdf.queryExecution().toString())
    exact = {(r.query_id, r.id) for r in search.topk_dense(q, c, 5).collect()}
    some = {(r.query_id, r.id): r.score for r in search.topk_approx(q, index=path, probes=20).collect()}
    assert len(exact & set(some)) / len(exact) >= 0.9
    assert {(r.query_id, r.id) for r in search.topk_approx(q, index=path, probes=32, refine=10**6).collect()} == exact
    search.write_vector_index(c.limit(0), str(tmp_path / "none"))
    assert search.topk_approx(q, index=str(tmp_path / "none")).collect() == []


def test_a_vector_index_measures_how_many_cells_a_search_has_to_probe(spark, tmp_path):
    from lodestone import queries

    d, path = "/root/testdata/sf0.01", str(tmp_path / "vectors")
    q, c = queries.vector_queries(spark, d), queries.vector_chunks(spark, d)
    search.write_vector_index(c, path, cells=128)
    exact = {(r.query_id, r.id) for r in search.topk_dense(q, c, 5).collect()}
    near = {(r.query_id, r.id): r.score for r in search.topk_approx(q, index=path).collect()}
    assert len(exact & set(near)) / len(exact) >= 0.9
    # queries that are too many to be sent to all tasks have the same results
    with pytest.MonkeyPatch.context() as m:
        m.setattr(search, "BROADCAST_BYTES", 0)
        assert {(r.query_id, r.id): r.score for r in search.topk_approx(q, index=path).collect()} == pytest.approx(near)


def caught(monkeypatch, df):
    """Makes ``mapInArrow`` return its function, so that a test can run a task by itself."""
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: run)


def peak_mb(make):
    """(what ``make`` gives, the most that it held at a time)."""
    tracemalloc.start()
    try:
        return make(), tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_a_task_holds_few_scores_however_many_ask(spark, monkeypatch):
    r = np.random.default_rng(3)
    q, m = r.normal(size=(1000, 4)).round(1), r.normal(size=(10_000, 4)).round(1)
    asks = spark.createDataFrame([(i, "p", v) for i, v in enumerate(q.tolist())], "query_id long, project_id string, query_vec array<double>")
    known = spark.createDataFrame([], "project_id string, id long, embedding array<double>")
    batches = [pa.RecordBatch.from_pydict({"project_id": ["p"] * 5000, "id": list(range(a, a + 5000)), "embedding": m[a : a + 5000].tolist()}) for a in (0, 5000)]
    caught(monkeypatch, known)
    run = search._scan_scores(asks, known, 5, "l2")
    out, peak = peak_mb(lambda: list(run(iter(batches))))
    assert peak < 80
    best = {}
    for b in out:
        for x in b.to_pylist():
            best.setdefault(x["query_id"], []).append((-round(x["score"], 9), x["id"]))
    for i in range(0, 1000, 50):
        exact = np.round(1 - ((m - q[i]) ** 2).sum(1), 9)
        assert [c for _, c in sorted(best[i])[:5]] == sorted(range(10_000), key=lambda c: (-exact[c], c))[:5]


def scan_peak(spark, monkeypatch, asks, batches, k):
    """(number of rows, the most that a task of the scan held at a time)."""
    kinds = "query_id long, project_id string, query_vec array<double>"
    known = spark.createDataFrame([], "project_id string, id long, embedding array<double>")
    caught(monkeypatch, known)
    run = search._scan_scores(spark.createDataFrame(asks, kinds), known, k, "cosine")
    return peak_mb(lambda: sum(b.num_rows for b in run(iter(batches))))


def test_a_task_holds_few_best_scores_however_many_projects_ask(spark, monkeypatch):
    asks = [(i, f"p{i % 200}", [1.0, i / 7]) for i in range(4000)]
    b = pa.RecordBatch.from_pydict({"project_id": [f"p{i % 200}" for i in range(2000)], "id": list(range(2000)), "embedding": [[1.0, i / 9] for i in range(2000)]})
    n, peak = scan_peak(spark, monkeypatch, asks, [b], 5000)
    assert n == 4000 * 10 and peak < 60


def test_a_task_holds_few_pairs_however_few_chunks_a_batch_has(spark, monkeypatch):
    asks = [(i, "p", [1.0, i / 7]) for i in range(15_000)]
    b = pa.RecordBatch.from_pydict({"project_id": ["p"] * 60, "id": list(range(60)), "embedding": [[1.0, i / 9] for i in range(60)]})
    n, peak = scan_peak(spark, monkeypatch, asks, [b], 60)
    assert n == 15_000 * 60 and peak < 100


def test_a_task_holds_few_vectors_however_long_they_are(spark, monkeypatch):
    m = np.random.default_rng(5).normal(size=(3000, 2000))
    vectors = pa.ListArray.from_arrays(np.arange(3001, dtype=np.int32) * 2000, pa.array(m.reshape(-1)))
    b = pa.RecordBatch.from_arrays([pa.array(["p"] * 3000), pa.array(range(3000)), vectors], names=["project_id", "id", "embedding"])
    n, peak = scan_peak(spark, monkeypatch, [(7, "p", m[7].tolist())], [b], 3000)
    assert n == 3000 and peak < 50


@pytest.mark.parametrize("name", ["attach_rerank", "compress_results", "recall_sweep", "hit_at_k", "context_refs", "log_rows", "topk_dense_l2"])
def test_a_task_of_a_registered_search_holds_few_scores(spark, monkeypatch, name):
    from lodestone import queries

    scans, d = [], "/root/testdata/check_s"
    maps = type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, run, schema: scans.append(run) or maps(self, run, schema))
    monkeypatch.setattr(search, "CELLS", 1 << 17, raising=False)
    queries.QUERIES[name](spark, d)
    t = spark.read.parquet(f"{d}/embeddings.parquet").toArrow().combine_chunks()
    t = pa.table({"project_id": pa.array(["p"] * len(t)), "id": t["vec_id"].cast("string"), "embedding": t["embedding"]})
    n, peak = peak_mb(lambda: sum(b.num_rows for b in scans[0](iter(t.to_batches()[:1]))))
    assert n >= 5 * spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 50 = 0").count() and peak < 25


def test_a_task_holds_few_words_and_texts_however_large_a_batch_is(spark, monkeypatch):
    rows = spark.createDataFrame([], "project_id string, id long, content string")
    caught(monkeypatch, rows)
    words = [[f"w{(i * 7 + j) % 50}" for j in range(1000)] for i in range(3000)]
    batch = pa.RecordBatch.from_pydict({"project_id": ["p"] * 3000, "id": list(range(3000)), "words": words})
    n, peak = peak_mb(lambda: sum(b.num_rows for b in search.postings(rows)(iter([batch]))))
    assert n == 3000 * 50 and peak < 60
    batch = pa.RecordBatch.from_pydict({"project_id": ["p"] * 3000, "id": list(range(3000)), "content": ["x" * 10_000 + str(i) for i in range(3000)]})
    e = embed.Embedder(lambda texts: [[float(t[10_000:])] for t in texts], dim=1)
    made, peak = peak_mb(lambda: [v[0] for b in embed.embed_documents(rows, e)(iter([batch])) for v in b.column("embedding").to_pylist()])
    assert made == list(map(float, range(3000))) and peak < 15


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_many_queries_meet_chunks_in_tiles(spark, monkeypatch, metric):
    r = np.random.default_rng(1)
    vectors_ = [r.normal(size=6).round(1).tolist() for _ in range(400)] + [[0.0] * 6, [1.0], None, [None] * 6]
    known = spark.createDataFrame([("hot" if i % 10 else f"p{i % 3}", f"c{i}", v) for i, v in enumerate(vectors_ + vectors_[:60], 1)], "project_id string, id string, embedding array<float>").repartition(5)
    asks = spark.createDataFrame([(i, "hot" if i % 5 else "p1", v) for i, v in enumerate(vectors_[:90] + vectors_[-4:])], "query_id long, project_id string, query_vec array<float>").repartition(3)
    rows = lambda df: sorted((x.query_id, x["rank"], x.id, round(x.score, 9)) for x in df.collect())
    plain = rows(search.topk_dense(asks, known, 7, metric))
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    assert rows(search.topk_dense(asks, known, 7, metric)) == plain
    tiled = search._tile_scores(asks.where("query_vec is not null"), known.where("embedding is not null"), 7, metric, size=480)
    assert rows(search._top(tiled, 7)) == plain
    tasks = {(t.project_id, t.n) for t in search._tiles(known, "id", "embedding", 6, 480).select("project_id", F.size("keys").alias("n")).collect()}
    assert max(n for _, n in tasks) <= 10  # a hot project is many tiles
    best = {}
    for k in known.where("size(embedding) = 6").collect():
        for q in asks.where("size(query_vec) = 6").collect():
            if k.project_id == q.project_id and None not in k.embedding and None not in q.query_vec:
                a, b = np.array(k.embedding), np.array(q.query_vec)
                n = np.linalg.norm(a) * np.linalg.norm(b)
                if metric == "l2" or n > 0:
                    best.setdefault(q.query_id, []).append((-round(1 - ((a - b) ** 2).sum() if metric == "l2" else a @ b / n, 9), k.id))
    assert [(q, i) for q, _, i, _ in plain] == [(q, i) for q in sorted(best) for _, i in sorted(best[q])[:7]]


def test_embedding_of_no_words(spark):
    from lodestone.functions import vectors

    rows = spark.createDataFrame([(1, ""), (2, None), (3, "a a b")], "k int, t string")
    got = {r.k: r.embedding for r in vectors.hash_embedding(rows, "k", "t", 8).collect()}
    assert got[1] == got[2] == [0.0] * 8 and sum(x * x for x in got[3]) == pytest.approx(1)
    assert vectors.hash_embedding(rows.limit(0), "k", "t", 8).collect() == []


def test_embedding_of_long_texts(spark):
    from lodestone.functions import vectors

    long = spark.range(100).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.concat(F.lit("w"), (i * (F.col("id") + 1)).cast("string"))), " ").alias("t")).cache()
    assert long.count() == 100
    began = time.time()
    got = vectors.hash_embedding(long, "id", "t").collect()
    assert time.time() - began < 100 * 0.1
    want = [0] * 64
    for i in range(1, 20_001):
        want[int(hashlib.sha256(f"w{i}".encode()).hexdigest()[:4], 16) % 64] += 1
    size = sum(x * x for x in want) ** 0.5
    assert next(r.embedding for r in got if r.id == 0) == pytest.approx([x / size for x in want])


def test_log(spark):
    rows = spark.createDataFrame([(i, f"q{i}", 0 if i == 3 else 2, 0.5) for i in range(40)], "id long, query string, results int, top_score double")
    kept = metrics.prune_log(rows, 5).collect()
    assert len(kept) == 5 and max(r.id for r in kept) == 39
    assert [r.query for r in metrics.recent_queries(rows, 3).collect()] == ["q39", "q38", "q37"]
    assert [r.query for r in metrics.zero_result_queries(rows).collect()] == ["q3"]


PAGES = {
    "pinecone": ({"vectors": {"v1": {"id": "v1", "metadata": {"content": "hello", "source_file": "a.go", "n": 1}}, "v2": {"id": "v2", "metadata": {"content": "world"}}}}, {}, {("v1", "hello", "a.go"), ("v2", "world", None)}),
    "weaviate": ({"data": {"Get": {"Doc": [{"text": "chunk one", "source_file": "x.go", "_additional": {"id": "id-1"}}]}}}, {"text_field": "text"}, {("id-1", "chunk one", "x.go")}),
    "chroma": ({"ids": [["c1", "c2"], ["c3"]], "documents": [["doc text"]], "metadatas": [[{"doc_id": "orig-1", "source_file": "c.go"}, {"content": "from meta"}]]}, {}, {("c1", "doc text", "c.go"), ("c2", "from meta", None), ("c3", "", None)}),
    "qdrant": ({"result": {"points": [{"id": 7, "payload": {"content": "t", "doc_id": "d#1", "n": 3, "source_file": "q.go"}}, {"id": "u", "payload": {}}]}}, {}, {("d#1", "t", "q.go"), ("u", "", None)}),
}


@pytest.mark.parametrize("kind", PAGES)
def test_imports(spark, kind):
    page, options, want = PAGES[kind]
    out = imports.IMPORTERS[kind](spark.createDataFrame([(json.dumps(page),)], "page string"), **options).collect()
    assert {(r.id, r.content, r.meta.get("source_file")) for r in out} == want
    assert all("n" not in r.meta for r in out) and (kind != "qdrant" or all("content" not in r.meta for r in out))


def test_pages_that_arrive_are_imported_once(spark, tmp_path):
    folder, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    folder.mkdir()
    page = lambda i: json.dumps({"vectors": {f"v{i}": {"id": f"v{i}", "metadata": {"content": f"text\n{i}"}}}}, indent=1)
    for lot in ((0, 1, 2), (3,), ()):
        for i in lot:
            (folder / f"{i}.json").write_text(page(i))
        (folder / f"broken{len(lot)}.json").write_text("{no json")
        imports.import_arriving(spark, "pinecone", str(folder), out, ck, 2).awaitTermination()
        got = sorted((r.id, r.content) for r in spark.read.parquet(out).collect())
        assert got == sorted((f"v{i}", f"text\n{i}") for i in range(4 if lot != (0, 1, 2) else 3))
    assert imports.import_pinecone(imports.read_pages(spark, str(folder))).count() == 4


def test_a_page_is_the_same_text_however_its_rows_arrive(spark, tmp_path):
    from lodestone import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 100")
    made = []
    for n, order in enumerate((F.col("doc_id"), F.col("doc_id").desc())):
        docs.coalesce(1).sortWithinPartitions(order).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        made.append(sorted(r.page for r in queries._page(spark, f"{tmp_path}/{n}", F.struct("r")).collect()))
    assert made[0] == made[1]


def test_reembedding(spark):
    docs = spark.createDataFrame([("p", f"i{i}", "", f"text {i}", {"content_hash": "h", "embed_model": "old"}) for i in range(150)], "project_id string, id string, doc_id string, content string, meta map<string,string>")
    e = embed.Embedder(lambda texts: [[float(len(t)), 1.0] for t in texts], "new", 2, 64)
    out = embed.reembed(docs, e).collect()
    assert len(out) == 150 and all(r.meta == {"content_hash": "h", "embed_model": "new", "embed_dim": "2"} and r.embedding[0] == len(r.content) for r in out)
    with pytest.raises(Exception, match="vectors for"):
        embed.embed_documents(docs, embed.Embedder(lambda texts: [[1.0]])).collect()
    m = chunks.inject_embed_meta(F.col("meta"), F.lit(""), F.lit(2))
    assert docs.select(m.alias("m")).first().m == {"content_hash": "h", "embed_model": "old", "embed_dim": "2"}


def test_progress(spark):
    rows = spark.createDataFrame([(1, b, b * 64, 1000) for b in range(1, 17)], "run_id int, batch int, done int, total int")
    assert [r.pct for r in metrics.progress(rows).orderBy("batch").collect()] == sorted({b * 64 * 100 // 1000 for b in range(1, 17)})


def test_lexical_search_by_scan_and_by_index(spark, tmp_path):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(r.choice("AB"), str(i), " ".join(r.choices(vocabulary, weights=range(60, 0, -1), k=r.randint(0, 150)))) for i in range(300)] + [("A", "none", None)]
    chunks_ = spark.createDataFrame(rows, "project_id string, id string, content string").repartition(5)
    asks = [(i, r.choice("ABC"), " ".join(r.choices(vocabulary, k=r.randint(0, 6)))) for i in range(80)] + [(900, "A", "w1 unknown"), (901, "A", "W1"), (902, "B", "")]
    queries_ = spark.createDataFrame(asks, "query_id long, project_id string, query string")
    path = str(tmp_path / "index")
    search.write_index(chunks_, path, buckets=3)
    by_scan = {(x.query_id, x.id): (round(x.score, 9), x["rank"]) for x in search.topk_lexical(queries_, chunks_, 400).collect()}
    by_index = {(x.query_id, x.id): (round(x.score, 9), x["rank"]) for x in search.topk_lexical(queries_, chunks_, 400, index=path).collect()}
    want = {(q, i) for q, p, t in asks for of, i, c in rows if p == of and t and c and set(t.lower().split()) <= set(c.split())}
    assert by_scan == by_index and set(by_scan) == want and len(want) > 100
    pair = next(iter(x for x in want if len(dict((a[0], a[2]) for a in asks)[x[0]].split()) > 1))
    words = dict((x[1], x[2]) for x in rows)[pair[1]].split()
    terms = list(dict.fromkeys(dict((a[0], a[2]) for a in asks)[pair[0]].split()))
    misses = 1.0
    for a in range(len(words)):
        for b in range(a + 1, len(words)):
            if words[a] in terms and words[b] in terms and words[a] != words[b]:
                misses *= 1 - (0.01 * (1e-30 if b - a > 100 else 1 / (1.005 + 0.05 * math.exp((b - a) / 1.5 - 2)))) ** 0.5
    assert by_scan[pair][0] == pytest.approx(1 - misses, abs=1e-8)


def test_an_index_reads_candidates_only(spark, tmp_path):
    from lodestone import queries

    d, path = "/root/testdata/sf0.001", str(tmp_path / "index")
    chunks_ = queries.vector_chunks(spark, d)
    search.write_index(chunks_, path)
    found = search._index_hits(search._asked(queries.word_queries(spark, d)), path)
    n = found.count()
    plan_ = found._jdf.queryExecution().toString()
    assert n and "PartitionFilters" in plan_
    asked = search._asked(queries.word_queries(spark, d))
    rarest = asked.select("query_id", F.explode("terms").alias("term")).join(spark.read.parquet(f"{path}/terms"), "term").groupBy("query_id").agg(F.min("chunks").alias("n"))
    joined = rarest.agg(F.sum("n")).first()[0] + found.agg(F.sum("n")).first()[0]
    assert joined <= 100 * n


def test_rank_of_many_hits_takes_time_in_proportion():
    at, term = np.arange(200_000), np.arange(200_000) % 3
    began = time.time()
    assert 0.999 < text._rank(at, term, 3) <= 1 and time.time() - began < 2


def test_a_migration_goes_on_where_it_was_cut_off(spark, tmp_path):
    from lodestone.plans import migrate

    seen, path = tmp_path / "seen", str(tmp_path / "run")
    seen.mkdir()
    docs = spark.createDataFrame([("p", f"i{i}", "", f"text {i}", {"content_hash": "h"}) for i in range(150)], "project_id string, id string, doc_id string, content string, meta map<string,string>")
    fail_at = next(r.content for r in docs.withColumn("b", F.pmod(F.xxhash64("project_id", "id"), F.lit(6))).where("b = 4").collect())

    def fn(texts, broken):
        if broken and fail_at in texts:
            raise RuntimeError("the model is gone")
        for t in texts:
            with open(seen / t.replace(" ", "-"), "a") as f:
                f.write("x")
        return [[float(len(t)), 1.0] for t in texts]

    migrate.start(docs, path, 6)
    with pytest.raises(Exception, match="the model is gone"):
        migrate.run(spark, path, embed.Embedder(lambda t: fn(t, True), "new", 2, 64))
    done = {r.batch for r in migrate.ledger(spark, path).where("done").collect()}
    assert done == {0, 1, 2, 3} and migrate.migrated(spark, path).count() < 150
    part = migrate.progress(spark, path).orderBy("batch").collect()
    assert [r.batch for r in part] == [0, 1, 2, 3] and part[-1].done == migrate.migrated(spark, path).count() and part[0].total == 150
    migrate.start(docs.limit(0), path, 6)  # has been done
    assert migrate.run(spark, path, embed.Embedder(lambda t: fn(t, False), "new", 2, 64)) == 2
    assert migrate.run(spark, path, embed.Embedder(lambda t: fn(t, False), "new", 2, 64)) == 0
    got = migrate.migrated(spark, path).collect()
    assert len(got) == 150 and {r.id for r in got} == {f"i{i}" for i in range(150)} and all(r.meta["embed_model"] == "new" for r in got)
    in_done = {r.content for r in spark.read.parquet(f"{path}/points").where("batch < 4").collect()}
    assert all((seen / t.replace(" ", "-")).read_text() == "x" for t in in_done)
    assert metrics.progress(migrate.progress(spark, path, "r")).count() > 0 and migrate.progress(spark, path).orderBy("batch").collect()[-1].done == 150
