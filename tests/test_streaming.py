import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunks, metrics, sync
from lodestone.sources import collection
from lodestone.streaming import jobs


def feed(folder, rows, files=3):
    folder.mkdir(parents=True, exist_ok=True)
    for k in range(files):
        (folder / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows[k::files]))


def table(stream, name, mode, spark):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def events(n):
    return [{"type": ["query_executed", "index_started", "points_deleted"][i % 3], "timestamp": f"2024-01-01T00:{i // 60:02}:{i % 60:02}", "data": str(i)} for i in range(n)]


def test_counts_and_feed(spark, tmp_path):
    feed(tmp_path / "in", events(200))
    stream = jobs.read_events(spark, str(tmp_path / "in"), files=1)
    batch = spark.read.schema(jobs.EVENT_SCHEMA).json(str(tmp_path / "in"))
    got = {r.type: r.events for r in table(jobs.activity_counts(stream), "counts", "complete", spark).collect()}
    assert got == {r.type: r.events for r in metrics.activity_by_type(batch).collect()}
    jobs.recent_feed(stream, str(tmp_path / "feed"), str(tmp_path / "c1"), keep=50).awaitTermination()
    assert {int(r.data) for r in jobs.state_of(spark, str(tmp_path / "feed")).collect()} == set(range(150, 200))
    closed = table(jobs.windowed_activity(stream, "1 second", "1 minute"), "windows", "append", spark)
    assert {r.events for r in closed.collect()} == {20}


def test_progress_ring_and_log(spark, tmp_path):
    rows = [{"run_id": r, "batch": i, "done": i if i < 251 else i - 251, "total": 250} for r in (1, 2) for i in range(260)]
    for k in range(4):
        feed(tmp_path / "p", [], 0)
        (tmp_path / "p" / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows if r["batch"] // 70 == k))
        done = jobs.read_events(spark, str(tmp_path / "p"), "run_id int, batch int, done int, total int", 1)
        jobs.progress_changes(done).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c0")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.run_id, r.batch, r.pct) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = spark.read.schema("run_id int, batch int, done int, total int").json(str(tmp_path / "p"))
    assert got == {(r.run_id, r.batch, r.pct) for r in metrics.progress(batch).collect()} and len(got) == 2 * 105
    rows = [{"id": i, "ts": f"2024-01-01T00:{i // 60:02}:{i % 60:02}", "g": "ab"[i % 2], "latency_ms": float(i), "no_log": i % 4 == 0} for i in range(100)]
    feed(tmp_path / "s", rows)
    samples = jobs.read_events(spark, str(tmp_path / "s"), "id long, ts timestamp, g string, latency_ms double, no_log boolean", 1)
    jobs.latency_ring(samples, str(tmp_path / "ring"), str(tmp_path / "c2"), ["g"], last=10, salts=3).awaitTermination()
    assert {r.id for r in jobs.ring_of(spark, str(tmp_path / "ring"), ["g"], 10).collect()} == set(range(80, 100))
    most = spark.read.parquet(str(tmp_path / "ring")).groupBy("batch").count().agg({"count": "max"}).first()[0]
    assert most <= 10 * 2 * 3
    jobs.query_log(samples, str(tmp_path / "log"), str(tmp_path / "c3"), 12).awaitTermination()
    assert {r.id for r in jobs.state_of(spark, str(tmp_path / "log")).collect()} == {i for i in range(88, 100) if i % 4}


FILES = "project_id string, source_dir string, source_file string, content string, length long, deleted boolean"


def a_file(name, content, gone=False):
    return {"project_id": "p", "source_dir": "d", "source_file": name, "content": content, "length": len(content), "deleted": gone}


@pytest.mark.parametrize("prune", [False, True])
def test_sync_stream(spark, tmp_path, prune):
    base, folder = str(tmp_path / "base"), tmp_path / "in"
    folder.mkdir()
    small = lambda f: chunks.chunk_files(f, 4)
    steps = [
        [a_file("a.go", "one1two2three"), a_file("b.go", "two"), *(a_file(f"x{i}.go", f"{i}") for i in range(30))],
        [a_file("a.go", "one1"), a_file("b.go", "", True), a_file("c.go", "four"), a_file("x1.go", "1")],
        [a_file("b.go", "back"), a_file("x2.go", "other")],
    ]
    sizes = []
    for k, rows in enumerate(steps):
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = jobs.read_events(spark, str(folder), FILES, 1)
        jobs.sync_stream(stream, base, str(tmp_path / "ck"), small, prune, rows=4).awaitTermination()
        v = collection.version(spark, base)
        sizes.append(spark.read.parquet(f"{base}/manifests/{v.manifest}").where(F.col("path").contains(v.manifest)).agg(F.sum("rows")).first()[0] or 0)
    stored, counts = None, small(spark.createDataFrame([], FILES))
    stored = counts
    for rows in steps:
        f = spark.createDataFrame(rows, FILES)
        gone = stored.join(f.where("deleted").select("project_id", "source_file"), ["project_id", "source_file"], "left_semi")
        now = small(f.where("not deleted"))
        lost = sync.orphan_chunks(stored, now) if prune else stored.limit(0)
        stored = sync.upsert_points(sync.delete_points(stored, gone.select("project_id", "id").unionByName(lost.select("project_id", "id"))), now)
        stored = spark.createDataFrame(stored.collect(), stored.schema)
    got = collection.read_chunks(spark, base)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stored.select(*got.columns).collect()))
    assert ("a.go", 2) in {(r.source_file, r.chunk_index) for r in got.collect()} or prune
    # what a batch writes goes by what it changes, not by what is stored
    assert sizes[0] > 30 and all(n < 20 for n in sizes[1:])


def test_only_changes_go_on(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, rows in enumerate([[a_file("a.go", "one1two2")], [a_file("a.go", "one1tow2")], [a_file("a.go", "one1tow2")], [a_file("a.go", "", True), a_file("never.go", "", True)]]):
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
    stream = jobs.changed_chunks(jobs.read_events(spark, str(folder), FILES, 1), lambda f: chunks.chunk_files(f, 4))
    out = []
    each = lambda batch, i: out.append(sorted((r.id[-1], r.gone) for r in batch.collect()))
    jobs.keyed_state(spark, lambda: stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()).awaitTermination()
    assert [x for x in out if x] == [[("0", False), ("1", False)], [("1", False)], [("0", True), ("1", True)]]


def test_a_group_of_files_asks_its_state_once_for_each():
    class State(dict):
        calls = 0

        def getValue(self, key):
            self.calls += 1
            return self.get(key)

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

        def removeKey(self, key):
            self.calls += 1
            del self[key]

    state = State()
    columns = ["project_id", "source_dir", "source_file", "id", "content_hash", "gone"]
    known = jobs._Known(columns, False)
    known.known = state
    made = lambda rows: [(r.source_file, r.id, r.gone) for f in known.handleInputRows((0,), iter([pd.DataFrame(rows, columns=columns, dtype=object)]), None) for r in f.itertuples()]
    chunk = lambda f, i, h: ("p", None, f"f{f}", f"{f}#{i}", h, False)
    first = [chunk(f, i, "h") for i in range(4) for f in range(300)]
    assert sorted(made(first)) == sorted((f"f{f}", f"{f}#{i}", False) for f in range(300) for i in range(4)) and state.calls <= 600
    assert made(first) == [] and state.calls <= 900
    assert sorted(made([chunk(1, 0, "h"), chunk(1, 1, "other"), ("p", None, "f2", None, None, True), ("p", None, "f999", None, None, True)])) == [("f1", "1#1", False), *(("f2", f"2#{i}", True) for i in range(4))]
    assert len(state) == 299
