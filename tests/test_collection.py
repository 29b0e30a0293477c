import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import sync
from lodestone.sources import collection

SCHEMA = "project_id string, id string, content string, meta map<string,string>"


def points(spark, n=400, mark=""):
    project = F.when(F.col("i") % 10 < 7, "big/p ä").otherwise(F.concat(F.lit("s"), (F.col("i") % 3).cast("string")))
    return spark.range(n).withColumnRenamed("id", "i").select(project.alias("project_id"), F.col("i").cast("string").alias("id"), F.concat(F.lit("t"), F.col("i").cast("string"), F.lit(mark)).alias("content"), F.create_map(F.lit("k"), (F.col("i") % 5).cast("string")).alias("meta"))


def rows(df):
    return sorted((r.project_id, r.id, r.content, *r.meta.items()) for r in df.collect())


def files(base):
    return {os.path.join(d, f) for d, _, names in os.walk(base) for f in names if f.endswith(".parquet") and "/data/" in d}


def test_upsert_leaves_other_buckets_alone(spark, tmp_path):
    base = str(tmp_path / "c")
    assert collection.write_chunks(points(spark), base, rows=10) == 1
    first = files(base)
    assert rows(collection.read_chunks(spark, base)) == rows(points(spark))
    again = points(spark, mark="!").where(F.col("id").cast("int") % 50 == 1)
    assert collection.upsert_chunks(again, base, rows=10) == 2
    want = sync.upsert_points(points(spark), again)
    assert rows(collection.read_chunks(spark, base)) == rows(want)
    assert rows(collection.read_chunks(spark, base, number=1)) == rows(points(spark))
    old, new = (collection.manifest(spark, base, collection.version(spark, base, n)) for n in (1, 2))
    kept, old, new = old.join(new, "path").count(), old.count(), new.count()
    assert first < files(base) and kept >= old - again.count() and new - kept <= again.count() and kept > 0
    assert collection.collect_old(spark, base) == old - kept
    assert len(files(base)) == new and len(files(base) & first) == kept and rows(collection.read_chunks(spark, base)) == rows(want)
    with pytest.raises(Exception, match="(?i)not exist|no such"):
        collection.version(spark, base, 1)


def test_rows_go_and_come(spark, tmp_path):
    base = str(tmp_path / "c")
    collection.write_chunks(points(spark, 60), base, rows=8)
    odd = points(spark, 60).where(F.col("id").cast("int") % 2 == 1)
    collection.delete_chunks(odd.unionByName(odd.withColumn("project_id", F.lit("unknown"))), base, rows=8)
    assert rows(collection.read_chunks(spark, base)) == rows(points(spark, 60).where(F.col("id").cast("int") % 2 == 0))
    both = points(spark, 4)
    collection.upsert_chunks(both, base, gone=points(spark, 8), rows=8)
    ids = {r.id for r in collection.read_chunks(spark, base).collect()}
    assert {"0", "1", "2", "3"} <= ids and not ids & {"4", "5", "6", "7"}
    collection.delete_projects(spark, base, ["big/p ä"])
    assert {r.project_id for r in collection.read_chunks(spark, base).collect()} == {"s0", "s1", "s2"}
    assert collection.read_chunks(spark, base, ["big/p ä"]).collect() == [] and collection.read_chunks(spark, base, ["s1"]).select("project_id").distinct().collect() == [("s1",)]


def test_the_last_of_repeated_rows_counts(spark, tmp_path):
    base = str(tmp_path / "c")
    repeated = spark.createDataFrame([("p", "a", "old", None, 1), ("p", "a", "new", {"k": "v"}, 2), ("q", "a", "other", None, 1)], SCHEMA + ", at int")
    collection.upsert_chunks(repeated, base, order="at")
    assert {(r.project_id, r.id, r.content) for r in collection.read_chunks(spark, base).collect()} == {("p", "a", "new"), ("q", "a", "other")}
    assert collection.read_chunks(spark, base).columns == ["project_id", "id", "content", "meta"]


def test_a_project_that_grows_gets_more_buckets(spark, tmp_path):
    base = str(tmp_path / "c")
    collection.write_chunks(points(spark, 40), base, rows=20)
    collection.upsert_chunks(points(spark, 400).where("id >= 40"), base, rows=20)
    m = collection.manifest(spark, base, collection.version(spark, base))
    sizes = {r.project_id: (r.b, r.n, r.most) for r in m.groupBy("project_id").agg(F.max("buckets").alias("b"), F.sum("rows").alias("n"), F.max("rows").alias("most")).collect()}
    assert sizes["big/p ä"][:2] == (16, 280) and sizes["big/p ä"][2] < 60
    assert rows(collection.read_chunks(spark, base)) == rows(points(spark, 400))
    collection.upsert_chunks(points(spark, 400, "?"), base, rows=20)
    assert rows(collection.read_chunks(spark, base)) == rows(points(spark, 400, "?"))


def test_a_change_is_made_once(spark, tmp_path):
    base = str(tmp_path / "c")
    collection.write_chunks(points(spark, 10), base, token="a")
    assert collection.upsert_chunks(points(spark, 10, "!"), base, token="b") == 2
    assert collection.upsert_chunks(points(spark, 10, "?"), base, token="b") == 2
    assert rows(collection.read_chunks(spark, base)) == rows(points(spark, 10, "!"))


def test_of_two_writers_one_fails(spark, tmp_path):
    base = str(tmp_path / "c")
    collection.write_chunks(points(spark, 10), base)
    v = collection.version(spark, base)
    with pytest.raises(collection.ConcurrentChange):
        collection._commit(spark, base, 1, "other", v.schema, None)
    assert collection.version(spark, base).manifest == v.manifest and [x for x in os.listdir(f"{base}/versions") if not x.endswith(".crc")] == [f"{1:012d}"]


def test_nothing_stored_and_rows_without_a_key(spark, tmp_path):
    base = str(tmp_path / "c")
    with pytest.raises(FileNotFoundError):
        collection.read_chunks(spark, base)
    with pytest.raises(ValueError, match="project_id and an id"):
        collection.write_chunks(spark.createDataFrame([("p", None, "x", None)], SCHEMA), base)
    assert collection.write_chunks(points(spark, 0), base) == 1 and collection.read_chunks(spark, base).columns == points(spark).columns
    assert collection.read_chunks(spark, base).collect() == [] and os.listdir(f"{base}/staging") == []
