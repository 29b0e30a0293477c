"""The chunk collection as bucket files under a manifest that changes in one step.

Rows are hashed by id to buckets within their project, about ``rows`` to a bucket. A change reads and
writes only the buckets that its rows fall into; other files stay as they are, under their
names. Below ``base`` there are

- ``data/write=<w>/place=<project's hash>-<bucket>/``: files that never change,
- ``manifests/<w>/``: a table ``project_id, buckets, bucket, path, rows`` of a version's files,
- ``versions/<n>``: a small file that names the manifest. It is put there by a rename that
  fails where the file exists, so readers see whole versions, and of two writers one fails.

Files of old versions stay until ``collect_old`` takes them away.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType
from pyspark.sql.window import Window

from lodestone.sources import files as files_

#: Rows of a bucket when a project is written or has outgrown twice as many.
ROWS = 100_000
MANIFEST = "project_id string, buckets int, bucket int, path string, rows long"


class ConcurrentChange(RuntimeError):
    """Another writer has made the version that this change was about to make."""


@dataclass(frozen=True)
class Version:
    number: int
    manifest: str
    schema: StructType
    token: str | None


def _numbers(spark: SparkSession, base: str) -> list[int]:
    return [int(n) for n in files_.names(spark, f"{base}/versions") if n.isdigit()]


def version(spark: SparkSession, base: str, number: int | None = None) -> Version | None:
    """A version of the collection, by default the newest; None where nothing was ever written."""
    known = _numbers(spark, base)
    if number is None and not known:
        return None
    number = known[-1] if number is None else number
    said = files_.read_json(spark, f"{base}/versions/{number:012d}")
    return Version(number, said["manifest"], StructType.fromJson(said["schema"]), said["token"])


def _commit(spark: SparkSession, base: str, number: int, manifest: str, schema: StructType, token: str | None) -> int:
    try:
        files_.put_json(spark, f"{base}/versions", f"{number:012d}", {"manifest": manifest, "schema": json.loads(schema.json()), "token": token})
    except files_.AlreadyThere as e:
        raise ConcurrentChange(f"version {number} of {base} is there already") from e
    return number


def manifest(spark: SparkSession, base: str, v: Version | None) -> DataFrame:
    """A version's files: ``project_id, buckets, bucket, path, rows``."""
    return spark.createDataFrame([], MANIFEST) if v is None else spark.read.schema(MANIFEST).parquet(f"{base}/manifests/{v.manifest}")


def _read(spark: SparkSession, base: str, schema: StructType, paths: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*(f"{base}/data/{p}" for p in paths)) if paths else spark.createDataFrame([], schema)


def read_chunks(spark: SparkSession, base: str, projects: list[str] | None = None, number: int | None = None) -> DataFrame:
    """A version of the collection, by default the newest, or some projects of it; of others no file is opened."""
    base = base.rstrip("/")
    v = version(spark, base, number)
    if v is None:
        raise FileNotFoundError(f"no collection in {base}")
    files = manifest(spark, base, v)
    if projects is not None:
        files = files.where(F.col("project_id").isin(projects))
    chunks = _read(spark, base, v.schema, sorted(r.path for r in files.select("path").distinct().toLocalIterator()))
    return chunks.where(F.col("project_id").isin(projects)) if projects is not None else chunks


def _bucket(buckets: Column) -> Column:
    """A row's bucket. Bucket counts are powers of two, so that more buckets split each one."""
    return F.pmod(F.xxhash64("id"), buckets).cast("int")


def _place(bucket: Column) -> Column:
    return F.concat_ws("-", F.md5(F.col("project_id").cast("binary")), bucket.cast("string"))


def _write(rows: DataFrame, base: str, schema: StructType, into: str) -> DataFrame:
    """Write rows (with ``buckets`` and ``bucket``) as files of one write; returns their manifest."""
    spark = rows.sparkSession
    folder = f"{base}/data/write={into}"
    rows.select(*schema.names, F.col("buckets").alias("__buckets"), F.col("bucket").alias("__bucket"), _place(F.col("bucket")).alias("place")).write.partitionBy("place").parquet(folder)
    made = StructType([*schema.fields]).add("__buckets", IntegerType()).add("__bucket", IntegerType())
    relative = F.regexp_extract("_metadata.file_path", r"/data/(write=[^/]+/.*)$", 1)
    files = spark.read.schema(made).parquet(folder).select("project_id", "__buckets", "__bucket", relative.alias("path"))
    return files.groupBy("project_id", F.col("__buckets").alias("buckets"), F.col("__bucket").alias("bucket"), "path").agg(F.count("*").alias("rows"))


def _finish(files: DataFrame, base: str, into: str, number: int, schema: StructType, token: str | None) -> int:
    spark = files.sparkSession
    files.select(*(f.name for f in StructType.fromDDL(MANIFEST))).write.parquet(f"{base}/manifests/{into}")
    return _commit(spark, base, number, into, schema, token)


def _buckets(count: Column, now: Column, rows: int) -> Column:
    """Buckets for ``count`` rows of a project that has ``now`` (null: none): as they are until each holds twice ``rows``."""
    wanted = F.pow(2.0, F.ceil(F.log2(F.greatest(count / F.lit(rows), F.lit(1.0))))).cast("int")
    return F.when(now.isNull(), wanted).when(count > 2 * F.lit(rows) * now, F.greatest(wanted, now)).otherwise(now)


def write_chunks(chunks: DataFrame, base: str, rows: int = ROWS, token: str | None = None) -> int:
    """Make ``chunks`` the whole collection and return its version. Of rows of one project and id, one stays."""
    return _change(chunks, None, base.rstrip("/"), None, rows, token, True)


def upsert_chunks(incoming: DataFrame, base: str, order: str | None = None, gone: DataFrame | None = None, rows: int = ROWS, token: str | None = None) -> int:
    """Replace or add rows by (project, id), take away those of ``gone`` (``project_id, id``), and return the new version.

    Of incoming rows of one id the last in ``order`` counts (without one, any but always the same); a row
    that comes in and goes as well comes in. Columns are the collection's; a row without project or id is an error. A change with the ``token``
    of the newest version has been made before and is not made again.
    """
    return _change(incoming, gone, base.rstrip("/"), order, rows, token, False)


def delete_chunks(gone: DataFrame, base: str, rows: int = ROWS, token: str | None = None) -> int:
    """Take away the rows of ``gone`` (``project_id, id``)."""
    spark, base = gone.sparkSession, base.rstrip("/")
    v = version(spark, base)
    if v is None:
        raise FileNotFoundError(f"no collection in {base}")
    return _change(spark.createDataFrame([], v.schema), gone, base, None, rows, token, False)


def delete_projects(spark: SparkSession, base: str, projects: list[str], token: str | None = None) -> int:
    """Without some projects: the manifest alone is written again."""
    base = base.rstrip("/")
    v = version(spark, base)
    if v is None:
        raise FileNotFoundError(f"no collection in {base}")
    if token is not None and v.token == token:
        return v.number
    return _finish(manifest(spark, base, v).where(~F.col("project_id").isin(projects)), base, uuid.uuid4().hex, v.number + 1, v.schema, token)


def _change(incoming: DataFrame, gone: DataFrame | None, base: str, order: str | None, rows: int, token: str | None, whole: bool) -> int:
    spark = incoming.sparkSession
    v = version(spark, base)
    if token is not None and v is not None and v.token == token:
        return v.number
    fresh = whole or v is None
    schema = StructType([f for f in incoming.schema.fields if f.name != order]) if fresh else v.schema
    schema = StructType([type(f)(f.name, f.dataType, True) for f in schema.fields])  # as files have it
    files = manifest(spark, base, None if fresh else v)
    into = uuid.uuid4().hex

    # the change itself is kept for its time, so that it is made once only
    last = F.xxhash64(*(F.to_json(c) if kind.startswith("map") else F.col(c) for c, kind in incoming.dtypes)) if order is None else F.col(order)
    staged = incoming.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields), F.struct(F.lit(2).alias("at"), last.cast("string" if order is None else incoming.schema[order].dataType).alias("order")).alias("__order"), F.lit(False).alias("__gone"))
    if gone is not None:
        staged = staged.unionByName(gone.select("project_id", "id").withColumn("__order", F.struct(F.lit(1).alias("at"), F.lit(None).cast(staged.schema["__order"].dataType["order"].dataType).alias("order"))).withColumn("__gone", F.lit(True)), allowMissingColumns=True)
    staging = f"{base}/staging/{into}"
    staged.write.parquet(staging)
    staged = spark.read.schema(staged.schema).parquet(staging)
    try:
        if not staged.where("project_id IS NULL OR id IS NULL").isEmpty():
            raise ValueError("a row of a collection has to have a project_id and an id")
        return _rewrite(staged, files, base, schema, rows, into, 1 if v is None else v.number + 1, token)
    finally:
        files_.remove(spark, staging)


def _rewrite(staged: DataFrame, files: DataFrame, base: str, schema: StructType, rows: int, into: str, number: int, token: str | None) -> int:
    """A version in which the buckets that staged rows fall into are written anew, beside the files of all others."""
    spark = staged.sparkSession
    order = staged.schema["__order"].dataType["order"].dataType
    have = files.groupBy("project_id").agg(F.max("buckets").alias("now"), F.sum("rows").alias("had"))
    more = staged.where(~F.col("__gone")).groupBy("project_id").agg(F.count("*").alias("more"))
    sizes = have.join(more, "project_id", "full").withColumn("buckets", _buckets(F.coalesce("had", F.lit(0)) + F.coalesce("more", F.lit(0)), F.col("now"), rows))
    sizes = sizes.select("project_id", "buckets", "now")
    placed = staged.join(sizes.drop("now"), "project_id").withColumn("bucket", _bucket(F.col("buckets")))
    # buckets that change: those that rows fall into, and all of a project that gets more buckets
    touched = placed.select("project_id", "bucket").distinct()
    split = sizes.where("buckets <> now").select("project_id")
    read = files.join(touched, ["project_id", "bucket"], "left_semi").unionByName(files.join(split, "project_id", "left_semi")).distinct()
    paths = sorted(r.path for r in read.select("path").distinct().toLocalIterator())
    held = _read(spark, base, schema, paths).join(sizes.drop("now"), "project_id").withColumn("bucket", _bucket(F.col("buckets")))
    held = held.withColumns({"__order": F.struct(F.lit(0).alias("at"), F.lit(None).cast(order).alias("order")), "__gone": F.lit(False)})
    both = held.unionByName(placed).repartition("project_id", "bucket")
    newest = Window.partitionBy("project_id", "bucket", "id").orderBy(F.col("__order").desc())
    kept = both.withColumn("__n", F.row_number().over(newest)).where((F.col("__n") == 1) & ~F.col("__gone"))
    made = _write(kept, base, schema, into)
    return _finish(files.join(read.select("path").distinct(), "path", "left_anti").unionByName(made), base, into, number, schema, token)


def collect_old(spark: SparkSession, base: str, keep: int = 1) -> int:
    """Delete all but the newest ``keep`` versions, and files that only those used; returns how many files went.

    Files of a write that never became a version go with the versions before which it began, unless it may still
    be going on: what no version names is left alone if it is newer than the newest version.
    """
    base = base.rstrip("/")
    numbers = _numbers(spark, base)
    old, new = numbers[:-keep] if keep else [], numbers[-keep:]
    if not new:
        return 0
    kept = {version(spark, base, n).manifest for n in new}
    used = None
    for n in new:
        m = manifest(spark, base, version(spark, base, n)).select("path")
        used = m if used is None else used.unionByName(m)
    newest = files_.changed_at(spark, f"{base}/versions/{new[-1]:012d}")
    removed = 0
    stale = [n for n in files_.names(spark, f"{base}/data") if n.startswith("write=") and files_.changed_at(spark, f"{base}/data/{n}") <= newest]
    if stale:
        there = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load([f"{base}/data/{n}" for n in stale])
        relative = F.regexp_extract("path", r"/data/(write=[^/]+/.*)$", 1)
        for r in there.select(relative.alias("path")).join(used.distinct(), "path", "left_anti").toLocalIterator():
            files_.remove(spark, f"{base}/data/{r.path}")
            removed += 1
    for n in old:
        files_.remove(spark, f"{base}/versions/{n:012d}")
    for name in files_.names(spark, f"{base}/manifests"):
        if name not in kept and files_.changed_at(spark, f"{base}/manifests/{name}") <= newest:
            files_.remove(spark, f"{base}/manifests/{name}")
    return removed
