"""Keeping stored chunks in step with their files, by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["project_id", "doc_id"]


def _stored_hashes(stored: DataFrame) -> DataFrame:
    """One hash for each stored document; an empty one never matches."""
    key = F.coalesce(F.nullif("doc_id", F.lit("")), "id").alias("doc_id")
    return stored.select("project_id", key, F.nullif("content_hash", F.lit("")).alias("old_hash")).groupBy(*KEY).agg(F.max("old_hash").alias("old_hash"))


def sync_diff(scanned: DataFrame, stored: DataFrame) -> DataFrame:
    """Scanned chunks with ``status``: ``new``, ``changed`` or ``skipped``."""
    old = _stored_hashes(stored).withColumn("known", F.lit(True))
    met = scanned.join(old, KEY, "left")
    status = F.when(F.col("old_hash") == F.col("content_hash"), "skipped").when(F.col("known"), "changed").otherwise("new")
    return met.withColumn("status", status).drop("old_hash", "known")


def new_or_changed(scanned: DataFrame, stored: DataFrame) -> DataFrame:
    """The chunks that have to be embedded."""
    old = _stored_hashes(stored).withColumnRenamed("old_hash", "content_hash")
    return scanned.join(old, [*KEY, "content_hash"], "left_anti")


def stale_points(stored: DataFrame, files: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Stored points of a scanned source directory whose file is gone. Points without a file stay.

    ``roots`` names the scanned directories (``project_id, source_dir``); it is needed where one
    may have no files left, else the files name them.
    """
    current = files.select("project_id", "source_dir", "source_file").distinct()
    gone = stored.where(F.coalesce(F.col("source_file"), F.lit("")) != "").join(current, ["project_id", "source_dir", "source_file"], "left_anti")
    scanned = (current if roots is None else roots).select("project_id", "source_dir").distinct()
    return gone.join(scanned, ["project_id", "source_dir"], "left_semi")


def orphan_chunks(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """Stored chunks of current files that the files no longer make."""
    current = scanned.select("project_id", "source_dir", "source_file").distinct()
    return stored.join(current, ["project_id", "source_dir", "source_file"], "left_semi").join(scanned, KEY, "left_anti")


def upsert_points(stored: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """Stored points, replaced or joined by incoming ones on (project, id); of incoming
    rows of one id the last in ``order`` counts (without one, any but always the same)."""
    by = [F.col(order).desc()] if order else [F.xxhash64(*(F.to_json(c) if kind.startswith("map") else F.col(c) for c, kind in incoming.dtypes))]
    last = incoming.withColumn("__n", F.row_number().over(Window.partitionBy("project_id", "id").orderBy(*by))).where("__n = 1").drop("__n")
    last = last.select(*stored.columns)
    return stored.join(last, ["project_id", "id"], "left_anti").select(*stored.columns).unionByName(last)


def append_points(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return stored.unionByName(incoming.select(*stored.columns))


def delete_points(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the (project, id) rows of ``ids``; none given, nothing goes."""
    return stored.join(ids.select("project_id", "id").distinct(), ["project_id", "id"], "left_anti")


def delete_project(stored: DataFrame, projects: DataFrame) -> DataFrame:
    return stored.join(projects.select("project_id").distinct(), "project_id", "left_anti")


def create_project(registry: DataFrame, requested: DataFrame) -> DataFrame:
    """The registry with the requested projects; known ones are not added again."""
    new = requested.select("project_id").distinct().join(registry, "project_id", "left_anti")
    return registry.select("project_id").unionByName(new)


def project_exists(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests for projects that hold anything."""
    return requests.join(stored.select("project_id").distinct(), "project_id", "left_semi")


def sync_result(diff: DataFrame, stale: DataFrame, files: DataFrame) -> DataFrame:
    """``project_id, indexed, deleted, files_scanned, skipped`` of each project."""
    done = diff.groupBy("project_id").agg(F.count_if(F.col("status") != "skipped").alias("indexed"), F.count_if(F.col("status") == "skipped").alias("skipped"))
    gone = stale.groupBy("project_id").agg(F.count("*").alias("deleted"))
    seen = files.groupBy("project_id").agg(F.count_distinct("source_dir", "source_file").alias("files_scanned"))
    out = seen.join(done, "project_id", "full").join(gone, "project_id", "full")
    return out.select("project_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("indexed", "deleted", "files_scanned", "skipped")))


def sync_corpus(scanned: DataFrame, files: DataFrame, stored: DataFrame, prune_orphan_chunks: bool = False, roots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the collection after the sync, the counters). Without a listing, pass an empty ``stored``."""
    diff = sync_diff(scanned, stored)
    stale = stale_points(stored, files, roots)
    gone = stale.select("project_id", "id")
    if prune_orphan_chunks:
        gone = gone.unionByName(orphan_chunks(stored, scanned).select("project_id", "id"))
    fresh = diff.where("status <> 'skipped'").drop("status")
    return upsert_points(delete_points(stored, gone), fresh), sync_result(diff, gone, files)
