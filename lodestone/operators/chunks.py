"""Files and documents to stored points, and views of what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import paths, text

#: Meta keys that are columns of a point.
PROMOTED = ("source_file", "source_dir", "chunk_index", "content_hash", "chunk_version", "doc_id", "embed_model")


def chunk_files(files: DataFrame, size: int = 1000, most: int = paths.MOST_BYTES) -> DataFrame:
    """Points of candidate files (``project_id, source_file, source_dir, content, length``).

    One row a chunk, with the id, the hash of the raw chunk, and the text as it is stored.
    """
    pieces = files.where(paths.in_size(F.col("length"), most)).select("project_id", "source_file", "source_dir", F.posexplode(text.chunk_text(F.col("content"), size)).alias("chunk_index", "chunk"))
    key = text.chunk_doc_id(F.col("source_dir"), F.col("source_file"), F.col("chunk_index"))
    return pieces.select(
        "project_id",
        key.alias("id"),
        key.alias("doc_id"),
        text.content_prefix(F.col("source_file"), F.col("chunk")).alias("content"),
        "source_file",
        "source_dir",
        "chunk_index",
        text.content_hash(F.col("chunk")).alias("content_hash"),
        F.lit("v2").alias("chunk_version"),
    )


def chunk_meta(points: DataFrame) -> Column:
    """The five meta keys of a scanned chunk."""
    keys = ("source_file", "source_dir", "chunk_index", "content_hash", "chunk_version")
    return F.create_map(*(x for k in keys for x in (F.lit(k), F.col(k).cast("string"))))


def override(low: Column, high: Column) -> Column:
    """Two string maps as one; ``high`` wins where both have a key."""
    return F.map_zip_with(low, high, lambda k, a, b: F.coalesce(b, a))


def inject_embed_meta(meta: Column, model: Column, dim: Column, force: bool = False) -> Column:
    """Meta with ``embed_model`` (``unknown`` if empty) and ``embed_dim``; what the caller set wins, unless forced."""
    own = F.create_map(F.lit("embed_model"), F.coalesce(F.nullif(model, F.lit("")), F.lit("unknown")), F.lit("embed_dim"), dim.cast("string"))
    given = F.coalesce(meta, F.create_map().cast("map<string,string>"))
    return override(given, own) if force else override(own, given)


def strip_text(meta: Column, key: str = "content") -> Column:
    """The text is never repeated in the meta."""
    return F.map_filter(meta, lambda k, _: k != key)


def point_info(points: DataFrame) -> DataFrame:
    """Listing rows: promoted keys as columns, the other tags as meta, a preview of the text."""
    given = [F.col("meta")[k].alias(k) for k in PROMOTED]
    rest = F.map_filter("meta", lambda k, _: ~k.isin(*PROMOTED, "content"))
    return points.select("project_id", "id", *given, text.preview(F.col("content")).alias("preview"), rest.alias("meta"))


def meta_filter(points: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Points whose meta has all of the given values."""
    for k, v in wanted.items():
        points = points.where(F.col(k) == v if k in points.columns else F.col("meta")[k] == v)
    return points


def list_points(points: DataFrame, project_id: str, wanted: dict[str, str] | None = None) -> DataFrame:
    """A project's points in the order of file and chunk number."""
    return order_points(meta_filter(points.where(F.col("project_id") == project_id), wanted or {}))


def list_point_ids(points: DataFrame, project_id: str, wanted: dict[str, str] | None = None) -> DataFrame:
    """The ids of a project's points."""
    return meta_filter(points.where(F.col("project_id") == project_id), wanted or {}).select("id")


def order_points(points: DataFrame) -> DataFrame:
    return points.orderBy("source_file", F.col("chunk_index").cast("int"), "id")


def export_points(points: DataFrame) -> DataFrame:
    """Documents again: the original id where one is kept, whole text and meta."""
    return points.select("project_id", F.coalesce(F.nullif("doc_id", F.lit("")), "id").alias("id"), "content", "meta")


def paginate(rows: DataFrame, order: list, offset: int = 0, limit: int = 0) -> DataFrame:
    """Rows from ``offset`` on, ``limit`` of them (0: all)."""
    out = rows.orderBy(*order).offset(offset)
    return out.limit(limit) if limit > 0 else out
