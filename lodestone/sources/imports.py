"""Pages that other vector stores export, as JSON text, to documents ``id, content, meta``.

``pages`` has one JSON page to a row in column ``page``. Only string values become meta.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_VALUES = "map<string,variant>"


def _strings(values: Column) -> Column:
    """The string values of a map of variants."""
    kept = F.map_filter(values, lambda k, v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform_values(kept, lambda k, v: v.cast("string")), F.create_map().cast("map<string,string>"))


def import_qdrant(pages: DataFrame, page: str = "page", content_key: str = "content") -> DataFrame:
    """Scroll pages. The stored ``doc_id`` is the id again; the text leaves the meta."""
    schema = f"struct<result:struct<points:array<struct<id:variant,payload:{_VALUES}>>>>"
    p = pages.select(F.explode(F.from_json(page, schema)["result"]["points"]).alias("p"))
    meta = _strings(F.col("p.payload"))
    key = F.coalesce(F.nullif(meta["doc_id"], F.lit("")), F.col("p.id").cast("string"))
    return p.select(key.alias("id"), F.coalesce(meta[content_key], F.lit("")).alias("content"), F.map_filter(meta, lambda k, _: k != content_key).alias("meta"))


def import_pinecone(pages: DataFrame, page: str = "page", text_field: str = "content") -> DataFrame:
    """Fetch pages: a map of vectors, the text in the metadata."""
    schema = f"struct<vectors:map<string,struct<id:string,metadata:{_VALUES}>>>"
    v = pages.select(F.explode(F.map_values(F.from_json(page, schema)["vectors"])).alias("v"))
    meta = _strings(F.col("v.metadata"))
    return v.select(F.col("v.id").alias("id"), F.coalesce(meta[text_field], F.lit("")).alias("content"), meta.alias("meta"))


def import_weaviate(pages: DataFrame, page: str = "page", text_field: str = "content") -> DataFrame:
    """GraphQL answers: objects by class, the id in ``_additional``."""
    schema = f"struct<data:struct<Get:map<string,array<{_VALUES}>>>>"
    o = pages.select(F.explode(F.flatten(F.map_values(F.from_json(page, schema)["data"]["Get"]))).alias("o"))
    meta = _strings(F.col("o"))
    key = F.expr("try_variant_get(o['_additional'], '$.id', 'string')")
    return o.select(F.coalesce(key, F.lit("")).alias("id"), F.coalesce(meta[text_field], F.lit("")).alias("content"), meta.alias("meta"))


def import_chroma(pages: DataFrame, page: str = "page", text_field: str = "content") -> DataFrame:
    """Parallel lists of lists, of which the later ones may be shorter."""
    schema = f"struct<ids:array<array<string>>,documents:array<array<string>>,metadatas:array<array<{_VALUES}>>>"
    j = F.from_json(page, schema)
    batch = pages.select(F.explode(F.arrays_zip(j["ids"].alias("ids"), F.coalesce(j["documents"], F.array()).alias("documents"), F.coalesce(j["metadatas"], F.array()).alias("metadatas"))).alias("b"))
    row = batch.select(F.explode(F.arrays_zip(F.col("b.ids").alias("id"), F.coalesce("b.documents", F.array()).alias("doc"), F.coalesce("b.metadatas", F.array()).alias("meta"))).alias("r"))
    meta = _strings(F.col("r.meta"))
    return row.where("r.id is not null").select(F.col("r.id").alias("id"), F.coalesce(F.nullif("r.doc", F.lit("")), meta[text_field], F.lit("")).alias("content"), meta.alias("meta"))


IMPORTERS = {"qdrant": import_qdrant, "pinecone": import_pinecone, "weaviate": import_weaviate, "chroma": import_chroma}


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Exported pages, one file each, as ``page``; files that are no JSON give no documents. Any store that Spark reads will do."""
    return spark.read.text(folder, wholetext=True, recursiveFileLookup=True).withColumnRenamed("value", "page")


def stream_pages(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """The same as a stream of the files that arrive, ``files`` to a micro-batch; its offsets are the files that have been read."""
    return spark.readStream.option("maxFilesPerTrigger", files).text(folder, wholetext=True, recursiveFileLookup=True).withColumnRenamed("value", "page")


def import_arriving(spark: SparkSession, kind: str, folder: str, out: str, checkpoint: str, files: int = 100, **options) -> StreamingQuery:
    """Documents of the pages that have come to ``folder`` since the last run, appended to ``out``: each page once,
    also where a run broke off."""
    documents = IMPORTERS[kind](stream_pages(spark, folder, files), **options)
    return documents.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
