"""Embedding with a caller's model, and moving collections to another model."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.batches import slices
from lodestone.operators import chunks

#: Bytes of text that a task has in hand at a time, whatever a batch holds.
BYTES = 4 << 20
Embed = Callable[[list[str]], list[list[float]]]


@dataclass(frozen=True)
class Embedder:
    """``fn`` gives one vector for each text; ``query_fn``, if there is one, embeds queries."""

    fn: Embed
    model: str = ""
    dim: int = 0
    batch: int = 32
    query_fn: Embed | None = None
    count_tokens: Callable[[str], int] | None = None


def _embed(rows: DataFrame, fn: Embed, e: Embedder, text: str, to: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]):
        for b in slices(batches, text, BYTES):
            texts = [t or "" for t in b.column(text).to_pylist()]
            out: list[list[float]] = []
            for i in range(0, len(texts), e.batch):
                part = fn(texts[i : i + e.batch])
                if len(part) != len(texts[i : i + e.batch]):
                    raise ValueError(f"{len(part)} vectors for {len(texts[i : i + e.batch])} texts")
                out += part
            if e.dim and any(len(v) != e.dim for v in out):
                raise ValueError(f"a vector has not {e.dim} dimensions")
            used = [e.count_tokens(t) if e.count_tokens else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float32())), pa.array(used, pa.int64())], names=[*b.schema.names, to, "tokens"])

    schema = rows.select("*", F.array(F.lit(0.0).cast("float")).alias(to), F.lit(0).cast("long").alias("tokens")).schema
    return rows.mapInArrow(run, schema)


def embed_documents(docs: DataFrame, e: Embedder, text: str = "content") -> DataFrame:
    """``docs`` with ``embedding`` and ``tokens``, in batches of the embedder's size."""
    return _embed(docs, e.fn, e, text, "embedding")


def embed_queries(queries: DataFrame, e: Embedder, text: str = "query") -> DataFrame:
    return _embed(queries, e.query_fn or e.fn, e, text, "query_vec")


def dim_check(points: DataFrame) -> DataFrame:
    """Points by model and dimension; a sound collection has one dimension a model."""
    return points.groupBy("embed_model", F.size("embedding").alias("dim")).agg(F.count("*").alias("points"))


def reembed(points: DataFrame, e: Embedder) -> DataFrame:
    """Exported points with new vectors; identity and meta stay, the model's name and dimension do not."""
    out = embed_documents(chunks.export_points(points), e).drop("tokens")
    return out.withColumn("meta", chunks.inject_embed_meta(F.col("meta"), F.lit(e.model), F.size("embedding"), force=True))
