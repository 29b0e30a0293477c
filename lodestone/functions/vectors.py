"""Distances of vectors, in double precision."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.batches import slices
from lodestone.functions.text import tokens


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; null for a zero vector. Known norms save a pass over the vectors."""
    return dot(a, b) / F.nullif((norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b), F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)


def hash_embedding(rows: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """``key, embedding`` for every row: a deterministic stand-in for a model, hashed word counts scaled to length 1.

    A null text, or one without words, has the zero vector, which is near nothing. Each
    distinct word of a batch is hashed once, and all its texts are counted together.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for b in slices(batches, "words", 1 << 19):
            words = b.column("words")
            size = np.diff(np.asarray(words.offsets))
            flat = words.flatten().dictionary_encode()
            cell = np.array([int(hashlib.sha256(w.encode()).hexdigest()[:4], 16) % dim for w in flat.dictionary.to_pylist()], np.int64)
            at = np.repeat(np.arange(len(size)) * dim, size) + (cell[flat.indices.to_numpy()] if len(flat) else 0)
            n = np.bincount(at, minlength=len(size) * dim).reshape(-1, dim).astype(np.float64)
            length = np.sqrt((n * n).sum(1, keepdims=True))
            unit = np.divide(n, length, out=np.zeros_like(n), where=length > 0).astype(np.float32)
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * dim), pa.array(unit.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(key), made], names=[key, "embedding"])

    cut = rows.select(key, tokens(F.coalesce(text, F.lit(""))).alias("words"))
    return cut.mapInArrow(run, f"`{key}` {kind}, embedding array<float>")
