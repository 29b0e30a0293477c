"""Helpers that the training-data operators share.

Intermediate tables go to the shared folder that the session names in
``spark.checkpoint.dir``; they are plain Parquet, so a lost executor costs only
the tasks it was running.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lodestone.sources.store import shared_dir

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: Lower-cases A-Z and leaves every other byte alone.
ASCII_LOWER = bytes.maketrans(UPPER, LOWER)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame, size: int = 4 << 20) -> DataFrame:
    """``df`` itself; its session then hands rows to Python workers in batches of about ``size``
    bytes, however long texts are, unless it has a size of its own."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "67108864b":  # Spark's default
        conf.set(_BATCH, f"{size}b")
    return df


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _fs(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    return path


def _fs(spark: SparkSession, path: str):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)


def remove(spark: SparkSession, path: str) -> None:
    _fs(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: (table, its path)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text has none."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def in_chunks(batches, text: str, limit: int = 4 << 20):
    """Slices of Arrow batches of about ``limit`` text bytes each, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        part = (np.cumsum(size) - size) // limit
        cut = np.flatnonzero(np.diff(part)) + 1
        edges = [0, *cut.tolist(), n]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def set_aside(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with columns that bear the names of results to come renamed, by underscores at their end."""
    wanted, taken = {n.lower() for n in names}, {c.lower() for c in (*df.columns, *names)}
    made = []
    for c in df.columns:
        new = c
        while c.lower() in wanted and new.lower() in taken:
            new += "_"
        taken.add(new.lower())
        made.append(new)
    return df.toDF(*made)
