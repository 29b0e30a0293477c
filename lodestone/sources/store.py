"""The shared folder, and the sinks of query metrics and logs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators import metrics
from lodestone.sources import files


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; a temporary one on a local master where none is named."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        sc = spark.sparkContext
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        where = sc.getCheckpointDir()
    return where.rstrip("/")


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read back; the files are deleted when the driver's JVM ends."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where, fs = files.locate(spark, path)
    fs.deleteOnExit(where)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def append_batch(rows: DataFrame, path: str, batch: str, order: list[str], key: str = "id") -> tuple[int, int]:
    """Sink of query metrics and logs: (first id, number) of the rows, which get ids that go on from those before, in ``order``.

    A batch is there once whatever happens: one that a retried job brings again is left as it is, rows of a write that
    broke off are never read, and of two writers at a time the later one takes the ids after the other's.
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    while True:
        log = _batches(spark, path)
        for b in log:
            if b["batch"] == batch:
                return b["first"], b["rows"]
        first = log[-1]["first"] + log[-1]["rows"] if log else 1
        staging, data = f"{path}/staging/{uuid.uuid4().hex}", uuid.uuid4().hex
        try:
            # numbers of sorted partitions rise from one to the next, and within each
            rows.drop(key).orderBy(*order).withColumn("__m", F.monotonically_increasing_id()).write.parquet(staging)
            there = spark.read.parquet(staging).withColumn("__part", F.shiftright("__m", 33))
            counts = there.groupBy("__part").agg(F.count("*").alias("__n"))
            before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            counts = counts.select("__part", "__n", before.alias("__before"))  # a row for each task of the write
            n = counts.agg(F.sum("__n")).first()[0] or 0
            number = (F.lit(first) + F.col("__before") + F.col("__m").bitwiseAND((1 << 33) - 1)).cast("long")
            there.join(counts, "__part").select(number.alias(key), *(c for c in rows.columns if c != key)).write.parquet(f"{path}/data/write={data}")
            files.put_json(spark, f"{path}/batches", f"{len(log):012d}", {"batch": batch, "first": first, "rows": n, "data": data})
            return first, n
        except files.AlreadyThere:
            files.remove(spark, f"{path}/data/write={data}")  # another batch has these ids: number the rows anew
        finally:
            files.remove(spark, staging)


def _batches(spark: SparkSession, path: str) -> list[dict]:
    return [files.read_json(spark, f"{path}/batches/{n}") for n in files.names(spark, f"{path}/batches") if n.isdigit()]


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches, of which there may be none."""
    path = path.rstrip("/")
    data = [f"{path}/data/write={b['data']}" for b in _batches(spark, path)]
    return spark.read.schema(schema).parquet(*data) if data else spark.createDataFrame([], schema)


def append_query_log(entries: DataFrame, path: str, batch: str, enabled: bool = False, order: tuple[str, ...] = ("ts",)) -> bool:
    """Append the entries that are not synthetic; a log that is not switched on stays untouched. Returns whether it is on."""
    if enabled:
        append_batch(metrics.logged(entries).drop("no_log") if "no_log" in entries.columns else entries, path, batch, list(order))
    return enabled


def read_query_log(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The log, or None where none was ever switched on (an empty log is a table without rows)."""
    return read_batches(spark, path, schema) if files.exists(spark, f"{path.rstrip('/')}/batches") else None
