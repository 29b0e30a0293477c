"""Rows stored in key order with counts, so that a page far down reads only where it lies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTS = "part int, n long"


def write_pages(rows: DataFrame, order: list[str], path: str, parts: int = 64) -> None:
    """Store ``rows`` by ranges of ``order``, and how many each range has. The columns of ``order`` should tell rows
    apart; rows that they do not tell apart stay in one range."""
    ranged = rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    ranged.sortWithinPartitions("part", *order).write.partitionBy("part").parquet(f"{path}/rows")
    stored = rows.sparkSession.read.schema(ranged.schema).parquet(f"{path}/rows")
    stored.groupBy("part").agg(F.count("*").alias("n")).select("part", "n").write.parquet(f"{path}/counts")


def read_page(spark: SparkSession, path: str, order: list[str], offset: int = 0, limit: int = 0) -> DataFrame:
    """Rows from ``offset`` on, ``limit`` of them (0: all), in ``order``: only the ranges that hold them are opened, whatever the offset."""
    counts = sorted((r.part, r.n) for r in spark.read.schema(COUNTS).parquet(f"{path}/counts").collect())  # one for each range
    wanted, before, skipped = [], 0, 0
    for part, n in counts:
        if before + n <= offset:
            skipped += n
        elif limit <= 0 or before < offset + limit:
            wanted.append(part)
        before += n
    rows = spark.read.parquet(f"{path}/rows").where(F.col("part").isin(wanted)).drop("part")
    page = rows.orderBy(*order).offset(max(0, offset - skipped))
    return page.limit(limit) if limit > 0 else page
