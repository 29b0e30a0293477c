"""Moving a collection to another model in batches that are each done once.

``start`` deals the points to batches and keeps them below a folder; ``run`` embeds the batches that are
left, one job each, and a batch counts as done when its output is whole. A migration that
was cut off goes on with a second ``run``: what is done is not embedded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from lodestone.operators import embed
from lodestone.sources import files


def start(points: DataFrame, path: str, batches: int = 16) -> None:
    """Deal exported points to ``batches`` by a hash of project and id; does nothing where that has been done."""
    spark = points.sparkSession
    if files.exists(spark, f"{path}/plan/_SUCCESS"):
        return
    batch = F.pmod(F.xxhash64("project_id", "id"), F.lit(batches)).cast("int").alias("batch")
    points.select("project_id", "id", "doc_id", "content", "meta", batch).hint("rebalance", F.col("batch")).write.mode("overwrite").partitionBy("batch").parquet(f"{path}/points")
    counts = spark.read.parquet(f"{path}/points").groupBy("batch").agg(F.count("*").alias("rows"))
    counts.write.mode("overwrite").parquet(f"{path}/plan")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """``batch, rows, done``."""
    whole = [n for n in files.names(spark, f"{path}/vectors") if files.exists(spark, f"{path}/vectors/{n}/_SUCCESS")]
    done = spark.createDataFrame([(int(n.removeprefix("batch=")),) for n in whole], "batch int").withColumn("done", F.lit(True))
    return spark.read.schema("batch int, rows long").parquet(f"{path}/plan").join(done, "batch", "left").withColumn("done", F.coalesce("done", F.lit(False)))


def run(spark: SparkSession, path: str, e: embed.Embedder, most: int | None = None) -> int:
    """Embed what is left, ``most`` batches at most; returns how many were done. Progress can be read meanwhile."""
    left = sorted(r.batch for r in ledger(spark, path).where("not done").collect())[:most]
    for b in left:
        points = spark.read.parquet(f"{path}/points/batch={b}")
        embed.reembed(points, e).write.mode("overwrite").parquet(f"{path}/vectors/batch={b}")
    return len(left)


def migrated(spark: SparkSession, path: str) -> DataFrame:
    """The points of all batches that are done, with their new vectors."""
    done = [r.batch for r in ledger(spark, path).where("done").collect()]
    schema = spark.read.parquet(f"{path}/points").select("project_id", "id", "content", "meta").schema.add("embedding", ArrayType(FloatType()))
    return spark.read.schema(schema).parquet(*(f"{path}/vectors/batch={b}" for b in done)) if done else spark.createDataFrame([], schema)


def progress(spark: SparkSession, path: str, run_id: str = "") -> DataFrame:
    """``run_id, batch, done, total``: points done after each batch, for ``metrics.progress``."""
    rows = ledger(spark, path)
    total = F.sum("rows").over(Window.partitionBy())
    so_far = F.sum(F.when(F.col("done"), F.col("rows")).otherwise(0)).over(Window.orderBy("batch"))
    counted = rows.select("batch", total.alias("total"), so_far.alias("so_far"), F.col("done").alias("there"))
    return counted.where("there").select(F.lit(run_id).alias("run_id"), "batch", F.col("so_far").alias("done"), "total")
