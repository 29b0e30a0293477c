"""Files to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import paths


def scan_corpus(spark: SparkSession, root: str, most: int = paths.MOST_BYTES) -> DataFrame:
    """``root, path, content, length`` of every file below ``root``; unreadable files are skipped.

    Bytes that are no UTF-8 become replacement characters. Files of more than ``most``
    bytes are listed with a null content and never read: the bound on ``length`` reaches the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(root)
    about = [F.lit(root.rstrip("/")).alias("root"), F.regexp_replace("path", "^file:/+", "/").alias("path")]
    read = files.where(F.col("length") <= most).select(*about, F.make_valid_utf8(F.col("content").cast("string")).alias("content"), "length")
    return read.unionByName(files.where(F.col("length") > most).select(*about, F.lit(None).cast("string").alias("content"), "length"))


def candidate_files(files: DataFrame) -> DataFrame:
    """Files that count as current: outside ignored directories, of a known kind, without secrets.

    Adds ``source_file`` and ``source_dir``. Size is judged later, so a file that has grown too
    large keeps what is stored of it.
    """
    f = files.withColumns({"source_file": paths.rel_path(F.col("root"), F.col("path")), "source_dir": paths.source_dir(F.col("root"))})
    name = paths.file_name(F.col("source_file"))
    return f.where(~paths.is_pruned(F.col("source_file")) & paths.is_indexable(name) & ~paths.is_sensitive(name))
