"""Small files beside large tables: what marks a version or a batch as there."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class AlreadyThere(RuntimeError):
    """Another writer has put the file there first."""


def locate(spark: SparkSession, path: str):
    """(Hadoop's path, its file system)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = locate(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What is in a folder, in order; nothing where there is none."""
    where, fs = locate(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def changed_at(spark: SparkSession, path: str) -> int:
    where, fs = locate(spark, path)
    return fs.getFileStatus(where).getModificationTime()


def remove(spark: SparkSession, path: str) -> None:
    where, fs = locate(spark, path)
    fs.delete(where, True)


def read_json(spark: SparkSession, path: str) -> dict:
    where, fs = locate(spark, path)
    stream = fs.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def put_json(spark: SparkSession, folder: str, name: str, content: dict) -> None:
    """Put a file there whole, or fail if one of its name is there."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    target, fs = locate(spark, f"{folder}/{name}")
    draft = jvm.org.apache.hadoop.fs.Path(f"{folder}/.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:  # without the option to overwrite, a rename onto a file fails
        context.rename(draft, target, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(target):
            raise AlreadyThere(f"{folder}/{name} is there already") from e
        raise
