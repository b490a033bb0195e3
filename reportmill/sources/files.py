"""Small files by the file system that a path belongs to: list, read, delete, and commit by a rename that fails if the name is there."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Taken(Exception):
    """A file of that name is there already."""


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it is not there."""
    target, system = _path(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(target)) if system.exists(target) else []


def read(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    target, system = _path(spark, path)
    stream = system.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    target, system = _path(spark, path)
    system.delete(target, True)


def commit(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole or not at all; raises Taken if it exists. Atomic where the file system's rename is."""
    jvm = spark.sparkContext._jvm
    folder, name = path.rsplit("/", 1)
    draft, system = _path(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    final, _ = _path(spark, path)
    out = system.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, final, plain)
    except Exception as e:
        system.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise Taken(name) from e
        raise
