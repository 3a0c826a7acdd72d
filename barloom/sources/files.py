"""Folders of stored tables, by the file system that Spark reaches them through."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder, by name, in order; nothing where there is no such folder."""
    fs, at = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.delete(at, True)


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file that must not be there yet: false, and nothing written, if it is.
    The file system makes it or refuses; stores without exclusive creation need one writer."""
    fs, at = _at(spark, path)
    try:
        out = fs.create(at, False)
    except Py4JJavaError as e:
        if fs.exists(at):
            return False
        raise OSError(str(e)) from e
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as it is."""
    fs, at = _at(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
