"""Tables whose content is replaced at once.

A version is written whole to a folder of its own; then the next pointer, a numbered file that
must not be there yet, names it. Readers follow the last pointer that is complete. A write that
fails, or that another one overtook, leaves the table as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession

from barloom.sources import files
from barloom.sources.tables import replace_subset


class Overtaken(RuntimeError):
    """Another write was there first."""


def _pointers(spark: SparkSession, path: str) -> list[int]:
    return sorted((int(n) for n in files.names(spark, f"{path}/pointers") if n.isdigit()), reverse=True)


def _named(spark: SparkSession, path: str, number: int) -> str | None:
    """The version of a pointer; none where the pointer was not written to its end."""
    text = files.read_text(spark, f"{path}/pointers/{number}")
    return text[:-1] if text.endswith("\n") else None


def current(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """The number of the last pointer, and the version that counts; 0 and none at first."""
    found = _pointers(spark, path)
    return (found[0] if found else 0), next((v for v in (_named(spark, path, n) for n in found) if v), None)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    _, version = current(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/versions/{version}") if version else spark.createDataFrame([], schema)


def swap(rows: DataFrame, path: str, after: int) -> str:
    """Writes rows as the version that follows pointer `after`."""
    spark, version = rows.sparkSession, uuid.uuid4().hex
    rows.write.parquet(f"{path}/versions/{version}")
    if not files.put_new(spark, f"{path}/pointers/{after + 1}", version + "\n"):
        files.remove(spark, f"{path}/versions/{version}")
        raise Overtaken(path)
    return version


def replace(spark: SparkSession, path: str, schema: str, new: DataFrame, subset: Column) -> str:
    """The rows of subset go and new come, at once."""
    number, _ = current(spark, path)
    return swap(replace_subset(read(spark, path, schema), new, subset), path, number)


def purge(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Removes versions that none of the last `keep` complete pointers names; readers of older
    ones must have ended."""
    named = [v for v in (_named(spark, path, n) for n in _pointers(spark, path)) if v]
    old = [v for v in files.names(spark, f"{path}/versions") if v not in named[:keep]]
    for v in old:
        files.remove(spark, f"{path}/versions/{v}")
    return old
