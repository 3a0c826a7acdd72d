"""Table operations: each takes the stored and the new rows and returns the rows to store.

Parquet has no keys; a write goes to a new version of the table, named by the caller, so
that a failed job leaves the old one whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append_new(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new whose key is not stored, the first of each key in new's order of keys:
    what an insert-only job appends."""
    one = F.row_number().over(Window.partitionBy(*keys).orderBy(*([c for c in new.columns if c not in keys] or keys)))
    return new.withColumn("_r", one).where("_r = 1").drop("_r").join(stored.select(*keys).distinct(), keys, "left_anti")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """stored with the named columns (all, unless named) of matching rows taken from new, and
    new's other rows. Columns that are not named keep their stored values."""
    named = [c for c in stored.columns if c not in keys] if columns is None else columns
    fresh = new.select(*(F.col(c).alias(f"_k_{c}") for c in keys), *(F.col(c).alias(f"_n_{c}") for c in new.columns if c not in keys), F.lit(True).alias("_new"))
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]
    both = stored.withColumn("_old", F.lit(True)).join(fresh, on, "full_outer")

    def value(c: str) -> Column:
        if c in keys:
            return F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_k_{c}"))
        taken = F.col(f"_n_{c}") if c in new.columns else F.lit(None)
        return F.when(F.col("_old") & (F.col("_new").isNull() | F.lit(c not in named)), F.col(c)).otherwise(taken)

    return both.select(*(value(c).alias(c) for c in stored.columns))


def replace_subset(stored: DataFrame, new: DataFrame, subset: Column) -> DataFrame:
    """stored without the rows of the subset, and new."""
    return stored.where(~F.coalesce(subset, F.lit(False))).unionByName(new)


def update(stored: DataFrame, where: Column, **values) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return stored.withColumns({c: F.when(hit, lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def delete(stored: DataFrame, where: Column) -> DataFrame:
    return stored.where(~F.coalesce(where, F.lit(False)))


def purge_versions(vectors: DataFrame, version: int) -> DataFrame:
    return vectors.where(F.col("version") == version)


def page(rows: DataFrame, order: list[Column], number: int, size: int, most_pages: int = 1000, most_rows: int = 200) -> DataFrame:
    number, size = min(max(number, 1), most_pages), min(max(size, 1), most_rows)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def write_version(rows: DataFrame, path: str, version: int, partition_by: list[str] | None = None) -> str:
    out = f"{path}/v{version}"
    writer = rows.write.mode("error")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(out)
    return out


def work_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder: spark.checkpoint.dir, or the warehouse where
    that is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, label: str) -> DataFrame:
    """The same rows from a table written to a new folder under the shared one: plans that
    build on them start from a scan, and survive lost executors."""
    path = work_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
