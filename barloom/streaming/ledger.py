"""Tables that micro-batches write exactly once.

A batch writes its rows to a folder of its own, and then a mark. Readers see marked batches
only. A batch that is run again after its mark is passed over; one that failed before it
overwrites its own folder. So each batch counts once, whenever a run is killed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources import files


def batches(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches that count."""
    return sorted(int(n) for n in files.names(spark, f"{path}/marks") if n.isdigit())


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches that count, with their batch."""
    counted = batches(spark, path)
    if not counted:
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(f"{path}/rows").where(F.col("batch").isin(counted))


def put(rows: DataFrame, path: str, batch: int) -> bool:
    """Writes a batch and its mark; false where it counts already."""
    spark = rows.sparkSession
    if files.exists(spark, f"{path}/marks/{batch}"):
        return False
    rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
    return files.put_new(spark, f"{path}/marks/{batch}", "")
