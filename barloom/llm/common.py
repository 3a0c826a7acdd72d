"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Largest file or table, in bytes, that may be sent whole to every executor.
BROADCAST_LIMIT = 32 * 1024 * 1024
#: Bytes of rows in an Arrow batch: an executor's JVM and its workers both hold a batch for each task.
BATCH_BYTES = 2 * 1024 * 1024


def ship(spark: SparkSession) -> None:
    """Lets Python workers that start from another folder import this package, and lets Spark
    delete a query's shuffle files when it ends: what is needed later is cut first. Rows reach
    the workers in batches of BATCH_BYTES."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or the
    warehouse where that is unset (as in a local test)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        set_dir = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint: later reads survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def file_broadcast(spark: SparkSession, path: str):
    """A vocabulary file as a broadcast variable; its size is checked first."""
    data = Path(path).read_bytes()
    if len(data) > BROADCAST_LIMIT:
        raise ValueError(f"{path} has {len(data)} bytes, more than {BROADCAST_LIMIT}")
    return spark.sparkContext.broadcast(data)


_kept: dict = {}


def kept(key: tuple, make: Callable):
    """What a worker keeps from task to task, one thing at a time: workers outlive a stage, and
    what an earlier one kept would count in the memory of the next."""
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Lets go of what an earlier stage kept, and gives free memory back to the system."""
    _kept.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)
