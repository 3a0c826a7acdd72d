"""Principal components of every series' vectors in one job, and their place in the features.

Each task sums the vectors of a series and their products (the Gram matrix) as they pass; what
it sends on is one row a series. These are added up in two steps, so that no task takes more
than one row from each of FAN parts; the components come from one eigen solve a series, in
a worker. The projections are expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.series import KEY, SERIES

SUMS = "symbol string, timeframe string, part int, n long, dim int, total array<double>, gram array<double>"
#: Parts that partial sums are added in first.
FAN = 32
COMPONENTS = [f"pca_component{k}" for k in range(1, 6)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    for batch in batches:
        frame = batch.to_pandas()
        for (symbol, timeframe, dim), rows in frame.groupby(["symbol", "timeframe", "vector_dim"], sort=False):
            x = np.stack(rows["vector"].to_list()).astype("f8")
            n, total, gram = held.get((symbol, timeframe, dim), (0, 0.0, 0.0))
            held[symbol, timeframe, dim] = (n + len(x), total + x.sum(axis=0), gram + x.T @ x)
    part = TaskContext.get().partitionId() % FAN
    for (symbol, timeframe, dim), (n, total, gram) in held.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([symbol]), pa.array([timeframe]), pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([dim], pa.int32()), pa.array([total.tolist()]), pa.array([gram.ravel().tolist()])],
            names=[c.split()[0] for c in SUMS.split(", ")],
        )


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    first = rows.iloc[[0]].copy()
    first["n"] = rows["n"].sum()
    for c in ("total", "gram"):
        first[c] = pd.Series([np.sum(np.stack(rows[c].to_list()), axis=0).tolist()], index=first.index)
    return first


def gram_sums(vectors: DataFrame) -> DataFrame:
    """symbol, timeframe, dim, n, total and gram (row by row) of each series' vectors."""
    rows = vectors.where("vector is not null").select(*SERIES, F.size("vector").alias("vector_dim"), "vector")
    partial = rows.mapInArrow(_sums, SUMS)
    return partial.groupBy(*SERIES, "dim", "part").applyInPandas(_added, SUMS).groupBy(*SERIES, "dim").applyInPandas(_added, SUMS).drop("part")


def _solved(components: int):
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        n, dim = int(row["n"]), int(row["dim"])
        mean = np.asarray(row["total"]) / n
        spread = np.asarray(row["gram"]).reshape(dim, dim) - n * np.outer(mean, mean)
        values, axes = np.linalg.eigh((spread + spread.T) / 2)
        axes = axes[:, np.argsort(values)[::-1][:components]].T
        largest = axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)]
        axes = axes * np.where(largest < 0, -1.0, 1.0)[:, None]
        return pd.DataFrame([[row["symbol"], row["timeframe"], n, mean.tolist(), axes.tolist()]], columns=[*SERIES, "vectors", "mean", "axes"])

    return solve


def fit(vectors: DataFrame, components: int = 5, least: int = 100) -> DataFrame:
    """symbol, timeframe, vectors, mean, axes: the first components of each series of at least
    `least` vectors; the largest loading of each is positive."""
    sums = gram_sums(vectors).where(F.col("n") >= least)
    return sums.groupBy(*SERIES, "dim").applyInPandas(_solved(components), "symbol string, timeframe string, vectors long, mean array<double>, axes array<array<double>>")


def project(vectors: DataFrame, model: DataFrame) -> DataFrame:
    """symbol, timeframe, start_time_ms, end_time_ms, pca: centred vectors on their series' axes."""
    centred = F.zip_with("vector", "mean", lambda x, m: x.cast("double") - m)
    product = lambda axis: F.aggregate(F.zip_with("_c", axis, lambda x, a: x * a), F.lit(0.0), lambda s, x: s + x)
    return (
        vectors.join(model.select(*SERIES, "mean", "axes"), SERIES)
        .withColumn("_c", centred)
        .select(*SERIES, "start_time_ms", "end_time_ms", F.transform("axes", product).alias("pca"))
    )


def principal_components(vectors: DataFrame, components: int = 5, least: int = 100) -> DataFrame:
    return project(vectors, fit(vectors, components, least))


def write_back(features: DataFrame, projected: DataFrame) -> DataFrame:
    """features with pca_component1 to 5 of the window that ends with each bar. A bar that no
    window ends with keeps what it had; components that are not there are null."""
    new = projected.select(*SERIES, F.col("end_time_ms").alias("open_time_ms"), F.col("pca").alias("_pca"))
    had = features.withColumns({c: F.lit(None).cast("double") for c in COMPONENTS if c not in features.columns})
    value = lambda k, c: F.when(F.col("_pca").isNotNull(), F.get("_pca", F.lit(k))).otherwise(F.col(c)).alias(c)
    rest = [F.col(c) for c in had.columns if c not in COMPONENTS]
    return had.join(new, KEY, "left").select(*rest, *(value(k, c) for k, c in enumerate(COMPONENTS)))
