"""Toxicity: a linear classifier of character n-grams, scaled by naive Bayes log-count ratios.

Texts are lower-cased; every run of 3 to 6 characters, spaces included, is hashed into
2**20 features, present or absent. On labelled rows the ratio r of a feature is the log of
its share among toxic rows over its share among others, with add-one smoothing. A logistic
regression (Spark ML) on the features times r then gives the weights; features whose shares
are within LEAST_ERRORS standard errors of each other tell nothing, and weigh nothing.

Nulls count as empty texts; texts without features score by the intercept alone. Repeated
rows are scored each. Texts of any length are read whole. Empty tables give empty results.
Other columns pass through untouched, whatever their names. With one class of labelled
rows only, the score is the smoothed share of toxic rows for every text. Without labelled
rows there is no evidence against any text: all score 0.25, and none is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barloom.llm.common import cut, release, ship

FEATURE_BITS = 20
LEAST, MOST = 3, 6
#: About so many labelled rows are fitted at most: where there are more, those whose hash is
#: in the first FIT_ROWS / rows of all hashes.
FIT_ROWS = 20_000
#: A feature is fitted if its shares in both classes are so many standard errors apart, however
#: many features are: what chance alone may have made would only hide the others (README).
LEAST_ERRORS = 4.0
#: Score of every text where there is nothing to learn from.
NO_EVIDENCE = 0.25
FIT_PARTS = 24
_multiplier = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None) -> np.ndarray:
    """The distinct features of a text."""
    return np.unique(_feature_runs(text))


def _feature_runs(text: str | None) -> np.ndarray:
    chars = np.frombuffer((" " + " ".join((text or "").lower().split()) + " ").encode("utf-32-le", "replace"), dtype="<u4").astype("u8")
    made, h = [], np.zeros(len(chars), dtype="u8")
    for n in range(1, MOST + 1):
        if len(chars) < n:
            break
        h = (h[: len(chars) - n + 1] + chars[n - 1 :] + np.uint64(n)) * _multiplier
        h ^= h >> np.uint64(29)
        if n >= LEAST:
            made.append((h >> np.uint64(64 - FEATURE_BITS)).astype("i4"))
    return np.concatenate(made) if made else np.empty(0, dtype="i4")


@dataclass
class Model:
    """intercept, and the weight of each feature (float32, 4 MB)."""

    intercept: float
    weights: np.ndarray


def held_out(id_col: str) -> Column:
    """True for the fold that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    count = np.zeros((2, 1 << FEATURE_BITS), dtype="i8")
    for batch in batches:
        for y, text in zip(batch.column(0), batch.column(1)):
            count[y.as_py()][features(text.as_py())] += 1
    at = np.flatnonzero(count.any(axis=0))
    for k in range(0, len(at), 100_000):
        part = at[k : k + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int64()), pa.array(count[0, part]), pa.array(count[1, part])], names=["feature", "clean", "toxic"]
        )


def _sample(rows: DataFrame, by: Column, most: int) -> DataFrame:
    share = min(1.0, most / max(1, rows.count()))
    return rows.where(F.pmod(by, F.lit(1 << 30)) < int(share * (1 << 30)))


def _sparse(at: list[np.ndarray], values: list[np.ndarray], size: int) -> pa.StructArray:
    """Sparse vectors as Arrow has them: the fields are those of the vector type."""
    n, column = len(at), lambda x, t: pa.array(x, pa.list_(pa.field("element", t, False)))
    fields = {"indices": column(at, pa.int32()), "values": column(values, pa.float64())}
    return pa.StructArray.from_arrays(
        [pa.array([0] * n, pa.int8()), pa.array([size] * n, pa.int32()), *fields.values()],
        fields=[pa.field("type", pa.int8(), False), pa.field("size", pa.int32()), *(pa.field(k, v.type) for k, v in fields.items())],
    )


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", fit_rows: int | None = FIT_ROWS, least_errors: float = LEAST_ERRORS) -> Model:
    """Learns from text_col and label_col (0 or 1; other labels are left out) alone.

    The counts are made in Spark; of the 2**FEATURE_BITS features at most, those that tell the
    labels apart by least_errors reach the driver. The sample's bound is fit_rows (None: rows is a
    sample already), the only limit on what is learned from.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import VectorUDT

    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(
        F.col(label_col).cast("int").alias("y"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")
    )
    if fit_rows is not None:
        rows = _sample(rows, F.xxhash64("t"), fit_rows)
    sample = cut(rows.repartition(FIT_PARTS))
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    flat = np.zeros(1 << FEATURE_BITS, dtype="f4")
    if not clean and not toxic:
        return Model(float(np.log(NO_EVIDENCE / (1 - NO_EVIDENCE))), flat)
    if not clean or not toxic:
        return Model(float(np.log((toxic + 1) / (clean + 1))), flat)
    ratio = F.log((F.col("toxic") + 1) / (toxic + 2)) - F.log((F.col("clean") + 1) / (clean + 2))
    share = (F.col("toxic") + F.col("clean")) / (toxic + clean)
    apart, error = F.abs(F.col("toxic") / toxic - F.col("clean") / clean), F.sqrt(share * (1 - share) * (1 / toxic + 1 / clean))
    chosen = (
        sample.mapInArrow(_counts, "feature long, clean long, toxic long")
        .groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .withColumn("r", ratio)
        .where((apart >= least_errors * error) & (share < 1))
        .where("r <> 0")
        .select("feature", "r")
        .toPandas()
    )
    if chosen.empty:
        return Model(float(np.log((toxic + 1) / (clean + 1))), flat)
    by = dict(zip(chosen["feature"].tolist(), chosen["r"].tolist()))
    at = np.array(sorted(by), dtype="i8")
    ratios = np.array([by[f] for f in at.tolist()])

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            own = [np.searchsorted(at, np.intersect1d(features(t.as_py()), at, assume_unique=True)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.float64()), _sparse(own, [ratios[k] for k in own], len(at))], names=["y", "x"])

    vectors = cut(sample.mapInArrow(scaled, StructType([StructField("y", DoubleType()), StructField("x", VectorUDT())])))
    fitted = LogisticRegression(featuresCol="x", labelCol="y", maxIter=60, regParam=1e-3, standardization=False).fit(vectors)
    flat[at] = fitted.coefficients.toArray() * ratios
    return Model(float(fitted.intercept), flat)


def _scores(held, texts: pa.Array) -> np.ndarray:
    intercept, weights = held.value
    used = weights != 0
    made = []
    for text in texts:
        own = _feature_runs(text.as_py())
        own = np.unique(own[used[own]])
        made.append(1 / (1 + np.exp(-(intercept + float(weights[own].sum(dtype="f8"))))))
    return np.array(made, dtype="f8")


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and predicted (1 from 0.5 on) of every row."""
    ship(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast((model.intercept, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            out = _scores(held, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out), pa.array((out >= 0.5).astype("i4"))], names=["id", "score", "predicted"]
            )

    id_type = df.schema[id_col].dataType.simpleString()
    return (
        df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(run, f"id {id_type}, score double, predicted int")
        .toDF(id_col, "score", "predicted")
    )


def drop_toxic(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of df that score below 0.5, all columns as they are."""
    ship(df.sparkSession)
    held, at = df.sparkSession.sparkContext.broadcast((model.intercept, model.weights)), df.columns.index(text_col)
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            yield batch.filter(pa.array(_scores(held, batch.column(at)) < 0.5))

    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def train_outside_fold(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from the labelled rows that are not held out. An id with several labels counts
    as toxic if any of them says so.

    The labels are sampled before the texts are read, so that the sample can be broadcast:
    it has FIT_ROWS pairs of id and label, give or take its chance.
    """
    known = labels.where(~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    known = _sample(known, F.xxhash64(id_col), FIT_ROWS)
    return train(docs.select(id_col, text_col).join(F.broadcast(known), id_col), text_col, "y", fit_rows=None)
