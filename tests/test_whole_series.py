"""Vectors and components of every series."""

import numpy as np
import pytest

import __spark_entry__ as entry
from barloom.operators import pca as pc
from barloom.operators import vectors as ve
from barloom.plans import catalogue as ca

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["open", "high", "low", "close", "all", "returns_shape", "returns_log", "volume_norm"])
def test_vectors_of_every_series(spark, name):
    got = {r[0] for r in entry.queries()[f"by_series_window_vectors_{name}"](spark, SF_DIR).select("symbol").distinct().collect()}
    assert f"by_series_window_vectors_{name}" in entry.oracle_sql()
    types = {r[0] for r in spark.read.parquet(f"{SF_DIR}/events.parquet").select("event_type").distinct().collect()}
    assert got == {"ALL", *types}


def test_components_of_each_series(spark):
    draw = np.random.default_rng(1)
    rows = [(s, "1h", i, i + 9, draw.normal(size=8).astype("f4").tolist()) for s, n in (("a", 150), ("b", 120), ("c", 99)) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, start_time_ms long, end_time_ms long, vector array<float>")
    got = {(r["symbol"], r["start_time_ms"]): r["pca"] for r in pc.principal_components(df).collect()}
    assert {s for s, _ in got} == {"a", "b"} and len(got) == 270
    for s in "ab":
        x = np.array([r[4] for r in rows if r[0] == s], dtype="f8")
        x -= x.mean(axis=0)
        loads = np.linalg.svd(x, full_matrices=False)[2][:5]
        loads *= np.sign(loads[np.arange(5), np.abs(loads).argmax(axis=1)])[:, None]
        assert np.allclose([got[s, i] for i in range(len(x))], x @ loads.T, atol=1e-6)


def test_components_query(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(ca.ve, "window_vectors", lambda bars, f, n, made=ve.window_vectors: (asked.append((f, n)), made(bars, f, n))[1])
    rows = entry.queries()["pca_components"](spark, "/root/testdata/sf0.01").collect()
    got = {r[0] for r in rows}
    assert asked == [("returns_shape", 25)] and "ALL" in got and len(got) > 1
    assert all(r[f"pca{k}"] is not None for r in rows for k in range(1, 6))
