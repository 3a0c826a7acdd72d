"""The stored vector index and search over it, against vectors and all pairs made in one go."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import pca as pc
from barloom.operators import slices as sl
from barloom.operators import vector_index as vi
from barloom.operators import vectors as ve
from barloom.sources import files

SCHEMA = "symbol string, timeframe string, open_time_ms long, open double, high double, low double, close double, volume double"
START, HOUR = 1_700_000_000_000, 3_600_000


def series(symbol, n, seed, flat=()):
    draw, price, rows = random.Random(seed), 100.0, []
    for i in range(n):
        opened, price = price, 5.0 if i in flat else round(max(1.0, price + draw.choice([-2, -1, 1, 2])), 2)
        high, low = (5.0, 5.0) if i in flat and i - 1 in flat else (max(opened, price) + draw.choice([0, 0.5]), min(opened, price) - draw.choice([0, 0.5]))
        rows.append((symbol, "1h", START + i * HOUR, opened, high, low, price, float(draw.randint(1, 50))))
    return rows


@pytest.fixture
def bars(spark):
    rows = series("a", 900, 1, range(300, 340)) + series("b", 260, 2) + series("c", 15, 3) + series("d", 25, 4)
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def content(df):
    return sorted(tuple(r) for r in df.select("symbol", "feature_type", "window_size", "start_time_ms", "end_time_ms", F.col("vector").cast("string"), "vector_dim", "vector_norm", "version").collect())


def test_steps_make_the_same_index(spark, bars, tmp_path):
    features, sizes = ["close", "returns_shape"], [5, 10]
    whole, steps = str(tmp_path / "whole"), str(tmp_path / "steps")
    vi.update(spark, whole, bars, features, sizes, as_of_ms=1)
    at = [START + k * HOUR for k in (3, 120, 121, 700, 10_000)]
    for k, end in enumerate(at):
        vi.update(spark, steps, bars.where(F.col("open_time_ms") < end), features, sizes, as_of_ms=k)
    want = content(ve.vectors_of(bars, features, sizes))
    assert content(vi.read(spark, whole)) == want and content(vi.read(spark, steps)) == want
    # nothing new: nothing is written anew; a feature that is lacking is built from the beginning
    vi.update(spark, steps, bars, features, sizes, as_of_ms=99)
    assert vi.read(spark, steps).agg(F.max("updated_ms")).first()[0] == 4
    vi.update(spark, steps, bars, ["close", "all"], [5], as_of_ms=100)
    assert content(vi.read(spark, steps).where("feature_type = 'all'")) == content(ve.vectors_of(bars, ["all"], [5]))
    assert content(vi.read(spark, steps).where("feature_type <> 'all'")) == want
    status = {tuple(r)[:4]: tuple(r)[4:] for r in vi.status(spark, steps).collect()}
    assert status["b", "1h", "close", 5] == (256, 3) and status["c", "1h", "close", 5] == (11, 1) and status["b", "1h", "all", 5] == (256, 100)


def test_mended_bars_and_old_versions(spark, bars, tmp_path):
    path = str(tmp_path / "index")
    vi.update(spark, path, bars, ["close"], [5], as_of_ms=1)
    late = START + 880 * HOUR
    mended = bars.withColumn("close", F.when((F.col("symbol") == "a") & (F.col("open_time_ms") == late), F.col("high")).otherwise(F.col("close")))
    vi.update(spark, path, mended, ["close"], [5], as_of_ms=2, again_ms=30 * HOUR)
    assert content(vi.read(spark, path)) == content(ve.vectors_of(mended, ["close"], [5]))
    old = vi.read(spark, path).where("symbol = 'b'").withColumn("version", F.lit(1))
    old.write.mode("append").partitionBy(*vi.PARTS).parquet(path)
    before = vi.status(spark, path).collect()
    assert vi.purge(spark, path) == ["version=1"] and vi.purge(spark, path) == []
    assert {tuple(r) for r in vi.status(spark, path).collect()} == {tuple(r) for r in before}
    assert [n for n in files.names(spark, path) if n.startswith("version")] == [f"version={ve.VERSION}"]


def all_pairs(spark, bars, asked, feature, size, top_k, gap, lookback, stored=None):
    """(query, rank) -> (start, similarity), by comparing every query with every window."""
    place = {(r["symbol"], r["open_time_ms"]): r["_i"] for r in sl.placed(bars).collect()}
    rows = [r for r in ve.vectors_of(bars, [feature], [size]).collect()]
    by = {(r["symbol"], place[r["symbol"], r["start_time_ms"]]): (np.array(r["vector"], "f4"), np.float32(r["vector_norm"]), r["start_time_ms"]) for r in rows}
    out, counts = {}, {}
    for name, symbol, end in asked:
        last = place.get((symbol, end))
        if last is None or min(last + 1, lookback) < 2 * size or (symbol, last - size + 1) not in by:
            continue
        q, qn, _ = by[symbol, last - size + 1]
        low = max(0, last - lookback + 1)
        found = [i for i in range(low, last - size + 1) if (symbol, i) in by and (stored is None or (symbol, i) in stored)]
        found = found or [i for i in range(low, last - 2 * size + 2) if (symbol, i) in by]
        scored = []
        for i in found:
            v, n, t = by[symbol, i]
            over = float(n) * float(qn)
            scored.append((math.fsum((v * q).astype("f8")) / over if over > 0 else 0.0, t, i))
        counts[name] = len(scored)
        picks = []
        for s, t, i in sorted(scored, key=lambda x: (-round(x[0], 12), -x[1])):
            if len(picks) < top_k and all(abs(i - j) >= gap for _, _, j in picks):
                picks.append((s, t, i))
        for k, (s, t, _) in enumerate(picks):
            out[name, k + 1] = (t, s)
    return out, counts


@pytest.mark.parametrize("feature, size, gap, lookback", [("returns_shape", 10, None, 2000), ("close", 5, 3, 150), ("all", 8, 1, 2000)])
def test_many_queries_are_all_pairs(spark, bars, tmp_path, monkeypatch, feature, size, gap, lookback):
    monkeypatch.setattr(vi, "BLOCK", 128)
    monkeypatch.setattr(vi, "CHUNK", 40)
    ends = [(r["symbol"], r["open_time_ms"]) for r in bars.collect() if random.Random(f"{r['symbol']}{r['open_time_ms']}").random() < 0.1] + [("c", START + 14 * HOUR), ("a", 17), ("x", START)]
    asked = [(f"{s}@{t}", s, t) for s, t in ends]
    assert len(asked) > 100
    queries = spark.createDataFrame([(n, s, "1h", t) for n, s, t in asked], "query_id string, symbol string, timeframe string, end_time_ms long")
    got = vi.search(spark, str(tmp_path / "i"), bars, 0, queries, feature, size, 6, gap, lookback).collect()
    want, counts = all_pairs(spark, bars, asked, feature, size, 6, size if gap is None else gap, lookback)
    assert {(r["query_id"], r["rank"]) for r in got} == set(want)
    for r in got:
        start, similarity = want[r["query_id"], r["rank"]]
        assert r["start_time_ms"] == start and abs(r["similarity"] - similarity) < 1e-9 and r["scanned"] == counts[r["query_id"]] and r["from_index"]
        assert r["window_id"] == f"w_{start}_{start + (size - 1) * HOUR}" and abs(r["distance"] + r["similarity"] - 1) < 1e-12


def test_search_without_stored_windows(spark, bars, tmp_path):
    """An index that holds another series only: the bars' own windows are looked through, but
    for those that overlap the query."""
    path = str(tmp_path / "i")
    vi.update(spark, path, bars.where("symbol = 'a'"), ["close"], [10], as_of_ms=0)
    got = vi.search(spark, path, bars, 0, feature="close", size=10, top_k=4)
    rows = got.collect()
    assert {(r["symbol"], r["from_index"]) for r in rows} == {("a", True), ("b", False), ("d", False)}
    ends = {r["symbol"]: r["end_time_ms"] for r in vi.last_windows(bars, 10).collect()}
    want, _ = all_pairs(spark, bars, [(f"{s}/1h", s, e) for s, e in ends.items()], "close", 10, 4, 10, 2000, stored={("a", i) for i in range(900)})
    assert {(r["query_id"], r["rank"]): r["start_time_ms"] for r in rows} == {k: t for k, (t, _) in want.items()}
    with pytest.raises(ValueError):
        vi.search(spark, path, bars, 0, feature="no such")


def test_search_reads_its_partitions_only(spark, bars, tmp_path):
    path = str(tmp_path / "i")
    vi.update(spark, path, bars, ["close", "open"], [5, 10], as_of_ms=0)
    own = vi.read(spark, path).where((F.col("version") == ve.VERSION) & (F.col("feature_type") == "close") & (F.col("window_size") == 10))
    assert all("/feature_type=close/window_size=10/" in f for f in own.inputFiles()) or own.count() == content(own).__len__()
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "feature_type" in plan.split("PartitionFilters")[1][:300]


def test_components_are_those_of_the_svd(spark, bars):
    vectors = ve.window_vectors(bars, "returns_shape", 5)
    got = {(r["symbol"], r["start_time_ms"]): r["pca"] for r in pc.principal_components(vectors, 4).collect()}
    rows = vectors.collect()
    assert {k[0] for k in got} == {"a", "b"}
    for symbol in "ab":
        own = sorted((r["start_time_ms"], r["vector"]) for r in rows if r["symbol"] == symbol)
        x = np.array([v for _, v in own], "f8")
        x -= x.mean(axis=0)
        axes = np.linalg.svd(x, full_matrices=False)[2][:4]
        axes *= np.where(axes[np.arange(4), np.abs(axes).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
        assert np.allclose([got[symbol, t] for t, _ in own], x @ axes.T, atol=1e-8)


def test_components_in_the_features(spark, bars):
    features = bars.select("symbol", "timeframe", "open_time_ms", "close", F.lit(7.0).alias("pca_component2"))
    projected = pc.principal_components(ve.window_vectors(bars, "close", 5), 3)
    by_end = {(r["symbol"], r["end_time_ms"]): r["pca"] for r in projected.collect()}
    rows = pc.write_back(features, projected).collect()
    assert len(rows) == bars.count()
    for r in rows:
        p = by_end.get((r["symbol"], r["open_time_ms"]))
        assert tuple(r[c] for c in pc.COMPONENTS) == ((*p, None, None) if p else (None, 7.0, None, None, None))
