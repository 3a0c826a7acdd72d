"""Indicators of series in slices against one pass over each series, bar by bar."""

import math
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators as ti
from barloom.operators import recursions as rc
from barloom.operators import slices as sl

SCHEMA = "symbol string, timeframe string, open_time_ms long, open double, high double, low double, close double, volume double"


def made_series(symbol, n, seed, missing=()):
    draw, price, rows = random.Random(seed), 100.0, []
    t = 1_700_000_000_000
    for i in range(n):
        opened, price = price, max(1.0, price + draw.choice([0, -1.5, 1.25, draw.gauss(0, 2)]))
        t += 3_600_000 * draw.choice([1, 1, 1, 5])
        close = None if i in missing else round(price, 2)
        rows.append((symbol, "1h", t, opened, max(opened, price) + draw.random(), min(opened, price) - draw.random(), close, float(draw.randint(0, 500))))
    return rows


def ema(x, period):
    out, seed, state = [], [], None
    for v in x:
        if v is None:
            out.append(None)
            continue
        if state is None:
            seed.append(v)
            state = sum(seed) / period if len(seed) == period else None
        else:
            state += (v - state) * 2 / (period + 1)
        out.append(state)
    return out


def rsi(close, period=14):
    out, gain, loss = [None] * len(close), 0.0, 0.0
    for i in range(1, len(close)):
        up, down = max(close[i] - close[i - 1], 0.0), max(close[i - 1] - close[i], 0.0)
        if i < period:
            gain, loss = gain + up, loss + down
            if i == period - 1:
                gain, loss = gain / period, loss / period
            continue
        keep = 1 if i == period else period - 1
        gain, loss = (gain * keep + up) / period, (loss * keep + down) / period
        out[i] = 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
    return out


def step_by_step(rows):
    """The indicators of one series, from its rows in order."""
    close = [r[6] for r in rows]
    out = {f"ema{p}": ema(close, p) for p in (12, 26, 50, 200)}
    out["macd"] = [None if a is None or b is None else a - b for a, b in zip(out["ema12"], out["ema26"])]
    out["macd_signal"] = ema(out["macd"], 9)
    tr, obv, total = [], [], 0.0
    for i, r in enumerate(rows):
        before = close[i - 1] if i else None
        back = r[3] if before is None else before
        tr.append(max(r[4] - r[5], abs(r[4] - back), abs(r[5] - back)))
        if r[6] is not None or before is None:
            total += r[7] if before is None or r[6] > before else -r[7] if r[6] < before else 0
        obv.append(total)
    out["obv"], out["obv_ema50"] = obv, ema(obv, 50)
    atr = [None] * len(tr)
    for i in range(14, len(tr)):
        atr[i] = sum(tr[:15]) / 15 if i == 14 else (atr[i - 1] * 13 + tr[i]) / 14
    out["atr14"] = atr
    if None not in close:
        out["rsi14"] = rsi(close)
        out["bollinger_middle"] = [None if i < 19 else sum(close[i - 19 : i + 1]) / 20 for i in range(len(close))]
    pv = [(r[4] + r[5] + r[6]) / 3 * r[7] if r[6] is not None else None for r in rows]
    if None not in pv:
        out["rolling_vwap24"] = [None if not sum(r[7] for r in rows[max(0, i - 23) : i + 1]) else sum(pv[max(0, i - 23) : i + 1]) / sum(r[7] for r in rows[max(0, i - 23) : i + 1]) for i in range(len(rows))]
    return out


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


@pytest.mark.parametrize("slice_bars", [37, 100, 4096])
def test_indicators_in_slices(spark, slice_bars):
    """A series of many slices, one that ends in its seeds, and ones with closes missing at the
    beginning, across a border, and for a slice in a row."""
    gaps = {"lead": range(130), "edge": [*range(20, 45), 99, 100, 101], "whole": range(100, 210)}
    series = {"long": made_series("long", 1000, 1), "short": made_series("short", 60, 2), "flat": [(*r[:6], 50.0, r[7]) for r in made_series("flat", 150, 3)]}
    series |= {k: made_series(k, 420, 4, set(v)) for k, v in gaps.items()}
    rows = [r for x in series.values() for r in x]
    random.Random(9).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["symbol"], r["open_time_ms"]): r for r in ti.technical_indicators(df, slice_bars=slice_bars).collect()}
    assert len(got) == len(rows)
    for symbol, own in series.items():
        for name, values in step_by_step(own).items():
            bad = [(i, got[symbol, r[2]][name], v) for i, (r, v) in enumerate(zip(own, values)) if not same(got[symbol, r[2]][name], v)]
            assert not bad, (symbol, name, bad[:3])


def test_no_group_is_larger_than_a_slice(spark):
    df = sl.placed(spark.createDataFrame(made_series("a", 1000, 5) + made_series("b", 250, 6), SCHEMA), bucket_ms=86_400_000)
    assert [tuple(r) for r in df.groupBy("symbol").agg(F.min("_i"), F.max("_i"), F.countDistinct("_i"), F.max("_n")).orderBy("symbol").collect()] == [
        ("a", 0, 999, 1000, 1000), ("b", 0, 249, 250, 250)
    ]
    cut = sl.sliced(df, before=3, after=2, slice_bars=100)
    assert cut.where("_own").count() == 1250
    sizes = cut.groupBy(*sl.SLICED).count().orderBy("symbol", "_slice").collect()
    assert [r["count"] for r in sizes] == [102, *[105] * 8, 103, 102, 105, 53]


def test_a_scan_in_blocks_is_the_recursion():
    draw = random.Random(2)
    for n in (0, 1, 63, 64, 65, 300):
        b, y, want = [draw.gauss(0, 1) for _ in range(n)], 3.0, []
        for x in b:
            y = 0.9 * y + x
            want.append(y)
        import numpy as np

        assert np.allclose(rc.affine_scan(np.array(b), 0.9, 3.0), want)
