"""Joins on inequalities against all pairs, and frames in slices of any length."""

import math
import random

import pytest

from barloom.operators import alerts as al
from barloom.operators import patterns as pt
from barloom.operators import ranges as rg
from barloom.operators import volume as vo
from test_slices import SCHEMA, made_series

ODD = [0.0, -0.0, 1.0, 1.0 + 2**-30, 1.0 + 2**-52, -1.0, -1e-9, 1e300, -1e300, 3e12, 3e12 + 1, math.inf, -math.inf, math.nan, None]


def below(a, b):
    """As Spark orders doubles: NaN is the largest and equals itself."""
    if a is None or b is None or math.isnan(a):
        return False
    return math.isnan(b) or a < b


@pytest.mark.parametrize("deal_high", [False, True])
def test_less_pairs(spark, deal_high):
    draw = random.Random(5)
    lows, highs = ([*ODD, *(round(draw.gauss(0, 50), draw.randint(0, 3)) for _ in range(60))] for _ in range(2))
    low = spark.createDataFrame(list(enumerate(lows)), "i long, a double")
    high = spark.createDataFrame([*enumerate(highs), *enumerate(highs)], "j long, b double")
    got = sorted((r["i"], r["j"]) for r in rg.less_pairs(low, high, "a", "b", deal_high, salts=3).collect())
    assert got == sorted((i, j) for i, a in enumerate(lows) for j, b in enumerate(highs) if below(a, b) for _ in range(2))
    assert rg.less_pairs(low.limit(0), high, "a", "b", deal_high).count() == rg.less_pairs(low, high.limit(0), "a", "b", deal_high).count() == 0


def test_less_pairs_join_on_keys(spark):
    """No pair holds here; the plan joins on equal keys alone."""
    low, high = spark.range(1000, 3000).selectExpr("double(id) a"), spark.range(0, 1000).selectExpr("double(id) b")
    plan = rg.less_pairs(low, high, "a", "b")
    assert plan.count() == 0
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_band_pairs(spark):
    left, right = [-21, -20, -1, 0, 5, 5, 19, 20, None], [-20, -1, 0, 1, 18, 19, 20, 39, 40, 40, None]
    a, z = spark.createDataFrame([(x,) for x in left], "a long"), spark.createDataFrame([(x,) for x in right], "z long")
    got = sorted(map(tuple, rg.band_pairs(a, z, "a", "z", 20).collect()))
    assert got == sorted((x, y) for x in left for y in right if None not in (x, y) and 0 < y - x < 20)


def test_price_hits(spark):
    latest = spark.createDataFrame([("x", 10.0, 1), ("y", 20.0, 2), ("none", None, 3)], "symbol string, close double, trigger_time_ms long")
    settings = spark.createDataFrame(
        [("both", True, 5.0, 30.0, 1), ("at", True, 10.0, 10.0, 2), ("nothing", True, None, None, 3), ("off", False, 0.0, 99.0, 4)],
        "user_id string, enabled boolean, price_above double, price_below double, cooldown_minutes int",
    )
    got = sorted((r["user_id"], r["symbol"], r["type"], r["price_snapshot"], r["trigger_time_ms"]) for r in al.price_hits(latest, settings).collect())
    assert got == [
        ("at", "y", "price_above", 20.0, 2), ("both", "x", "price_above", 10.0, 1), ("both", "x", "price_below", 10.0, 1),
        ("both", "y", "price_above", 20.0, 2), ("both", "y", "price_below", 20.0, 2),
    ]


@pytest.mark.parametrize("of", [vo.volume_stats, pt.recognise, pt.recognise_daily])
def test_slices_change_nothing(spark, of):
    df = spark.createDataFrame([*made_series("a", 700, 1), *made_series("b", 8, 2), *made_series("c", 5, 3), *made_series("d", 1, 4)], SCHEMA)
    whole = sorted(map(tuple, of(df, 10_000).collect()), key=str)
    assert len(whole) > 100
    for n in (1, 7, 64):
        assert sorted(map(tuple, of(df, n).collect()), key=str) == whole
