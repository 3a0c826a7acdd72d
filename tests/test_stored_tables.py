"""Replaced and growing tables: failed and overtaken writes, daily increments, saved rules."""

import json
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import increments as inc
from barloom.operators import patterns as pt
from barloom.operators import rules as ru
from barloom.operators import volume as vo
from barloom.sources import files, versions
from barloom.streaming import ledger

SCHEMA = "k string, v int"
BARS = "symbol string, timeframe string, open_time_ms long, open double, high double, low double, close double, volume double"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def content(spark, path):
    return sorted(tuple(r) for r in versions.read(spark, path, SCHEMA).collect())


def test_a_failed_write_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    assert content(spark, path) == []
    versions.replace(spark, path, SCHEMA, frame(spark, ("a", 1), ("b", 2)), F.lit(True))
    versions.replace(spark, path, SCHEMA, frame(spark, ("a", 3)), F.col("k") == "a")
    want = [("a", 3), ("b", 2)]
    assert content(spark, path) == want
    reader = versions.read(spark, path, SCHEMA)
    # the rows cannot be made
    bad = frame(spark, ("a", 0)).withColumn("v", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        versions.replace(spark, path, SCHEMA, bad, F.col("k") == "a")
    assert content(spark, path) == want
    # the rows are written, and the writer dies before the pointer is
    with monkeypatch.context() as m:
        m.setattr(versions.files, "put_new", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            versions.replace(spark, path, SCHEMA, frame(spark, ("a", 9)), F.col("k") == "a")
    assert content(spark, path) == want
    # it dies inside the pointer: that one counts for nothing, and the next write goes after it
    number, _ = versions.current(spark, path)
    assert files.put_new(spark, f"{path}/pointers/{number + 1}", "half a na")
    assert content(spark, path) == want
    versions.replace(spark, path, SCHEMA, frame(spark, ("c", 4)), F.col("k") == "b")
    assert content(spark, path) == [("a", 3), ("c", 4)]
    # who reads an older version goes on reading it
    assert sorted(tuple(r) for r in reader.collect()) == want


def test_an_overtaken_write_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.swap(frame(spark, ("a", 1)), path, 0)
    number, _ = versions.current(spark, path)
    versions.swap(frame(spark, ("a", 2)), path, number)
    with pytest.raises(versions.Overtaken):
        versions.swap(frame(spark, ("a", 3)), path, number)
    assert content(spark, path) == [("a", 2)]
    for v in range(3):
        versions.replace(spark, path, SCHEMA, frame(spark, ("a", v)), F.lit(True))
    assert len(versions.purge(spark, path, keep=2)) == 3 and content(spark, path) == [("a", 2)]
    assert len(files.names(spark, f"{path}/versions")) == 2


def test_saved_rules(spark, tmp_path):
    path = str(tmp_path / "rules")
    schema = "symbol string, timeframe string, candidate int, sample_count long, win_rate double, avg_return double, profit_factor double"
    at = {ru.candidates()[k][0].signature: k for k in range(29)}
    found = [("A", "1h", 0, 40, 0.61234, 0.456, 1.234), ("A", "1h", 30, 11, 0.5, 0.1, 2.0), ("B", "1h", 1, 10, 0.75, 0.2, 3.0)]
    df = spark.createDataFrame(found, schema)
    assert ru.save_discovered(df, path, "A", "1h", 1) == 2 and ru.save_discovered(df, path, "B", "1h", 1) == 1
    own = versions.read(spark, path, ru.STORED_RULES).limit(1).withColumns({"name": F.lit("mine"), "is_auto_discovered": F.lit(False), "symbol": F.lit("A")})
    versions.replace(spark, path, ru.STORED_RULES, own, F.lit(False))
    assert ru.save_discovered(df.where("candidate = 30"), path, "A", "1h", 2) == 1
    # a run that finds nothing leaves what is there
    assert ru.save_discovered(df.where("false"), path, "B", "1h", 3) == 0
    rows = {(r["symbol"], r["name"], r["created_ms"]): r for r in versions.read(spark, path, ru.STORED_RULES).collect()}
    first, second = ru.candidates()[30]
    name = f"{ru.label(first)} + {ru.label(second)}"
    assert set(rows) == {("A", "mine", 1), ("A", name, 2), ("B", "2higher_close", 1)} and at
    r = rows["B", "2higher_close", 1]
    assert r["description"] == "Auto-discovered: 2higher_close | Future 3 bars | WinRate=75.0% AvgRet=0.20 Samples=10 PF=3.00"
    assert (r["required_bars"], r["is_enabled"], r["cooldown_minutes"], r["action"]) == (10, True, 60, "ALERT")
    assert ru.parse_conditions(rows["A", name, 2]["conditions"]) == (first, second)
    assert json.loads(r["conditions"]) == [{"type": "consecutive_bars", "direction": "higher_close", "count": 2, "barOffset": 0}]


def test_labels():
    c = ru.Condition
    assert [ru.label(x) for x in (
        c("volume_compare", operator="gt", multiplier=1.2), c("range_compare", operator="lt", multiplier=0.7), c("body_ratio", operator="gt", value=0.55),
        c("shadow_ratio", side="upper", multiplier=2.0), c("close_position", position="top_25"), c("other"),
    )] == ["Vol>1.2x", "Range<70", "Body>55", "upperWick>2x", "Closetop_25", "other"]


def bars(spark, days=24, seed=3):
    draw, rows = random.Random(seed), []
    for symbol in ("a", "b", "late"):
        price = 50.0
        for h in range(days * 6):
            if draw.random() < 0.15 or symbol == "late" and h < 40:
                continue
            opened, price = price, max(5.0, price + draw.choice([-3, -1, 0, 1, 3]) + (2 if h // 9 % 2 else -2))
            rows.append((symbol, "4h", h * 4 * 3_600_000, opened, max(opened, price) + draw.choice([0, 1]), min(opened, price) - draw.choice([0, 1]), price, float(draw.randint(0, 20))))
    return spark.createDataFrame(rows, BARS)


def rows_of(df, names):
    return sorted(tuple(None if v is None else str(v) if not isinstance(v, float) else round(v, 9) for v in r) for r in df.select(*(n.split()[0] for n in names.split(", "))).collect())


def test_daily_increments_are_the_whole_index(spark, tmp_path):
    df = bars(spark)
    volume, patterns = str(tmp_path / "v"), str(tmp_path / "p")
    ends = [0, 1, 2, 5, 6, 13, 14, 23, 24]
    for k, day in enumerate(ends):
        part = df.where(F.col("open_time_ms") < day * 86_400_000)
        assert inc.index_volume(part, volume, k) and inc.index_patterns(part, patterns, k)
        assert not inc.index_volume(df, volume, k)
    got = rows_of(ledger.read(spark, patterns, inc.PATTERNS), inc.PATTERNS)
    assert got == rows_of(pt.recognise_daily(df), inc.PATTERNS) and len(got) > 50
    assert rows_of(ledger.read(spark, volume, inc.VOLUME), inc.VOLUME) == rows_of(vo.volume_stats(df), inc.VOLUME)


def test_an_increment_reads_its_tail(spark):
    df = bars(spark)
    marks = df.where("symbol <> 'late'").groupBy("symbol", "timeframe").agg((F.max("open_time_ms") - 10 * 3_600_000).alias("mark"))
    rows = inc.tail(df, marks, 7).groupBy("symbol", "_new").count().collect()
    assert {(r["symbol"], r["_new"]): r["count"] for r in rows if not r["_new"]} == {("a", False): 7, ("b", False): 7}
    assert {r["symbol"] for r in rows if r["_new"]} == {"a", "b", "late"}
