"""Streams run to their end on landed files, stopped and gone on from their checkpoints."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barloom.operators import alerts, rules
from barloom.plans import catalogue as ca
from barloom.sources import files
from barloom.sources import fixtures as fx
from barloom.streaming import cycles, ledger, streams

MINUTE = 60_000
EVENTS = "event_id long, ts timestamp_ntz, event_type string, value double"
BASE = dt.datetime(2024, 1, 1)


def ms(at):
    return int((at - BASE).total_seconds() * 1000) + 1_704_067_200_000


def runner(spark, folder, schema, start):
    """land(rows): the rows land as a file, and the stream runs from its checkpoint to the end."""
    own = streams.stream_session(spark)

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/landed")
        run = start(own.readStream.schema(schema).parquet(f"{folder}/landed"))
        streams.finished(run, 300)
        return run

    return land


def test_cooldown_over_runs_is_the_batch_anti_join(spark, tmp_path):
    draw, folder = random.Random(1), str(tmp_path)
    schema = "user_id string, type string, t long, price double, cooldown_minutes int"
    cooldown = {"a": 5, "b": 60}
    start = lambda rows: streams.to_table(streams.cooled_alerts(rows, "1 minute"), f"{folder}/out", f"{folder}/checkpoint")
    land = runner(spark, folder, schema, start)
    hits = [(u, k, 1_000_000 + MINUTE * draw.randint(0, 600), float(i), cooldown[u]) for i, (u, k) in enumerate([(draw.choice("ab"), draw.choice(["price_above", "rule:7"])) for _ in range(300)])]
    hits.append(("a", "edge", 1_000_000, 1.0, 5))
    hits.append(("a", "edge", 1_000_000 + 5 * MINUTE, 2.0, 5))
    hits = sorted({h[:3]: h for h in hits}.values(), key=lambda h: h[2])
    stored, made = spark.createDataFrame([], "user_id string, type string, created_at timestamp"), []
    for k in range(3):
        part = [h for h in hits if k * 200 * MINUTE <= h[2] - 1_000_000 < (k + 1) * 200 * MINUTE or k == 2 and h[2] - 1_000_000 == 600 * MINUTE]
        land(draw.sample(part, len(part)))
    for u, kind, t, price, minutes in hits:
        if all(not (x[0] == u and x[1] == kind and x[2] >= t - minutes * MINUTE) for x in made):
            made.append((u, kind, t, price))
    got = sorted(tuple(r) for r in spark.read.schema(streams.ALERT).parquet(f"{folder}/out").collect())
    assert got == sorted(made) and 0 < len(made) < len(hits)
    # the same decisions as the batch's anti-join, hit by hit
    for u, kind, t, price, minutes in random.Random(2).sample(hits, 12):
        before = [(x[0], x[1], dt.datetime.fromtimestamp(x[2] / 1000, dt.timezone.utc)) for x in made if x[2] < t]
        now = spark.createDataFrame([(u, "s", kind, price, t, minutes)], "user_id string, symbol string, type string, price_snapshot double, trigger_time_ms long, cooldown_minutes int")
        let = alerts.not_recent(now, stored.unionByName(spark.createDataFrame(before, stored.schema)) if before else stored, t).count()
        assert bool(let) == ((u, kind, t, price) in made)
    # cooldowns that are over hold no state
    held = lambda: {tuple(r["key"]) for r in spark.read.format("statestore").option("stateVarName", "last").load(f"{folder}/checkpoint").collect()}
    assert held()
    land([("z", "end", 10**9, 0.0, 1)])
    assert held() == {("z", "end")}


def test_bars_close_with_the_watermark(spark, tmp_path):
    """In append mode a bar is written once, when the watermark passes its end; rows that come in
    time are counted whatever their order, rows that come later are not."""
    folder = str(tmp_path)
    at = lambda h, m=0: BASE + dt.timedelta(hours=h, minutes=m)

    def start(rows):
        return streams.to_table(streams.live_bars(rows.withColumn("at", F.col("ts").cast("timestamp"))), f"{folder}/bars", f"{folder}/checkpoint")

    land = runner(spark, folder, EVENTS, start)
    closed = lambda: sorted((r["symbol"], r["open_time_ms"], r["open"], r["high"], r["low"], r["close"], r["volume"], r["trade_count"]) for r in spark.read.schema(cycles.LIVE).parquet(f"{folder}/bars").collect())
    land([(1, at(0, 5), "x", 5.0), (2, at(0, 30), "x", 9.0), (3, at(0, 59), "y", 1.5)])
    assert closed() == []
    # late by 50 minutes of events, but its hour is open still: the watermark was at 0:49
    land([(4, at(0, 50), "x", 2.0), (5, at(1, 5), "x", 4.0)])
    assert closed() == []
    land([(6, at(1, 30), "x", 3.0)])
    assert closed() == [("x", ms(at(0)), 5.0, 9.0, 2.0, 2.0, 16.0, 3), ("y", ms(at(0)), 1.5, 1.5, 1.5, 1.5, 1.5, 1)]
    # its hour is written: dropped; the other row counts
    land([(7, at(0, 58), "x", 100.0), (8, at(1, 25), "x", 8.0)])
    land([(9, at(4), "x", 1.0)])
    assert closed()[:2] == [("x", ms(at(0)), 5.0, 9.0, 2.0, 2.0, 16.0, 3), ("x", ms(at(1)), 4.0, 8.0, 3.0, 3.0, 15.0, 3)]
    assert len(closed()) == 3


def test_first_write_wins(spark, tmp_path):
    folder = str(tmp_path)
    schema = "k string, v long, at timestamp"
    start = lambda rows: streams.to_table(streams.first_only(rows, ["k"]), f"{folder}/out", f"{folder}/checkpoint")
    land = runner(spark, folder, schema, start)
    land([("a", 1, BASE), ("b", 2, BASE)])
    land([("a", 3, BASE + dt.timedelta(minutes=1)), ("c", 4, BASE)])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(f"{folder}/out").collect()) == [("a", 1), ("b", 2), ("c", 4)]


def test_liquidations_by_hour(spark, tmp_path):
    folder = str(tmp_path)
    schema = "at timestamp, side string, price double, qty double"
    start = lambda rows: streams.to_table(streams.live_liquidations(rows), f"{folder}/out", f"{folder}/checkpoint")
    land = runner(spark, folder, schema, start)
    land([(BASE, "sell", 2.0, 3.0), (BASE + dt.timedelta(minutes=3), "BUY", 5.0, 1.0), (BASE + dt.timedelta(minutes=59), "SELL", 1.0, 1.0)])
    land([(BASE + dt.timedelta(hours=2), "BUY", 1.0, 1.0)])
    assert [tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()] == [(ms(BASE), 7.0, 5.0)]


PAYLOADS = "symbol string, timeframe string, payload string, landed_ms long"


def kline(t, close, width=MINUTE):
    return [t, str(close), str(close + 1), str(close - 1), str(close), "10", t + width - 1]


def test_a_batch_counts_once(spark, tmp_path, monkeypatch):
    """A run is killed between its rows and its mark: the run after it writes the same batch
    again, readers never see it half, and a batch that counts adds nothing when it is repeated."""
    folder = str(tmp_path)
    land = runner(spark, folder, PAYLOADS, lambda rows: cycles.ingest_stream(rows, f"{folder}/bars", f"{folder}/checkpoint"))
    closes = lambda: sorted((r["symbol"], r["timeframe"], r["open_time_ms"], r["close"], r["batch"]) for r in ledger.read(spark, f"{folder}/bars", cycles.BARS).collect())
    land([
        ("S", "1m", json.dumps([kline(0, 5), kline(60_000, 6)]), 1), ("S", "1m", json.dumps([kline(60_000, 7)]), 2), ("S", "2m", json.dumps([kline(0, 1)]), 2),
        ("S", "1h", "no json", 1), ("S", "4h", None, 1), (None, "1m", "[]", 1),
    ])
    first = [("S", "1m", 0, 5.0, 0), ("S", "1m", 60_000, 7.0, 0)]
    assert closes() == first

    def killed(*_):
        raise RuntimeError("killed")

    real = files.put_new
    monkeypatch.setattr(ledger.files, "put_new", killed)
    with pytest.raises(Exception, match="killed"):
        land([("S", "1m", json.dumps([kline(60_000, 9), kline(120_000, 8)]), 3), ("T", "1d", json.dumps([kline(0, 3)]), 3)])
    assert closes() == first and ledger.batches(spark, f"{folder}/bars") == [0]
    monkeypatch.setattr(ledger.files, "put_new", real)
    land([("S", "1m", json.dumps([kline(180_000, 4)]), 4)])
    # the interrupted batch keeps its number and its rows; the later file makes the next batch
    assert closes() == [*first, ("S", "1m", 120_000, 8.0, 1), ("S", "1m", 180_000, 4.0, 2), ("T", "1d", 0, 3.0, 1)]
    again = spark.createDataFrame([("S", "1m", json.dumps([kline(240_000, 1)]), 9)], PAYLOADS)
    assert not cycles.ingest(spark, again, f"{folder}/bars", 1) and len(closes()) == 5


def test_rule_cycles_are_those_of_the_batch(spark, tmp_path):
    """Every batch's signals: the rules over the whole of what is stored by then, less those
    with a signal of the series in their cooldown."""
    folder = str(tmp_path)
    bars = [r for r in fx.bars(spark, "/root/testdata/sf0.01", "1h").where("symbol in ('click', 'view')").orderBy("open_time_ms").collect()][:160]
    names = [c.split()[0] for c in cycles.LIVE.split(", ")]
    land = runner(spark, folder, cycles.LIVE, lambda rows: cycles.rule_stream(rows, folder, f"{folder}/checkpoint", ca.RULES))
    stored, signals = [], []
    for k, size in enumerate((5, 31, 2, 60, 4, 58)):
        part, bars = bars[:size], bars[size:]
        land([tuple(r[n] for n in names) for r in part])
        stored += part
        touched = {r["symbol"] for r in part}
        fired = rules.evaluate(spark.createDataFrame([tuple(r[n] for n in names) for r in stored], cycles.LIVE), ca.RULES).collect()
        new = []
        for r in fired:
            made = r["trigger_time_ms"] + 3_600_000
            if r["symbol"] in touched and not any(s[0] == r["symbol"] and s[1] == r["rule_id"] and s[2] >= made - r["cooldown_minutes"] * MINUTE for s in signals):
                new.append((r["symbol"], r["rule_id"], made, k))
        signals += new
    got = sorted((r["symbol"], r["rule_id"], r["created_ms"], r["batch"]) for r in ledger.read(spark, f"{folder}/signals", cycles.SIGNALS).collect())
    assert got == sorted(signals) and len({s[3] for s in signals}) > 3


def test_rule_stream_query_is_its_batches(spark):
    rows = entry.queries()["rule_stream"](spark, "/root/testdata/sf0.001").collect()
    assert {r["name"] for r in rows} <= {r.name for r in ca.RULES} and all(r["created_ms"] == r["trigger_time_ms"] + 3_600_000 for r in rows)


def test_a_key_asks_its_state_once():
    """However many hits of a key a batch lets through, its state gets one timer and one value."""
    calls = []

    class Fake:
        def __getattr__(self, name):
            return lambda *a: calls.append((name, *a)) or (self if name == "getValueState" else None)

    cooldown = streams.Cooldown()
    cooldown.init(Fake())
    calls.clear()
    hits = [{"t": k * 2 * MINUTE, "price": 1.0, "cooldown_minutes": 1} for k in range(50)]
    assert [r["t"] for r in cooldown.handleInputRows(("u", "x"), iter(hits[::-1]), None)] == [h["t"] for h in hits]
    assert calls == [("get",), ("registerTimer", 99 * MINUTE + 1), ("update", (98 * MINUTE, 99 * MINUTE + 1))]
