"""Queries that run as streams over the events, which land slice by slice; each slice is a run of
its own that goes on from the checkpoint of the one before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalar import begun_ms, event_ms, tick_order
from barloom.operators import slices as sl
from barloom.plans import blocks as b
from barloom.plans.catalogue import KEYS, RULES, cols, query
from barloom.sources import fixtures as fx
from barloom.sources import tables as tb
from barloom.streaming import cycles, ledger, streams

SLICES = 4


def land(rows: DataFrame, at: str, folder: str, run: Callable[[], None]) -> None:
    """Rows land in SLICES equal stretches of time; after each of them the stream runs."""
    low, high = rows.agg(F.min(at), F.max(at)).first()
    if low is None:
        return
    width = (high - low) // SLICES + 1
    for k in range(SLICES):
        rows.where((F.col(at) >= low + k * width) & (F.col(at) < low + (k + 1) * width)).write.mode("append").parquet(folder)
        run()


def over_events(spark: SparkSession, d: str, label: str, run: Callable[[SparkSession, DataFrame, str], None], ms: Callable[[Column], Column] = event_ms) -> str:
    """Lands the events and runs a stream over them; run(session, events, path) starts it and waits.
    ms is how their times are read."""
    path, own = tb.work_path(spark, label), streams.stream_session(spark)
    events = fx.table(spark, d, "events").withColumn("t", ms(F.col("ts")))
    schema = events.schema

    def once() -> None:
        rows = own.readStream.schema(schema).parquet(f"{path}/landed")
        run(own, rows.withColumn("at", F.timestamp_millis("t")), path)

    land(events, "t", f"{path}/landed", once)
    return path


def closed_bars(rows: DataFrame) -> DataFrame:
    return streams.live_bars(rows, order=tick_order(F.col("t"), F.col("event_id")))


@query(f"""
WITH {b.bars()}, last AS (SELECT max(epoch_ms(ts)) - 600000 AS mark FROM events)
SELECT {KEYS}, trade_count, {cols(["open", "high", "low", "close", "volume"])} FROM bars, last WHERE symbol <> 'ALL' AND open_time_ms + 3600000 <= mark
""")
def stream_bars(spark, d):
    """Bars of each event type that the watermark has closed, as appended by the runs."""
    path = over_events(spark, d, "stream-bars", lambda own, rows, p: streams.finished(streams.to_table(closed_bars(rows), f"{p}/bars", f"{p}/checkpoint")))
    return spark.read.schema(cycles.LIVE).parquet(f"{path}/bars").select("symbol", "timeframe", "open_time_ms", "trade_count", "open", "high", "low", "close", "volume")


@query("""
WITH RECURSIVE hits AS (SELECT user_id::VARCHAR AS user_id, event_type AS type, epoch_us(ts) // 1000 AS t, value AS price FROM events WHERE value > 20),
through AS (
  SELECT user_id, type, min(t) AS t FROM hits GROUP BY user_id, type
  UNION ALL SELECT l.user_id, l.type, min(h.t) FROM through l JOIN hits h ON h.user_id = l.user_id AND h.type = l.type AND h.t > l.t + 2880 * 60000 GROUP BY l.user_id, l.type)
SELECT through.user_id, through.type, through.t, round(price, 6) + 0.0 AS price FROM through JOIN hits USING (user_id, type, t)
""")
def stream_cooldown(spark, d):
    """Hits of each user and event type over 20, two days apart at least."""

    def run(own, rows, p):
        hits = rows.where("value > 20").select(F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("type"), "t", F.col("value").alias("price"), F.lit(2880).alias("cooldown_minutes"))
        streams.finished(streams.to_table(streams.cooled_alerts(hits), f"{p}/alerts", f"{p}/checkpoint"))

    path = over_events(spark, d, "stream-alerts", run, begun_ms)
    return spark.read.schema(streams.ALERT).parquet(f"{path}/alerts")


def _payloads(spark, d) -> DataFrame:
    """Bars of the six timeframes as exchange payloads of a hundred bars, each with ten of the next."""
    out = None
    for timeframe in cycles.LIMITS:
        chunks = sl.sliced(sl.placed(fx.bars(spark, d, timeframe)), after=10, slice_bars=100)
        text = lambda c: F.col(c).cast("string")
        bar = F.array(*(text(c) for c in ("open_time_ms", "open", "high", "low", "close", "volume", "close_time_ms", "quote_volume", "trade_count", "taker_buy_volume", "taker_buy_quote_volume")))
        made = chunks.groupBy(*sl.SLICED).agg(F.to_json(F.collect_list(bar)).alias("payload"), F.min("open_time_ms").alias("landed_ms")).drop("_slice")
        out = made if out is None else out.unionByName(made)
    return out


@query(" UNION ALL ".join(
    f"SELECT {KEYS}, close_time_ms, trade_count, {cols(['open', 'high', 'low', 'close', 'volume', 'quote_volume', 'taker_buy_volume', 'taker_buy_quote_volume'])} FROM (WITH {b.bars(t)} SELECT * FROM bars)" for t in cycles.LIMITS
))
def ingestion_cycle(spark, d):
    """Payloads that overlap land slice by slice; every bar is stored once, and a batch that is
    run again adds nothing."""
    path, own = tb.work_path(spark, "ingestion"), streams.stream_session(spark)
    payloads = tb.stored(_payloads(spark, d), "payloads")

    def once() -> None:
        rows = own.readStream.schema(payloads.schema).parquet(f"{path}/landed")
        streams.finished(cycles.ingest_stream(rows, f"{path}/bars", f"{path}/checkpoint"))

    land(payloads, "landed_ms", f"{path}/landed", once)
    cycles.ingest(spark, payloads, f"{path}/bars", 0)
    return ledger.read(spark, f"{path}/bars", cycles.BARS).drop("batch")


@query(None)
def rule_stream(spark, d):
    """Signals of the rules over bars that a stream closes, batch by batch, with their cooldowns."""
    path = over_events(spark, d, "rule-stream", lambda own, rows, p: streams.finished(cycles.rule_stream(closed_bars(rows), p, f"{p}/checkpoint", RULES)))
    return ledger.read(spark, f"{path}/signals", cycles.SIGNALS)
