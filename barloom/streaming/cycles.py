"""Cycles over streams: bars from landed payloads, and rules over stored tails of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import interval_ms
from barloom.operators import rules as ru
from barloom.operators.series import KEY, SERIES
from barloom.sources import landed
from barloom.sources.tables import append_new
from barloom.streaming import ledger

#: The timeframes of a cycle, and the bars that are asked for of each.
LIMITS = {"1m": 1000, "5m": 1000, "15m": 500, "1h": 500, "4h": 200, "1d": 100}
BARS = (
    "symbol string, timeframe string, open_time_ms long, close_time_ms long, open double, high double, low double, close double, "
    "volume double, quote_volume double, trade_count long, taker_buy_volume double, taker_buy_quote_volume double"
)
SIGNALS = "symbol string, timeframe string, trigger_time_ms long, close_price double, rule_id long, name string, priority int, cooldown_minutes int, created_ms long"
LIVE = "symbol string, timeframe string, open_time_ms long, open double, high double, low double, close double, volume double, trade_count long"


def ingest(spark: SparkSession, payloads: DataFrame, path: str, batch: int) -> bool:
    """One batch of landed payloads (symbol, timeframe, payload, landed_ms): bars whose key the
    table lacks are added. Of equal keys in a batch the one landed last stays. Payloads of other
    timeframes, and what cannot be read of a payload, add nothing and stop nothing."""
    rows = landed.klines_by_row(payloads.where(F.col("timeframe").isin(list(LIMITS))))
    return ledger.put(append_new(ledger.read(spark, path, BARS), rows.select(*(c.split()[0] for c in BARS.split(", "))), KEY), path, batch)


def ingest_stream(payloads: DataFrame, path: str, checkpoint: str):
    """Ingests all that has landed, batch by batch, then stops."""
    work = lambda rows, batch: ingest(rows.sparkSession, rows, path, batch)
    return payloads.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tails(spark: SparkSession, path: str, touched: DataFrame, bars: int) -> DataFrame:
    """The last bars of each touched series of a stored table."""
    newest = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("open_time_ms")))
    rows = ledger.read(spark, path, LIVE).join(touched.select(*SERIES).distinct(), SERIES, "left_semi")
    return rows.drop("batch").withColumn("_r", newest).where(F.col("_r") <= bars).drop("_r")


def rule_cycle(spark: SparkSession, closed: DataFrame, path: str, batch: int, rules: list[ru.Rule], least_bars: int = 50) -> bool:
    """One batch of closed bars: they are stored under path/bars, rules are evaluated over the
    last bars of the series that the batch has bars of, and what fires beyond its cooldown is
    stored under path/signals. A signal is made when its bar closes."""
    ledger.put(append_new(ledger.read(spark, f"{path}/bars", LIVE), closed, KEY), f"{path}/bars", batch)
    deep = [c.period or 0 for r in rules for c in r.conditions] + [(c.count or 0) + 1 - c.barOffset for r in rules for c in r.conditions]
    width = max([least_bars, *(r.required_bars for r in rules), *(d + 10 for d in deep)])
    fired = ru.evaluate(tails(spark, f"{path}/bars", closed, width), rules)
    ms = F.coalesce(*(F.when(F.col("timeframe") == t, F.lit(interval_ms(t))) for t in (*LIMITS, "30m")), F.lit(0))
    fired = fired.withColumn("created_ms", F.col("trigger_time_ms") + ms)
    signals = ledger.read(spark, f"{path}/signals", SIGNALS)
    return ledger.put(_beyond_cooldown(fired, signals).select(*(c.split()[0] for c in SIGNALS.split(", "))), f"{path}/signals", batch)


def _beyond_cooldown(fired: DataFrame, signals: DataFrame) -> DataFrame:
    """fired without rules of which the series has a signal since its time minus the cooldown."""
    s = signals.select(*(F.col(c).alias(f"s_{c}") for c in (*SERIES, "rule_id", "created_ms")))
    on = F.col("rule_id") == F.col("s_rule_id")
    for c in SERIES:
        on = on & (F.col(c) == F.col(f"s_{c}"))
    return fired.join(s, on & (F.col("s_created_ms") >= F.col("created_ms") - F.col("cooldown_minutes") * 60_000), "left_anti")


def rule_stream(closed: DataFrame, path: str, checkpoint: str, rules: list[ru.Rule]):
    """Runs the rule cycle on all closed bars that are there, batch by batch, then stops."""
    work = lambda rows, batch: rule_cycle(rows.sparkSession, rows, path, batch, rules)
    return closed.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
