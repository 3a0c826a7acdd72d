"""Market metrics: funding, open interest and liquidations, and the as-of join to bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import HOUR_MS, ratio


def funding_zscore(rows: DataFrame, n: int = 30) -> DataFrame:
    """rows(symbol, open_time_ms, funding_rate): against the n non-null rates before each;
    null before there are n, 0 without spread."""
    w = Window.partitionBy("symbol").orderBy("open_time_ms")
    frame = w.rowsBetween(-n, -1)
    mean, std = F.avg("funding_rate").over(frame), F.stddev_pop("funding_rate").over(frame)
    z = F.when(F.row_number().over(w) > n, F.when(std > 0, (F.col("funding_rate") - mean) / std).otherwise(0.0))
    return rows.where("funding_rate is not null").withColumn("funding_rate_zscore", z)


def oi_delta(rows: DataFrame, back: int) -> DataFrame:
    """rows(symbol, open_time_ms, open_interest): change in percent against `back` rows before."""
    before = F.lag("open_interest", back).over(Window.partitionBy("symbol").orderBy("open_time_ms"))
    return rows.withColumn("oi_delta_pct", F.when(before > 0, ratio(F.col("open_interest") - before, before) * 100))


def liquidations_hourly(orders: DataFrame) -> DataFrame:
    """orders(symbol, time, side, cents, qty): long (SELL, in any case) and short USD by hour."""
    usd = F.col("cents") * F.col("qty")
    sold = F.upper("side") == "SELL"
    total = lambda c: F.coalesce(F.sum(F.when(c, usd)), F.lit(0)).cast("double") / 100
    return orders.groupBy("symbol", (F.col("time") - F.pmod(F.col("time"), F.lit(HOUR_MS))).alias("open_time_ms")).agg(
        total(sold).alias("long_liquidation_usd"), total(~sold).alias("short_liquidation_usd")
    )


def merge_metrics(*parts: DataFrame) -> DataFrame:
    """Metric tables of one key as one row a key: columns of the same hour are merged."""
    names = ["funding_rate_zscore", "oi_delta_pct", "long_liquidation_usd", "short_liquidation_usd"]
    whole = None
    for p in parts:
        row = p.select("symbol", "open_time_ms", *((F.col(c) if c in p.columns else F.lit(None)).cast("double").alias(c) for c in names))
        whole = row if whole is None else whole.unionByName(row)
    return whole.groupBy("symbol", "open_time_ms").agg(*(F.max(c).alias(c) for c in names))


def as_of(bars: DataFrame, facts: DataFrame, name: str, tie: str | None = None, slice_ms: int | None = None) -> DataFrame:
    """bars with the latest row of facts (symbol, open_time_ms, ...) at or before each, as a
    struct. The whole row is taken, nulls and all. Among rows of one time the last by tie.

    Facts and bars of a symbol are merged in order of time. With slice_ms a symbol's history
    is cut into slices that are merged apart; each slice starts with the last fact before it,
    so that one hot symbol is spread over many tasks.
    """
    cols = [c for c in facts.columns if c != "symbol"]
    fact = facts.select("symbol", "open_time_ms", F.struct(*cols).alias("f"), (F.col(tie).cast("string") if tie else F.lit("")).alias("tie"))
    slot = F.floor(F.col("open_time_ms") / slice_ms) if slice_ms else F.lit(0)
    left = bars.select("symbol", "open_time_ms", F.struct(*bars.columns).alias("b"))
    both = left.select("symbol", "open_time_ms", "b", F.lit(None).cast(fact.schema["f"].dataType).alias("f"), F.lit(1).alias("kind"), F.lit("").alias("tie")).unionByName(
        fact.select("symbol", "open_time_ms", F.lit(None).cast(left.schema["b"].dataType).alias("b"), "f", F.lit(0).alias("kind"), "tie")
    ).withColumn("slot", slot.cast("long"))
    last = F.last("f", ignorenulls=True).over(
        Window.partitionBy("symbol", "slot").orderBy("open_time_ms", "kind", "tie").rowsBetween(Window.unboundedPreceding, 0)
    )
    found = both.withColumn("hit", last).where("kind = 1")
    if slice_ms:
        ends = both.where("kind = 0").groupBy("symbol", "slot").agg(F.max_by("f", F.struct("open_time_ms", "tie")).alias("end"))
        slots = both.select("symbol", "slot").distinct().join(ends, ["symbol", "slot"], "left")
        carried = slots.withColumn("carry", F.last("end", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)))
        found = found.join(carried.select("symbol", "slot", "carry"), ["symbol", "slot"]).withColumn("hit", F.coalesce("hit", "carry"))
    return found.select("b.*", F.col("hit").alias(name))


def eight_hourly_funding(bars: DataFrame) -> DataFrame:
    """A funding series out of bars: the scaled mean close of each eight hours. The scale is
    a prime, so that no rate lies halfway between two roundings."""
    slot = F.col("open_time_ms") - F.pmod(F.col("open_time_ms"), F.lit(8 * HOUR_MS))
    cents = F.sum(F.round(F.col("close") * 100).cast("long")).cast("double")
    return bars.groupBy("symbol", slot.alias("open_time_ms")).agg((cents / F.count("*") / 700_001).alias("funding_rate"))


def open_interest(bars: DataFrame) -> DataFrame:
    """An open-interest series out of bars: trades so far, each hour."""
    w = Window.partitionBy("symbol").orderBy("open_time_ms").rowsBetween(Window.unboundedPreceding, 0)
    return bars.select("symbol", "open_time_ms", F.sum("trade_count").over(w).cast("double").alias("open_interest"))
