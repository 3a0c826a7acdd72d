"""Reads of stored tables: bars around a time, pages of a dataset, rules and their timeframes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalar import interval_ms

#: The window sizes and horizons of stored datasets.
SIZES, HORIZONS = (5, 10, 15, 20, 25), ("1h", "4h", "1d")


def clamp(x: int, low: int, high: int) -> int:
    return max(low, min(high, x))


def bars_around(bars: DataFrame, symbol: str, timeframe: str, time_ms: int, before: int = 200, after: int = 200) -> DataFrame:
    """The bars of a series from before bars ahead of a time to after bars behind it, at most
    1000 from the first one on, with resolved_time_ms, the open time nearest to the time (the
    earlier of two)."""
    if time_ms <= 0:
        raise ValueError("time_ms")
    before, after, width = clamp(before, 0, 2000), clamp(after, 0, 2000), interval_ms(timeframe)
    near = bars.where((F.col("symbol") == symbol) & (F.col("timeframe") == timeframe) & F.col("open_time_ms").between(time_ms - before * width, time_ms + after * width))
    near = near.orderBy("open_time_ms").limit(clamp(before + after + 1, 1, 1000))
    nearest = F.min(F.struct(F.abs(F.col("open_time_ms") - time_ms).alias("d"), "open_time_ms"))
    # at most 1000 rows and one
    return near.crossJoin(F.broadcast(near.agg(nearest["open_time_ms"].alias("resolved_time_ms"))))


def dataset_page(dataset: DataFrame, symbol: str, timeframe: str, size: int = 10, horizon: str = "1d", label: int | None = None, page: int = 1, take: int = 100) -> DataFrame:
    """A page of a series' windows, the latest first, with total, how many there are."""
    if size not in SIZES or horizon not in HORIZONS:
        raise ValueError("size or horizon")
    page, take = clamp(page, 1, 1000), clamp(take, 1, 1000)
    own = dataset.where((F.col("symbol") == symbol) & (F.col("timeframe") == timeframe) & (F.col("window_size") == size) & (F.col("horizon") == horizon))
    own = own if label is None else own.where(F.col("label") == label)
    total = own.agg(F.count("*").alias("total"))
    return own.orderBy(F.desc("start_time_ms")).offset((page - 1) * take).limit(take).crossJoin(F.broadcast(total))


def discovered_rules(rules: DataFrame, symbol: str | None = None, timeframe: str | None = None) -> DataFrame:
    """Rules that were found by discovery, the best expected return first."""
    own = rules.where("is_auto_discovered")
    for name, value in (("symbol", symbol), ("timeframe", timeframe)):
        own = own.where(F.col(name) == value) if (value or "").strip() else own
    return own.orderBy(F.desc(F.col("win_rate") * F.col("avg_return")), "id")


def rule_timeframes(rules: DataFrame, symbol: str) -> DataFrame:
    """The timeframes that enabled rules of a symbol look at."""
    return rules.where(F.col("is_enabled") & (F.col("symbol") == symbol)).select("timeframe").distinct()


def active_rules(rules: DataFrame) -> DataFrame:
    """symbol, timeframe and active_rule_count of enabled rules."""
    return rules.where("is_enabled").groupBy("symbol", "timeframe").agg(F.count("*").alias("active_rule_count"))
