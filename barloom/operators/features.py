"""The per-bar feature store and the sliding-window dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalar import horizon_bars, interval_ms, pattern_code, ratio
from barloom.operators.indicators import rsi_slope, sma_ratio, zscore
from barloom.operators.series import KEY, SERIES, lag, lead, rows, whole

#: The 32 features, in order, and the eight that windows are made of.
FEATURES = [
    "close_pct_change1", "close_pct_change4", "close_pct_change24", "high_low_range_pct", "body_pct", "upper_wick_pct", "lower_wick_pct", "close_zscore",
    "volume_zscore", "volume_sma20_ratio", "taker_buy_ratio",
    "rsi14", "rsi14_slope", "macd_norm", "macd_signal_norm", "macd_histogram_norm", "ema12_dist", "ema26_dist", "ema50_dist", "ema200_dist",
    "bollinger_width", "bollinger_position", "atr14_pct", "obv_ema_dist", "vwap_dist", "rolling_vwap_dist",
    "funding_rate_zscore", "oi_delta_pct", "long_liquidation_usd", "short_liquidation_usd",
    "recent_pattern_encoded", "active_rule_count",
]
WINDOW_FEATURES = ["close_pct_change1", "body_pct", "high_low_range_pct", "rsi14", "macd_histogram_norm", "ema12_dist", "ema26_dist", "volume_zscore"]


def feature_store(indicators: DataFrame, timeframe: str, active_rules: int | DataFrame = 0, gate: float | None = 0.25, least_bars: int = 300) -> DataFrame:
    """indicators: bars with technical indicators and the structs metric (or null) and
    pattern (or null) of as-of joins. 32 features and null_ratio, the share of them that is
    null; rows over the gate are left out, and series of fewer than least_bars bars.
    active_rules is a number, or a table (symbol, timeframe, active_rule_count): a series that
    it lacks has none."""
    c = F.col
    long = indicators.groupBy(*SERIES).count().where(c("count") >= least_bars)
    indicators = indicators.join(long.select(*SERIES), SERIES, "left_semi")
    if isinstance(active_rules, DataFrame):
        counts = active_rules.select(*SERIES, c("active_rule_count").alias("_rules"))
        indicators, active = indicators.join(counts, SERIES, "left"), F.coalesce(c("_rules"), F.lit(0)).cast("int")
    else:
        active = F.lit(active_rules)
    rng, body = c("high") - c("low"), F.abs(c("close") - c("open"))
    change = lambda k: ratio(c("close") - lag("close", k), lag("close", k)) * 100
    of_range = lambda x: F.when(rng > 0, ratio(x, rng))
    dist = lambda x: ratio(c("close") - c(x), c(x)) * 100
    width = c("bollinger_upper") - c("bollinger_lower")
    slope = indicators.withColumn("rsi14_slope", rsi_slope(indicators))
    out = slope.select(
        *KEY, "close",
        change(1).alias("close_pct_change1"), change(4).alias("close_pct_change4"), change(horizon_bars(timeframe, "1d")).alias("close_pct_change24"),
        (ratio(rng, c("close")) * 100).alias("high_low_range_pct"), of_range(body).alias("body_pct"),
        of_range(c("high") - F.greatest("open", "close")).alias("upper_wick_pct"), of_range(F.least("open", "close") - c("low")).alias("lower_wick_pct"),
        zscore("close").alias("close_zscore"), zscore("volume").alias("volume_zscore"), sma_ratio("volume").alias("volume_sma20_ratio"),
        F.when(c("volume") > 0, ratio(c("taker_buy_volume"), c("volume"))).alias("taker_buy_ratio"),
        "rsi14", "rsi14_slope", "macd_norm", "macd_signal_norm", "macd_histogram_norm",
        *(dist(f"ema{p}").alias(f"ema{p}_dist") for p in (12, 26, 50, 200)),
        (ratio(width, c("bollinger_middle")) * 100).alias("bollinger_width"),
        F.when(width > 0, ratio(c("close") - c("bollinger_lower"), width)).alias("bollinger_position"),
        (ratio(c("atr14"), c("close")) * 100).alias("atr14_pct"),
        (ratio(c("obv") - c("obv_ema50"), F.abs("obv_ema50")) * 100).alias("obv_ema_dist"),
        dist("vwap").alias("vwap_dist"), dist("rolling_vwap24").alias("rolling_vwap_dist"),
        *(c(f"metric.{m}").alias(m) for m in ("funding_rate_zscore", "oi_delta_pct", "long_liquidation_usd", "short_liquidation_usd")),
        pattern_code(c("pattern.pattern_type")).alias("recent_pattern_encoded"), active.alias("active_rule_count"),
    )
    nulls = sum((c(f).isNull().cast("int") for f in FEATURES[1:]), c(FEATURES[0]).isNull().cast("int"))
    out = out.withColumn("null_ratio", nulls / len(FEATURES))
    return out if gate is None else out.where(c("null_ratio") <= gate)


def window_dataset(features: DataFrame, targets: DataFrame, timeframe: str, size: int, horizon: str, gate: float = 0.25, least_extra: int = 10) -> DataFrame:
    """Windows of `size` consecutive feature rows whose last bar has a target. The vector is
    the eight features of each bar in turn; a window with a null in it, or whose mean null
    ratio is over the gate, is left out."""
    ahead, span = rows(0, size - 1), (size - 1) * interval_ms(timeframe)
    per_bar = F.array(*(F.col(f).cast("float") for f in WINDOW_FEATURES))
    w = (
        features.withColumn("_n", F.count("*").over(whole()))
        .where(F.col("_n") >= size + least_extra)
        .withColumn("_bar", F.struct(per_bar.alias("v")))
        .select(
            *KEY, lead("open_time_ms", size - 1).alias("end_time_ms"), F.collect_list("_bar").over(ahead).alias("_w"),
            F.avg("null_ratio").over(ahead).alias("mean_null_ratio"),
        )
        .where((F.col("end_time_ms") - F.col("open_time_ms") == span) & (F.col("mean_null_ratio") <= gate))
        .withColumn("vector", F.flatten("_w.v"))
        .where(F.forall("vector", lambda x: x.isNotNull()))
    )
    label = targets.select(
        *KEY[:2], F.col("open_time_ms").alias("end_time_ms"), F.col(f"direction_{horizon}").alias("label"), F.col(f"return_{horizon}").alias("return_pct")
    ).where("label is not null")
    return w.join(label, [*KEY[:2], "end_time_ms"]).select(
        *KEY[:2], F.lit(size).alias("window_size"), F.lit(horizon).alias("horizon"), F.col("open_time_ms").alias("start_time_ms"), "end_time_ms",
        "vector", "mean_null_ratio", "label", "return_pct",
    )


def window_datasets(features: DataFrame, targets: DataFrame, timeframe: str, sizes=(5, 10, 15, 20, 25), horizons=("1h", "4h", "1d")) -> DataFrame:
    out = None
    for s in sizes:
        for h in horizons:
            part = window_dataset(features, targets, timeframe, s, h)
            out = part if out is None else out.unionByName(part)
    return out
