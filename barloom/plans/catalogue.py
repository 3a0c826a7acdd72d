"""The catalogue of the engine's queries, each with its DuckDB oracle where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import event_ms
from barloom.operators import alerts as al
from barloom.operators import features as ft
from barloom.operators import increments as inc
from barloom.operators import indicators as ti
from barloom.operators import metrics as mm
from barloom.operators import patterns as pt
from barloom.operators import pca as pc
from barloom.operators import ranges as rg
from barloom.operators import reads as rd
from barloom.operators import rules as ru
from barloom.operators import scenarios as sc
from barloom.operators import slices as sl
from barloom.operators import structure as st
from barloom.operators import summaries as su
from barloom.operators import targets as tg
from barloom.operators import text as tx
from barloom.operators import validate as va
from barloom.operators import vector_index as vi
from barloom.operators import vectors as ve
from barloom.operators import volume as vo
from barloom.operators.series import KEY
from barloom.plans import blocks as b
from barloom.sources import fixtures as fx
from barloom.sources import tables as tb
from barloom.sources import versions
from barloom.streaming import ledger

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = "symbol, timeframe, open_time_ms"


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, without a negative zero."""
    return df.select(*((F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def cols(names: list[str], plain: tuple[str, ...] = ()) -> str:
    return ", ".join(n if n in plain else b.r(n) for n in names)


# bars

BAR_COLS = ["open", "high", "low", "close", "volume", "quote_volume", "taker_buy_volume", "taker_buy_quote_volume"]
for tf in ("15m", "1h", "4h", "1d"):
    query(
        f"WITH {b.bars(tf)} SELECT {KEYS}, close_time_ms, trade_count, {cols(BAR_COLS)} FROM bars", f"bars_ohlcv_{tf}"
    )(lambda spark, d, tf=tf: fx.bars(spark, d, tf))


@query("""
SELECT event_type, user_id, arg_max(event_id, ts) AS event_id, round(arg_max(value, ts), 6) + 0.0 AS value
FROM events GROUP BY event_type, user_id
""")
def dedupe_keep_last(spark, d):
    e = fx.table(spark, d, "events").select("event_type", "user_id", "ts", "event_id", "value")
    return va.keep_last(e, ["event_type", "user_id"], "ts").select("event_type", "user_id", "event_id", "value")


ISSUES = f"""
iss AS (
  SELECT {KEYS}, unnest([
    CASE WHEN least(open, high, low, close) < 0 THEN 'NEGATIVE_PRICE' END, CASE WHEN high < low THEN 'HIGH_BELOW_LOW' END,
    CASE WHEN high < greatest(open, close) THEN 'HIGH_BELOW_BODY' END, CASE WHEN low > least(open, close) THEN 'LOW_ABOVE_BODY' END,
    CASE WHEN volume < 0 THEN 'NEGATIVE_VOLUME' END, CASE WHEN gap <> 900000 THEN 'MISSING_CANDLE' END]) AS issue,
    CASE WHEN gap <> 900000 THEN gap // 900000 - 1 ELSE 0 END AS missing
  FROM (SELECT *, open_time_ms - lag(open_time_ms) OVER ({b.S}) AS gap FROM bars))"""


@query(f"WITH {b.bars('15m')}, {ISSUES} SELECT {KEYS}, issue, CASE WHEN issue = 'MISSING_CANDLE' THEN missing ELSE 0 END AS missing FROM iss WHERE issue IS NOT NULL")
def validate_bars(spark, d):
    return va.issues(fx.bars(spark, d, "15m"), "15m")


@query(f"""
WITH {b.bars('15m')}, {ISSUES},
bad AS (SELECT symbol, count(*) AS issues, count(DISTINCT open_time_ms) AS bad_bars FROM iss WHERE issue IS NOT NULL GROUP BY symbol)
SELECT symbol, '15m' AS timeframe, count(*) AS bars, coalesce(any_value(issues), 0) AS issues, count(*) - coalesce(any_value(bad_bars), 0) AS valid_bars,
       coalesce(any_value(issues), 0) = 0 AS is_valid
FROM bars LEFT JOIN bad USING (symbol) GROUP BY symbol
""")
def validate_report(spark, d):
    return va.report(fx.bars(spark, d, "15m"), "15m")


# volume and indicators

VOL = ["volume", "volume_sma20", "anomaly_ratio", "vs_previous", "vs_max10"]


@query(f"WITH {b.bars()}, {b.volume()} SELECT {KEYS}, {cols(VOL)}, volume_trend FROM vol")
def volume_stats(spark, d):
    return vo.volume_stats(fx.bars(spark, d))


@query(f"WITH {b.bars()}, {b.volume()} SELECT {KEYS}, {cols(VOL)}, volume_trend FROM vol ORDER BY open_time_ms DESC, symbol LIMIT 100")
def topk_recent_volume(spark, d):
    return vo.recent(vo.volume_stats(fx.bars(spark, d)), 100)


def frame_query(name: str, columns: list[str]) -> None:
    sql = f"WITH {b.bars()}, {b.frames()} SELECT {KEYS}, {cols(columns)} FROM framed"
    query(sql, name)(lambda spark, d: ti.frame_indicators(fx.bars(spark, d)).select(*KEY, *columns))


frame_query("bollinger", ["bollinger_upper", "bollinger_middle", "bollinger_lower"])
frame_query("vwap_session", ["vwap"])
frame_query("vwap_rolling24", ["rolling_vwap24"])
frame_query("obv", ["obv"])
frame_query("true_range", ["true_range"])


@query(f"""
WITH {b.bars()}
SELECT {KEYS}, {b.r("CASE WHEN i >= 19 THEN CASE WHEN stddev_pop(close) OVER w > 0 THEN (close - avg(close) OVER w) / stddev_pop(close) OVER w ELSE 0 END END", "close_zscore")},
       {b.r("CASE WHEN i >= 19 THEN volume / nullif(avg(volume) OVER w, 0) END", "volume_sma20_ratio")}
FROM bars WINDOW w AS ({b.S} ROWS 19 PRECEDING)
""")
def zscore_sma_ratio20(spark, d):
    return fx.bars(spark, d).select(*KEY, ti.zscore("close").alias("close_zscore"), ti.sma_ratio("volume").alias("volume_sma20_ratio"))


IND = f"WITH RECURSIVE {b.bars()}, {b.frames()}, {b.folds()}"


def fold_query(name: str, columns: list[str]) -> None:
    query(f"{IND} SELECT {KEYS}, {cols(columns)} FROM ind", name)(
        lambda spark, d: ti.technical_indicators(fx.bars(spark, d)).select(*KEY, *columns)
    )


fold_query("ema", ["ema12", "ema26", "ema50", "ema200"])
fold_query("macd", ["macd", "macd_signal", "macd_histogram", "macd_norm", "macd_signal_norm", "macd_histogram_norm"])
fold_query("rsi14", ["rsi14"])
fold_query("atr14", ["atr14"])
fold_query("obv_ema50", ["obv_ema50"])


@query(f"{IND} SELECT {KEYS}, {b.r(f'CASE WHEN i >= 5 THEN (2 * rsi14 + lag(rsi14) OVER w - lag(rsi14, 3) OVER w - 2 * lag(rsi14, 4) OVER w) / 10 END', 'rsi14_slope')} FROM ind WINDOW w AS ({b.S})")
def rsi_slope5(spark, d):
    ind = ti.technical_indicators(fx.bars(spark, d))
    return ind.select(*KEY, ti.rsi_slope(ind).alias("rsi14_slope"))


@query(f"""
WITH {b.bars()},
x AS (SELECT *, greatest(close - lag(close) OVER ({b.S}), 0) AS up, greatest(lag(close) OVER ({b.S}) - close, 0) AS down FROM bars),
y AS (SELECT *, avg(up) OVER w AS u, avg(down) OVER w AS dn FROM x WINDOW w AS ({b.S} ROWS 13 PRECEDING)),
z AS (SELECT symbol, max(n) AS bars, max(high) AS max_high, min(low) AS min_low, arg_min(close, open_time_ms) AS f, arg_max(close, open_time_ms) AS l,
             max(CASE WHEN i = n - 1 AND i >= 14 THEN CASE WHEN dn = 0 THEN 100 ELSE 100 - 100 / (1 + u / dn) END END) AS simple_rsi
      FROM y GROUP BY symbol)
SELECT symbol, '1h' AS timeframe, bars, {cols(["max_high", "min_low"])}, {b.r("f", "first_close")}, {b.r("l", "last_close")},
       {b.r("coalesce((l - f) / nullif(f, 0) * 100, 0)", "change_pct")}, {b.r("simple_rsi")} FROM z
""")
def tech_summary(spark, d):
    return ti.simple_rsi(fx.bars(spark, d))


# targets and metrics

TARGETS = ["close", *(f"return_{h}" for h in tg.HORIZONS), "volatility_1d", "max_drawdown_1d", *(f"direction_{h}" for h in tg.HORIZONS)]
WAYS = tuple(f"direction_{h}" for h in tg.HORIZONS)


@query(f"WITH {b.bars()}, {b.targets('1h')} SELECT {KEYS}, {cols(TARGETS, WAYS)} FROM tgt")
def price_targets(spark, d):
    return tg.price_targets(fx.bars(spark, d), "1h")


@query(f"WITH {b.bars()}, {b.metrics()} SELECT symbol, open_time_ms, {cols(['funding_rate', 'funding_rate_zscore'])} FROM fund")
def funding_zscore(spark, d):
    return mm.funding_zscore(mm.eight_hourly_funding(fx.bars(spark, d)))


@query(f"WITH {b.bars()}, {b.metrics()} SELECT symbol, open_time_ms, {cols(['open_interest', 'oi_delta_pct'])} FROM oi")
def oi_delta(spark, d):
    return mm.oi_delta(mm.open_interest(fx.bars(spark, d)), 24)


@query(f"WITH {b.bars()}, {b.metrics()} SELECT symbol, open_time_ms, {cols(['long_liquidation_usd', 'short_liquidation_usd'])} FROM liq")
def liquidation_hourly(spark, d):
    return mm.liquidations_hourly(fx.forced_orders(spark, d))


METRICS = ["funding_rate_zscore", "oi_delta_pct", "long_liquidation_usd", "short_liquidation_usd"]


def market_metrics(spark, d) -> DataFrame:
    bars = fx.bars(spark, d)
    return mm.merge_metrics(
        mm.funding_zscore(mm.eight_hourly_funding(bars)), mm.oi_delta(mm.open_interest(bars), 24), mm.liquidations_hourly(fx.forced_orders(spark, d))
    )


@query(f"WITH {b.bars()}, {b.metrics()} SELECT symbol, open_time_ms, {cols(METRICS)} FROM met", "market_metrics")
def _market_metrics(spark, d):
    return market_metrics(spark, d)


ASOF = f"""
WITH {b.bars('15m')}, h AS (SELECT symbol, open_time_ms - open_time_ms % 28800000 AS t, sum(CAST(round(close * 100) AS BIGINT)) AS cents FROM bars GROUP BY ALL)
SELECT bars.symbol, bars.timeframe, bars.open_time_ms, h.t AS metric_time_ms, h.cents FROM bars ASOF LEFT JOIN h ON bars.symbol = h.symbol AND bars.open_time_ms >= h.t + 3600000
"""


@query(ASOF)
def asof_metrics(spark, d):
    bars = fx.bars(spark, d, "15m")
    slot = F.col("open_time_ms") - F.pmod("open_time_ms", F.lit(28_800_000))
    facts = bars.groupBy("symbol", slot.alias("t")).agg(F.sum(F.round(F.col("close") * 100).cast("long")).alias("cents"))
    facts = facts.select("symbol", (F.col("t") + 3_600_000).alias("open_time_ms"), "t", "cents")
    out = mm.as_of(bars, facts, "m", slice_ms=7 * 86_400_000)
    return out.select(*KEY, F.col("m.t").alias("metric_time_ms"), F.col("m.cents").alias("cents"))


# features

def feature_rows(spark, d, active_rules: int | DataFrame = 0) -> DataFrame:
    """Indicators and features are stored tables, each built from the one before."""
    bars = fx.bars(spark, d)
    ind = tb.stored(ti.technical_indicators(bars), "indicators")
    found = pt.recognise(bars).groupBy("symbol", "open_time_ms").agg(F.max("pattern_type").alias("pattern_type"))
    slot = 30 * 86_400_000
    both = mm.as_of(mm.as_of(ind, market_metrics(spark, d), "metric", slice_ms=slot), found, "pattern", slice_ms=slot)
    return tb.stored(ft.feature_store(both, "1h", active_rules, gate=None), "features").where("null_ratio <= 0.25")


FEAT = f"{IND}, {b.trends()}, {b.patterns()}, {b.metrics()}, {b.features()}"


@query(f"{FEAT} SELECT {KEYS}, {cols(['close', *ft.FEATURES, 'null_ratio'], ('recent_pattern_encoded', 'active_rule_count'))} FROM feat")
def ml_features(spark, d):
    return feature_rows(spark, d).withColumn("recent_pattern_encoded", F.col("recent_pattern_encoded").cast("long"))


W = f"""
win AS (
  SELECT symbol, timeframe, open_time_ms AS start_time_ms, lead(open_time_ms, 4) OVER w AS end_time_ms, count(*) OVER (PARTITION BY symbol) AS m,
         avg(null_ratio) OVER f AS mean_null_ratio, list([{", ".join(f"{x}::FLOAT::DOUBLE" for x in ft.WINDOW_FEATURES)}]) OVER f AS parts
  FROM feat WINDOW w AS ({b.S}), f AS ({b.S} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))"""


@query(f"""
{FEAT}, {b.targets('1h')}, {W}
SELECT win.symbol, win.timeframe, 5 AS window_size, '4h' AS horizon, start_time_ms, end_time_ms, len(flatten(parts)) AS vector_dim,
       {b.r("list_sum(flatten(parts)) / 40", "vector_mean")}, {b.r("mean_null_ratio")}, direction_4h AS label, {b.r("return_4h", "return_pct")}
FROM win JOIN tgt ON win.symbol = tgt.symbol AND win.end_time_ms = tgt.open_time_ms
WHERE m >= 15 AND end_time_ms - start_time_ms = 4 * 3600000 AND mean_null_ratio <= 0.25 AND direction_4h IS NOT NULL
  AND list_count(flatten(parts)) = 40
""")
def window_dataset(spark, d):
    """The vector is compared by its length and mean; floats make the mean good to four places."""
    w = ft.window_dataset(feature_rows(spark, d), tg.price_targets(fx.bars(spark, d), "1h"), "1h", 5, "4h")
    mean = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size("vector")
    return w.select(
        "symbol", "timeframe", "window_size", "horizon", "start_time_ms", "end_time_ms", F.size("vector").alias("vector_dim"), F.round(mean, 3).alias("vector_mean"),
        "mean_null_ratio", "label", "return_pct",
    )


ORACLE_SQL["window_dataset"] = ORACLE_SQL["window_dataset"].replace("round(list_sum(flatten(parts)) / 40, 6)", "round(list_sum(flatten(parts)) / 40, 3)")


AROUND = f"""
WITH {b.bars()}, asked AS (SELECT (min(open_time_ms) + max(open_time_ms)) // 2 AS t FROM bars WHERE symbol = 'ALL'),
near AS (SELECT symbol, timeframe, open_time_ms, close, t FROM bars, asked WHERE symbol = 'ALL' AND open_time_ms BETWEEN t - 24 * 3600000 AND t + 12 * 3600000 ORDER BY open_time_ms LIMIT 37)
SELECT symbol, timeframe, open_time_ms, {b.r("close")}, (SELECT open_time_ms FROM near ORDER BY abs(open_time_ms - t), open_time_ms LIMIT 1) AS resolved_time_ms FROM near"""


@query(AROUND)
def candles_around(spark, d):
    """24 bars before and 12 after the middle of the series of all events."""
    bars = fx.bars(spark, d)
    low, high = bars.where("symbol = 'ALL'").agg(F.min("open_time_ms"), F.max("open_time_ms")).first()
    return rd.bars_around(bars, "ALL", "1h", (low + high) // 2, 24, 12).select("symbol", "timeframe", "open_time_ms", "close", "resolved_time_ms")


DATASET_PAGE = f"""
WITH whole AS ({ORACLE_SQL["window_dataset"]}), own AS (SELECT * FROM whole WHERE symbol = 'ALL' AND label = 1)
SELECT symbol, start_time_ms, end_time_ms, label, return_pct, (SELECT count(*) FROM own) AS total FROM own ORDER BY start_time_ms DESC LIMIT 20 OFFSET 20"""


@query(DATASET_PAGE)
def dataset_page(spark, d):
    """The second page of twenty windows that rise."""
    w = ft.window_dataset(feature_rows(spark, d), tg.price_targets(fx.bars(spark, d), "1h"), "1h", 5, "4h")
    return rd.dataset_page(w, "ALL", "1h", 5, "4h", label=1, page=2, take=20).select("symbol", "start_time_ms", "end_time_ms", "label", "return_pct", "total")


@query(None)
def window_datasets(spark, d):
    targets = tb.stored(tg.price_targets(fx.bars(spark, d), "1h"), "targets")
    return ft.window_datasets(feature_rows(spark, d), targets, "1h").drop("vector")


def _daily(bars: DataFrame) -> DataFrame:
    """Every day of a series as a series of its own."""
    return bars.withColumn("symbol", F.concat_ws("@", "symbol", F.floor(F.col("open_time_ms") / 86_400_000)))


# patterns

PAT = f"WITH {b.bars()}, {b.trends()}, {b.patterns()}"
PAT_COLS = "symbol, timeframe, open_time_ms, pattern_type, span, trend_direction, end_time_ms, category, global_trend"
for kind, span in (("single", 1), ("double", 2), ("triple", 3)):
    query(f"{PAT} SELECT {PAT_COLS} FROM pat WHERE span = {span}", f"{kind}_patterns")(
        lambda spark, d, span=span: pt.recognise(fx.bars(spark, d)).where(F.col("span") == span).select(*PAT_COLS.split(", "))
    )


@query(f"{PAT} SELECT symbol, category, pattern_type, trend_direction, count(*) AS n FROM pat GROUP BY ALL")
def pattern_index(spark, d):
    return pt.recognise(fx.bars(spark, d)).groupBy("symbol", "category", "pattern_type", "trend_direction").agg(F.count("*").alias("n"))


@query(f"{PAT} SELECT {PAT_COLS} FROM pat WHERE category = 'Double' ORDER BY open_time_ms DESC, symbol, pattern_type, span LIMIT 50 OFFSET 50")
def paged_patterns(spark, d):
    rows = pt.recognise(fx.bars(spark, d)).where("category = 'Double'").select(*PAT_COLS.split(", "))
    return tb.page(rows, [F.desc("open_time_ms"), F.col("symbol"), F.col("pattern_type"), F.col("span")], 2, 50)


@query(f"{PAT} SELECT {PAT_COLS} FROM pat WHERE open_time_ms BETWEEN 1704500000000 AND 1705500000000 AND category = 'Double' AND pattern_type = 'BullishEngulfing'")
def filtered_patterns(spark, d):
    """By beginning, category and type."""
    return pt.filtered(pt.recognise(fx.bars(spark, d)), 1_704_500_000_000, 1_705_500_000_000, "Double", "BullishEngulfing").select(*PAT_COLS.split(", "))


@query(f"""
{PAT}, o AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS m FROM pat),
g AS (SELECT symbol, timeframe, open_time_ms AS start_time_ms, pattern_type AS a,
             lead(pattern_type, 1) OVER w AS b, lead(pattern_type, 2) OVER w AS c, lead(pattern_type, 3) OVER w AS d, lead(pattern_type, 4) OVER w AS e,
             lead(open_time_ms, 2) OVER w AS t3, lead(open_time_ms, 3) OVER w AS t4, lead(open_time_ms, 4) OVER w AS t5
      FROM o WHERE m >= 5 WINDOW w AS (PARTITION BY symbol ORDER BY open_time_ms, span, pattern_type))
SELECT symbol, timeframe, start_time_ms, t3 AS end_time_ms, 3 AS n, format('["{{}}","{{}}","{{}}"]', a, b, c) AS chain, 1 AS count FROM g WHERE t3 IS NOT NULL
UNION ALL SELECT symbol, timeframe, start_time_ms, t4, 4, format('["{{}}","{{}}","{{}}","{{}}"]', a, b, c, d), 1 FROM g WHERE t4 IS NOT NULL
UNION ALL SELECT symbol, timeframe, start_time_ms, t5, 5, format('["{{}}","{{}}","{{}}","{{}}","{{}}"]', a, b, c, d, e), 1 FROM g WHERE t5 IS NOT NULL
""")
def pattern_ngrams(spark, d):
    return pt.ngrams(pt.recognise(fx.bars(spark, d)))


# structure and scenarios

SW = f"""
WITH {b.bars()},
sw0 AS (SELECT *, max(high) OVER wb AS hb, max(high) OVER wa AS ha, min(low) OVER wb AS lb, min(low) OVER wa AS la FROM bars
        WINDOW wb AS ({b.S} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), wa AS ({b.S} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
sw1 AS (SELECT symbol, timeframe, open_time_ms, i AS bar_index, 'High' AS type, high AS price FROM sw0 WHERE high > hb AND high > ha AND i >= 5 AND i < n - 5
        UNION ALL SELECT symbol, timeframe, open_time_ms, i, 'Low', low FROM sw0 WHERE low < lb AND low < la AND i >= 5 AND i < n - 5),
sw2 AS (SELECT *, lag(price) OVER (PARTITION BY symbol, type ORDER BY open_time_ms) AS pp FROM sw1),
sw AS (SELECT *, CASE WHEN pp IS NULL OR row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms, type) < 3 THEN NULL WHEN type = 'High' THEN CASE WHEN price > pp THEN 'HH' ELSE 'LH' END ELSE CASE WHEN price > pp THEN 'HL' ELSE 'LL' END END AS label FROM sw2),
ev2 AS (SELECT *, lag(type) OVER w AS bt, lag(label) OVER w AS bl FROM sw WINDOW w AS (PARTITION BY symbol ORDER BY open_time_ms, type))"""


@query(f"{SW} SELECT {KEYS}, bar_index, type, {b.r('price')}, label FROM sw")
def swing_points(spark, d):
    return st.swings(fx.bars(spark, d)).withColumn("bar_index", F.col("bar_index").cast("long"))


@query(f"""{SW}
SELECT {KEYS}, {b.r('price')}, 'BOS' AS event, CASE WHEN type = 'High' THEN 'Bullish' ELSE 'Bearish' END AS direction FROM ev2
WHERE type = 'High' AND label = 'HH' AND bt = 'Low' OR type = 'Low' AND label = 'LL' AND bt = 'High'
UNION ALL SELECT {KEYS}, {b.r('price')}, 'CHoCH', CASE WHEN type = 'Low' THEN 'Bearish' ELSE 'Bullish' END FROM ev2
WHERE type = 'Low' AND label = 'LL' AND bt = 'High' AND bl = 'HH' OR type = 'High' AND label = 'LH' AND bt = 'Low' AND bl = 'HL'
""")
def structure_events(spark, d):
    return st.events(st.swings(fx.bars(spark, d)))


@query(f"""{SW}, l AS (SELECT symbol, timeframe, count(*) FILTER (WHERE type = 'High') AS highs, count(*) FILTER (WHERE type = 'Low') AS lows,
  arg_max(coalesce(label, ''), open_time_ms) FILTER (WHERE type = 'High') AS last_high, arg_max(coalesce(label, ''), open_time_ms) FILTER (WHERE type = 'Low') AS last_low
  FROM sw GROUP BY symbol, timeframe)
SELECT symbol, timeframe, highs, lows, nullif(last_high, '') AS last_high, nullif(last_low, '') AS last_low,
       CASE WHEN last_high = 'HH' AND last_low = 'HL' THEN 'Uptrend' WHEN last_high = 'LH' AND last_low = 'LL' THEN 'Downtrend' ELSE 'Sideways' END AS trend FROM l
""")
def structure_trend(spark, d):
    return st.trend(st.swings(fx.bars(spark, d)))


SCN = """
s0 AS (SELECT *, n - i AS k, high - low AS rng, abs(close - open) AS body, high - greatest(open, close) AS up, least(open, close) - low AS lo,
              high - low > 1.15 * (lag(high) OVER w - lag(low) OVER w) AS grew, volume > 1.2 * lag(volume) OVER w AS thick,
              coalesce(NOT close > lag(close) OVER w, true) AS nu, coalesce(NOT close < lag(close) OVER w, true) AS nd
       FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time_ms)),
s1 AS (SELECT symbol, timeframe, max(n) AS n, count(*) FILTER (WHERE k BETWEEN 2 AND 5 AND grew) AS wid, avg(rng) FILTER (WHERE k BETWEEN 2 AND 6) AS bef,
              max(rng) FILTER (WHERE k = 1) AS rng, max(open) FILTER (WHERE k = 1) AS o, max(close) FILTER (WHERE k = 1) AS c, max(close) FILTER (WHERE k = 5) AS c5,
              coalesce(min(k) FILTER (WHERE nu) - 1, 0) AS rises, coalesce(min(k) FILTER (WHERE nd) - 1, 0) AS falls,
              count(*) FILTER (WHERE k <= 4 AND body > 0 AND rng > 0 AND up > 1.5 * body AND up > 0.2 * rng) AS ups,
              count(*) FILTER (WHERE k <= 4 AND body > 0 AND rng > 0 AND lo > 1.5 * body AND lo > 0.2 * rng) AS los,
              count(*) FILTER (WHERE k <= 4 AND thick) AS thick, count(*) FILTER (WHERE k <= 3 AND rng > 0 AND body < 0.3 * rng) AS small
       FROM s0 GROUP BY symbol, timeframe HAVING max(n) >= 5),
scn AS (
  SELECT symbol, timeframe, 'ContractionThenExpansion' AS scenario, least(1, rng / (bef + 0.0001) / 3) AS strength, CASE WHEN c > o THEN 'Bullish' ELSE 'Bearish' END AS direction
  FROM s1 WHERE n >= 6 AND wid = 0 AND rng >= 1.5 * bef AND abs(c - o) > 0.5 * rng
  UNION ALL SELECT symbol, timeframe, 'ProgressiveCloses', least(1, greatest(rises, falls) / 8), CASE WHEN rises >= falls THEN 'Bullish' ELSE 'Bearish' END FROM s1 WHERE greatest(rises, falls) >= 4
  UNION ALL SELECT symbol, timeframe, 'ShadowRejectionCluster', least(1, greatest(ups, los) / 4), CASE WHEN ups < los THEN 'Bullish' ELSE 'Bearish' END FROM s1 WHERE greatest(ups, los) >= 2
  UNION ALL SELECT symbol, timeframe, 'VolumePriceDivergence', 0.7, CASE WHEN c < c5 THEN 'Bullish' ELSE 'Bearish' END FROM s1 WHERE n >= 6 AND c <> c5 AND thick = 0
  UNION ALL SELECT symbol, timeframe, 'IntradayReversalSequence', least(1, small / 3), 'Neutral' FROM s1 WHERE small >= 2)"""
for tf in ("15m", "1h", "4h"):
    query(f"WITH {b.bars(tf)}, {SCN} SELECT symbol, timeframe, scenario, {b.r('strength')}, direction FROM scn", f"scenarios_{tf}")(
        lambda spark, d, tf=tf: sc.scenarios(fx.bars(spark, d, tf))
    )


@query(None)
def scenario_summary(spark, d):
    return sc.summary(sc.scenarios(fx.bars(spark, d, "15m")))


DAYS = f"""
days AS (SELECT symbol || '@' || (open_time_ms // 86400000) AS symbol, timeframe, open_time_ms, open, high, low, close, volume,
                row_number() OVER (PARTITION BY symbol, open_time_ms // 86400000 ORDER BY open_time_ms) - 1 AS i, count(*) OVER (PARTITION BY symbol, open_time_ms // 86400000) AS n FROM bars),
{SCN.replace("FROM bars WINDOW", "FROM days WINDOW")}"""


@query(f"WITH {b.bars()}, {DAYS} SELECT symbol, timeframe, scenario, {b.r('strength')}, direction FROM scn")
def scenarios_daily(spark, d):
    """The scenarios that every day of every series ends in."""
    return sc.scenarios(_daily(fx.bars(spark, d)))


@query(f"WITH {b.bars()}, {DAYS} SELECT symbol, timeframe, string_agg(format('{{}} ({{:.2f}})', scenario, round(strength, 2)), '; ' ORDER BY strength DESC, scenario) AS summary FROM scn GROUP BY symbol, timeframe")
def scenario_summary_daily(spark, d):
    return sc.summary(sc.scenarios(_daily(fx.bars(spark, d))))


# texts

STRUCTURE = f"""{SW},
ev3 AS (SELECT symbol, timeframe, open_time_ms, type, price, unnest([
    CASE WHEN type = 'High' AND label = 'HH' AND bt = 'Low' THEN 'BOS|Break of Structure: Higher High' WHEN type = 'Low' AND label = 'LL' AND bt = 'High' THEN 'BOS|Break of Structure: Lower Low' END,
    CASE WHEN type = 'Low' AND label = 'LL' AND bt = 'High' AND bl = 'HH' THEN 'CHoCH|Change of Character: Bullish to Bearish'
         WHEN type = 'High' AND label = 'LH' AND bt = 'Low' AND bl = 'HL' THEN 'CHoCH|Change of Character: Bearish to Bullish' END]) AS e FROM ev2),
ev4 AS (SELECT *, split_part(e, '|', 1) AS kind, split_part(e, '|', 2) AS message, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms DESC, type DESC, e DESC) AS back FROM ev3 WHERE e IS NOT NULL),
cnt AS (SELECT symbol, count(*) FILTER (WHERE kind = 'BOS') AS bos, count(*) FILTER (WHERE kind = 'CHoCH') AS choch,
               string_agg('- [' || kind || '] ' || message || ' @ ' || format('{{:.2f}}', round(price, 2)), chr(10) ORDER BY back DESC) FILTER (WHERE back <= 3) AS lines FROM ev4 GROUP BY symbol),
l AS (SELECT symbol, timeframe, count(*) AS n, arg_max(coalesce(label, ''), open_time_ms) FILTER (WHERE type = 'High') AS last_high, arg_max(coalesce(label, ''), open_time_ms) FILTER (WHERE type = 'Low') AS last_low
      FROM sw GROUP BY symbol, timeframe)"""


@query(f"{STRUCTURE} SELECT symbol, '1h' AS timeframe, bos, choch FROM cnt")
def structure_event_counts(spark, d):
    return su.event_counts(st.events(st.swings(fx.bars(spark, d))))


@query(f"""{STRUCTURE}
SELECT symbol, timeframe, 'Market Structure: ' || n || ' swing points detected. Current trend: ' ||
       CASE WHEN last_high = 'HH' AND last_low = 'HL' THEN 'Uptrend' WHEN last_high = 'LH' AND last_low = 'LL' THEN 'Downtrend' ELSE 'Sideways' END || '.' ||
       CASE WHEN lines IS NULL THEN '' ELSE chr(10) || 'Events: ' || bos || ' BOS, ' || choch || ' CHoCH.' || chr(10) || lines END AS structure_summary
FROM l LEFT JOIN cnt USING (symbol)""")
def structure_summary(spark, d):
    points = tb.stored(st.swings(fx.bars(spark, d)), "swings")
    return su.structure_summary(points, st.events(points), st.trend(points))


@query(f"""
WITH {b.bars()}, {b.volume()}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms DESC) AS back FROM vol)
SELECT symbol, timeframe, 'Latest volume anomaly: ' || format('{{:.2f}}', round(max(anomaly_ratio) FILTER (WHERE back = 1), 2)) || 'x (avg last 5 bars: ' || format('{{:.2f}}', round(avg(anomaly_ratio), 2)) || 'x). ' ||
       CASE WHEN max(anomaly_ratio) FILTER (WHERE back = 1) > 1.5 THEN 'Above-average volume.' WHEN max(anomaly_ratio) FILTER (WHERE back = 1) < 0.5 THEN 'Below-average volume.' ELSE 'Normal volume.' END AS volume_summary
FROM l WHERE back <= 5 GROUP BY symbol, timeframe""")
def volume_summary(spark, d):
    return su.volume_summary(vo.volume_stats(fx.bars(spark, d)))


@query(f"""
WITH {b.bars()}, last AS (SELECT * FROM (SELECT *, n - i AS back FROM bars) WHERE back <= 48),
x AS (SELECT *, row_number() OVER w AS k, greatest(close - lag(close) OVER w, 0) AS up, greatest(lag(close) OVER w - close, 0) AS down FROM last WINDOW w AS ({b.S})),
f AS (SELECT symbol, timeframe, count(*) AS c, arg_min(close, open_time_ms) AS a, arg_max(close, open_time_ms) AS z, min(open_time_ms) AS t0, max(open_time_ms) AS t1, max(high) AS hi, min(low) AS lo,
             avg(up) FILTER (WHERE back <= 14) AS u, avg(down) FILTER (WHERE back <= 14) AS dn FROM x GROUP BY symbol, timeframe)
SELECT symbol, timeframe, symbol || ' (' || timeframe || ' candles, last ' || c || ' bars).' || chr(10) ||
       'First bar close (oldest in window): ' || format('{{:.2f}}', round(a, 2)) || ' at ' || strftime(make_timestamp(t0 * 1000), '%Y-%m-%dT%H:%M:%S.000Z') || '.' || chr(10) ||
       'Last bar close (newest): ' || format('{{:.2f}}', round(z, 2)) || ' at ' || strftime(make_timestamp(t1 * 1000), '%Y-%m-%dT%H:%M:%S.000Z') || '.' || chr(10) ||
       'Period high: ' || format('{{:.2f}}', round(hi, 2)) || ', period low: ' || format('{{:.2f}}', round(lo, 2)) || '.' || chr(10) ||
       'Approximate change from oldest to newest close in window: ' || format('{{:.2f}}', round(coalesce((z - a) / nullif(a, 0) * 100, 0), 2)) || '%.' || chr(10) ||
       'Simple RSI(14) on closes (last window): ' || CASE WHEN c < 15 THEN 'n/a (not enough bars)' ELSE format('{{:.2f}}', round(CASE WHEN dn = 0 THEN 100 ELSE 100 - 100 / (1 + u / dn) END, 2)) END || '.' AS head
FROM f""")
def tech_summary_text(spark, d):
    """The first paragraph; the tests hold the others."""
    return su.tech_summary(fx.bars(spark, d)).select("symbol", "timeframe", F.split_part("tech_summary", F.lit("\n\n"), F.lit(1)).alias("head"))


def _news(spark, d) -> tuple[DataFrame, DataFrame, list[float]]:
    """Every embedding as that of the first line of the document of its number; the query is the first one."""
    e, articles = fx.table(spark, d, "embeddings"), fx.articles(spark, d).withColumn("id", F.col("id").cast("long"))
    q = e.where("vec_id = 0").select("embedding").first()[0]
    chunks = e.select(F.col("vec_id").alias("article_id"), F.lit(0).alias("chunk_index"), "embedding").join(articles.select(F.col("id").alias("article_id"), F.col("title").alias("text")), "article_id")
    return chunks, articles, list(q)


NEWS = """
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding, e), lambda z: (z[1] * z[2])::DOUBLE)) /
             (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE)))) AS similarity FROM embeddings, q),
top AS (SELECT vec_id, similarity, substr(split_part(text, chr(10), 1), 1, 200) AS title FROM s JOIN documents ON doc_id = vec_id ORDER BY similarity DESC, vec_id LIMIT 8),
news AS (SELECT string_agg('---' || chr(10) || 'Title: ' || title || chr(10) || 'Link: doc://' || vec_id || chr(10) || title, chr(10) || chr(10) ORDER BY similarity DESC, vec_id) AS context FROM top)"""


@query(f"{NEWS} SELECT context FROM news")
def news_context(spark, d):
    return su.news_context(*_news(spark, d))


@query("""
WITH a AS (SELECT doc_id::VARCHAR AS id, substr(split_part(text, chr(10), 1), 1, 200) AS title, CASE WHEN doc_id % 7 <> 0 THEN 1700000000 + doc_id * 3600 ELSE 1700001800 + doc_id * 3600 END AS made FROM documents ORDER BY 3 DESC, 1 LIMIT 8)
SELECT '(Retrieved by recency; embedding similarity unavailable.)' || chr(10) || string_agg('---' || chr(10) || 'Title: ' || title || chr(10) || 'Link: doc://' || id, chr(10) || chr(10) ORDER BY made DESC, id) AS context FROM a
""")
def news_context_latest(spark, d):
    """Without a query vector: the latest articles."""
    articles = fx.articles(spark, d)
    return su.news_context(tx.embed(tx.chunks(articles.limit(0))), articles, None)


@query(f"{NEWS}, {b.bars()} SELECT DISTINCT symbol, timeframe, context AS news_context FROM bars, news")
def analysis_context(spark, d):
    """What an analysis of each series is asked with; the text of prices is tech_summary_text's."""
    return su.analysis_context(fx.bars(spark, d), *_news(spark, d)).select("symbol", "timeframe", "news_context")


# rules

C = ru.Condition
RULES = [
    ru.Rule(1, "close high", (C("close_position", position="top_50"),), 60, 1),
    ru.Rule(2, "two green", (C("consecutive_bars", direction="green", count=2), C("volume_compare", operator="gt", period=20, multiplier=0.5)), 30, 5),
    ru.Rule(3, "red before", (C("consecutive_bars", direction="red", count=1, barOffset=-1),), 120, 3),
    ru.Rule(4, "narrow", (C("range_compare", operator="lt", period=5, multiplier=1.5), C("body_ratio", operator="lte", value=0.9)), 15, 2),
    ru.Rule(5, "wick", (C("shadow_ratio", side="lower", operator="gt", multiplier=0.5),), 15, 4),
    ru.Rule(6, "unknown", (C("no_such_condition"),), 15, 9),
    ru.Rule(7, "no period", (C("volume_compare", operator="gt", multiplier=0.5),), 15, 6),
    ru.Rule(8, "some body", (C("body_ratio", operator="gte", value=0.01),), 45, 7),
]


def _sql_condition(c: ru.Condition, stats: bool) -> str:
    """A condition in SQL over the columns of bars and of volume statistics."""
    op = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "="}.get(c.operator or "gt", ">")
    m = 1.0 if c.multiplier is None else c.multiplier
    mean = lambda x, p: f"avg({x}) OVER ({b.S} ROWS BETWEEN {p} PRECEDING AND 1 PRECEDING)"
    if c.type == "consecutive_bars":
        one = {"green": "lag(close, {0}) OVER w > lag(open, {0}) OVER w", "red": "lag(close, {0}) OVER w < lag(open, {0}) OVER w",
               "higher_close": "lag(close, {0}) OVER w > lag(close, {1}) OVER w", "lower_close": "lag(close, {0}) OVER w < lag(close, {1}) OVER w"}[c.direction]
        out = " AND ".join(one.format(k, k + 1) for k in range(c.count or 1))
    elif c.type in ("range_compare", "volume_compare") and (c.period is None or c.multiplier is None):
        out = "false"
    elif c.type == "range_compare":
        out = f"{mean('high - low', c.period)} > 0 AND high - low {op} {mean('high - low', c.period)} * {m}"
    elif c.type == "volume_compare":
        known = {"prev": "vs_previous", "max10": "vs_max10"}.get(c.reference, "anomaly_ratio" if c.reference == "sma" and c.period == 20 else None)
        out = f"{known} {op} {m}" if stats and known else f"{mean('volume', c.period)} > 0 AND volume {op} {mean('volume', c.period)} * {m}"
    elif c.type == "body_ratio":
        out = f"high > low AND abs(close - open) / nullif(high - low, 0) {op} {c.value}"
    elif c.type == "shadow_ratio":
        side = "high - greatest(open, close)" if c.side == "upper" else "least(open, close) - low"
        out = f"abs(close - open) > 0 AND {side} {op} abs(close - open) * {m}"
    elif c.type == "close_position":
        p = "(close - low) / nullif(high - low, 0)"
        out = f"high > low AND " + {"top_25": f"{p} >= 0.75", "top_50": f"{p} >= 0.5", "bottom_25": f"{p} <= 0.25", "bottom_50": f"{p} <= 0.5", "middle": f"{p} BETWEEN 0.35 AND 0.65"}[c.position]
    else:
        out = "false"
    return f"coalesce({out}, false)"


def _rule_sql() -> str:
    conds = [(x.id, k, c) for x in RULES for k, c in enumerate(x.conditions)]
    first = ", ".join(f"{_sql_condition(c, False)} AS c{x}_{k}" for x, k, c in conds)
    met = ", ".join(f"coalesce(lag(c{x}_{k}, {-c.barOffset}) OVER w, false) AS m{x}_{k}" for x, k, c in conds)
    rows = " UNION ALL ".join(
        f"SELECT symbol, timeframe, open_time_ms AS trigger_time_ms, {b.r('close', 'close_price')}, {x.id}::BIGINT AS rule_id, '{x.name}' AS name, {x.priority} AS priority, "
        f"{x.cooldown_minutes} AS cooldown_minutes FROM r1 WHERE i = n - 1 AND n >= 10 AND {' AND '.join(f'm{x.id}_{k}' for k in range(len(x.conditions)))}" for x in RULES
    )
    return f"WITH {b.bars()}, r0 AS (SELECT *, {first} FROM bars WINDOW w AS ({b.S})), r1 AS (SELECT *, {met} FROM r0 WINDOW w AS ({b.S})), fired AS ({rows})"


@query(f"{_rule_sql()} SELECT * FROM fired")
def rule_eval(spark, d):
    return ru.evaluate(fx.bars(spark, d), RULES)


COOLED = f"""{_rule_sql()}, latest AS (SELECT max(open_time_ms) + 3600000 AS a FROM bars),
sig AS (SELECT event_id % 8 + 1 AS rule_id, epoch_ms(ts) AS created_ms FROM events)
SELECT fired.* FROM fired, latest WHERE NOT EXISTS (SELECT 1 FROM sig WHERE sig.rule_id = fired.rule_id AND sig.created_ms >= a - fired.cooldown_minutes * 60000)
"""


@query(COOLED)
def rule_cooldown(spark, d):
    events = fx.table(spark, d, "events")
    signals = events.select((F.col("event_id") % 8 + 1).alias("rule_id"), event_ms(F.col("ts")).alias("created_ms"))
    bars = fx.bars(spark, d)
    as_of = bars.agg(F.max("open_time_ms")).first()[0] + 3_600_000
    return ru.cooled_down(ru.evaluate(bars, RULES), signals, as_of)


def _discovery_sql() -> str:
    found = ru.candidates()
    distinct = list(dict.fromkeys(c for x in found for c in x))
    at = {c: k for k, c in enumerate(distinct)}
    conds = ", ".join(f"{_sql_condition(c, True)} AS p{k}" for k, c in enumerate(distinct))
    hits = ", ".join(f"CASE WHEN {' AND '.join(f'p{at[c]}' for c in x)} THEN {k} END" for k, x in enumerate(found))
    names = ", ".join(f"({k}, '{' + '.join(sorted(c.signature for c in x))}')" for k, x in enumerate(found))
    return f"""
WITH {b.bars()}, {b.volume()}, d0 AS (SELECT *, {conds}, (lead(close, 3) OVER w - close) / nullif(close, 0) * 100 AS ret FROM vol WINDOW w AS ({b.S})),
d1 AS (SELECT symbol, timeframe, ret, unnest([{hits}]) AS candidate FROM d0 WHERE n >= 200 AND i >= 10 AND i < n - 3 AND ret IS NOT NULL),
d2 AS (SELECT symbol, timeframe, candidate, count(*) AS sample_count, count(*) FILTER (WHERE ret > 0.3) AS w, count(*) FILTER (WHERE ret < -0.3) AS l, avg(ret) AS avg_return,
              sum(greatest(ret, 0)) AS plus, sum(least(ret, 0)) AS minus FROM d1 WHERE candidate IS NOT NULL GROUP BY symbol, timeframe, candidate HAVING count(*) >= 10),
d3 AS (SELECT symbol, timeframe, candidate, sample_count, w / (w + l + 0.0001) AS win_rate, avg_return, plus / (-minus + 0.0001) AS profit_factor, -minus AS max_drawdown FROM d2),
names(candidate, signature) AS (VALUES {names}),
d4 AS (SELECT *, win_rate * avg_return AS score, row_number() OVER (PARTITION BY symbol, signature ORDER BY round(win_rate * avg_return, 6) DESC, candidate) AS best
       FROM d3 JOIN names USING (candidate) WHERE win_rate >= 0.5 AND avg_return >= 0.1),
d5 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(score, 6) DESC, candidate) AS rank FROM d4 WHERE best = 1)
SELECT symbol, timeframe, candidate, sample_count, {cols(['win_rate', 'avg_return', 'profit_factor', 'max_drawdown', 'score'])}, signature, rank::INT AS rank FROM d5 WHERE rank <= 100"""


@query(_discovery_sql())
def rule_discovery(spark, d):
    bars = fx.bars(spark, d)
    return ru.discover(bars, vo.volume_stats(bars))


def _in_quarters(bars: DataFrame):
    """The bars up to the end of each quarter of their days."""
    day = F.floor(F.col("open_time_ms") / 86_400_000)
    low, high = bars.agg(F.min(day), F.max(day)).first()
    for k in range(1, 5):
        yield bars.where(day <= F.lit(low + (high - low) * k // 4))


@query(f"WITH {b.bars()}, {b.volume()} SELECT {KEYS}, {cols(VOL)}, volume_trend FROM vol")
def volume_increments(spark, d):
    """The volume index grown in four increments of days, the last one twice."""
    path, bars = tb.work_path(spark, "volume-index"), fx.bars(spark, d)
    for k, part in enumerate([*_in_quarters(bars), bars]):
        inc.index_volume(part, path, k)
    return ledger.read(spark, path, inc.VOLUME).drop("batch")


@query(f"WITH {b.bars()}, {b.trends(daily=True)}, {b.patterns(daily=True)} SELECT {PAT_COLS} FROM pat")
def pattern_increments(spark, d):
    """The pattern index grown in four increments of days, the last one twice."""
    path, bars = tb.work_path(spark, "pattern-index"), fx.bars(spark, d)
    for k, part in enumerate([*_in_quarters(bars), bars]):
        inc.index_patterns(part, path, k)
    return ledger.read(spark, path, inc.PATTERNS).select(*PAT_COLS.split(", "))


_NAMES = ", ".join(f"({k}, '{' + '.join(map(ru.label, x))}', {max(10, 3 * len(x))})" for k, x in enumerate(ru.candidates()))


@query(f"""
{IND}, {b.trends()}, {b.patterns()}, {b.metrics()}, {b.features("(SELECT count(*) FROM disc WHERE disc.symbol = j2.symbol)").replace("pat1 AS (", f"disc AS ({_discovery_sql()}), pat1 AS (", 1)}
SELECT {KEYS}, close_pct_change1, active_rule_count FROM feat""".replace("SELECT symbol, timeframe, open_time_ms, close_pct_change1", f"SELECT {KEYS}, {b.r('close_pct_change1')}"))
def ml_features_with_rules(spark, d):
    """Features with the number of enabled rules that discovery has saved for their series."""
    bars = fx.bars(spark, d)
    saved = ru.as_stored(ru.discover(bars, vo.volume_stats(bars)), 0)
    rows = feature_rows(spark, d, tb.stored(rd.active_rules(saved), "active-rules"))
    return rows.select(*KEY, "close_pct_change1", F.col("active_rule_count").cast("long").alias("active_rule_count"))


@query(f"""
WITH found AS ({_discovery_sql()}), names(candidate, name, required_bars) AS (VALUES {_NAMES})
SELECT symbol, timeframe, name, required_bars, format('Auto-discovered: {{}} | Future 3 bars | WinRate={{:.1f}}% AvgRet={{:.2f}} Samples={{}} PF={{:.2f}}', name, round(win_rate * 100, 1), round(avg_return, 2), sample_count, round(profit_factor, 2)) AS description,
       {cols(['win_rate', 'avg_return'])}, sample_count, 60 AS cooldown_minutes, CASE WHEN symbol = 'view' THEN 2 ELSE 3 END::BIGINT AS created_ms
FROM found JOIN names USING (candidate) WHERE symbol IN ('view', 'click')
""")
def rule_discovery_saved(spark, d):
    """The rules of two series saved to a versioned table, those of one of them twice."""
    path, bars = tb.work_path(spark, "rules"), fx.bars(spark, d)
    found = tb.stored(ru.discover(bars, vo.volume_stats(bars)), "discovery")
    for at, symbol in ((1, "click"), (2, "view"), (3, "click")):
        ru.save_discovered(found, path, symbol, "1h", at)
    return versions.read(spark, path, ru.STORED_RULES).select(
        "symbol", "timeframe", "name", "required_bars", "description", "win_rate", "avg_return", "sample_count", "cooldown_minutes", "created_ms"
    )


@query("SELECT a.p_partkey AS i, b.p_partkey AS j FROM part a JOIN part b ON b.p_partkey > a.p_partkey AND b.p_partkey < a.p_partkey + 20")
def rule_pairs_band_join(spark, d):
    """Pairs within 20 places, as the discovery pairs its conditions, of the numbers of parts."""
    n = fx.table(spark, d, "part")
    return rg.band_pairs(n.select(F.col("p_partkey").alias("i")), n.select(F.col("p_partkey").alias("j")), "i", "j", 20)


# vectors and retrieval

def _vector_query(name: str, feature: str, size: int, sql: str, by_type: bool = False) -> None:
    """The vector is compared by its length, sum and norm, which floats make good to four places.
    Under the name the series of all events, under by_series_ and the name every series."""
    if not by_type:
        _vector_query(f"by_series_{name}", feature, size, sql, by_type=True)

    def run(spark, d):
        v = ve.window_vectors(fx.bars(spark, d, by_type=by_type), feature, size)
        total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
        return v.select("symbol", "timeframe", "start_time_ms", "end_time_ms", "vector_dim", F.round(total, 3).alias("vector_sum"), F.round(ve.norm(F.col("vector")), 3).alias("vector_norm"))

    query(f"""
WITH {b.bars()}, wv AS (
  SELECT symbol, timeframe, open_time_ms AS start_time_ms, lead(open_time_ms, {size - 1}) OVER (PARTITION BY symbol ORDER BY open_time_ms) AS end_time_ms,
         list(struct_pack(o := open, h := high, l := low, c := close, v := volume)) OVER (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING) AS w
  FROM bars{"" if by_type else " WHERE symbol = 'ALL'"}),
wx AS (SELECT *, list_min(list_transform(w, lambda x: x.l)) AS lo, list_max(list_transform(w, lambda x: x.h)) AS hi FROM wv WHERE end_time_ms IS NOT NULL),
vec AS (SELECT *, list_transform({sql}, lambda x: x::FLOAT::DOUBLE) AS vector FROM wx)
SELECT symbol, timeframe, start_time_ms, end_time_ms, len(vector)::INT AS vector_dim, round(list_sum(vector), 3) + 0.0 AS vector_sum,
       round(sqrt(list_sum(list_transform(vector, lambda x: x * x))), 3) + 0.0 AS vector_norm
FROM vec WHERE vector IS NOT NULL""", name)(run)


for f in ("open", "high", "low", "close"):
    _vector_query(f"window_vectors_{f}", f, 10, f"CASE WHEN hi - lo > 1e-7 THEN list_transform(w, lambda x: (x.{f[0]} - lo) / (hi - lo)) END")
_vector_query("window_vectors_all", "all", 10, "CASE WHEN hi - lo > 1e-7 THEN flatten(list_transform(w, lambda x: [(x.o - lo) / (hi - lo), (x.c - lo) / (hi - lo), (x.h - lo) / (hi - lo), (x.l - lo) / (hi - lo)])) END")
SHAPE = """flatten(list_transform(w, lambda x, i: [
  CASE WHEN i > 1 AND abs(w[i - 1].c) > 1e-7 THEN x.c / w[i - 1].c - 1 ELSE 0 END,
  CASE WHEN x.h - x.l > 1e-7 THEN abs(x.c - x.o) / (x.h - x.l) ELSE 0 END,
  CASE WHEN x.h - x.l > 1e-7 THEN (x.h - greatest(x.o, x.c)) / (x.h - x.l) ELSE 0 END,
  CASE WHEN x.h - x.l > 1e-7 THEN (least(x.o, x.c) - x.l) / (x.h - x.l) ELSE 0 END]))"""
_vector_query("window_vectors_returns_shape", "returns_shape", 10, SHAPE)
MM = "list_transform({0}, lambda y: CASE WHEN list_max({0}) - list_min({0}) <= 1e-7 THEN 0.5 ELSE (y - list_min({0})) / (list_max({0}) - list_min({0})) END)"
LOGS = "list_transform(w, lambda x, i: CASE WHEN i > 1 AND w[i - 1].c > 1e-7 THEN ln(x.c / w[i - 1].c) ELSE 0.0 END)"
_vector_query("window_vectors_returns_log", "returns_log", 10, MM.format(f"({LOGS})"))
_vector_query("window_vectors_volume_norm", "volume_norm", 10, MM.format("list_transform(w, lambda x: x.v / list_avg(list_transform(w, lambda z: z.v)))"))
for f in ("volatility", "trend"):
    query(None, f"window_vectors_{f}")(lambda spark, d, f=f: ve.window_vectors(fx.bars(spark, d), f, 10).drop("vector"))


def _vectors_sql(feature: str, size: int, keep: str = "true") -> str:
    """vec: the vectors of every series, rounded to floats. Needs bars."""
    return f"""
wv AS (
  SELECT symbol, timeframe, i, n, open_time_ms AS start_time_ms, lead(open_time_ms, {size - 1}) OVER (PARTITION BY symbol ORDER BY open_time_ms) AS end_time_ms,
         list(struct_pack(o := open, h := high, l := low, c := close, v := volume)) OVER (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING) AS w
  FROM bars WHERE {keep}),
wx AS (SELECT *, list_min(list_transform(w, lambda x: x.l)) AS lo, list_max(list_transform(w, lambda x: x.h)) AS hi FROM wv WHERE end_time_ms IS NOT NULL),
vec AS (SELECT *, list_transform({VECTOR_SQL[feature]}, lambda x: x::FLOAT) AS vector FROM wx)"""


VECTOR_SQL = {f: f"CASE WHEN hi - lo > 1e-7 THEN list_transform(w, lambda x: (x.{f[0]} - lo) / (hi - lo)) END" for f in ("open", "high", "low", "close")}
VECTOR_SQL["all"] = "CASE WHEN hi - lo > 1e-7 THEN flatten(list_transform(w, lambda x: [(x.o - lo) / (hi - lo), (x.c - lo) / (hi - lo), (x.h - lo) / (hi - lo), (x.l - lo) / (hi - lo)])) END"
VECTOR_SQL["returns_shape"] = SHAPE
VECTOR_SQL["returns_log"] = MM.format(f"({LOGS})")
VECTOR_SQL["volume_norm"] = MM.format("list_transform(w, lambda x: x.v / list_avg(list_transform(w, lambda z: z.v)))")
VECTOR_SQL["volatility"] = MM.format(f"list_transform({LOGS}, lambda y, i: list_aggregate(list_slice({LOGS}, greatest(i - 4, 1), i), 'stddev_pop'))")
_YM = "list_avg(list_transform(w, lambda z: z.c))"
_XM = "((len(w) - 1) / 2.0)"
_SLOPE = f"(list_sum(list_transform(w, lambda z, j: (j - 1 - {_XM}) * (z.c - {_YM}))) / (len(w) * (len(w) * len(w) - 1) / 12.0))"
VECTOR_SQL["trend"] = MM.format(f"list_transform(w, lambda x, i: x.c - ({_SLOPE} * (i - 1) + {_YM} - {_SLOPE} * {_XM}))")


def _whole_vector_query(feature: str, size: int) -> None:
    """Every number of every series' vectors, in thousandths, in order."""

    def run(spark, d):
        thousandths = F.array_join(F.transform("vector", lambda x: F.round(x.cast("double") * 1000).cast("long").cast("string")), ",")
        return ve.window_vectors(fx.bars(spark, d), feature, size).select("symbol", "timeframe", "start_time_ms", "end_time_ms", thousandths.alias("vector_milli"))

    query(f"""
WITH {b.bars()}, {_vectors_sql(feature, size)}
SELECT symbol, timeframe, start_time_ms, end_time_ms, array_to_string(list_transform(vector, lambda x: round(x::DOUBLE * 1000)::BIGINT), ',') AS vector_milli
FROM vec WHERE vector IS NOT NULL""", f"whole_vectors_{feature}")(run)


for f in ve.FEATURE_TYPES:
    _whole_vector_query(f, 10)


def _half_built(spark, d, features: list[str], sizes: list[int]) -> tuple[str, DataFrame]:
    """An index made in two steps, of the earlier and of all bars, and purged of another version."""
    path, bars = tb.work_path(spark, "vector-index"), fx.bars(spark, d)
    middle = 1_705_300_000_000
    vi.update(spark, path, bars.where(F.col("open_time_ms") < middle), features, sizes, as_of_ms=middle)
    vi.update(spark, path, bars, features, sizes, as_of_ms=middle + 1)
    vi.purge(spark, path)
    return path, bars


@query(f"""
WITH {b.bars()}, {_vectors_sql("close", 10)}
SELECT symbol, timeframe, 'close' AS feature_type, 10 AS window_size, count(*) AS windows,
       CASE WHEN bool_or(end_time_ms >= 1705300000000) THEN 1705300000001 ELSE 1705300000000 END AS updated_ms
FROM vec WHERE vector IS NOT NULL GROUP BY symbol, timeframe""")
def vector_index_status(spark, d):
    """An index built in two steps, by its own status."""
    path, _ = _half_built(spark, d, ["close"], [10])
    return vi.status(spark, path)


WARM = " UNION ALL ".join(
    f"SELECT symbol, '{f}' AS feature_type, {n} AS window_size, count(*) AS windows, round(sum(sqrt(list_sum(list_transform(vector, lambda z: z::DOUBLE * z::DOUBLE)))), 2) + 0.0 AS norms "
    f"FROM (WITH {_vectors_sql(f, n)} SELECT * FROM vec WHERE vector IS NOT NULL) GROUP BY symbol"
    for f in vi.WARM_FEATURES for n in vi.WARM_SIZES
)


@query(f"WITH {b.bars()} {WARM}")
def vector_index_warm(spark, d):
    """The whole index of the six feature types and five sizes, in one job: windows and sums of norms."""
    path = tb.work_path(spark, "vector-index")
    vi.warm_up(spark, path, fx.bars(spark, d), as_of_ms=0)
    return vi.read(spark, path).groupBy("symbol", "feature_type", "window_size").agg(F.count("*").alias("windows"), F.round(F.sum(ve.norm(F.col("vector"))), 2).alias("norms"))


NEAREST = """
pick AS (
  SELECT query_id, symbol, timeframe, 1 AS rank, ranked[1] AS x, list_filter(ranked, lambda y: abs(y.i - ranked[1].i) >= {gap}) AS rest FROM ranked
  UNION ALL
  SELECT query_id, symbol, timeframe, rank + 1, rest[1], list_filter(rest, lambda y: abs(y.i - rest[1].i) >= {gap}) FROM pick WHERE rank < {k} AND len(rest) > 0)"""
SIMILAR = """list_sum(list_transform(list_zip({0}.vector, {1}.vector), lambda z: (z[1] * z[2])::DOUBLE)) / nullif(
           sqrt(list_sum(list_transform({0}.vector, lambda z: z::DOUBLE * z::DOUBLE)))::FLOAT::DOUBLE * sqrt(list_sum(list_transform({1}.vector, lambda z: z::DOUBLE * z::DOUBLE)))::FLOAT::DOUBLE, 0)"""


def _search_sql(asked: str) -> str:
    """The ten most similar windows of returns_shape, 10 bars, of each asked window of vec (asked: query_id, symbol, timeframe, e)."""
    return f"""
WITH RECURSIVE {b.bars()}, {_vectors_sql("returns_shape", 10)},
asked AS ({asked}),
q AS (SELECT query_id, vec.* FROM asked JOIN vec ON vec.symbol = asked.symbol AND vec.end_time_ms = e WHERE i + 10 >= 20),
scored AS (SELECT q.query_id, q.symbol, q.timeframe, c.i, c.start_time_ms AS s, c.end_time_ms AS e, coalesce({SIMILAR.format("c", "q")}, 0) AS similarity
           FROM q JOIN vec c ON c.symbol = q.symbol AND c.i BETWEEN q.i + 9 - 1999 AND q.i - 1),
ranked AS (SELECT query_id, symbol, timeframe, list(struct_pack(i := i, s := s, e := e, similarity := similarity) ORDER BY similarity DESC, s DESC) AS ranked, count(*) AS scanned FROM scored GROUP BY ALL),
{NEAREST.format(gap=10, k=10)}
SELECT p.query_id, p.symbol, p.timeframe, p.rank, format('w_{{}}_{{}}', x.s, x.e) AS window_id, x.s AS start_time_ms, x.e AS end_time_ms,
       {b.r("x.similarity", "similarity")}, {b.r("1 - x.similarity", "distance")}, scanned, true AS from_index
FROM pick p JOIN ranked USING (query_id)"""


@query(_search_sql("SELECT symbol || '/1h' AS query_id, symbol, max(end_time_ms) AS e FROM vec GROUP BY symbol"))
def pattern_search(spark, d):
    """The last window of each series, in an index built in two steps."""
    path, bars = _half_built(spark, d, ["returns_shape"], [10])
    return vi.search(spark, path, bars, as_of_ms=0, feature="returns_shape", size=10)


@query(_search_sql("SELECT format('{}@{}', symbol, end_time_ms) AS query_id, symbol, end_time_ms AS e FROM vec WHERE i % 20 = 3"))
def pattern_search_many(spark, d):
    """Every twentieth window of every series asks, in an index that the search builds."""
    bars = fx.bars(spark, d)
    ends = sl.placed(bars).where("_i >= 9 and (_i - 9) % 20 = 3")
    asked = ends.select(F.concat_ws("@", "symbol", "open_time_ms").alias("query_id"), "symbol", "timeframe", F.col("open_time_ms").alias("end_time_ms"))
    return vi.search(spark, tb.work_path(spark, "vector-index"), bars, as_of_ms=0, queries=asked, feature="returns_shape", size=10)


@query("""
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding, e), lambda z: (z[1] * z[2])::DOUBLE)) AS dot,
             sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n, sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE))) AS m
      FROM embeddings, q)
SELECT vec_id, round(dot / (n * m), 4) + 0.0 AS similarity FROM s ORDER BY dot / (n * m) DESC, vec_id LIMIT 8
""")
def rag_topk(spark, d):
    e = fx.table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()[0]
    return ve.top_similar(e, list(q), 8).withColumn("similarity", F.round("similarity", 4))


@query("""
SELECT doc_id::VARCHAR AS id, source, substr(split_part(text, chr(10), 1), 1, 200) AS title, 'doc://' || doc_id AS link
FROM documents ORDER BY CASE WHEN doc_id % 7 <> 0 THEN 1700000000 + doc_id * 3600 ELSE 1700001800 + doc_id * 3600 END DESC, id LIMIT 20 OFFSET 20
""")
def rag_latest(spark, d):
    return tx.latest_articles(fx.articles(spark, d), 2, 20)


@query(None)
def text_chunks(spark, d):
    return tx.chunks(fx.articles(spark, d))


@query(None)
def chunk_retrieval(spark, d):
    chunks = tx.embed(tx.chunks(fx.articles(spark, d)))
    q = tx.hashed_embedding("the and of")
    rows = chunks.withColumn("key", F.concat_ws("/", "article_id", "chunk_index"))
    return ve.top_similar(rows, q, 8, id_col="key")


def _pca_vectors(spark, d) -> DataFrame:
    return tb.stored(ve.window_vectors(fx.bars(spark, d), "returns_shape", 25), "pca-vectors")


@query(None)
def pca_components(spark, d):
    p = pc.principal_components(_pca_vectors(spark, d))
    return p.select("symbol", "timeframe", "start_time_ms", *(F.get("pca", F.lit(k)).alias(f"pca{k + 1}") for k in range(5)))


@query(None)
def pca_features(spark, d):
    """Features with the components of the window that ends with each bar."""
    return pc.write_back(feature_rows(spark, d), pc.principal_components(_pca_vectors(spark, d))).select(*KEY, "close", *pc.COMPONENTS)


@query(f"WITH {b.bars()} SELECT symbol, arg_min(open_time_ms, abs(open_time_ms - 1705000000000)::HUGEINT * 10000000000000 + open_time_ms) AS open_time_ms FROM bars GROUP BY symbol")
def nearest_bar(spark, d):
    away = F.abs(F.col("open_time_ms") - 1_705_000_000_000)
    return fx.bars(spark, d).groupBy("symbol").agg(F.min_by("open_time_ms", F.struct(away.alias("d"), F.col("open_time_ms").alias("t"))).alias("open_time_ms"))


# tables

@query("""
SELECT coalesce(c.c_custkey, s.s_suppkey) AS id, CASE WHEN s.s_suppkey IS NOT NULL THEN s.s_name ELSE c.c_name END AS name,
       round(CASE WHEN s.s_suppkey IS NOT NULL THEN s.s_acctbal ELSE c.c_acctbal END, 6) + 0.0 AS balance, c.c_mktsegment AS segment
FROM customer c FULL JOIN (SELECT s_suppkey * 3 AS s_suppkey, s_name, s_acctbal FROM supplier) s ON c.c_custkey = s.s_suppkey
""")
def upsert_merge(spark, d):
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = fx.table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return tb.upsert(c, s, ["id"], ["name", "balance"])


@query("""
SELECT s_suppkey AS id, s_nationkey AS nation FROM supplier WHERE coalesce(NOT s_nationkey < 10, true)
UNION ALL SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey < 10
""")
def replace_subset(spark, d):
    s = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    c = fx.table(spark, d, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    return tb.replace_subset(s, c, F.col("nation") < 10)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def antijoin_insert(spark, d):
    new = fx.table(spark, d, "orders").select("o_orderkey")
    stored = fx.table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return tb.append_new(stored, new, ["o_orderkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0")
def update_delete(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return tb.delete(tb.update(o, F.col("o_orderstatus") == "O", o_orderstatus="X"), F.col("o_orderkey") % 5 == 0)


@query(f"""
WITH {b.bars()}, last AS (SELECT symbol, arg_max(close, open_time_ms) AS close, max(open_time_ms) AS trigger_time_ms FROM bars GROUP BY symbol),
st(user_id, price_above, price_below, cooldown_minutes) AS (VALUES ('a', 50.0, 1.0, 30), ('b', NULL, 100000.0, 60), ('c', 0.0, NULL, 10))
SELECT user_id, symbol, type, {b.r('close', 'price_snapshot')}, trigger_time_ms, cooldown_minutes FROM (
  SELECT *, unnest([CASE WHEN close > price_above THEN 'price_above' END, CASE WHEN close < price_below THEN 'price_below' END]) AS type FROM last, st) WHERE type IS NOT NULL
""")
def price_alerts(spark, d):
    settings = spark.createDataFrame(
        [("a", True, 50.0, 1.0, 30), ("b", True, None, 100000.0, 60), ("c", True, 0.0, None, 10), ("off", False, 0.0, None, 10)],
        "user_id string, enabled boolean, price_above double, price_below double, cooldown_minutes int",
    )
    last = fx.bars(spark, d).groupBy("symbol").agg(F.max_by("close", "open_time_ms").alias("close"), F.max("open_time_ms").alias("trigger_time_ms"))
    return al.price_hits(last, settings)


@query("""
WITH x AS (SELECT l_suppkey, l_orderkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem)
SELECT l_suppkey, l_orderkey, round(l_extendedprice, 6) + 0.0 AS l_extendedprice, rank::INT AS rank FROM x WHERE rank <= 3
""")
def topk_per_group(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return fx.table(spark, d, "lineitem").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("l_suppkey", "l_orderkey", "l_extendedprice", "rank")


# streams: they register themselves

from barloom.plans import stream_queries  # noqa: E402, F401
