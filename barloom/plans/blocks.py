"""Building blocks of the DuckDB oracles: common table expressions over the test tables."""

from __future__ import annotations

from barloom.functions.scalar import interval_ms


def r(expr: str, name: str | None = None) -> str:
    """Rounded to six places, without a negative zero."""
    return f"round({expr}, 6) + 0.0 AS {name or expr}"


def bars(timeframe: str = "1h") -> str:
    """bars of ALL and of each event type; i is a bar's place in its series, n their number."""
    w = interval_ms(timeframe)
    return f"""
ev AS (SELECT epoch_ms(ts) AS t, event_id, event_type, value, CAST(round(value * 100) AS BIGINT) AS cents,
              CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
tk AS (SELECT 'ALL' AS symbol, * FROM ev UNION ALL SELECT event_type AS symbol, * FROM ev),
bars0 AS (
  SELECT symbol, '{timeframe}' AS timeframe, t - t % {w} AS open_time_ms, t - t % {w} + {w - 1} AS close_time_ms,
         arg_min(value, t::HUGEINT * 10000000000 + event_id) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, t::HUGEINT * 10000000000 + event_id) AS close, sum(cents)::DOUBLE / 100 AS volume, count(*) AS trade_count,
         sum(CASE WHEN event_type = 'purchase' THEN cents ELSE 0 END)::DOUBLE / 100 AS taker_buy_volume
  FROM tk GROUP BY symbol, t - t % {w}),
bars AS (
  SELECT *, volume * close AS quote_volume, taker_buy_volume * close AS taker_buy_quote_volume,
         row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n
  FROM bars0 WINDOW w AS (PARTITION BY symbol ORDER BY open_time_ms))"""


S = "PARTITION BY symbol ORDER BY open_time_ms"


def frames() -> str:
    """framed: bars with Bollinger bands, VWAPs, OBV and true range. Needs bars."""
    return f"""
f0 AS (
  SELECT *, (high + low + close) / 3 * volume AS pv, open_time_ms // 86400000 AS day, lag(close) OVER ({S}) AS pc FROM bars),
f1 AS (
  SELECT *, greatest(high - low, abs(high - coalesce(pc, open)), abs(low - coalesce(pc, open))) AS true_range,
         CAST(round(CASE WHEN pc IS NULL OR close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END * 100) AS BIGINT) AS step
  FROM f0),
framed AS (
  SELECT *, CASE WHEN i >= 19 THEN avg(close) OVER w20 END AS bollinger_middle,
         CASE WHEN i >= 19 THEN avg(close) OVER w20 + 2 * stddev_pop(close) OVER w20 END AS bollinger_upper,
         CASE WHEN i >= 19 THEN avg(close) OVER w20 - 2 * stddev_pop(close) OVER w20 END AS bollinger_lower,
         sum(pv) OVER wd / nullif(sum(volume) OVER wd, 0) AS vwap,
         sum(pv) OVER w24 / nullif(sum(volume) OVER w24, 0) AS rolling_vwap24,
         sum(step) OVER ({S} ROWS UNBOUNDED PRECEDING)::DOUBLE / 100 AS obv
  FROM f1
  WINDOW w20 AS ({S} ROWS 19 PRECEDING), w24 AS ({S} ROWS 23 PRECEDING),
         wd AS (PARTITION BY symbol, day ORDER BY open_time_ms ROWS UNBOUNDED PRECEDING))"""


def _ema(x: str, p: int, first: int, source: str) -> str:
    """ema_x_p(symbol, i, e): seeded at place first with the mean of the p values up to it."""
    k = f"(2.0::DOUBLE / {p + 1})"
    name = f"{x}_{p}"
    return f"""
seed_{name} AS (SELECT symbol, avg({x}) AS e FROM {source} WHERE i BETWEEN {first - p + 1} AND {first} GROUP BY symbol HAVING count({x}) = {p}),
ema_{name} AS (
  SELECT symbol, {first}::BIGINT AS i, e FROM seed_{name}
  UNION ALL
  SELECT s.symbol, s.i, m.e + (s.{x} - m.e) * {k} FROM ema_{name} m JOIN {source} s ON s.symbol = m.symbol AND s.i = m.i + 1)"""


def folds() -> str:
    """ind: framed with all recursive indicators, for series of 50 bars or more. Needs frames;
    goes under WITH RECURSIVE."""
    return ",".join([
        "\nlong AS (SELECT * FROM framed WHERE n >= 50)",
        *(_ema("close", p, p - 1, "long") for p in (12, 26, 50, 200)),
        "\nmac AS (SELECT a.symbol, a.i, a.e - b.e AS macd FROM ema_close_12 a JOIN ema_close_26 b ON a.symbol = b.symbol AND a.i = b.i)",
        _ema("macd", 9, 33, "mac"),
        _ema("obv", 50, 49, "long"),
        """
chg AS (SELECT symbol, i, greatest(close - pc, 0) AS up, greatest(pc - close, 0) AS down FROM long),
rs AS (
  SELECT symbol, 14::BIGINT AS i,
         (sum(up) FILTER (WHERE i BETWEEN 1 AND 13) / 14 + sum(up) FILTER (WHERE i = 14)) / 14 AS g,
         (sum(down) FILTER (WHERE i BETWEEN 1 AND 13) / 14 + sum(down) FILTER (WHERE i = 14)) / 14 AS l
  FROM chg GROUP BY symbol
  UNION ALL
  SELECT c.symbol, c.i, (rs.g * 13 + c.up) / 14, (rs.l * 13 + c.down) / 14 FROM rs JOIN chg c ON c.symbol = rs.symbol AND c.i = rs.i + 1)""",
        """
atrs AS (
  SELECT symbol, 14::BIGINT AS i, avg(true_range) AS a FROM long WHERE i <= 14 GROUP BY symbol
  UNION ALL
  SELECT s.symbol, s.i, (atrs.a * 13 + s.true_range) / 14 FROM atrs JOIN long s ON s.symbol = atrs.symbol AND s.i = atrs.i + 1)""",
        """
ind0 AS (
  SELECT f.*, e12.e AS ema12, e26.e AS ema26, e50.e AS ema50, e200.e AS ema200, mac.macd, sg.e AS macd_signal, mac.macd - sg.e AS macd_histogram,
         CASE WHEN rs.l = 0 THEN 100 ELSE 100 - 100 / (1 + rs.g / rs.l) END AS rsi14, atrs.a AS atr14, ob.e AS obv_ema50
  FROM long f LEFT JOIN ema_close_12 e12 USING (symbol, i) LEFT JOIN ema_close_26 e26 USING (symbol, i)
  LEFT JOIN ema_close_50 e50 USING (symbol, i) LEFT JOIN ema_close_200 e200 USING (symbol, i) LEFT JOIN mac USING (symbol, i)
  LEFT JOIN ema_macd_9 sg USING (symbol, i) LEFT JOIN rs USING (symbol, i) LEFT JOIN atrs USING (symbol, i) LEFT JOIN ema_obv_50 ob USING (symbol, i)),
ind AS (
  SELECT *, CASE WHEN atr14 > 0 THEN macd / atr14 END AS macd_norm, CASE WHEN atr14 > 0 THEN macd_signal / atr14 END AS macd_signal_norm,
         CASE WHEN atr14 > 0 THEN macd_histogram / atr14 END AS macd_histogram_norm
  FROM ind0)""",
    ])


def volume() -> str:
    """vol: volume statistics. Needs bars."""
    return f"""
v0 AS (
  SELECT *, coalesce(avg(volume) OVER (ROWS20), 0) AS volume_sma20, lag(volume) OVER ({S}) AS v1, lag(volume, 2) OVER ({S}) AS v2,
         max(volume) OVER ({S} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS top10
  FROM bars),
vol AS (
  SELECT *, CASE WHEN volume_sma20 > 0 THEN volume / volume_sma20 ELSE 1 END AS anomaly_ratio,
         CASE WHEN v1 > 0 THEN volume / v1 ELSE 1 END AS vs_previous, CASE WHEN top10 > 0 THEN volume / top10 ELSE 1 END AS vs_max10,
         CASE WHEN volume > v1 AND v1 > v2 THEN 'increasing' WHEN volume < v1 AND v1 < v2 THEN 'decreasing' ELSE 'normal' END AS volume_trend
  FROM v0)""".replace("ROWS20", f"{S} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING")


def targets(timeframe: str) -> str:
    """tgt: forward targets. Needs bars."""
    from barloom.functions.scalar import horizon_bars
    from barloom.operators.targets import HORIZONS

    day = horizon_bars(timeframe, "1d")
    ret = lambda h: f"(lead(close, {horizon_bars(timeframe, h)}) OVER ({S}) - close) / nullif(close, 0) * 100"
    way = lambda h: f"CASE WHEN return_{h} > 0.3 THEN 1 WHEN return_{h} < -0.3 THEN -1 WHEN return_{h} IS NOT NULL THEN 0 END AS direction_{h}"
    return f"""
t0 AS (SELECT *, (close - lag(close) OVER ({S})) / nullif(lag(close) OVER ({S}), 0) * 100 AS step FROM bars),
t1 AS (
  SELECT *, {", ".join(f"{ret(h)} AS return_{h}" for h in HORIZONS)},
         count(close) OVER wf AS ahead, count(step) OVER wf AS steps, stddev_pop(step) OVER wf AS vola
  FROM t0 WINDOW wf AS ({S} ROWS BETWEEN 1 FOLLOWING AND {day} FOLLOWING)),
peaks AS (
  SELECT a.symbol, a.i, b.i AS j, b.close AS c, max(b.close) OVER (PARTITION BY a.symbol, a.i ORDER BY b.i) AS peak
  FROM bars a JOIN bars b ON a.symbol = b.symbol AND b.i BETWEEN a.i AND a.i + {day}),
dds AS (SELECT symbol, i, max(coalesce((peak - c) / nullif(peak, 0), 0) * 100) AS dd FROM peaks GROUP BY symbol, i),
tgt AS (
  SELECT t1.*, CASE WHEN ahead = {day} AND steps >= 2 THEN vola END AS volatility_1d, CASE WHEN ahead = {day} THEN dd END AS max_drawdown_1d,
         {", ".join(way(h) for h in HORIZONS)}
  FROM t1 JOIN dds USING (symbol, i) WHERE return_1d IS NOT NULL)"""


def trends(daily: bool = False) -> str:
    """tr: bars with trend and global_trend (daily: the trend at the end of the bar's day). Needs bars."""
    case = lambda u, d, ok: f"CASE WHEN {ok} AND {u} >= 4 AND {d} <= 1 THEN 'Uptrend' WHEN {ok} AND {d} >= 4 AND {u} <= 1 THEN 'Downtrend' ELSE 'Sideways' END"
    day = "PARTITION BY symbol, open_time_ms // 86400000"
    return f"""
tr0 AS (SELECT *, coalesce((close > lag(close) OVER ({S}))::INT, 0) AS up, coalesce((close < lag(close) OVER ({S}))::INT, 0) AS down FROM bars),
tr1 AS (
  SELECT *, sum(up) OVER w5 AS ups, sum(down) OVER w5 AS downs,
         sum(CASE WHEN i >= n - 5 THEN up ELSE 0 END) OVER (PARTITION BY symbol) AS gups,
         sum(CASE WHEN i >= n - 5 THEN down ELSE 0 END) OVER (PARTITION BY symbol) AS gdowns
  FROM tr0 WINDOW w5 AS ({S} ROWS 4 PRECEDING)),
tr2 AS (SELECT *, {case("ups", "downs", "i >= 3")} AS trend, {case("gups", "gdowns", "n >= 6")} AS whole_trend FROM tr1),
tr AS (SELECT *, {f"CASE WHEN max(i) OVER ({day}) >= 5 THEN last_value(trend) OVER ({day} ORDER BY open_time_ms ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE 'Sideways' END" if daily else "whole_trend"} AS global_trend FROM tr2)"""


def patterns(daily: bool = False) -> str:
    """pat: recognised patterns (daily: judged by the trend of their last bar's day). Needs trends."""
    cols = ("open", "high", "low", "close")
    ahead = ", ".join(f"lead({c}, {k}) OVER ({S}) AS {c[0]}{k + 1}" for k in (1, 2) for c in cols)
    shape = ", ".join(
        f"abs(c{k} - o{k}) AS b{k}, h{k} - l{k} AS r{k}, h{k} - greatest(o{k}, c{k}) AS u{k}, least(o{k}, c{k}) - l{k} AS d{k}, c{k} > o{k} AS g{k}, c{k} < o{k} AS x{k}"
        for k in (1, 2, 3)
    )
    up, down, up3, down3 = "judge2 = 'Uptrend'", "judge2 = 'Downtrend'", "judge3 = 'Uptrend'", "judge3 = 'Downtrend'"
    judge2, judge3 = (f"lead(global_trend, {k}) OVER ({S})" if daily else "global_trend" for k in (1, 2))
    return f"""
p0 AS (SELECT *, {judge2} AS judge2, {judge3} AS judge3, open AS o1, high AS h1, low AS l1, close AS c1, {ahead}, lead(trend) OVER ({S}) AS trend2, lead(trend, 2) OVER ({S}) AS trend3,
              lead(open_time_ms) OVER ({S}) AS time2, lead(open_time_ms, 2) OVER ({S}) AS time3 FROM tr),
p1 AS (SELECT *, {shape}, (o1 + c1) / 2 AS mid FROM p0),
pm AS (
  SELECT *,
    CASE WHEN r1 <= 1e-7 THEN 'Doji'
         WHEN b1 / r1 < 0.015 AND d1 / r1 > 0.6 AND u1 / r1 < 0.1 THEN 'DragonflyDoji'
         WHEN b1 / r1 < 0.015 AND u1 / r1 > 0.6 AND d1 / r1 < 0.1 THEN 'GravestoneDoji'
         WHEN b1 / r1 < 0.015 THEN 'Doji'
         WHEN b1 / r1 > 0.95 AND g1 THEN 'BullishMarubozu'
         WHEN b1 / r1 > 0.95 AND x1 THEN 'BearishMarubozu'
         WHEN b1 / r1 < 0.3 AND u1 / r1 > 0.25 AND d1 / r1 > 0.25 THEN 'SpinningTop' END AS single,
    CASE WHEN NOT (b1 > 1e-7 AND b2 > 1e-7) THEN NULL
         WHEN x1 AND g2 AND o2 <= c1 AND c2 >= o1 AND b2 > b1 THEN 'BullishEngulfing'
         WHEN g1 AND x2 AND o2 >= c1 AND c2 <= o1 AND b2 > b1 THEN 'BearishEngulfing'
         WHEN {down} AND x1 AND g2 AND o2 < c1 AND c2 > mid AND c2 < o1 THEN 'PiercingLine'
         WHEN {up} AND g1 AND x2 AND o2 > c1 AND c2 < mid AND c2 > o1 THEN 'DarkCloudCover'
         WHEN b2 < 0.6 * b1 AND x1 AND g2 AND o2 <= o1 AND c2 >= c1 THEN 'BullishHarami'
         WHEN b2 < 0.6 * b1 AND g1 AND x2 AND o2 >= o1 AND c2 <= c1 THEN 'BearishHarami'
         WHEN {down} AND abs(l2 - l1) / nullif(r1, 0) < 0.08 THEN 'TweezerBottoms'
         WHEN {up} AND abs(h2 - h1) / nullif(r1, 0) < 0.08 THEN 'TweezerTops' END AS double,
    CASE WHEN NOT (r1 > 1e-7 AND r2 > 1e-7 AND c3 IS NOT NULL) THEN NULL
         WHEN {down3} AND x1 AND g3 AND b1 > 0.5 * r1 AND b2 < 0.3 * r2 AND b3 > 0.5 * b1 AND c3 > mid THEN 'MorningStar'
         WHEN {up3} AND g1 AND x3 AND b1 > 0.5 * r1 AND b2 < 0.3 * r2 AND b3 > 0.5 * b1 AND c3 < mid THEN 'EveningStar'
         WHEN g1 AND g2 AND g3 AND least(b1, b2, b3) > 0.5 * r1 AND o2 > o1 AND o3 > o2 AND c2 > c1 AND c3 > c2
              AND u1 < 0.15 * b1 AND u2 < 0.15 * b2 AND u3 < 0.15 * b3 THEN 'ThreeWhiteSoldiers'
         WHEN x1 AND x2 AND x3 AND least(b1, b2, b3) > 0.5 * r1 AND o2 < o1 AND o3 < o2 AND c2 < c1 AND c3 < c2
              AND d1 < 0.15 * b1 AND d2 < 0.15 * b2 AND d3 < 0.15 * b3 THEN 'ThreeBlackCrows'
         WHEN {down3} AND x1 AND g2 AND g3 AND b2 < 0.6 * b1 AND o2 >= c1 AND c2 <= o1 AND c3 > h1 THEN 'ThreeInsideUp'
         WHEN {up3} AND g1 AND x2 AND x3 AND b2 < 0.6 * b1 AND o2 <= c1 AND c2 >= o1 AND c3 < l1 THEN 'ThreeInsideDown' END AS triple
  FROM p1),
pat AS (
  SELECT symbol, timeframe, open_time_ms, single AS pattern_type, 1 AS span, trend AS trend_direction, open_time_ms AS end_time_ms, 'Single' AS category, global_trend
  FROM pm WHERE single IS NOT NULL
  UNION ALL SELECT symbol, timeframe, open_time_ms, double, 2, trend2, time2, 'Double', judge2 FROM pm WHERE double IS NOT NULL
  UNION ALL SELECT symbol, timeframe, open_time_ms, triple, 3, trend3, time3, CASE WHEN triple LIKE 'Three%' THEN 'Triple' ELSE 'Double' END, judge3
  FROM pm WHERE triple IS NOT NULL)"""


def metrics() -> str:
    """met: funding, open interest and liquidations of ALL by hour. Needs bars of 1h."""
    m = "PARTITION BY symbol ORDER BY open_time_ms"
    return f"""
fund0 AS (SELECT symbol, open_time_ms - open_time_ms % 28800000 AS open_time_ms, sum(CAST(round(close * 100) AS BIGINT))::DOUBLE / count(*) / 700001 AS funding_rate
          FROM bars GROUP BY symbol, open_time_ms - open_time_ms % 28800000),
fund AS (SELECT *, CASE WHEN row_number() OVER ({m}) > 30 THEN CASE WHEN stddev_pop(funding_rate) OVER w > 0
              THEN (funding_rate - avg(funding_rate) OVER w) / stddev_pop(funding_rate) OVER w ELSE 0 END END AS funding_rate_zscore
         FROM fund0 WINDOW w AS ({m} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
oi0 AS (SELECT symbol, open_time_ms, sum(trade_count) OVER ({m} ROWS UNBOUNDED PRECEDING)::DOUBLE AS open_interest FROM bars),
oi AS (SELECT *, CASE WHEN lag(open_interest, 24) OVER ({m}) > 0
              THEN (open_interest - lag(open_interest, 24) OVER ({m})) / lag(open_interest, 24) OVER ({m}) * 100 END AS oi_delta_pct FROM oi0),
liq AS (SELECT 'ALL' AS symbol, t - t % 3600000 AS open_time_ms,
               coalesce(sum(cents * k) FILTER (WHERE event_type IN ('error', 'view')), 0)::DOUBLE / 100 AS long_liquidation_usd,
               coalesce(sum(cents * k) FILTER (WHERE event_type NOT IN ('error', 'view')), 0)::DOUBLE / 100 AS short_liquidation_usd
        FROM ev GROUP BY t - t % 3600000),
met0 AS (
  SELECT symbol, open_time_ms, funding_rate_zscore, NULL::DOUBLE AS oi_delta_pct, NULL::DOUBLE AS long_liquidation_usd, NULL::DOUBLE AS short_liquidation_usd FROM fund
  UNION ALL SELECT symbol, open_time_ms, NULL, oi_delta_pct, NULL, NULL FROM oi
  UNION ALL SELECT symbol, open_time_ms, NULL, NULL, long_liquidation_usd, short_liquidation_usd FROM liq),
met AS (SELECT symbol, open_time_ms, max(funding_rate_zscore) AS funding_rate_zscore, max(oi_delta_pct) AS oi_delta_pct,
               max(long_liquidation_usd) AS long_liquidation_usd, max(short_liquidation_usd) AS short_liquidation_usd FROM met0 GROUP BY symbol, open_time_ms)"""


def features(active: str = "0") -> str:
    """feat: the feature store of 1h bars; active is the number of a row's active rules. Needs bars, frames, folds, trends, patterns, metrics."""
    from barloom.operators.features import FEATURES

    z = lambda c: f"CASE WHEN i >= 19 THEN CASE WHEN stddev_pop({c}) OVER w20 > 0 THEN ({c} - avg({c}) OVER w20) / stddev_pop({c}) OVER w20 ELSE 0 END END"
    chg = lambda k: f"(close - lag(close, {k}) OVER w) / nullif(lag(close, {k}) OVER w, 0) * 100"
    part = lambda x: f"CASE WHEN high - low > 0 THEN ({x}) / (high - low) END"
    dist = lambda c: f"(close - {c}) / nullif({c}, 0) * 100"
    made = [
        chg(1), chg(4), chg(24), "(high - low) / nullif(close, 0) * 100", part("abs(close - open)"), part("high - greatest(open, close)"), part("least(open, close) - low"),
        z("close"), z("volume"), "CASE WHEN i >= 19 THEN volume / nullif(avg(volume) OVER w20, 0) END", "CASE WHEN volume > 0 THEN taker_buy_volume / volume END",
        "rsi14", "CASE WHEN i >= 5 THEN (2 * rsi14 + lag(rsi14) OVER w - lag(rsi14, 3) OVER w - 2 * lag(rsi14, 4) OVER w) / 10 END",
        "macd_norm", "macd_signal_norm", "macd_histogram_norm", dist("ema12"), dist("ema26"), dist("ema50"), dist("ema200"),
        "(bollinger_upper - bollinger_lower) / nullif(bollinger_middle, 0) * 100",
        "CASE WHEN bollinger_upper - bollinger_lower > 0 THEN (close - bollinger_lower) / (bollinger_upper - bollinger_lower) END",
        "atr14 / nullif(close, 0) * 100", "(obv - obv_ema50) / nullif(abs(obv_ema50), 0) * 100", dist("vwap"), dist("rolling_vwap24"),
        "m_f", "m_o", "m_l", "m_s", "('0x' || substr(md5(p_type), 1, 7))::BIGINT % 1000", active,
    ]
    return f"""
pat1 AS (SELECT symbol, open_time_ms, max(pattern_type) AS p_type FROM pat GROUP BY symbol, open_time_ms),
j1 AS (SELECT ind.*, met.funding_rate_zscore AS m_f, met.oi_delta_pct AS m_o, met.long_liquidation_usd AS m_l, met.short_liquidation_usd AS m_s
       FROM ind ASOF LEFT JOIN met ON ind.symbol = met.symbol AND ind.open_time_ms >= met.open_time_ms),
j2 AS (SELECT j1.*, pat1.p_type FROM j1 ASOF LEFT JOIN pat1 ON j1.symbol = pat1.symbol AND j1.open_time_ms >= pat1.open_time_ms),
feat0 AS (SELECT symbol, timeframe, open_time_ms, i, close, {", ".join(f"{e} AS {f}" for e, f in zip(made, ["_" + f for f in FEATURES]))}
          FROM j2 WHERE n >= 300 WINDOW w AS ({S}), w20 AS ({S} ROWS 19 PRECEDING)),
feat1 AS (SELECT symbol, timeframe, open_time_ms, i, close, {", ".join(f"_{f} AS {f}" for f in FEATURES)},
                 ({" + ".join(f"(_{f} IS NULL)::INT" for f in FEATURES)}) / {float(len(FEATURES))} AS null_ratio FROM feat0),
feat AS (SELECT * FROM feat1 WHERE null_ratio <= 0.25)"""
