"""Schemas of the engine's tables, as DDL."""

from __future__ import annotations

KEY = "symbol string, timeframe string, open_time_ms long"

BARS = (
    KEY + ", close_time_ms long, open double, high double, low double, close double, volume double, "
    "quote_volume double, trade_count long, taker_buy_volume double, taker_buy_quote_volume double"
)
METRICS = (
    KEY + ", funding_rate double, open_interest double, long_short_ratio double, funding_rate_zscore double, "
    "oi_delta_pct double, long_liquidation_usd double, short_liquidation_usd double"
)
CONDITION = (
    "struct<type:string,direction:string,count:int,operator:string,reference:string,period:int,"
    "multiplier:double,value:double,side:string,position:string,barOffset:int>"
)
RULES = (
    "id long, name string, description string, symbol string, timeframe string, required_bars int, "
    f"is_enabled boolean, cooldown_minutes int, conditions array<{CONDITION}>, action string, priority int, "
    "is_auto_discovered boolean, win_rate double, avg_return double, sample_count int"
)
SIGNALS = KEY.replace("open_time_ms", "trigger_time_ms") + ", rule_id long, close_price double, message string, created_at timestamp"
ALERT_SETTINGS = (
    "user_id string, enabled boolean, price_above double, price_below double, kline_interval string, "
    "cooldown_minutes int, updated_at timestamp"
)
ALERTS = (
    "id string, user_id string, type string, title string, message string, price_snapshot double, "
    "created_at timestamp, is_read boolean"
)
ARTICLES = (
    "id string, source string, title string, link string, published_at timestamp, summary string, "
    "content string, fetched_at timestamp"
)
CHUNKS = "id string, article_id string, chunk_index int, text string, embedding array<float>, embedded_at timestamp"
WINDOW_VECTORS = (
    KEY.replace("open_time_ms", "start_time_ms") + ", end_time_ms long, feature_type string, window_size int, "
    "vector array<float>, vector_dim int, vector_norm float, version int"
)
