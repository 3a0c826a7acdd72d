"""Price alerts, their settings and the alert list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.ranges import less_pairs
from barloom.schemas import ALERT_SETTINGS
from barloom.sources.tables import upsert

#: The intervals that settings accept.
INTERVALS = {"1m", "3m", "5m", "15m", "30m", "1h", "2h", "4h", "6h", "8h", "12h", "1d", "3d", "1w"}


def checked_settings(user_id: str, enabled: bool, above: float | None, below: float | None, interval: str, cooldown: int) -> dict:
    """The settings as a row, or ValueError: user of up to 128 characters, cooldown of 1 to
    1440 minutes, a known interval (blank: 1m), above over below where both are there."""
    user, interval = (user_id or "").strip(), (interval or "").strip().lower() or "1m"
    if not user or len(user) > 128:
        raise ValueError("user_id")
    if not 1 <= cooldown <= 1440:
        raise ValueError("cooldown_minutes")
    if interval not in INTERVALS:
        raise ValueError("kline_interval")
    if above is not None and below is not None and above <= below:
        raise ValueError("price_above")
    return {"user_id": user, "enabled": enabled, "price_above": above, "price_below": below, "kline_interval": interval, "cooldown_minutes": cooldown}


def put_settings(spark: SparkSession, stored: DataFrame, settings: dict, as_of) -> DataFrame:
    return upsert(stored, spark.createDataFrame([settings | {"updated_at": as_of}], ALERT_SETTINGS), ["user_id"])


def settings_of(stored: DataFrame, user_id: str) -> DataFrame:
    """A user's settings; ValueError for a user that no settings can have."""
    user = (user_id or "").strip()
    if not user or len(user) > 128:
        raise ValueError("user_id")
    return stored.where(F.col("user_id") == user)


def price_hits(latest: DataFrame, settings: DataFrame) -> DataFrame:
    """latest(symbol, close, trigger_time_ms) against each user's thresholds: a close over
    price_above or under price_below. Only closes and thresholds that make a hit meet."""
    users = settings.where("enabled")
    closes = latest.select("symbol", F.col("close").cast("double").alias("price_snapshot"), "trigger_time_ms")

    def threshold(name: str) -> DataFrame:
        return users.select("user_id", "cooldown_minutes", F.col(name).cast("double").alias("_threshold"), F.lit(name).alias("type"))

    over = less_pairs(threshold("price_above"), closes, "_threshold", "price_snapshot")
    under = less_pairs(closes, threshold("price_below"), "price_snapshot", "_threshold", deal_high=True)
    return over.unionByName(under).select("user_id", "symbol", "type", "price_snapshot", "trigger_time_ms", "cooldown_minutes")


def not_recent(hits: DataFrame, alerts: DataFrame, as_of_ms: int) -> DataFrame:
    """Hits without an alert of that user and type since as_of minus the cooldown."""
    a = alerts.select(F.col("user_id").alias("u"), F.col("type").alias("t"), F.unix_millis("created_at").alias("made"))
    on = (F.col("user_id") == F.col("u")) & (F.col("type") == F.col("t")) & (F.col("made") >= F.lit(as_of_ms) - F.col("cooldown_minutes") * 60_000)
    return hits.join(a, on, "left_anti")


def alert_list(alerts: DataFrame, user_id: str, unread_only: bool = False, take: int = 50) -> DataFrame:
    """The newest alerts of a user; take outside 1..200 is 50."""
    take = take if 1 <= take <= 200 else 50
    rows = alerts.where(F.col("user_id") == user_id)
    rows = rows.where(~F.col("is_read")) if unread_only else rows
    return rows.orderBy(F.desc("created_at"), "id").limit(take)


def unread_count(alerts: DataFrame, user_id: str) -> DataFrame:
    return alerts.where((F.col("user_id") == user_id) & ~F.col("is_read")).agg(F.count("*").alias("unread"))


def alert_interval(settings: DataFrame) -> DataFrame:
    """The longest cooldown among enabled settings, 10 where there are none."""
    return settings.where("enabled").agg(F.coalesce(F.max("cooldown_minutes"), F.lit(10)).alias("cooldown_minutes"))
