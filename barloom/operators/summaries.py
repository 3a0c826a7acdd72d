"""Texts about series: patterns, volume, structure and prices, and the context of an analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import hour_minute, iso_utc
from barloom.operators import indicators as ti
from barloom.operators.patterns import recognise
from barloom.operators.series import KEY, SERIES
from barloom.operators.vectors import top_similar
from barloom.operators.volume import volume_stats

#: Fixed value: what the summary of a series without patterns says.
NO_PATTERNS = "No significant candlestick patterns detected in recent bars."
#: What an event of the structure says.
MESSAGES = {
    ("BOS", "Bullish"): "Break of Structure: Higher High", ("BOS", "Bearish"): "Break of Structure: Lower Low",
    ("CHoCH", "Bearish"): "Change of Character: Bullish to Bearish", ("CHoCH", "Bullish"): "Change of Character: Bearish to Bullish",
}


def two(c: Column) -> Column:
    """Two decimals, halves away from zero; null stays null."""
    return F.when(c.isNotNull(), F.format_string("%.2f", F.round(c, 2)))


def joined(items: Column, mark: str) -> Column:
    """Collected structs in order, their texts (t) joined."""
    return F.array_join(F.transform(F.sort_array(items), lambda x: x["t"]), mark)


def latest(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows of each series."""
    newest = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("open_time_ms")))
    return rows.withColumn("_back", newest).where(F.col("_back") <= n)


def volume_summary(stats: DataFrame) -> DataFrame:
    """The last bar's volume against the 20 before it, and the mean of the last five of these ratios."""
    last = F.max(F.when(F.col("_back") == 1, F.col("anomaly_ratio")))
    word = F.when(last > 1.5, "Above-average volume.").when(last < 0.5, "Below-average volume.").otherwise("Normal volume.")
    return latest(stats, 5).groupBy(*SERIES).agg(
        F.concat(F.lit("Latest volume anomaly: "), two(last), F.lit("x (avg last 5 bars: "), two(F.avg("anomaly_ratio")), F.lit("x). "), word).alias("volume_summary")
    )


def pattern_summary(bars: DataFrame, tail: int = 30) -> DataFrame:
    """The patterns and volume spikes of each series' last bars; a pattern of several bars is
    named once."""
    recent = latest(bars, tail).drop("_back")
    found = recognise(recent)
    at = hour_minute(F.col("open_time_ms"))
    one, more = F.col("span") == 1, F.col("span") > 1
    names = found.groupBy(*SERIES).agg(
        F.count_if(one).alias("singles"),
        joined(F.collect_list(F.when(one, F.struct("open_time_ms", F.concat("pattern_type", F.lit("@"), at).alias("t")))), ", ").alias("single_list"),
        F.array_join(F.sort_array(F.collect_set(F.when(more, F.col("pattern_type")))), ", ").alias("multi_list"),
    )
    loud = volume_stats(bars).join(recent.select(*KEY), KEY, "left_semi").where("anomaly_ratio > 1.5")
    spikes = loud.groupBy(*SERIES).agg(joined(F.collect_list(F.struct("open_time_ms", F.concat(F.format_string("%.1f", F.round("anomaly_ratio", 1)), F.lit("x@"), at).alias("t"))), ", ").alias("spike_list"))
    lines = F.array_compact(F.array(
        F.when(F.col("singles") > 0, F.format_string("Single-candle patterns (%d): %s.", "singles", "single_list")),
        F.when(F.col("multi_list") != "", F.format_string("Multi-candle patterns: %s.", "multi_list")),
        F.when(F.col("spike_list") != "", F.format_string("Volume spikes: %s.", "spike_list")),
    ))
    every = bars.select(*SERIES).distinct()
    text = F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(NO_PATTERNS)
    return every.join(names, SERIES, "left").join(spikes, SERIES, "left").select(*SERIES, text.alias("pattern_summary"))


def event_counts(events: DataFrame) -> DataFrame:
    """bos and choch: how many events of each type a series has."""
    return events.groupBy(*SERIES).agg(F.count_if(F.col("event") == "BOS").alias("bos"), F.count_if(F.col("event") == "CHoCH").alias("choch"))


def structure_summary(points: DataFrame, events: DataFrame, trends: DataFrame) -> DataFrame:
    """The swings, the trend, the events by type and the last three of them."""
    message = F.lit(None).cast("string")
    for (event, direction), text in MESSAGES.items():
        message = F.when((F.col("event") == event) & (F.col("direction") == direction), text).otherwise(message)
    order = Window.partitionBy(*SERIES).orderBy(F.desc("open_time_ms"), F.asc("price"), F.desc("event"))
    item = F.struct((-F.col("_r")).alias("o"), F.concat(F.lit("- ["), "event", F.lit("] "), message, F.lit(" @ "), two(F.col("price"))).alias("t"))
    last = events.withColumn("_r", F.row_number().over(order)).where("_r <= 3").groupBy(*SERIES).agg(joined(F.collect_list(item), "\n").alias("lines"))
    counted = points.groupBy(*SERIES).agg(F.count("*").alias("swings")).join(trends.select(*SERIES, "trend"), SERIES)
    text = F.concat_ws(
        "\n",
        F.format_string("Market Structure: %d swing points detected. Current trend: %s.", "swings", "trend"),
        F.when(F.col("lines").isNotNull(), F.format_string("Events: %d BOS, %d CHoCH.", "bos", "choch")),
        "lines",
    )
    return counted.join(event_counts(events), SERIES, "left").join(last, SERIES, "left").select(*SERIES, text.alias("structure_summary"))


def tech_summary(bars: DataFrame, limit: int = 48) -> DataFrame:
    """The prices, change and RSI of each series' last bars, with their patterns and volume."""
    recent = latest(bars, min(max(limit, 1), 2000)).drop("_back")
    facts = ti.simple_rsi(recent)
    ends = recent.groupBy(*SERIES).agg(F.min("open_time_ms").alias("begin"), F.max("open_time_ms").alias("end"))
    rsi = F.coalesce(two(F.col("simple_rsi")), F.lit("n/a (not enough bars)"))
    head = F.concat_ws(
        "\n",
        F.format_string("%s (%s candles, last %d bars).", "symbol", "timeframe", "bars"),
        F.concat(F.lit("First bar close (oldest in window): "), two(F.col("first_close")), F.lit(" at "), iso_utc(F.col("begin")), F.lit(".")),
        F.concat(F.lit("Last bar close (newest): "), two(F.col("last_close")), F.lit(" at "), iso_utc(F.col("end")), F.lit(".")),
        F.concat(F.lit("Period high: "), two(F.col("max_high")), F.lit(", period low: "), two(F.col("min_low")), F.lit(".")),
        F.concat(F.lit("Approximate change from oldest to newest close in window: "), two(F.col("change_pct")), F.lit("%.")),
        F.concat(F.lit("Simple RSI(14) on closes (last window): "), rsi, F.lit(".")),
    )
    whole = facts.join(ends, SERIES).join(pattern_summary(recent), SERIES).join(volume_summary(volume_stats(recent)), SERIES)
    return whole.select(*SERIES, F.concat_ws("\n\n", head, "pattern_summary", "volume_summary").alias("tech_summary"))


#: What a context without similarity, and one without articles, says.
BY_RECENCY = "(Retrieved by recency; embedding similarity unavailable.)"
NO_ARTICLES = "No news articles are stored in the database yet. The RSS ingestion worker may still be running or feeds may be unavailable."


def news_context(chunks: DataFrame, articles: DataFrame, query: list[float] | None, k: int = 8) -> DataFrame:
    """One row, the context: the k chunks most like the query, each under its article's title and
    link; without a query, or without a chunk of its length, the k latest articles.

    chunks: article_id, chunk_index, text, embedding. articles: id, title, link, summary,
    published_at, fetched_at.
    """
    block = lambda *parts: F.concat_ws("\n", F.lit("---"), *parts)
    title, link = F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Link: "), "link")
    key = chunks.withColumn("_key", F.struct("article_id", "chunk_index"))
    top = None if query is None else top_similar(key, query, k, id_col="_key")
    if top is not None and not top.isEmpty():
        own = articles.select(F.col("id").alias("article_id"), "title", "link")
        # at most k rows from here on
        rows = top.join(key.select("_key", "article_id", "text"), "_key").join(own, "article_id")
        item = F.struct((-F.col("similarity")).alias("s"), "_key", block(title, link, "text").alias("t"))
        return rows.agg(joined(F.collect_list(item), "\n\n").alias("context"))
    at = F.coalesce("published_at", "fetched_at")
    newest = articles.orderBy(F.desc(at), "id").limit(k)
    item = F.struct((-F.unix_micros(at)).alias("s"), "id", block(title, link, F.nullif(F.trim("summary"), F.lit(""))).alias("t"))
    text = joined(F.collect_list(item), "\n\n")
    return newest.agg(F.when(text == "", F.lit(NO_ARTICLES)).otherwise(F.concat(F.lit(BY_RECENCY + "\n"), text)).alias("context"))


def analysis_context(bars: DataFrame, chunks: DataFrame, articles: DataFrame, query: list[float] | None, limit: int = 48) -> DataFrame:
    """symbol, news_context, tech_context: what an analysis of each series is asked with."""
    news = news_context(chunks, articles, query).select(F.col("context").alias("news_context"))
    # news is one row
    return tech_summary(bars, limit).select(*SERIES, F.col("tech_summary").alias("tech_context")).crossJoin(F.broadcast(news))


