"""Checks of bar series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalar import interval_ms
from barloom.operators.series import SERIES, index, lag


def empty(bars: DataFrame, expected: DataFrame) -> DataFrame:
    """An EMPTY issue for each expected series (symbol, timeframe) without a bar."""
    lacking = expected.select(*SERIES).distinct().join(bars.select(*SERIES).distinct(), SERIES, "left_anti")
    return lacking.select(*SERIES, F.lit(None).cast("long").alias("open_time_ms"), F.lit("EMPTY").alias("issue"), F.lit(0).cast("long").alias("missing"))


def issues(bars: DataFrame, timeframe: str) -> DataFrame:
    """symbol, timeframe, open_time_ms, issue and missing (bars lacking before this one)."""
    width = interval_ms(timeframe, 0)
    gap = F.col("open_time_ms") - lag("open_time_ms")
    missing = (F.floor(gap / width) - 1).cast("long") if width else F.lit(0).cast("long")
    none = F.lit(0).cast("long")
    issue = lambda bad, name, n=none: F.when(bad, F.struct(F.lit(name).alias("issue"), n.alias("missing")))
    c = F.col
    found = F.array_compact(F.array(
        issue(F.least("open", "high", "low", "close") < 0, "NEGATIVE_PRICE"),
        issue(c("high") < c("low"), "HIGH_BELOW_LOW"),
        issue(c("high") < F.greatest("open", "close"), "HIGH_BELOW_BODY"),
        issue(c("low") > F.least("open", "close"), "LOW_ABOVE_BODY"),
        issue(c("volume") < 0, "NEGATIVE_VOLUME"),
        issue(gap != width, "MISSING_CANDLE", missing),
    ))
    flagged = bars.withColumn("x", found).select(*SERIES, "open_time_ms", F.explode("x").alias("x")).select(*SERIES, "open_time_ms", "x.*")
    copies = bars.groupBy(*SERIES, "open_time_ms").count().where("count > 1")
    return flagged.unionByName(copies.select(*SERIES, "open_time_ms", F.lit("DUPLICATE_TIME").alias("issue"), none.alias("missing")))


def report(bars: DataFrame, timeframe: str) -> DataFrame:
    """Bars, bars with an issue of their own, valid bars, issues and is_valid of each series."""
    found = issues(bars, timeframe)
    bad = found.groupBy(*SERIES).agg(
        F.count("*").alias("issues"), F.countDistinct(F.when(F.col("issue") != "DUPLICATE_TIME", F.col("open_time_ms"))).alias("bad_bars")
    )
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    return (
        bars.groupBy(*SERIES).agg(F.count("*").alias("bars"))
        .join(bad, SERIES, "left")
        .select(*SERIES, "bars", zero(F.col("issues")).alias("issues"), (F.col("bars") - zero(F.col("bad_bars"))).alias("valid_bars"), (zero(F.col("issues")) == 0).alias("is_valid"))
    )


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of each key, the last by order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def with_index(bars: DataFrame) -> DataFrame:
    return bars.withColumn("bar_index", index())
