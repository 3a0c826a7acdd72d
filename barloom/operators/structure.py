"""Market structure: swing points, breaks of structure and the trend they make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.series import SERIES, by_time, index, rows, whole


def swings(bars: DataFrame, k: int = 5) -> DataFrame:
    """Bars whose high (low) is above (below) those of k bars on each side. label compares a
    swing with the one of its kind before: HH, LH, HL or LL, null for the first of a kind and for the
    first two of the series."""
    high = (F.col("high") > F.max("high").over(rows(-k, -1))) & (F.col("high") > F.max("high").over(rows(1, k)))
    low = (F.col("low") < F.min("low").over(rows(-k, -1))) & (F.col("low") < F.min("low").over(rows(1, k)))
    inner = (F.col("_i") >= k) & (F.col("_i") < F.col("_n") - k)
    found = F.filter(
        F.array(
            F.struct(F.lit("High").alias("type"), F.col("high").alias("price"), (high & inner).alias("ok")),
            F.struct(F.lit("Low").alias("type"), F.col("low").alias("price"), (low & inner).alias("ok")),
        ),
        lambda x: x["ok"],
    )
    points = (
        bars.withColumns({"_i": index(), "_n": F.count("*").over(whole())})
        .withColumn("s", found)
        .select(*SERIES, "open_time_ms", F.col("_i").alias("bar_index"), F.explode("s").alias("s"))
        .select(*SERIES, "open_time_ms", "bar_index", "s.type", "s.price")
    )
    before = F.lag("price").over(Window.partitionBy(*SERIES, "type").orderBy("open_time_ms"))
    label = F.when(F.col("type") == "High", F.when(F.col("price") > before, "HH").when(before.isNotNull(), "LH")).otherwise(
        F.when(F.col("price") > before, "HL").when(before.isNotNull(), "LL")
    )
    place = F.row_number().over(Window.partitionBy(*SERIES).orderBy("open_time_ms", "type"))
    return points.withColumn("label", F.when(place > 2, label))


def events(points: DataFrame) -> DataFrame:
    """Breaks of structure (BOS) and changes of character (CHoCH) at each swing, against the
    swing before it of either kind."""
    w = by_time().orderBy("open_time_ms", "type")
    before, was = F.lag("type").over(w), F.lag("label").over(w)
    high, low = F.col("type") == "High", F.col("type") == "Low"
    made = F.array_compact(F.array(
        F.when(high & (F.col("label") == "HH") & (before == "Low"), F.struct(F.lit("BOS").alias("event"), F.lit("Bullish").alias("direction"))),
        F.when(low & (F.col("label") == "LL") & (before == "High"), F.struct(F.lit("BOS").alias("event"), F.lit("Bearish").alias("direction"))),
        F.when(low & (F.col("label") == "LL") & (before == "High") & (was == "HH"), F.struct(F.lit("CHoCH").alias("event"), F.lit("Bearish").alias("direction"))),
        F.when(high & (F.col("label") == "LH") & (before == "Low") & (was == "HL"), F.struct(F.lit("CHoCH").alias("event"), F.lit("Bullish").alias("direction"))),
    ))
    return points.withColumn("e", made).select(*SERIES, "open_time_ms", "price", F.explode("e").alias("e")).select(*SERIES, "open_time_ms", "price", "e.*")


def trend(points: DataFrame) -> DataFrame:
    """Uptrend if the last high is a HH and the last low a HL, Downtrend for LH and LL, else
    Sideways; series without two swings of each kind are Sideways."""
    of = lambda k, c: F.max_by(F.when(F.col("type") == k, F.col(c)), F.when(F.col("type") == k, F.col("open_time_ms")))
    n = lambda k: F.count_if(F.col("type") == k)
    return (
        points.groupBy(*SERIES)
        .agg(n("High").alias("highs"), n("Low").alias("lows"), of("High", "label").alias("last_high"), of("Low", "label").alias("last_low"))
        .withColumn(
            "trend",
            F.when((F.col("last_high") == "HH") & (F.col("last_low") == "HL"), "Uptrend")
            .when((F.col("last_high") == "LH") & (F.col("last_low") == "LL"), "Downtrend")
            .otherwise("Sideways"),
        )
    )
