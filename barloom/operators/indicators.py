"""Technical indicators: frames in SQL windows over slices, recursions by affine maps of slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import ratio, utc_day
from barloom.operators import slices as sl
from barloom.operators.recursions import folded
from barloom.operators.series import KEY, SERIES, index, lag, rows
from barloom.operators.slices import SLICE_BARS


def zscore(c: str, n: int = 20):
    """Against n bars, the current one included; null before there are n, 0 without spread."""
    frame = rows(1 - n, 0)
    mean, std = F.avg(c).over(frame), F.stddev_pop(c).over(frame)
    return F.when(index() >= n - 1, F.when(std > 0, (F.col(c) - mean) / std).otherwise(0.0))


def sma_ratio(c: str, n: int = 20):
    return F.when(index() >= n - 1, ratio(F.col(c), F.avg(c).over(rows(1 - n, 0))))


def frame_indicators(bars: DataFrame, slice_bars: int = SLICE_BARS) -> DataFrame:
    """Adds Bollinger bands, session and rolling VWAP, OBV and true range to bars, and the
    change of the close from the bar before.

    Frames are of 24 bars at most and run inside slices with as many bars of halo; the session
    runs inside its day; OBV is summed in its slice, on top of the sums of the slices before.
    """
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    before = sl.neighbour("close", -1)
    back = F.coalesce(before, F.col("open"))
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - back), F.abs(F.col("low") - back))
    step = F.when(before.isNull() | (F.col("close") > before), F.col("volume")).when(F.col("close") < before, -F.col("volume")).otherwise(0.0)
    last20, last24 = sl.window(-19, 0), sl.window(-23, 0)
    mean, std = F.avg("close").over(last20), F.stddev_pop("close").over(last20)
    full = F.col("_i") >= 19
    # sums of volumes are made in cents, so that their order does not matter
    cents = lambda c: F.round(c * 100).cast("long")
    framed = (
        sl.sliced(bars if "_i" in bars.columns else sl.placed(bars), before=23, slice_bars=slice_bars)
        .withColumns({"_day": utc_day(F.col("open_time_ms")), "_pv": tp * F.col("volume"), "true_range": tr, "_step": cents(step), "change": F.col("close") - before})
        .withColumns({
            "bollinger_middle": F.when(full, mean), "bollinger_upper": F.when(full, mean + 2 * std),
            "bollinger_lower": F.when(full, mean - 2 * std),
            "rolling_vwap24": ratio(F.sum("_pv").over(last24), F.sum("volume").over(last24)),
        })
        .where("_own")
    )
    sums = framed.groupBy(*sl.SLICED).agg(F.sum("_step").alias("_in"))
    earlier = Window.partitionBy(*SERIES).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*sl.SLICED, F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_carried"))
    day = Window.partitionBy(*SERIES, "_day").orderBy("open_time_ms").rowsBetween(Window.unboundedPreceding, 0)
    own = sl.window(Window.unboundedPreceding, 0)
    return (
        framed.join(sums, sl.SLICED)
        .withColumn("obv", (F.col("_carried") + F.sum("_step").over(own)) / 100)
        .withColumn("vwap", ratio(F.sum("_pv").over(day), F.sum("volume").over(day)))
        .drop("_day", "_pv", "_step", "_own", "_carried")
    )


def technical_indicators(bars: DataFrame, least_bars: int = 50, slice_bars: int = SLICE_BARS) -> DataFrame:
    """All indicators of series with least_bars bars or more."""
    framed = frame_indicators(sl.placed(bars).where(F.col("_n") >= least_bars), slice_bars)
    normal = lambda c: F.when(F.col("atr14") > 0, ratio(F.col(c), F.col("atr14")))
    return framed.join(folded(framed), KEY).drop("_i", "_n", "_slice", "change").withColumns({
        "macd_norm": normal("macd"), "macd_signal_norm": normal("macd_signal"), "macd_histogram_norm": normal("macd_histogram"),
    })


def simple_rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """The plain-mean RSI of each series' last bar, and its first and last close, highest
    high, lowest low and change in percent. Fewer than n + 1 bars: the RSI is null."""
    d = F.col("close") - lag("close")
    changes = bars.withColumns({"up": F.greatest(d, F.lit(0.0)), "down": F.greatest(-d, F.lit(0.0)), "i": index()})
    up, down = F.avg("up").over(rows(1 - n, 0)), F.avg("down").over(rows(1 - n, 0))
    value = F.when(F.col("i") >= n, F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / F.nullif(down, F.lit(0.0)))))
    first, last = F.min_by("close", "open_time_ms"), F.max_by("close", "open_time_ms")
    return (
        changes.withColumn("rsi", value)
        .groupBy(*SERIES)
        .agg(
            F.count("*").alias("bars"), F.max("high").alias("max_high"), F.min("low").alias("min_low"), first.alias("first_close"),
            last.alias("last_close"), F.coalesce(ratio(last - first, first) * 100, F.lit(0.0)).alias("change_pct"),
            F.max_by("rsi", "open_time_ms").alias("simple_rsi"),
        )
    )


def rsi_slope(ind: DataFrame, c: str = "rsi14"):
    """Least-squares slope over the last five rows; null before there are six."""
    y = [F.col(c), *(lag(c, k) for k in range(1, 5))]
    return F.when(index() >= 5, (2 * y[0] + y[1] - y[3] - 2 * y[4]) / 10)

