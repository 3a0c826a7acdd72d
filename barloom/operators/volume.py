"""Volume statistics of each bar against the bars before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalar import ratio
from barloom.operators import slices as sl
from barloom.operators.series import KEY

#: Bars that the statistics look back on.
BACK = 20


def volume_stats(bars: DataFrame, slice_bars: int = sl.SLICE_BARS) -> DataFrame:
    """Mean of up to 20 earlier volumes (0 at the first bar), ratios to it, to the volume
    before and to the largest of 10 before (1 where there is none), and the trend of three.
    Series are taken in slices."""
    v, one, two = F.col("volume"), sl.neighbour("volume", -1), sl.neighbour("volume", -2)
    sma, top = F.coalesce(F.avg("volume").over(sl.window(-BACK, -1)), F.lit(0.0)), F.max("volume").over(sl.window(-10, -1))
    over = lambda base: F.when(base > 0, ratio(v, base)).otherwise(1.0)
    trend = F.when((v > one) & (one > two), "increasing").when((v < one) & (one < two), "decreasing").otherwise("normal")
    return sl.sliced(sl.placed(bars.select(*KEY, "volume")), before=BACK, slice_bars=slice_bars).select(
        *KEY, "volume", sma.alias("volume_sma20"), over(sma).alias("anomaly_ratio"), over(one).alias("vs_previous"),
        over(top).alias("vs_max10"), trend.alias("volume_trend"), "_own",
    ).where("_own").drop("_own")


def recent(stats: DataFrame, take: int = 100) -> DataFrame:
    """The newest rows first; take is held between 1 and 1000."""
    return stats.orderBy(F.desc("open_time_ms"), "symbol").limit(min(max(take, 1), 1000))
