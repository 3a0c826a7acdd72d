"""Forward targets: what follows each bar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalar import horizon_bars, ratio
from barloom.operators.series import KEY, lag, lead, rows

HORIZONS = ("1h", "4h", "1d", "3d", "7d")


def forward_return(bars: int):
    return ratio(lead("close", bars) - F.col("close"), F.col("close")) * 100


def direction(r):
    return F.when(r > 0.3, 1).when(r < -0.3, -1).when(r.isNotNull(), 0)


def price_targets(bars: DataFrame, timeframe: str) -> DataFrame:
    """Return in percent and direction at five horizons, and the next day's volatility
    (population deviation of one-bar returns) and maximum drawdown. Rows without a return of
    one day are left out."""
    day = horizon_bars(timeframe, "1d")
    b = bars.withColumn("step", ratio(F.col("close") - lag("close"), lag("close")) * 100)
    ahead = F.collect_list("close").over(rows(0, day))
    start = F.struct(F.col("close").alias("peak"), F.lit(0.0).alias("dd"))
    drop = F.aggregate(
        ahead, start,
        lambda a, x: F.struct(
            F.greatest(a["peak"], x).alias("peak"),
            F.greatest(a["dd"], F.coalesce(F.try_divide(F.greatest(a["peak"], x) - x, F.greatest(a["peak"], x)), F.lit(0.0)) * 100).alias("dd"),
        ),
        lambda a: a["dd"],
    )
    full = F.count("close").over(rows(1, day)) == day
    steps = F.count("step").over(rows(1, day))
    out = b.select(
        *KEY, "close", *(forward_return(horizon_bars(timeframe, h)).alias(f"return_{h}") for h in HORIZONS),
        F.when(full & (steps >= 2), F.stddev_pop("step").over(rows(1, day))).alias("volatility_1d"),
        F.when(full, drop).alias("max_drawdown_1d"),
    ).where("return_1d is not null")
    return out.select("*", *(direction(F.col(f"return_{h}")).alias(f"direction_{h}") for h in HORIZONS))
