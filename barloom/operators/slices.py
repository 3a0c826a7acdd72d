"""Long series in slices, so that no task holds a whole series.

A bar's place in its series comes from counts of its time bucket and the sums of the buckets
before it, which are one row a bucket. Slices are runs of equal numbers of places. A window
that looks some bars back or ahead stays right inside a slice when the slice has copies of
that many neighbours (its halo); windows are then partitioned by series and slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.series import SERIES

#: Bars of a slice, and the width of the buckets that places are counted by.
SLICE_BARS, BUCKET_MS = 4096, 7 * 86_400_000
SLICED = [*SERIES, "_slice"]


def placed(bars: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """bars with _i, the place of each in its series from 0, and _n, the bars of the series."""
    bucketed = bars.withColumn("_bucket", F.floor(F.col("open_time_ms") / F.lit(bucket_ms)).cast("long"))
    counts = bucketed.groupBy(*SERIES, "_bucket").agg(F.count("*").alias("_in"))
    ordered = Window.partitionBy(*SERIES).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select(
        *SERIES, "_bucket", F.coalesce(F.sum("_in").over(ordered), F.lit(0)).alias("_before"), F.sum("_in").over(Window.partitionBy(*SERIES)).alias("_n")
    )
    within = F.row_number().over(Window.partitionBy(*SERIES, "_bucket").orderBy("open_time_ms"))
    return (
        bucketed.withColumn("_within", within)
        .join(sums, [*SERIES, "_bucket"])
        .withColumn("_i", F.col("_before") + F.col("_within") - 1)
        .drop("_bucket", "_within", "_before")
    )


def sliced(rows: DataFrame, before: int = 0, after: int = 0, slice_bars: int = SLICE_BARS) -> DataFrame:
    """Placed rows with _slice and _own; rows that another slice needs, as one of its `before`
    earlier or `after` later bars, are there once more for it, not its own."""
    n = F.lit(slice_bars)
    own = F.floor(F.col("_i") / n)
    first = F.greatest(F.floor((F.col("_i") - after) / n), F.lit(0))
    last = F.least(F.floor((F.col("_i") + before) / n), F.floor((F.col("_n") - 1) / n))
    return rows.withColumn("_slice", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_slice") == own)


def window(start: int, end: int):
    """A frame of rows inside a slice."""
    return Window.partitionBy(*SLICED).orderBy("open_time_ms").rowsBetween(start, end)


def neighbour(c: str, n: int):
    """The value n bars ahead (behind: negative) inside a slice."""
    return F.lead(c, n).over(Window.partitionBy(*SLICED).orderBy("open_time_ms"))
