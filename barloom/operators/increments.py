"""Indexes of volume statistics and patterns that grow with their bars.

An increment reads, of each series, the bars after the last one that it has stored, and as many
before them as its windows look back on; what is not stored yet is added. Increments of whole
days add up to the index built at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import patterns as pt
from barloom.operators.series import KEY, SERIES
from barloom.operators.volume import BACK as VOLUME_BACK
from barloom.operators.volume import volume_stats
from barloom.sources.tables import append_new
from barloom.streaming import ledger

VOLUME = "symbol string, timeframe string, open_time_ms long, volume double, volume_sma20 double, anomaly_ratio double, vs_previous double, vs_max10 double, volume_trend string"
PATTERNS = (
    "symbol string, timeframe string, open_time_ms long, open double, high double, low double, close double, volume double, global_trend string, "
    "pattern_type string, span int, trend_direction string, end_time_ms long, category string"
)
PATTERN_KEY = [*KEY, "pattern_type"]
#: Bars that a pattern and its trends look back on: five changes of the close before the first
#: of three bars, one of which may be stored already.
PATTERN_BACK = 10


def tail(bars: DataFrame, marks: DataFrame, back: int) -> DataFrame:
    """bars after their series' mark (symbol, timeframe, mark), with _new, and the `back` last
    ones up to it. A series without a mark is new from its beginning."""
    marked = bars.join(marks, SERIES, "left").withColumn("_new", F.col("mark").isNull() | (F.col("open_time_ms") > F.col("mark"))).drop("mark")
    newest = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("open_time_ms")))
    before = marked.where(~F.col("_new")).withColumn("_r", newest).where(F.col("_r") <= back).drop("_r")
    return marked.where("_new").unionByName(before)


def _marks(stored: DataFrame) -> DataFrame:
    return stored.groupBy(*SERIES).agg(F.max("open_time_ms").alias("mark"))


def index_volume(bars: DataFrame, path: str, batch: int) -> bool:
    """Adds the statistics of the bars that the index at path lacks, as one batch of it."""
    have = ledger.read(bars.sparkSession, path, VOLUME).drop("batch")
    rows = tail(bars, _marks(have), VOLUME_BACK)
    made = volume_stats(rows).join(rows.where("_new").select(*KEY), KEY, "left_semi")
    return ledger.put(append_new(have, made, KEY), path, batch)


def index_patterns(bars: DataFrame, path: str, batch: int) -> bool:
    """Adds the patterns that the index at path lacks. A pattern is judged by the trend at the
    end of the day that it ends in. Everything that ends after the last stored pattern begins is
    looked at again, since a series may have bars after it that made no pattern."""
    have = ledger.read(bars.sparkSession, path, PATTERNS).drop("batch")
    marks = _marks(have)
    rows = tail(bars, marks, PATTERN_BACK).drop("_new")
    made = pt.recognise_daily(rows).join(marks, SERIES, "left").where(F.col("mark").isNull() | (F.col("end_time_ms") > F.col("mark"))).drop("mark")
    return ledger.put(append_new(have, made, PATTERN_KEY), path, batch)
