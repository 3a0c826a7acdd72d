"""Scenario detectors over the last bars of each series, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.series import SERIES, index, lag, whole


def scenarios(bars: DataFrame, least: int = 5) -> DataFrame:
    """A row for each scenario that a series ends in: name, strength (0 to 1) and direction."""
    back = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("open_time_ms")))
    p, c = lag("close"), F.col("close")
    b = bars.withColumns({
        "i": index(), "n": F.count("*").over(whole()), "k": back, "rng": F.col("high") - F.col("low"), "body": F.abs(c - F.col("open")),
        "upper": F.col("high") - F.greatest("open", "close"), "lower": F.least("open", "close") - F.col("low"),
        "grew": F.col("high") - F.col("low") > 1.15 * (lag("high") - lag("low")), "thicker": F.col("volume") > 1.2 * lag("volume"),
        "not_up": F.coalesce(~(c > p), F.lit(True)), "not_down": F.coalesce(~(c < p), F.lit(True)),
    })
    at = lambda k, x: F.max(F.when(F.col("k") == k, F.col(x)))
    among = lambda lo, hi, cond: F.count_if(F.col("k").between(lo, hi) & cond)
    thin = (F.col("body") > 0) & (F.col("rng") > 0)
    facts = b.groupBy(*SERIES).agg(
        F.max("n").alias("n"),
        among(2, 5, F.col("grew")).alias("widened"), F.avg(F.when(F.col("k").between(2, 6), F.col("rng"))).alias("before"),
        at(1, "rng").alias("rng"), at(1, "open").alias("open"), at(1, "close").alias("close"), at(5, "close").alias("close5"),
        F.coalesce(F.min(F.when(F.col("not_up"), F.col("k"))) - 1, F.lit(0)).alias("rises"),
        F.coalesce(F.min(F.when(F.col("not_down"), F.col("k"))) - 1, F.lit(0)).alias("falls"),
        among(1, 4, thin & (F.col("upper") > 1.5 * F.col("body")) & (F.col("upper") > 0.2 * F.col("rng"))).alias("uppers"),
        among(1, 4, thin & (F.col("lower") > 1.5 * F.col("body")) & (F.col("lower") > 0.2 * F.col("rng"))).alias("lowers"),
        among(1, 4, F.col("thicker")).alias("thicker"),
        among(1, 3, (F.col("rng") > 0) & (F.col("body") < 0.3 * F.col("rng"))).alias("small"),
    )
    half = F.abs(F.col("close") - F.col("open")) > 0.5 * F.col("rng")
    way = lambda up: F.when(up, "Bullish").otherwise("Bearish")
    row = lambda ok, name, strength, direction: F.when(ok, F.struct(
        F.lit(name).alias("scenario"), F.least(F.lit(1.0), strength).cast("double").alias("strength"), direction.alias("direction")))
    n, run = F.col("n"), F.greatest("rises", "falls")
    made = F.array_compact(F.array(
        row((n >= 6) & (F.col("widened") == 0) & (F.col("rng") >= 1.5 * F.col("before")) & half, "ContractionThenExpansion",
            F.col("rng") / (F.col("before") + 0.0001) / 3, way(F.col("close") > F.col("open"))),
        row((n >= 5) & (run >= 4), "ProgressiveCloses", run / 8, way(F.col("rises") >= F.col("falls"))),
        row((n >= 3) & (F.greatest("uppers", "lowers") >= 2), "ShadowRejectionCluster", F.greatest("uppers", "lowers") / 4, way(F.col("uppers") < F.col("lowers"))),
        row((n >= 6) & (F.col("close") != F.col("close5")) & (F.col("thicker") == 0), "VolumePriceDivergence", F.lit(0.7), way(F.col("close") < F.col("close5"))),
        row((n >= 3) & (F.col("small") >= 2), "IntradayReversalSequence", F.col("small") / 3, F.lit("Neutral")),
    ))
    return facts.where(n >= least).select(*SERIES, F.explode(made).alias("s")).select(*SERIES, "s.*")


def summary(found: DataFrame) -> DataFrame:
    """One line for each series, the strongest scenario first."""
    text = F.format_string("%s (%.2f)", "scenario", F.round("strength", 2))
    return found.groupBy(*SERIES).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("strength")).alias("s"), "scenario", text.alias("t")))), lambda x: x["t"]), "; ").alias("summary")
    )
