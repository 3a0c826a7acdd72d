"""Candle patterns: single, double and triple, their n-grams, and the trend around a bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import ratio, utc_day
from barloom.operators import slices as sl
from barloom.operators.series import KEY, SERIES, by_time, whole
from barloom.operators.slices import neighbour

#: Fixed value: shapes smaller than this count as nothing.
EPSILON = 1e-7


def shape(o: Column, h: Column, low: Column, c: Column) -> dict[str, Column]:
    """Body, range, shadows and colour of a bar."""
    return {
        "body": F.abs(c - o), "range": h - low, "upper": h - F.greatest(o, c), "lower": F.least(o, c) - low,
        "green": c > o, "red": c < o, "top": F.greatest(o, c), "bottom": F.least(o, c),
    }


def _named(ups: Column, downs: Column, enough: Column) -> Column:
    """The trend of up to five changes of the close."""
    up, down = enough & (ups >= 4) & (downs <= 1), enough & (downs >= 4) & (ups <= 1)
    return F.when(up, "Uptrend").when(down, "Downtrend").otherwise("Sideways")


def with_trend(bars: DataFrame, slice_bars: int = sl.SLICE_BARS) -> DataFrame:
    """bars in slices, with trend (over up to six bars that end at each bar): Uptrend, Downtrend
    or Sideways. A slice has what its own bars, and two after them, need to be right."""
    before = sl.neighbour("close", -1)
    up, down = (F.col("close") > before).cast("int"), (F.col("close") < before).cast("int")
    moved = sl.sliced(sl.placed(bars), before=5, after=2, slice_bars=slice_bars).withColumns({"_up": F.coalesce(up, F.lit(0)), "_down": F.coalesce(down, F.lit(0))})
    ups, downs = F.sum("_up").over(sl.window(-4, 0)), F.sum("_down").over(sl.window(-4, 0))
    return moved.withColumn("trend", _named(ups, downs, F.col("_i") >= 3))


def with_global_trend(trended: DataFrame, slice_bars: int = sl.SLICE_BARS) -> DataFrame:
    """Adds global_trend, over the last six bars of the series, to bars in slices. It comes to
    them as one row for each slice, so that no series meets in one task."""
    ends = trended.where(F.col("_own") & (F.col("_i") >= F.col("_n") - 5)).groupBy(*SERIES, "_n").agg(F.sum("_up").alias("u"), F.sum("_down").alias("d"))
    slices = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / F.lit(slice_bars)))
    named = ends.select(*SERIES, F.explode(slices).alias("_slice"), _named(F.col("u"), F.col("d"), F.col("_n") >= 6).alias("global_trend"))
    return trended.join(named, sl.SLICED)


def _rated(s: dict[str, Column]) -> tuple[Column, Column, Column]:
    return tuple(ratio(s[k], s["range"]) for k in ("body", "upper", "lower"))


def single(trend: Column) -> Column:
    """The pattern of a bar by itself, or null. The first that fits wins. The hammer and
    star shapes ask for a small upper (lower) shadow and a body in the lowest (highest) part
    at once, so that they never fire."""
    s = shape(*(F.col(c) for c in ("open", "high", "low", "close")))
    body, upper, lower = _rated(s)
    flat, small = s["range"] <= EPSILON, body < 0.015
    hammer = (s["lower"] >= 2 * s["body"]) & (ratio(s["top"] - F.col("low"), s["range"]) < 0.35) & (upper < 0.15)
    star = (s["upper"] >= 2 * s["body"]) & (ratio(F.col("high") - s["bottom"], s["range"]) < 0.35) & (lower < 0.15)
    up, down = trend == "Uptrend", trend == "Downtrend"
    return (
        F.when(flat, "Doji")
        .when(small & (lower > 0.6) & (upper < 0.1), "DragonflyDoji")
        .when(small & (upper > 0.6) & (lower < 0.1), "GravestoneDoji")
        .when(small, "Doji")
        .when((body > 0.95) & s["green"], "BullishMarubozu")
        .when((body > 0.95) & s["red"], "BearishMarubozu")
        .when((body < 0.3) & (upper > 0.25) & (lower > 0.25), "SpinningTop")
        .when(hammer & down, "Hammer").when(hammer & up, "HangingMan")
        .when(star & down, "InvertedHammer").when(star & up, "ShootingStar")
    )


def _next(n: int) -> dict[str, Column]:
    o, h, low, c = (neighbour(x, n) for x in ("open", "high", "low", "close"))
    return shape(o, h, low, c) | {"o": o, "h": h, "l": low, "c": c}


def _first() -> dict[str, Column]:
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return shape(o, h, low, c) | {"o": o, "h": h, "l": low, "c": c}


def double(trend: Column) -> Column:
    """The pattern of a bar and the next, or null."""
    a, b = _first(), _next(1)
    up, down, mid = trend == "Uptrend", trend == "Downtrend", (a["o"] + a["c"]) / 2
    rise, fall = a["red"] & b["green"], a["green"] & b["red"]
    grown, shrunk = b["body"] > a["body"], b["body"] < 0.6 * a["body"]
    near = lambda x: ratio(F.abs(b[x] - a[x]), a["range"]) < 0.08
    ok = (a["body"] > EPSILON) & (b["body"] > EPSILON)
    return F.when(
        ok,
        F.when(rise & (b["o"] <= a["c"]) & (b["c"] >= a["o"]) & grown, "BullishEngulfing")
        .when(fall & (b["o"] >= a["c"]) & (b["c"] <= a["o"]) & grown, "BearishEngulfing")
        .when(down & rise & (b["o"] < a["c"]) & (b["c"] > mid) & (b["c"] < a["o"]), "PiercingLine")
        .when(up & fall & (b["o"] > a["c"]) & (b["c"] < mid) & (b["c"] > a["o"]), "DarkCloudCover")
        .when(shrunk & rise & (b["o"] <= a["o"]) & (b["c"] >= a["c"]), "BullishHarami")
        .when(shrunk & fall & (b["o"] >= a["o"]) & (b["c"] <= a["c"]), "BearishHarami")
        .when(down & near("l"), "TweezerBottoms")
        .when(up & near("h"), "TweezerTops"),
    )


def triple(trend: Column) -> Column:
    """The pattern of a bar and the next two, or null."""
    a, b, c = _first(), _next(1), _next(2)
    up, down, mid = trend == "Uptrend", trend == "Downtrend", (a["o"] + a["c"]) / 2
    star = (a["body"] > 0.5 * a["range"]) & (b["body"] < 0.3 * b["range"]) & (c["body"] > 0.5 * a["body"])
    big = (a["body"] > 0.5 * a["range"]) & (b["body"] > 0.5 * a["range"]) & (c["body"] > 0.5 * a["range"])
    every = lambda k: a[k] & b[k] & c[k]
    rising = (b["o"] > a["o"]) & (c["o"] > b["o"]) & (b["c"] > a["c"]) & (c["c"] > b["c"])
    falling = (b["o"] < a["o"]) & (c["o"] < b["o"]) & (b["c"] < a["c"]) & (c["c"] < b["c"])
    short = lambda k: (a[k] < 0.15 * a["body"]) & (b[k] < 0.15 * b["body"]) & (c[k] < 0.15 * c["body"])
    inside = b["body"] < 0.6 * a["body"]
    return F.when(
        (a["range"] > EPSILON) & (b["range"] > EPSILON) & c["c"].isNotNull(),
        F.when(down & a["red"] & c["green"] & star & (c["c"] > mid), "MorningStar")
        .when(up & a["green"] & c["red"] & star & (c["c"] < mid), "EveningStar")
        .when(every("green") & big & rising & short("upper"), "ThreeWhiteSoldiers")
        .when(every("red") & big & falling & short("lower"), "ThreeBlackCrows")
        .when(down & a["red"] & b["green"] & c["green"] & inside & (b["o"] >= a["c"]) & (b["c"] <= a["o"]) & (c["c"] > a["h"]), "ThreeInsideUp")
        .when(up & a["green"] & b["red"] & c["red"] & inside & (b["o"] <= a["c"]) & (b["c"] >= a["o"]) & (c["c"] < a["l"]), "ThreeInsideDown"),
    )


def recognise(bars: DataFrame, slice_bars: int = sl.SLICE_BARS) -> DataFrame:
    """One row for each pattern and start bar: span (bars it takes), the series' global
    trend by which it was judged, the bar's own trend (its last bar's for longer ones), and
    the category, which is Triple for names that start with Three alone."""
    return _recognised(with_global_trend(with_trend(bars, slice_bars), slice_bars))


def recognise_daily(bars: DataFrame, slice_bars: int = sl.SLICE_BARS) -> DataFrame:
    """The same, but judged by the trend at the end of the UTC day that a pattern ends in."""
    trended = with_trend(bars, slice_bars).withColumn("_day", utc_day(F.col("open_time_ms")))
    days = trended.where("_own").groupBy(*SERIES, "_day").agg(
        F.when(F.max("_i") >= 5, F.max_by("trend", "open_time_ms")).otherwise("Sideways").alias("global_trend")
    )
    return _recognised(trended.join(days, [*SERIES, "_day"]), ahead=True)


def _recognised(judged: DataFrame, ahead: bool = False) -> DataFrame:
    """Patterns of bars in slices with their trends. ahead: a pattern is judged by the trend of
    its last bar."""
    g = [neighbour("global_trend", n) if ahead and n else F.col("global_trend") for n in range(3)]
    mark = lambda p, n: F.struct(
        p.alias("pattern_type"), F.lit(n).alias("span"), neighbour("trend", n - 1).alias("trend_direction"), neighbour("open_time_ms", n - 1).alias("end_time_ms"),
        g[n - 1].alias("judged_by"))
    marks = F.filter(
        F.array(
            mark(single(g[0]), 1),
            mark(double(g[1]), 2), mark(triple(g[2]), 3),
        ),
        lambda x: x["pattern_type"].isNotNull(),
    )
    out = judged.withColumn("m", marks).where("_own").select(*KEY, "open", "high", "low", "close", "volume", F.explode("m").alias("m"))
    kind = F.when(F.col("m.span") == 1, "Single").when(F.startswith(F.col("m.pattern_type"), F.lit("Three")), "Triple").otherwise("Double")
    return out.select(
        *KEY, "open", "high", "low", "close", "volume", F.col("m.judged_by").alias("global_trend"), "m.pattern_type", "m.span", "m.trend_direction", "m.end_time_ms", kind.alias("category")
    )


def filtered(patterns: DataFrame, from_ms: int | None = None, to_ms: int | None = None, category: str | None = None, pattern_type: str | None = None) -> DataFrame:
    """Patterns that begin within from and to, both included, of a category and a type; what is
    not given or blank asks for nothing."""
    out = patterns if from_ms is None else patterns.where(F.col("open_time_ms") >= from_ms)
    out = out if to_ms is None else out.where(F.col("open_time_ms") <= to_ms)
    for name, value in (("category", category), ("pattern_type", pattern_type)):
        out = out.where(F.col(name) == value.strip()) if (value or "").strip() else out
    return out


def ngrams(patterns: DataFrame, sizes: tuple[int, ...] = (3, 4, 5), least: int = 5) -> DataFrame:
    """Runs of n patterns in order of time and name, as JSON chains, of series with at least
    `least` patterns."""
    order = by_time().orderBy("open_time_ms", "span", "pattern_type")
    p = patterns.withColumn("_n", F.count("*").over(whole())).where(F.col("_n") >= least)
    made = F.array(*(
        F.struct(
            F.lit(n).alias("n"), F.lead("open_time_ms", n - 1).over(order).alias("end_time_ms"),
            F.array(*(F.lead("pattern_type", k).over(order) for k in range(n))).alias("chain"),
        ) for n in sizes
    ))
    return (
        p.withColumn("g", made)
        .select(*SERIES, F.col("open_time_ms").alias("start_time_ms"), F.explode("g").alias("g"))
        .where("g.end_time_ms is not null")
        .select(*SERIES, "start_time_ms", "g.end_time_ms", "g.n", F.to_json("g.chain").alias("chain"), F.lit(1).alias("count"))
    )
