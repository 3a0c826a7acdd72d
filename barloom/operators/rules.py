"""The candle-rule language: conditions become columns; live evaluation, cooldown and discovery."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import compare, ratio
from barloom.operators.series import KEY, SERIES, by_time, index, lag, rows, whole
from barloom.sources import versions
from barloom.sources.tables import stored


@dataclass(frozen=True)
class Condition:
    type: str
    direction: str | None = None
    count: int | None = None
    operator: str | None = None
    reference: str | None = None
    period: int | None = None
    multiplier: float | None = None
    value: float | None = None
    side: str | None = None
    position: str | None = None
    barOffset: int = 0

    def as_row(self) -> dict:
        return asdict(self)

    @property
    def signature(self) -> str:
        """What candidates are told apart by; period and reference are no part of it."""
        parts = (self.type, self.direction, self.count, self.operator, self.multiplier, self.value, self.side, self.position)
        return ":".join("" if p is None else str(p) for p in parts)


def _run(direction: str | None, count: int | None) -> Column:
    n = max(1, count or 1)
    c, o = F.col("close"), F.col("open")
    flags = {
        "green": c > o, "red": c < o, "higher_close": c > lag("close"), "lower_close": c < lag("close"),
        "higher_high": F.col("high") > lag("high"), "lower_low": F.col("low") < lag("low"),
    }
    if (direction or "").lower() not in flags:
        return F.lit(False)
    # the flag of each of the n bars, by lags of the columns it is made of
    at = lambda x, k: F.lag(x, k).over(by_time()) if k else F.col(x)
    one = lambda k: {
        "green": at("close", k) > at("open", k), "red": at("close", k) < at("open", k),
        "higher_close": at("close", k) > at("close", k + 1), "lower_close": at("close", k) < at("close", k + 1),
        "higher_high": at("high", k) > at("high", k + 1), "lower_low": at("low", k) < at("low", k + 1),
    }[direction.lower()]
    out = one(0)
    for k in range(1, n):
        out = out & one(k)
    return out


def _against_mean(c: str, period: int | None, multiplier: float | None, op: str | None) -> Column:
    """False where period or multiplier is missing."""
    if period is None or multiplier is None:
        return F.lit(False)
    mean = F.avg(c).over(rows(-period, -1))
    return (mean > 0) & compare(op, F.col(c), mean * multiplier)


def predicate(cond: Condition, stats: bool = False) -> Column:
    """True where a bar meets a condition, else false; unknown types are never met. bars must
    have a column rng (high - low). With stats, volume conditions use the columns
    anomaly_ratio, vs_previous and vs_max10 where they answer the reference."""
    kind, m = (cond.type or "").lower(), 1.0 if cond.multiplier is None else cond.multiplier
    body, rng = F.abs(F.col("close") - F.col("open")), F.col("rng")
    if kind == "consecutive_bars":
        out = _run(cond.direction, cond.count)
    elif kind == "range_compare":
        out = _against_mean("rng", cond.period, cond.multiplier, cond.operator)
    elif kind == "volume_compare":
        out = _against_mean("volume", cond.period, cond.multiplier, cond.operator)
        reference = (cond.reference or "").lower()
        named = {"prev": "vs_previous", "max10": "vs_max10"}.get(reference)
        if reference == "sma" and cond.period == 20:
            named = "anomaly_ratio"
        if stats and named and cond.multiplier is not None:
            out = F.when(F.col(named).isNotNull(), compare(cond.operator, F.col(named), F.lit(m))).otherwise(out)
    elif kind == "body_ratio" and cond.value is not None:
        out = (rng > 0) & compare(cond.operator, ratio(body, rng), F.lit(cond.value), 1e-6)
    elif kind == "shadow_ratio":
        side = (cond.side or "upper").lower()
        upper, lower = F.col("high") - F.greatest("open", "close"), F.least("open", "close") - F.col("low")
        shadow = upper if side == "upper" else lower if side == "lower" else F.lit(0.0)
        out = (body > 0) & compare(cond.operator, shadow, body * m)
    elif kind == "close_position":
        p = ratio(F.col("close") - F.col("low"), rng)
        out = (rng > 0) & {
            "top_50": p >= 0.5, "bottom_25": p <= 0.25, "bottom_50": p <= 0.5, "middle": (p >= 0.35) & (p <= 0.65),
        }.get((cond.position or "top_25").lower(), p >= 0.75)
    else:
        out = F.lit(False)
    return F.coalesce(out, F.lit(False))


def parse_conditions(text: str | None) -> tuple[Condition, ...]:
    """The conditions of a stored rule: a JSON array of objects whose names may be in any case.
    Unknown names are passed over; blank text and text that is no such array give none."""
    try:
        found = json.loads(text or "[]")
    except ValueError:
        return ()
    names = {f.name.lower(): f.name for f in fields(Condition)}
    made = [{names[k.lower()]: v for k, v in x.items() if k.lower() in names and v is not None} for x in found if isinstance(x, dict)] if isinstance(found, list) else []
    return tuple(Condition(**({"type": ""} | x)) for x in made)


@dataclass(frozen=True)
class Rule:
    id: int
    name: str
    conditions: tuple[Condition, ...]
    cooldown_minutes: int = 60
    priority: int = 0
    required_bars: int = 10


def evaluate(bars: DataFrame, rules: list[Rule]) -> DataFrame:
    """A row for each series and rule that its last bar meets, highest priority first. A
    condition with an offset looks at the bar that many places off; out of bounds is unmet."""
    b = bars.withColumns({"rng": F.col("high") - F.col("low"), "_i": index(), "_n": F.count("*").over(whole())})
    offs = sorted({(r.id, k) for r in rules for k in range(len(r.conditions))})
    by = {r.id: r for r in rules}
    b = b.withColumns({f"_c{r}_{k}": predicate(by[r].conditions[k]) for r, k in offs})

    def met(r: int, k: int) -> Column:
        off = by[r].conditions[k].barOffset
        c = F.col(f"_c{r}_{k}")
        return F.coalesce(F.lag(c, -off).over(by_time()), F.lit(False)) if off < 0 else c if off == 0 else F.lit(False)

    b = b.withColumns({f"_m{r}_{k}": met(r, k) for r, k in offs}).where(F.col("_i") == F.col("_n") - 1)
    fired = F.array_compact(F.array(*(
        F.when(
            _all(*(F.col(f"_m{r.id}_{k}") for k in range(len(r.conditions)))) & (F.col("_n") >= r.required_bars),
            F.struct(F.lit(r.id).cast("long").alias("rule_id"), F.lit(r.name).alias("name"), F.lit(r.priority).alias("priority"), F.lit(r.cooldown_minutes).alias("cooldown_minutes")),
        ) for r in rules
    )))
    return (
        b.select(*SERIES, F.col("open_time_ms").alias("trigger_time_ms"), F.col("close").alias("close_price"), F.explode(fired).alias("r"))
        .select(*SERIES, "trigger_time_ms", "close_price", "r.*")
        .orderBy(F.desc("priority"), "rule_id", "symbol")
    )


def _all(*c: Column) -> Column:
    out = F.lit(True) if not c else c[0]
    for x in c[1:]:
        out = out & x
    return out


def cooled_down(fired: DataFrame, signals: DataFrame, as_of_ms: int) -> DataFrame:
    """fired without the rules that have a signal (rule_id, created_ms) since as_of minus
    their cooldown."""
    s = signals.select(F.col("rule_id").alias("r"), "created_ms")
    recent = (F.col("rule_id") == F.col("r")) & (F.col("created_ms") >= F.lit(as_of_ms) - F.col("cooldown_minutes") * 60_000)
    return fired.join(s, recent, "left_anti")


def candidate_singles() -> list[Condition]:
    """The 29 single conditions, in their order."""
    out = []
    for n in (2, 3, 4):
        out += [Condition("consecutive_bars", direction=d, count=n) for d in ("green", "higher_close", "red", "lower_close")]
    out += [Condition("volume_compare", operator="gt", reference="sma", period=20, multiplier=m) for m in (1.1, 1.2, 1.3, 1.5)]
    out += [Condition("range_compare", operator="lt", reference="avg", period=5, multiplier=m) for m in (0.6, 0.7, 0.8)]
    out += [Condition("range_compare", operator="gt", reference="avg", period=5, multiplier=m) for m in (1.3, 1.5, 2.0)]
    out += [Condition("body_ratio", operator="gt", value=0.55), Condition("body_ratio", operator="lt", value=0.35)]
    out += [Condition("shadow_ratio", operator="gt", side=s, multiplier=1.5) for s in ("upper", "lower")]
    out += [Condition("close_position", position=p) for p in ("top_25", "bottom_25", "middle")]
    return out


def candidates() -> list[tuple[Condition, ...]]:
    """Singles, the pairs i < j < i + 20 of them, and six combinations (fixed values)."""
    s = candidate_singles()
    c = Condition
    green3, vol12 = c("consecutive_bars", direction="green", count=3), c("volume_compare", operator="gt", reference="sma", period=20, multiplier=1.2)
    vol11 = c("volume_compare", operator="gt", reference="sma", period=20, multiplier=1.1)
    wick = lambda side: c("shadow_ratio", operator="gt", side=side, multiplier=2.0)
    fixed = [
        (green3, vol12),
        (c("consecutive_bars", direction="higher_close", count=3), vol11),
        (c("consecutive_bars", direction="red", count=3), vol12),
        (wick("upper"), c("close_position", position="bottom_25")),
        (wick("lower"), c("close_position", position="top_25")),
        (c("range_compare", operator="lt", reference="avg", period=5, multiplier=0.7), c("body_ratio", operator="gt", value=0.6)),
    ]
    pairs = [(s[i], s[j]) for i in range(len(s)) for j in range(i + 1, min(i + 20, len(s)))]
    return [(x,) for x in s] + pairs + fixed


def discover(bars: DataFrame, stats: DataFrame, future: int = 3, min_win: float = 0.5, min_n: int = 5, min_avg: float = 0.1, top: int = 100, least_bars: int = 200) -> DataFrame:
    """Back-tests every candidate rule over all bars of series of least_bars bars, and keeps the best.

    Each distinct condition is one boolean column; a bar's met candidates become rows, and
    one aggregation a candidate follows. No bar is joined with candidates it does not meet.
    """
    found = candidates()
    distinct = list(dict.fromkeys(x for conds in found for x in conds))
    b = bars.withColumn("rng", F.col("high") - F.col("low")).join(
        stats.select(*KEY, "anomaly_ratio", "vs_previous", "vs_max10"), KEY, "left"
    )
    i, n = index(), F.count("*").over(whole())
    ahead = F.lead("close", future).over(by_time())
    b = b.withColumns({f"_p{k}": predicate(x, stats=True) for k, x in enumerate(distinct)} | {"_i": i, "_n": n, "ret": ratio(ahead - F.col("close"), F.col("close")) * 100})
    b = b.where((F.col("_i") >= 10) & (F.col("_i") < F.col("_n") - future) & F.col("ret").isNotNull() & (F.col("_n") >= least_bars))
    at = {x: k for k, x in enumerate(distinct)}
    met = F.array_compact(F.array(*(F.when(_all(*(F.col(f"_p{at[x]}") for x in conds)), F.lit(k)) for k, conds in enumerate(found))))
    hits = b.select(*SERIES, "ret", F.explode(met).alias("candidate"))
    r = F.col("ret")
    wins, losses = F.count_if(r > 0.3), F.count_if(r < -0.3)
    plus, minus = F.sum(F.greatest(r, F.lit(0.0))), F.sum(F.least(r, F.lit(0.0)))
    tested = (
        hits.groupBy(*SERIES, "candidate")
        .agg(F.count("*").alias("sample_count"), wins.alias("wins"), losses.alias("losses"), F.avg("ret").alias("avg_return"), plus.alias("plus"), minus.alias("minus"))
        .where("sample_count >= 10")
        .select(
            *SERIES, "candidate", "sample_count", (F.col("wins") / (F.col("wins") + F.col("losses") + 0.0001)).alias("win_rate"), "avg_return",
            (F.col("plus") / (-F.col("minus") + 0.0001)).alias("profit_factor"), (-F.col("minus")).alias("max_drawdown"),
        )
        .where((F.col("win_rate") >= min_win) & (F.col("sample_count") >= min_n) & (F.col("avg_return") >= min_avg))
    )
    spark = bars.sparkSession
    names = spark.createDataFrame([(k, " + ".join(sorted(x.signature for x in conds))) for k, conds in enumerate(found)], "candidate int, signature string")
    score = (F.col("win_rate") * F.col("avg_return")).alias("score")
    # sums of doubles differ in their last digits by the order of rows: equal scores stay equal
    by_score = F.round("score", 6).desc()
    best = Window.partitionBy(*SERIES, "signature").orderBy(by_score, "candidate")
    order = Window.partitionBy(*SERIES).orderBy(by_score, "candidate")
    return (
        tested.join(F.broadcast(names), "candidate")
        .select("*", score)
        .withColumn("_b", F.row_number().over(best))
        .where("_b = 1")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .drop("_b")
    )


def label(cond: Condition) -> str:
    """The short name of a condition in a discovered rule."""
    sign = "<" if cond.operator == "lt" else ">"
    times = "" if cond.multiplier is None else f"{cond.multiplier:g}"
    return {
        "consecutive_bars": f"{cond.count}{cond.direction}", "volume_compare": f"Vol>{times}x", "range_compare": f"Range{sign}{int((cond.multiplier or 0) * 100)}",
        "body_ratio": f"Body{sign}{int((cond.value or 0) * 100)}", "shadow_ratio": f"{cond.side}Wick>{times}x", "close_position": f"Close{cond.position}",
    }.get(cond.type, cond.type)


#: Stored rules; conditions are a JSON array.
STORED_RULES = (
    "symbol string, timeframe string, name string, description string, required_bars int, is_enabled boolean, cooldown_minutes int, conditions string, "
    "action string, priority int, is_auto_discovered boolean, win_rate double, avg_return double, sample_count long, created_ms long"
)


def as_stored(found: DataFrame, as_of_ms: int, future: int = 3) -> DataFrame:
    """Discovered candidates as rows of STORED_RULES, enabled, with what their test showed."""
    spark = found.sparkSession
    rows = [
        (k, " + ".join(map(label, conds)), json.dumps([{a: v for a, v in c.as_row().items() if v is not None} for c in conds]), max(10, 3 * len(conds)))
        for k, conds in enumerate(candidates())
    ]
    named = spark.createDataFrame(rows, "candidate int, name string, conditions string, required_bars int")
    text = F.format_string(
        f"Auto-discovered: %s | Future {future} bars | WinRate=%.1f%% AvgRet=%.2f Samples=%d PF=%.2f",
        "name", F.round(F.col("win_rate") * 100, 1), F.round("avg_return", 2), "sample_count", F.round("profit_factor", 2),
    )
    return found.join(F.broadcast(named), "candidate").select(
        *SERIES, "name", text.alias("description"), "required_bars", F.lit(True).alias("is_enabled"), F.lit(60).alias("cooldown_minutes"), "conditions",
        F.lit("ALERT").alias("action"), F.lit(0).alias("priority"), F.lit(True).alias("is_auto_discovered"), "win_rate", "avg_return", "sample_count",
        F.lit(as_of_ms).cast("long").alias("created_ms"),
    )


def save_discovered(found: DataFrame, path: str, symbol: str, timeframe: str, as_of_ms: int) -> int:
    """Puts the candidates of one series in the place of the rules that were discovered for it
    before, at once; a run without candidates leaves them. The number of rules saved."""
    spark = found.sparkSession
    new = stored(as_stored(found.where((F.col("symbol") == symbol) & (F.col("timeframe") == timeframe)), as_of_ms), "discovered-rules")
    saved = new.count()
    if saved:
        old = (F.col("symbol") == symbol) & (F.col("timeframe") == timeframe) & F.col("is_auto_discovered")
        versions.replace(spark, path, STORED_RULES, new, old)
    return saved
