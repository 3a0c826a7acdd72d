"""Window vectors of bar series and similarity search over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators import slices as sl
from barloom.operators.series import SERIES

EPSILON, VERSION = 1e-7, 2
#: The accepted feature types; the first two have four numbers a bar.
FEATURE_TYPES = ["all", "returns_shape", "open", "high", "low", "close", "returns_log", "volume_norm", "volatility", "trend"]


def feature_type(name: str | None) -> str:
    """Trimmed and lower-cased; blank is all, unknown is empty."""
    n = (name or "").strip().lower() or "all"
    return n if n in FEATURE_TYPES else ""


def dimension(feature: str, size: int) -> int:
    return size * (4 if feature in FEATURE_TYPES[:2] else 1)


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _let(x: Column, f) -> Column:
    """f of x, which is computed once however often f names it."""
    return F.transform(F.array(x), f)[0]


def min_max(a: Column) -> Column:
    """To 0..1; all alike: 0.5."""

    def scaled(v: Column, m: Column) -> Column:
        flat = m["spread"] <= EPSILON
        return F.transform(v, lambda x: F.when(flat, 0.5).otherwise((x - m["low"]) / F.when(flat, 1.0).otherwise(m["spread"])))

    ends = lambda v: F.struct(F.array_min(v).alias("low"), (F.array_max(v) - F.array_min(v)).alias("spread"))
    return _let(a, lambda v: _let(ends(v), lambda m: scaled(v, m)))


def _log_returns(w: Column) -> Column:
    before = lambda i: F.get(w, i - 1)["close"]
    return F.transform(w, lambda b, i: F.when((i > 0) & (before(i) > EPSILON), F.ln(b["close"] / before(i))).otherwise(0.0))


def vector(feature: str, w: Column) -> Column:
    """The vector of a window (an array of bars); null where prices have no range."""
    low, high = F.array_min(F.transform(w, lambda b: b["low"])), F.array_max(F.transform(w, lambda b: b["high"]))
    scale = lambda x: (x - low) / F.when(high - low > EPSILON, high - low)
    if feature in ("open", "high", "low", "close"):
        v = F.when(high - low > EPSILON, F.transform(w, lambda b: scale(b[feature])))
    elif feature == "all":
        v = F.when(high - low > EPSILON, F.flatten(F.transform(w, lambda b: F.array(*(scale(b[x]) for x in ("open", "close", "high", "low"))))))
    elif feature == "returns_shape":
        def one(b, i):
            p, r = F.get(w, i - 1)["close"], b["high"] - b["low"]
            part = lambda x: F.when(r > EPSILON, x / F.when(r > EPSILON, r)).otherwise(0.0)
            ret = F.when((i > 0) & (F.abs(p) > EPSILON), b["close"] / F.when(F.abs(p) > EPSILON, p) - 1).otherwise(0.0)
            top, bottom = F.greatest(b["open"], b["close"]), F.least(b["open"], b["close"])
            return F.array(ret, part(top - bottom), part(b["high"] - top), part(bottom - b["low"]))
        v = F.flatten(F.transform(w, one))
    elif feature == "returns_log":
        v = min_max(_log_returns(w))
    elif feature == "volume_norm":
        over = lambda mean: F.transform(w, lambda b: F.when(mean > EPSILON, b["volume"] / F.when(mean > EPSILON, mean)).otherwise(0.0))
        v = min_max(_let(_mean(F.transform(w, lambda b: b["volume"])), over))
    elif feature == "volatility":
        def deviation(part):
            return _let(_mean(part), lambda m: F.sqrt(_mean(F.transform(part, lambda y: (y - m) * (y - m)))))
        near = lambda r, i: F.slice(r, F.greatest(i - 3, F.lit(1)), F.least(i + 1, F.lit(5)))
        v = min_max(_let(_log_returns(w), lambda r: F.transform(r, lambda x, i: _let(near(r, i), deviation))))
    elif feature == "trend":
        n = F.size(w)
        xm, den = (n - 1) / 2, n * (n * n - 1) / F.lit(12.0)
        def rest(closes, ym):
            num = F.aggregate(F.transform(closes, lambda y, i: (i - xm) * (y - ym)), F.lit(0.0), lambda s, x: s + x)
            slope = F.coalesce(F.try_divide(num, den), F.lit(0.0))
            return _let(slope, lambda k: F.transform(closes, lambda y, i: y - (k * i + ym - k * xm)))
        v = min_max(_let(F.transform(w, lambda b: b["close"]), lambda closes: _let(_mean(closes), lambda ym: rest(closes, ym))))
    else:
        raise ValueError(f"no feature type {feature!r}")
    return F.transform(v, lambda x: x.cast("float"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def window_vectors(bars: DataFrame, feature: str, size: int) -> DataFrame:
    """A vector for each run of `size` bars of a series."""
    return vectors_of(bars, [feature], [size])


def vectors_of(bars: DataFrame, features: list[str], sizes: list[int]) -> DataFrame:
    """The vectors of every feature type and window size. Bars are placed and windows are
    gathered once for all features of a size, in slices of a series that hold size - 1 bars of
    the next one."""
    bar = F.struct("open", "high", "low", "close", "volume")
    at = bars if "_i" in bars.columns else sl.placed(bars)
    out = None
    for size in sizes:
        full = (
            sl.sliced(at, after=size - 1)
            .withColumns({"_w": F.collect_list(bar).over(sl.window(0, size - 1)), "end_time_ms": sl.neighbour("open_time_ms", size - 1)})
            .where("_own and end_time_ms is not null")
        )
        made = F.array(*(F.struct(F.lit(f).alias("feature_type"), vector(f, F.col("_w")).alias("vector")) for f in features))
        rows_ = (
            full.select(*SERIES, F.col("open_time_ms").alias("start_time_ms"), "end_time_ms", F.col("_i").alias("start_index"), F.col("_n").alias("series_bars"), F.inline(made))
            .where("vector is not null")
            .select(
                *SERIES, "start_time_ms", "end_time_ms", "feature_type", F.lit(size).alias("window_size"), "vector", F.size("vector").alias("vector_dim"),
                norm(F.col("vector")).cast("float").alias("vector_norm"), F.lit(VERSION).alias("version"), "start_index", "series_bars",
            )
        )
        out = rows_ if out is None else out.unionByName(rows_)
    return out


def dot(a: Column, b: Column) -> Column:
    """Products in float, sum in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x.cast("double"))


def cosine(a: Column, b: Column, na: Column, nb: Column) -> Column:
    ok = (na > 0) & (nb > 0)
    return F.when(ok, dot(a, b) / F.when(ok, na.cast("double") * nb.cast("double"))).otherwise(0.0)


def greedy_apart(ranked: Column, gap: int, k: int) -> Column:
    """Of structs in order, the first k of which no two have index closer than gap."""
    return F.aggregate(
        ranked, F.slice(ranked, 1, 0),
        lambda kept, x: F.when((F.size(kept) < k) & ~F.exists(kept, lambda y: F.abs(y["index"] - x["index"]) < gap), F.concat(kept, F.array(x))).otherwise(kept),
    )


def top_similar(rows_: DataFrame, query: list[float], k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows most like the query vector, ties by id. Rows of another length are left out."""
    q = F.array(*(F.lit(float(x)).cast("float") for x in query))
    v = F.col(vector_col)
    s = cosine(v, q, norm(v), norm(q))
    return rows_.where(F.size(v) == len(query)).select(id_col, s.alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(k)
