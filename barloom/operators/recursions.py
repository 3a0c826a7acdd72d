"""EMA, MACD, RSI, ATR and the EMA of OBV over series of any length.

After its seed, each of these recursions is an affine step of its state: s becomes a * s + b.
A slice of bars is then one affine map, whatever the state it begins with. Three passes follow:
every slice gives its maps; a scan over the slices of a series, one row each, gives the state
that every slice begins with; every slice runs again from that state. No group is larger than a
slice, but for the scan, which has a row for each slice.

Seeds stand on the first 200 bars of a series at most, and are made from these alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.series import KEY, SERIES
from barloom.operators.slices import SLICED

EMAS, SIGNAL, PERIOD, OBV = (12, 26, 50, 200), 9, 14, 50
FOLDED = [*(f"ema{p}" for p in EMAS), "macd", "macd_signal", "macd_histogram", "rsi14", "atr14", "obv_ema50"]
#: The states: their factor after the seed, and the place that the seed is at. The first five
#: count bars that have a close, the others all bars.
STATES = {
    **{f"ema{p}": (1 - 2 / (p + 1), p - 1) for p in EMAS},
    "signal": (1 - 2 / (SIGNAL + 1), max(EMAS[:2]) + SIGNAL - 2),
    "gain": ((PERIOD - 1) / PERIOD, PERIOD), "loss": ((PERIOD - 1) / PERIOD, PERIOD), "atr": ((PERIOD - 1) / PERIOD, PERIOD),
    "obv": (1 - 2 / (OBV + 1), OBV - 1),
}
CLOSES = [*(f"ema{p}" for p in EMAS), "signal"]
HEAD = max(p + 1 for _, p in STATES.values())
#: Steps that are made by one product.
BLOCK = 64


def affine_scan(b: np.ndarray, a: float, start: float) -> np.ndarray:
    """y where y[t] = a * y[t - 1] + b[t], from start. Steps are made in blocks: what a block adds
    is a product with the powers of a, and what it begins with comes from the block before."""
    n = len(b)
    if not n:
        return np.empty(0)
    padded = np.zeros(-(-n // BLOCK) * BLOCK)
    padded[:n] = b
    apart = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    lower = np.where(apart >= 0, a ** np.maximum(apart, 0), 0.0)
    with np.errstate(invalid="ignore"):
        own = padded.reshape(-1, BLOCK) @ lower.T if not np.isnan(b).any() else _stepwise(padded, a)
        fading, out, y = a ** np.arange(1, BLOCK + 1), np.empty_like(own), start
        for k, block in enumerate(own):
            out[k] = block + fading * y
            y = out[k, -1]
    return out.ravel()[:n]


def _stepwise(padded: np.ndarray, a: float) -> np.ndarray:
    """The blocks of affine_scan where a value is missing: it must not reach steps before it."""
    own = padded.reshape(-1, BLOCK).copy()
    for t in range(1, BLOCK):
        own[:, t] += a * own[:, t - 1]
    return own


def _run(b: np.ndarray, places: np.ndarray, name: str, seed: float, start: float) -> np.ndarray:
    """A state after each bar of a slice: nan before its place, the seed at it, then its steps."""
    a, at = STATES[name]
    out = np.full(len(b), np.nan)
    if not len(b) or places[-1] < at:
        return out
    first = int(np.searchsorted(places, at))
    if places[0] > at:
        return affine_scan(b, a, start)
    out[first] = seed
    out[first + 1 :] = affine_scan(b[first + 1 :], a, seed)
    return out


def _inputs(bars: pd.DataFrame):
    """What drives each state: b of its step, and the places that count for it."""
    close = bars["close"].to_numpy(dtype=float)
    valid = ~np.isnan(close)
    places, closes = bars["_i"].to_numpy(), bars["_closes"].to_numpy()[valid]
    change = bars["change"].to_numpy(dtype=float)
    up, down = np.where(np.isnan(change), np.nan, np.maximum(change, 0)), np.where(np.isnan(change), np.nan, np.maximum(-change, 0))
    drive = {f"ema{p}": close[valid] * (2 / (p + 1)) for p in EMAS}
    drive |= {"gain": up / PERIOD, "loss": down / PERIOD, "atr": bars["true_range"].to_numpy(dtype=float) / PERIOD, "obv": bars["obv"].to_numpy(dtype=float) * (2 / (OBV + 1))}
    return valid, closes, places, drive


def _states(bars: pd.DataFrame, seeds, start) -> tuple[dict[str, np.ndarray], np.ndarray]:
    valid, closes, places, drive = _inputs(bars)
    out = {n: _run(b, closes if n in CLOSES else places, n, seeds[n], start[n]) for n, b in drive.items()}
    macd = out["ema12"] - out["ema26"]
    out["signal"] = _run(macd * (2 / (SIGNAL + 1)), closes, "signal", seeds["signal"], start["signal"])
    return out, valid


def _seeds(head: pd.DataFrame) -> pd.DataFrame:
    """The seed of each state from the first bars of a series; nan where there are too few."""
    head = head.sort_values("_i", kind="stable")
    close, tr, obv = (head[c].to_numpy(dtype=float) for c in ("close", "true_range", "obv"))
    closes, change = close[~np.isnan(close)], head["change"].to_numpy(dtype=float)
    mean = lambda x, n: x[:n].mean() if len(x) >= n else np.nan
    seeds = {f"ema{p}": mean(closes, p) for p in EMAS}
    k = {p: 2 / (p + 1) for p in EMAS}
    lines = {p: np.concatenate([[seeds[f"ema{p}"]], affine_scan(closes[p:] * k[p], 1 - k[p], seeds[f"ema{p}"])]) for p in EMAS[:2] if len(closes) >= p}
    if len(closes) > STATES["signal"][1]:
        seeds["signal"] = mean(lines[12][14:] - lines[26], SIGNAL)
    # the first changes are summed and divided by the period; the next one is added and divided again
    for name, part in (("gain", np.maximum(change, 0)), ("loss", np.maximum(-change, 0))):
        seeds[name] = (part[1:PERIOD].sum() / PERIOD + part[PERIOD]) / PERIOD if len(part) > PERIOD else np.nan
    seeds["atr"], seeds["obv"] = mean(tr, PERIOD + 1), mean(obv, OBV)
    return pd.DataFrame([[*head.iloc[0][SERIES], *(float(seeds.get(n, np.nan)) for n in STATES)]], columns=[*SERIES, *(f"seed_{n}" for n in STATES)])


def _of(row, prefix: str) -> dict[str, float]:
    return {n: float(row[f"{prefix}_{n}"]) for n in STATES}


_zero = dict.fromkeys(STATES, 0.0)


def _maps(bars: pd.DataFrame) -> pd.DataFrame:
    """A slice as maps of the states that it begins with: a, b, and what the signal line takes
    from both of its EMAs. A slice that a seed is in, or that is before it, keeps nothing of the
    state: a is 0, or the state is nan still."""
    bars = bars.sort_values("_i", kind="stable")
    states, _ = _states(bars, _of(bars.iloc[0], "seed"), _zero)
    valid, closes, places, _ = _inputs(bars)
    row, factor = {}, {}
    for n, (a, at) in STATES.items():
        count = closes if n in CLOSES else places
        begun, reached = len(count) and count[0] > at, len(count) and count[-1] >= at
        row[f"a_{n}"] = a ** len(count) if begun else 0.0 if reached else 1.0
        row[f"b_{n}"] = states[n][-1] if reached else 0.0
        factor[n] = a ** np.arange(1, len(count) + 1) if begun else np.zeros(len(count))
    # the signal line takes up its EMAs' own share of the beginning state
    steady = len(closes) and closes[0] > STATES["signal"][1]
    for n, sign in (("ema12", 1), ("ema26", -1)):
        share = affine_scan(sign * factor[n] * (2 / (SIGNAL + 1)), STATES["signal"][0], 0.0)
        row[f"c_{n}"] = share[-1] if steady else 0.0
    if len(closes) and not steady and closes[-1] >= STATES["signal"][1]:
        # the seed is inside: what follows it still takes from EMAs that began before the slice
        first = int(np.searchsorted(closes, STATES["signal"][1])) + 1
        for n, sign in (("ema12", 1), ("ema26", -1)):
            share = affine_scan(sign * factor[n][first:] * (2 / (SIGNAL + 1)), STATES["signal"][0], 0.0)
            row[f"c_{n}"] = share[-1] if len(share) else 0.0
    return pd.DataFrame([[*bars.iloc[0][SERIES], int(bars.iloc[0]["_slice"]), *row.values()]], columns=[*SERIES, "_slice", *row])


def _scan(slices: pd.DataFrame) -> pd.DataFrame:
    """The states that each slice of a series begins with: one row a slice, in order."""
    slices = slices.sort_values("_slice", kind="stable")
    state, out = dict.fromkeys(STATES, np.nan), []
    for row in slices.to_dict("records"):
        out.append([*(row[c] for c in SERIES), row["_slice"], *state.values()])
        kept = {n: (row[f"a_{n}"] * state[n] if row[f"a_{n}"] else 0.0) + row[f"b_{n}"] for n in STATES}
        kept["signal"] += sum(row[f"c_{n}"] * state[n] for n in ("ema12", "ema26") if row[f"c_{n}"])
        state = kept
    return pd.DataFrame(out, columns=[*SERIES, "_slice", *(f"start_{n}" for n in STATES)])


def _fold(bars: pd.DataFrame) -> pd.DataFrame:
    bars = bars.sort_values("_i", kind="stable")
    states, valid = _states(bars, _of(bars.iloc[0], "seed"), _of(bars.iloc[0], "start"))
    out = bars[KEY].copy()

    def spread(x):
        full = np.full(len(bars), np.nan)
        full[valid] = x
        return full

    for p in EMAS:
        out[f"ema{p}"] = spread(states[f"ema{p}"])
    out["macd"], out["macd_signal"] = out["ema12"] - out["ema26"], spread(states["signal"])
    out["macd_histogram"] = out["macd"] - out["macd_signal"]
    gain, loss = states["gain"], states["loss"]
    with np.errstate(divide="ignore", invalid="ignore"):
        out["rsi14"] = np.where(np.isnan(gain), np.nan, np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss)))
    out["atr14"], out["obv_ema50"] = states["atr"], states["obv"]
    return out[[*KEY, *FOLDED]]


def folded(framed: DataFrame) -> DataFrame:
    """KEY and the recursive indicators of framed bars: placed and sliced ones with change (of
    the close), true_range and obv. Null where an indicator is not defined yet."""
    series = "symbol string, timeframe string"
    doubles = lambda prefix, names: ", ".join(f"{prefix}_{n} double" for n in names)
    with_close = F.count("close")
    counts = framed.groupBy(*SLICED).agg(with_close.alias("_in"))
    earlier = Window.partitionBy(*SERIES).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    closes = counts.select(*SLICED, F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_closes_before"))
    own = Window.partitionBy(*SLICED).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    rows = framed.select(*KEY, "_slice", "_i", "close", "change", "true_range", "obv", (with_close.over(own) - 1).alias("_closes_in"))
    rows = rows.join(closes, SLICED).withColumn("_closes", F.col("_closes_before") + F.col("_closes_in")).drop("_closes_before", "_closes_in")
    # both kinds of place: a series may begin with bars that have no close
    first = (F.col("_i") < HEAD) | F.col("close").isNotNull() & (F.col("_closes") < HEAD)
    head = rows.where(first).groupBy(*SERIES).applyInPandas(_seeds, f"{series}, {doubles('seed', STATES)}")
    seeded = rows.join(head, SERIES)
    taken = ["ema12", "ema26"]
    maps = seeded.groupBy(*SLICED).applyInPandas(
        _maps, f"{series}, _slice long, " + ", ".join(f"a_{n} double, b_{n} double" for n in STATES) + f", {doubles('c', taken)}"
    )
    starts = maps.groupBy(*SERIES).applyInPandas(_scan, f"{series}, _slice long, {doubles('start', STATES)}")
    made = seeded.join(starts, SLICED).groupBy(*SLICED).applyInPandas(_fold, f"{series}, open_time_ms long, " + ", ".join(f"{c} double" for c in FOLDED))
    return made.select(*KEY, *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in FOLDED))
