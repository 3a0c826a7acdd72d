"""Datasets of every size and horizon, counted by brute force."""

import __spark_entry__ as entry
from barloom.operators import features as ft
from barloom.plans import catalogue as ca

SF_DIR = "/root/testdata/sf0.01"


def test_datasets_of_every_size_and_horizon(spark):
    counts = {(r["window_size"], r["horizon"]): r["count"] for r in entry.queries()["window_datasets"](spark, SF_DIR).groupBy("window_size", "horizon").count().collect()}
    rows = [r.asDict() for r in ca.feature_rows(spark, SF_DIR).collect()]
    targets = {(r["symbol"], r["open_time_ms"]): r for r in ca.tg.price_targets(ca.fx.bars(spark, SF_DIR), "1h").collect()}
    want = {}
    for symbol in {r["symbol"] for r in rows}:
        own = sorted((r for r in rows if r["symbol"] == symbol), key=lambda r: r["open_time_ms"])
        for size in (5, 10, 15, 20, 25):
            for a in range(len(own) - size + 1) if len(own) >= size + 10 else ():
                w, end = own[a : a + size], own[a + size - 1]["open_time_ms"]
                whole = all(r[f] is not None for r in w for f in ft.WINDOW_FEATURES)
                if end - w[0]["open_time_ms"] == (size - 1) * 3_600_000 and whole and sum(r["null_ratio"] for r in w) / size <= 0.25 + 1e-12:
                    for horizon in ("1h", "4h", "1d"):
                        t = targets.get((symbol, end))
                        if t and t[f"direction_{horizon}"] is not None:
                            want[size, horizon] = want.get((size, horizon), 0) + 1
    assert {s for s, _ in want} > {5, 10} and counts == want
