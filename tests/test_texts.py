"""Scenarios that fire, and texts about series and articles, against rows written by hand."""

import datetime as dt

import __spark_entry__ as entry
import pyarrow as pa

from barloom.operators import features as ft
from barloom.operators import patterns as pt
from barloom.operators import scenarios as sc
from barloom.operators import structure as st
from barloom.operators import summaries as su
from barloom.operators import text as tx
from barloom.operators import volume as vo

BARS = "symbol string, timeframe string, open_time_ms long, open double, high double, low double, close double, volume double"
HOUR = 3_600_000


def bars(spark, **series):
    return spark.createDataFrame([(s, "1h", i * HOUR, *map(float, x)) for s, rows in series.items() for i, x in enumerate(rows)], BARS)


def test_each_scenario_fires(spark):
    narrow, wide = (10, 10.5, 9.5, 10.2, 5), (10, 14, 9.9, 13.9, 5)
    rise = [(10 + i, 11.5 + i, 9.9 + i, 11 + i, 5 * 2**i) for i in range(6)]
    wick = [(10, 13, 9.9, 10.1 - 0.01 * i, 5) for i in range(5)]
    drift = [(10, 10.6, 9.9, 10.5 - 0.1 * i, 5) for i in range(7)]
    small = [(10, 11, 9, 10.1, 5 * 2**i) for i in range(5)]
    df = bars(spark, expand=[narrow] * 6 + [wide], rise=rise, wick=wick, drift=drift, small=small, short=[narrow] * 4)
    got = {(r["symbol"], r["scenario"]): (round(r["strength"], 4), r["direction"]) for r in sc.scenarios(df).collect()}
    assert got["expand", "ContractionThenExpansion"] == (1.0, "Bullish")
    assert got["rise", "ProgressiveCloses"] == (0.625, "Bullish")
    assert got["wick", "ShadowRejectionCluster"] == (1.0, "Bearish")
    assert got["drift", "VolumePriceDivergence"] == (0.7, "Bullish")
    assert got["small", "IntradayReversalSequence"] == (1.0, "Neutral")
    assert not any(s == "short" for s, _ in got)
    lines = {r["symbol"]: r["summary"] for r in sc.summary(sc.scenarios(df)).collect()}
    assert lines["rise"].startswith("ProgressiveCloses (0.63)")


def test_all_scenarios_of_the_days(spark):
    rows = entry.queries()["scenarios_daily"](spark, "/root/testdata/sf0.01").collect()
    # an expansion after a contraction is in none of these days
    assert {r["scenario"] for r in rows} == {"ProgressiveCloses", "ShadowRejectionCluster", "VolumePriceDivergence", "IntradayReversalSequence"}


def test_labels_begin_with_the_third_swing(spark):
    points = [(0, 5), (1, 9), (2, 3), (3, 11), (4, 2), (5, 10), (6, 4)]
    flat = [(v, v, v, v, 1) for _, v in points for v in (v,)]
    got = [(r["type"], r["label"]) for r in st.swings(bars(spark, a=flat), 1).orderBy("open_time_ms").collect()]
    assert got == [("High", None), ("Low", None), ("High", "HH"), ("Low", "LL"), ("High", "LH")]
    # two highs without a low between them: the second one is not labelled either
    highs = [(5, 6, 1, 5, 1), (5, 9, 1, 5, 1), (5, 7, 1, 5, 1), (5, 10, 1, 5, 1), (5, 6, 1, 5, 1), (5, 11, 1, 5, 1), (5, 6, 1, 5, 1)]
    assert [r["label"] for r in st.swings(bars(spark, a=highs), 1).orderBy("open_time_ms").collect()] == [None, None, "HH"]


def test_pattern_and_volume_summaries(spark):
    quiet = [(10, 10.6, 9.9, 10.5, 10)] * 24
    marubozu, doji = (10, 12, 10, 12, 30), (11, 13, 9, 11.01, 10)
    df = bars(spark, a=[*quiet, marubozu, doji], none=[(10, 10.6, 9.9, 10.5, 10)] * 3)
    text = {r["symbol"]: r["pattern_summary"] for r in su.pattern_summary(df).collect()}
    assert text["none"] == su.NO_PATTERNS
    lines = text["a"].split("\n")
    assert lines[0] == "Single-candle patterns (2): BullishMarubozu@00:00, Doji@01:00."
    assert lines[-1] == "Volume spikes: 3.0x@00:00."
    volume = {r["symbol"]: r["volume_summary"] for r in su.volume_summary(vo.volume_stats(df)).collect()}
    assert volume["a"] == "Latest volume anomaly: 0.91x (avg last 5 bars: 1.38x). Normal volume."
    whole = {r["symbol"]: r["tech_summary"] for r in su.tech_summary(df, 48).collect()}
    assert whole["none"].split("\n\n")[1:] == [su.NO_PATTERNS, "Latest volume anomaly: 1.00x (avg last 5 bars: 1.00x). Normal volume."]
    assert "Simple RSI(14) on closes (last window): n/a (not enough bars)." in whole["none"]
    assert whole["a"].startswith("a (1h candles, last 26 bars).\nFirst bar close (oldest in window): 10.50 at 1970-01-01T00:00:00.000Z.")


def test_filtered_patterns(spark):
    rows = spark.createDataFrame([(1, "Single", "Doji"), (2, "Double", "X"), (3, "Double", "Y")], "open_time_ms long, category string, pattern_type string")
    ids = lambda **k: [r[0] for r in pt.filtered(rows, **k).orderBy("open_time_ms").collect()]
    assert ids() == [1, 2, 3] and ids(from_ms=2, to_ms=2) == [2] and ids(category="Double") == [2, 3] and ids(category=" ", pattern_type="Doji") == [1]


def test_news_context_by_recency_and_empty(spark):
    schema = "id string, title string, link string, summary string, published_at timestamp, fetched_at timestamp"
    at = lambda d: dt.datetime(2024, 1, d)
    articles = spark.createDataFrame([("a", "A", "la", " ", at(1), at(1)), ("b", "B", "lb", "sum", None, at(3)), ("c", "C", "lc", None, at(2), at(9))], schema)
    chunks = spark.createDataFrame([("a", 0, "text a", [1.0, 0.0]), ("b", 1, "text b", [0.6, 0.8]), ("c", 0, "other length", [1.0])], "article_id string, chunk_index int, text string, embedding array<float>")
    context = lambda *x, **k: su.news_context(*x, **k).first()[0]
    assert context(chunks, articles, [0.0, 1.0], k=1) == "---\nTitle: B\nLink: lb\ntext b"
    latest = f"{su.BY_RECENCY}\n---\nTitle: B\nLink: lb\nsum\n\n---\nTitle: C\nLink: lc"
    assert context(chunks, articles, None, k=2) == latest and context(chunks, articles, [1.0, 2.0, 3.0], k=2) == latest
    assert context(chunks.limit(0), articles.limit(0), None) == su.NO_ARTICLES


def test_chunks_by_hand():
    assert tx.chunk(None) == tx.chunk("  ") == [] and tx.chunk(" one. two ") == ["one. two"]
    assert tx.sentences("A b. C d! E? f.g h") == ["A b.", "C d!", "E?", "f.g h"]
    text = "para one.\n\npara two is here.\r\n\r\n" + "First sentence. Second sentence! Third one? " * 2
    assert tx.chunk(text, most=40, overlap=0) == ["para one.\npara two is here.", "First sentence. Second sentence!", "Third one? First sentence.", "Second sentence! Third one?"]
    assert tx.chunk(text, most=40, overlap=5)[1] == "here. First sentence. Second sentence!"


def test_rule_counts_by_series(spark):
    out = entry.queries()["ml_features_with_rules"](spark, "/root/testdata/sf0.01").select("symbol", "active_rule_count").distinct().collect()
    assert len({r["symbol"] for r in out}) == len(out) > 1 and max(r["active_rule_count"] for r in out) > 0
    assert ft.FEATURES[-1] == "active_rule_count"


def test_chunks_are_cut_in_parts(spark):
    texts = [None if k % 50 == 3 else f"{k} " + "one two. " * (k % 400) for k in range(2 * tx.PART_ROWS + 7)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, content string").coalesce(1)
    got = {(r.article_id, r.chunk_index): r.text for r in tx.chunks(rows).collect()}
    assert got == {(k, i): c for k, t in enumerate(texts) for i, c in enumerate(tx.chunk(t))}

    run = []
    mapped = tx.chunks(type("Rows", (), {"schema": rows.schema, "select": lambda self, *c: self, "mapInArrow": lambda self, f, s: run.append(f) or self})())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "content"])
    assert mapped and [len(set(b.column(0).to_pylist())) <= tx.PART_ROWS for b in run[0](iter([batch]))] == [True] * 3
