"""Landed payloads, rules, settings and checks against rows written by hand."""

import datetime as dt
import json

import pytest

from barloom.operators import alerts, reads, rules, validate
from barloom.sources import landed

BARS = "symbol string, timeframe string, open_time_ms long, open double, high double, low double, close double, volume double"


def payloads(spark, *texts, source="src"):
    return spark.createDataFrame([(source, t) for t in texts], "source string, payload string")


def test_klines(spark):
    rows = [
        [1000, "1", "3", "0.5", "2", "10", 1999, "20", 5, "4", "8"], [2000, "1", "2", "1", "2", "10", 2999], [1000, "7", "9", "6", "8", "1", 1999],
        [3000, "1", "1", "2", "1", "1", 3999], [4000, "1", "2"], ["x", "1", "2", "1", "2", "10", 1],
    ]
    got = landed.klines(payloads(spark, json.dumps(rows), "no json", "[]"), "S", "1m").orderBy("open_time_ms").collect()
    assert [(r["open_time_ms"], r["open"], r["close"], r["quote_volume"], r["trade_count"]) for r in got] == [(1000, 7.0, 8.0, 0.0, 0), (2000, 1.0, 2.0, 0.0, 0)]


def test_metrics_payloads(spark):
    f = landed.funding(payloads(spark, '[{"fundingTime": 5, "fundingRate": "0.01"}, {"fundingTime": 6, "fundingRate": "x"}, {"fundingRate": "1"}]'), "S")
    assert [tuple(r) for r in f.orderBy("open_time_ms").collect()] == [("S", "8h", 5, 0.01), ("S", "8h", 6, None)]
    o = landed.open_interest(payloads(spark, '[{"timestamp": 5, "sumOpenInterest": "2.5"}]', '{"code": 1}'), "S")
    assert [tuple(r) for r in o.collect()] == [("S", "1h", 5, 2.5)]
    x = landed.forced_orders(payloads(spark, '[{"time": 5, "side": "SELL", "price": "2.5", "qty": "4"}]'), "S")
    assert [tuple(r) for r in x.collect()] == [("S", 5, "SELL", 250, 4.0)]


RSS = """<rss xmlns:dc="u"><channel><title>The feed</title>
<item><title>A</title><link>http://x/a</link><dc:creator>c</dc:creator></item>
<item><title> </title><link>http://x/b</link><description>about B</description><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item>
<item><title>no link</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Other</title>
<entry><title>C</title><link rel="self" href="http://x/self"/><link rel="alternate" href="http://x/c"/><summary>s</summary></entry>
<entry><title>D</title><link rel="enclosure" href="http://x/d"/></entry></feed>"""


def test_feed_keeps_what_belongs_together(spark):
    got = landed.feed(payloads(spark, RSS, ATOM, None, "", source=" ")).collect()
    assert sorted((r["source"], r["title"], r["link"], r["summary"]) for r in got if r["summary"]) == [
        ("Other", "C", "http://x/c", "s"), ("The feed", "(no title)", "http://x/b", "about B"),
    ]
    assert sorted((r["source"], r["title"], r["link"]) for r in got if not r["summary"]) == [("Other", "D", "http://x/d"), ("The feed", "A", "http://x/a")]
    long = f"<rss><item><title>{'t' * 3000}</title><link>http://x/{'l' * 5000}</link><description>{'s' * 5000}</description></item></rss>"
    (r,) = landed.feed(payloads(spark, long)).collect()
    assert (len(r["title"]), len(r["link"]), len(r["summary"]), r["source"]) == (2000, 4000, 5000, "src")


HOSTILE = """<?xml version="1.0"?><!-- <item><title>comment</title><link>http://x/no</link></item> -->
<rss version="2.0" xmlns:media="m" xmlns:atom="http://www.w3.org/2005/Atom"><channel><title>The <![CDATA[<feed>]]></title><atom:link href="http://self" rel="self"/>
<item><title><![CDATA[A </item> <b>x</b> & y]]></title><media:title>other</media:title><media:link>http://x/other</media:link><link>http://x/a</link><guid isPermaLink="false">g</guid><description><p>in <i>parts</i></p></description></item>
<item><title type="x">T &amp; U &lt;b&gt;</title><link> http://x/b </link><source><item>deep</item><link>http://x/deep</link></source></item></channel></rss>"""
PREFIXED = """<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:title>Pre</a:title><a:entry><a:title>E</a:title><a:link href="http://x/e"/><a:summary type="xhtml"><div>s <b>q</b></div></a:summary><a:published>2024-01-01T00:00:00Z</a:published></a:entry></a:feed>"""
RDF = """<rdf:RDF xmlns:rdf="r" xmlns="http://purl.org/rss/1.0/"><channel><title>Old</title></channel><item><title>R</title><link>http://x/r</link></item></rdf:RDF>"""


def test_feed_is_read_as_xml(spark):
    got = landed.feed(payloads(spark, HOSTILE, PREFIXED, RDF, "<rss><channel><item><title>broken", "no xml", source=None)).collect()
    assert sorted((r["source"], r["title"], r["link"], r["summary"], r["published"]) for r in got) == [
        ("Old", "R", "http://x/r", None, None),
        ("Pre", "E", "http://x/e", "<div>s <b>q</b></div>", "2024-01-01T00:00:00Z"),
        ("The <feed>", "A </item> <b>x</b> & y", "http://x/a", "<p>in <i>parts</i></p>", None),
        ("The <feed>", "T & U <b>", "http://x/b", None, None),
    ]


def met(spark, cond, stats=True):
    rows = [("S", "1h", i, 1.0, 2.0, 0.5, 1.5, float(v), a, p, m) for i, (v, a, p, m) in enumerate([(10, None, None, None), (10, 1.0, 1.0, 1.0), (30, 2.0, 3.0, 0.5)])]
    df = spark.createDataFrame(rows, BARS + ", anomaly_ratio double, vs_previous double, vs_max10 double").selectExpr("*", "high - low as rng")
    return [r["x"] for r in df.withColumn("x", rules.predicate(cond, stats)).orderBy("open_time_ms").collect()]


@pytest.mark.parametrize(("given", "want"), [
    ({"reference": "Prev", "multiplier": 2.5}, [False, False, True]),
    ({"reference": "MAX10", "multiplier": 0.7}, [False, True, False]),
    ({"reference": "sma", "period": 20, "multiplier": 1.5}, [False, False, True]),
    ({"reference": "sma", "period": 2, "multiplier": 2.5}, [False, False, True]),
    ({"reference": "sma", "period": None, "multiplier": 0.1}, [False, False, False]),
    ({"reference": "prev", "multiplier": None}, [False, False, False]),
])
def test_volume_conditions(spark, given, want):
    assert met(spark, rules.Condition("volume_compare", operator="gt", **given)) == want


def test_parsed_conditions():
    text = '[{"Type": "range_compare", "period": 5, "MULTIPLIER": 0.7, "operator": "lt", "other": 1}, {"type": "body_ratio", "value": 0.6, "barOffset": -1}]'
    assert rules.parse_conditions(text) == (
        rules.Condition("range_compare", period=5, multiplier=0.7, operator="lt"), rules.Condition("body_ratio", value=0.6, barOffset=-1),
    )
    assert rules.parse_conditions(None) == rules.parse_conditions("x") == rules.parse_conditions("{}") == ()


def test_settings(spark):
    assert alerts.checked_settings(" u ", True, 2.0, 1.0, " ", 5)["kline_interval"] == "1m"
    for bad in (("", True, None, None, "1m", 5), ("u", True, 1.0, 1.0, "1m", 5), ("u", True, None, None, "7m", 5), ("u", True, None, None, "1m", 0)):
        with pytest.raises(ValueError):
            alerts.checked_settings(*bad)
    stored = spark.createDataFrame([], alerts.ALERT_SETTINGS)
    at = dt.datetime(2024, 1, 1)
    once = alerts.put_settings(spark, stored, alerts.checked_settings("u", True, 2.0, 1.0, "1h", 5), at)
    twice = alerts.put_settings(spark, once, alerts.checked_settings("u", False, 3.0, 1.0, "1h", 9), at)
    assert [(r["enabled"], r["price_above"], r["cooldown_minutes"]) for r in alerts.settings_of(twice, " u ").collect()] == [(False, 3.0, 9)]
    assert alerts.alert_interval(once).first()[0] == 5 and alerts.alert_interval(twice).first()[0] == 10
    with pytest.raises(ValueError):
        alerts.settings_of(twice, " ")


def test_empty_series_and_duplicates(spark):
    bars = spark.createDataFrame([("A", "1h", 0, 1.0, 2.0, 1.0, 2.0, 1.0), ("A", "1h", 0, 1.0, 2.0, 1.0, 2.0, 1.0), ("A", "1h", 10_800_000, 1.0, 2.0, 1.0, 2.0, 1.0)], BARS)
    expected = spark.createDataFrame([("A", "1h"), ("B", "1h")], "symbol string, timeframe string")
    assert [tuple(r) for r in validate.empty(bars, expected).collect()] == [("B", "1h", None, "EMPTY", 0)]
    found = {(r["issue"], r["missing"]) for r in validate.issues(bars, "1h").collect()}
    assert {("DUPLICATE_TIME", 0), ("MISSING_CANDLE", 2)} <= found


def test_stored_rules(spark):
    df = spark.createDataFrame([
        (1, "A", "1h", True, True, 0.6, 0.5), (2, "A", "4h", True, True, 0.9, 0.5), (3, "A", "4h", True, False, 1.0, 9.0), (4, "B", "1h", False, True, 0.7, 0.7), (5, "A", "1h", True, False, None, None),
    ], "id long, symbol string, timeframe string, is_enabled boolean, is_auto_discovered boolean, win_rate double, avg_return double")
    assert [r["id"] for r in reads.discovered_rules(df).collect()] == [4, 2, 1]
    assert [r["id"] for r in reads.discovered_rules(df, "A", "1h").collect()] == [1]
    assert sorted(r[0] for r in reads.rule_timeframes(df, "A").collect()) == ["1h", "4h"]
    assert sorted(map(tuple, reads.active_rules(df).collect())) == [("A", "1h", 2), ("A", "4h", 2)]
