"""Readers of landed payloads: exchange JSON and feed XML, one payload a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalar import interval_ms
from barloom.operators.series import KEY
from barloom.operators.validate import keep_last


def klines(payloads: DataFrame, symbol: str, timeframe: str, json_col: str = "payload") -> DataFrame:
    """Bars of JSON arrays of arrays: time, four prices, volume, and up to five more values.
    Rows of fewer than seven values and rows with high < low go; of equal times the last
    stays."""
    return keep_last(_klines(payloads.select(F.lit(symbol).alias("symbol"), F.lit(timeframe).alias("timeframe"), json_col), json_col), KEY, "_pos").drop("_pos")


def klines_by_row(payloads: DataFrame, json_col: str = "payload", landed_col: str = "landed_ms") -> DataFrame:
    """The same of payloads that say their symbol and timeframe; of equal keys the one that
    landed last stays."""
    rows = _klines(payloads, json_col, landed_col).withColumn("_at", F.struct(landed_col, "_pos"))
    return keep_last(rows, KEY, "_at").drop("_pos", "_at", landed_col)


def _klines(payloads: DataFrame, json_col: str, *more: str) -> DataFrame:
    item = F.from_json(json_col, "array<array<string>>")
    x = lambda i, t: F.try_element_at("k", F.lit(i + 1)).try_cast(t)
    return payloads.select("symbol", "timeframe", *more, F.posexplode(item).alias("_pos", "k")).where(F.size("k") >= 7).select(
        "symbol", "timeframe", *more, x(0, "long").alias("open_time_ms"),
        x(6, "long").alias("close_time_ms"), *(x(i, "double").alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"), 1)),
        F.coalesce(x(7, "double"), F.lit(0.0)).alias("quote_volume"), F.coalesce(x(8, "long"), F.lit(0)).alias("trade_count"),
        F.coalesce(x(9, "double"), F.lit(0.0)).alias("taker_buy_volume"), F.coalesce(x(10, "double"), F.lit(0.0)).alias("taker_buy_quote_volume"), "_pos",
    ).where("high >= low and open_time_ms is not null")


def funding(payloads: DataFrame, symbol: str, json_col: str = "payload") -> DataFrame:
    r = F.from_json(json_col, "array<struct<fundingTime:long,fundingRate:string>>")
    return payloads.select(F.explode(r).alias("r")).select(
        F.lit(symbol).alias("symbol"), F.lit("8h").alias("timeframe"), F.col("r.fundingTime").alias("open_time_ms"), F.col("r.fundingRate").try_cast("double").alias("funding_rate")
    ).where("open_time_ms is not null")


def open_interest(payloads: DataFrame, symbol: str, timeframe: str = "1h", json_col: str = "payload") -> DataFrame:
    """Payloads that are no arrays give no rows."""
    r = F.from_json(json_col, "array<struct<timestamp:long,sumOpenInterest:string>>")
    return payloads.where(F.startswith(F.ltrim(F.col(json_col)), F.lit("["))).select(F.explode(r).alias("r")).select(
        F.lit(symbol).alias("symbol"), F.lit(timeframe).alias("timeframe"), F.col("r.timestamp").alias("open_time_ms"), F.col("r.sumOpenInterest").try_cast("double").alias("open_interest")
    ).where("open_time_ms is not null")


def forced_orders(payloads: DataFrame, symbol: str, json_col: str = "payload") -> DataFrame:
    r = F.from_json(json_col, "array<struct<time:long,side:string,price:string,qty:string>>")
    return payloads.select(F.explode(r).alias("r")).select(
        F.lit(symbol).alias("symbol"), F.col("r.time").alias("time"), F.col("r.side").alias("side"),
        F.round(F.col("r.price").try_cast("double") * 100).cast("long").alias("cents"), F.col("r.qty").try_cast("double").alias("qty"),
    ).where("time is not null")


#: What is read of a feed: RSS items in or beside the channel, and Atom entries.
_ITEM = "struct<title:string,link:string,description:string,pubDate:string>"
_ENTRY = "struct<title:string,link:array<struct<_rel:string,_href:string>>,summary:string,published:string>"
FEED = f"channel struct<title:string,item:array<{_ITEM}>>, item array<{_ITEM}>, title string, entry array<{_ENTRY}>"


def feed(payloads: DataFrame, source_col: str = "source", xml_col: str = "payload") -> DataFrame:
    """Articles of RSS, RDF and Atom payloads, read by the schema FEED: elements of other
    namespaces are not taken for a feed's own, CDATA may hold anything, and an article lacks what
    it lacks. The alternate link, else the first one; articles with a blank link go. The title
    has 2000 characters at most and the link 4000. A blank source is the feed's title, else RSS.
    A payload that is no well-formed XML has no articles.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    # an Atom feed may carry its own namespace as a prefix on every element
    prefixed = F.rlike(F.col(xml_col), F.lit(r"<[\w.-]+:feed[\s>]"))
    parsed = lambda bare: F.from_xml(F.col(xml_col), FEED, {"ignoreNamespace": bare})
    docs = payloads.where(F.col(xml_col).isNotNull()).select(
        F.col(source_col), F.when(prefixed, parsed("true")).otherwise(parsed("false")).alias("f")
    )
    items = F.concat(F.coalesce("f.channel.item", F.array()), F.coalesce("f.item", F.array()))
    first = lambda links: F.get(F.transform(links, lambda x: x["_href"]), F.lit(0))
    alternate = lambda x: F.filter(x["link"], lambda y: F.coalesce(y["_rel"], F.lit("alternate")) == "alternate")
    article = lambda title, link, summary, published: F.struct(
        title.alias("title"), link.alias("link"), summary.alias("summary"), published.alias("published")
    )
    found = F.concat(
        F.transform(items, lambda x: article(x["title"], x["link"], x["description"], x["pubDate"])),
        F.transform(F.coalesce("f.entry", F.array()), lambda x: article(x["title"], F.coalesce(first(alternate(x)), first(x["link"])), x["summary"], x["published"])),
    )
    source = F.coalesce(blank(F.col(source_col)), blank(F.coalesce("f.channel.title", "f.title")), F.lit("RSS"))
    rows = docs.select(source.alias(source_col), F.explode(found).alias("x")).select(
        source_col,
        F.substring(F.coalesce(blank(F.col("x.title")), F.lit("(no title)")), 1, 2000).alias("title"),
        F.substring(blank(F.col("x.link")), 1, 4000).alias("link"),
        blank(F.col("x.summary")).alias("summary"),
        blank(F.col("x.published")).alias("published"),
    )
    return rows.where("link <> ''").select(F.sha2("link", 256).alias("id"), source_col, "title", "link", "summary", "published")


def only_new(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(stored.select(*keys), keys, "left_anti")


def expected_close(open_ms: int, timeframe: str) -> int:
    return open_ms + interval_ms(timeframe) - 1
