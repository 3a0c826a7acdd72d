"""The stored index of window vectors, and search over it.

The index is a table partitioned by version, feature type, window size, timeframe and span (of
SPAN_MS of the windows' beginnings). An update reads the bars from the last stored window on,
and rewrites the spans that its windows fall in, by dynamic partition overwrite: their stored
rows, and the new ones in place of rows of the same window. It can be repeated after a
failure. A search reads the partitions of its version, feature type, size and timeframes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators import slices as sl
from barloom.operators import vectors as ve
from barloom.operators.series import SERIES
from barloom.sources import files
from barloom.sources.tables import stored

SPAN_MS = 30 * 86_400_000
PARTS = ["version", "feature_type", "window_size", "timeframe", "span"]
WINDOW = [*SERIES, "feature_type", "window_size", "start_time_ms"]
INDEX = (
    "symbol string, start_time_ms long, end_time_ms long, vector array<float>, vector_dim int, vector_norm float, updated_ms long, "
    "version int, feature_type string, window_size int, timeframe string, span long"
)
#: The feature types and sizes that a warm-up builds.
WARM_FEATURES, WARM_SIZES = ["open", "high", "low", "close", "all", "returns_shape"], [5, 10, 15, 20, 25]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The index; no rows where there is none."""
    there = any(n.startswith("version=") for n in files.names(spark, path))
    return spark.read.schema(INDEX).parquet(path) if there else spark.createDataFrame([], INDEX)


def update(spark: SparkSession, path: str, bars: DataFrame, features: list[str], sizes: list[int], as_of_ms: int, again_ms: int = 0) -> None:
    """Adds the windows that the index lacks: of each series, feature type and size those that
    begin after the last stored one, or up to again_ms before it (bars that have been mended).

    Only bars from the least of these beginnings on are read into windows. Stored windows of
    other versions are left to purge.
    """
    have = read(spark, path).where(F.col("version") == ve.VERSION)
    marks = have.groupBy(*WINDOW[:4]).agg((F.max("start_time_ms") - again_ms).alias("mark"))
    wanted = spark.createDataFrame([(f, s) for f in features for s in sizes], "feature_type string, window_size int")
    marks = stored(marks.join(F.broadcast(wanted), ["feature_type", "window_size"], "left_semi"), "vector-marks")
    # a series that lacks one of the wanted tables is read from its beginning
    begun = marks.groupBy(*SERIES).agg(F.min("mark").alias("begin"), F.count("*").alias("tables")).where(F.col("tables") == len(features) * len(sizes))
    tail = bars.join(begun.drop("tables"), SERIES, "left").where(F.col("begin").isNull() | (F.col("open_time_ms") > F.col("begin"))).drop("begin")
    fresh = (
        ve.vectors_of(tail, features, sizes)
        .drop("start_index", "series_bars")
        .join(marks, WINDOW[:4], "left")
        .where(F.col("mark").isNull() | (F.col("start_time_ms") > F.col("mark")))
        .withColumns({"updated_ms": F.lit(as_of_ms).cast("long"), "span": F.floor(F.col("start_time_ms") / F.lit(SPAN_MS)).cast("long")})
        .select(*(c.split()[0] for c in INDEX.split(", ")))
    )
    fresh = stored(fresh, "vector-new")
    touched = fresh.select(*PARTS).distinct()
    kept = have.join(F.broadcast(touched), PARTS, "left_semi").join(fresh.select(*WINDOW), WINDOW, "left_anti").select(fresh.columns)
    # the old rows are read before their partitions are written
    merged = stored(kept.unionByName(fresh), "vector-merged")
    (
        merged.repartition(*PARTS, "symbol")
        .sortWithinPartitions(*PARTS, "symbol", "start_time_ms")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTS)
        .parquet(path)
    )


def warm_up(spark: SparkSession, path: str, bars: DataFrame, as_of_ms: int, size: int | None = None) -> None:
    """All feature types that searches use, of the given size or of all five."""
    update(spark, path, bars, WARM_FEATURES, [size] if size else WARM_SIZES, as_of_ms)


def purge(spark: SparkSession, path: str, version: int = ve.VERSION) -> list[str]:
    """Removes the partitions of all other versions; their names."""
    old = [n for n in files.names(spark, path) if n.startswith("version=") and n != f"version={version}"]
    for n in old:
        files.remove(spark, f"{path}/{n}")
    return old


def status(spark: SparkSession, path: str) -> DataFrame:
    """symbol, timeframe, feature_type, window_size, windows, updated_ms of the present version."""
    have = read(spark, path).where(F.col("version") == ve.VERSION)
    return have.groupBy(*WINDOW[:4]).agg(F.count("*").alias("windows"), F.max("updated_ms").alias("updated_ms"))


#: Places of a block of candidates, queries of a chunk, and how far a similarity by matrix
#: product may be from the one by single products.
BLOCK, CHUNK, MATRIX_ERROR = 4096, 2048, 1e-4
#: Queries of one matrix product.
PRODUCT = 256
BEST = "symbol string, timeframe string, query_id string, start_index long, start_time_ms long, end_time_ms long, similarity double, block long, scanned long"


def last_windows(bars: DataFrame, size: int) -> DataFrame:
    """query_id, symbol, timeframe, end_time_ms: the last window of each series."""
    return bars.groupBy(*SERIES).agg(F.max("open_time_ms").alias("end_time_ms")).withColumn("query_id", F.concat_ws("/", *SERIES))


def _query_vectors(at: DataFrame, queries: DataFrame, feature: str, size: int, lookback: int) -> DataFrame:
    """Each query's vector, and the places that its candidates may begin at. A query needs
    twice its size in bars up to its end, of the lookback."""
    ends = queries.select("query_id", *SERIES, F.col("end_time_ms").alias("open_time_ms")).join(at.select(*SERIES, "open_time_ms", F.col("_i").alias("_end")), [*SERIES, "open_time_ms"])
    places = ends.where(F.least(F.col("_end") + 1, F.lit(lookback)) >= 2 * size).withColumn("_i", F.explode(F.sequence(F.col("_end") - size + 1, F.col("_end")))).drop("open_time_ms")
    bar = F.struct("_i", "open", "high", "low", "close", "volume")
    windows = at.join(places, [*SERIES, "_i"]).groupBy("query_id", *SERIES, "_end").agg(F.sort_array(F.collect_list(bar)).alias("_w"))
    return (
        windows.select("query_id", *SERIES, "_end", ve.vector(feature, F.col("_w")).alias("q"))
        .where("q is not null")
        .withColumns({"qn": ve.norm(F.col("q")).cast("float"), "low": F.greatest(F.col("_end") - lookback + 1, F.lit(0)), "high": F.col("_end") - size})
    )


def _block_best(k: int):
    """Of a block of candidates and a chunk of queries, what may be among the k best of a query:
    by matrix products, then single products (of floats, summed as doubles) for those left."""

    def best(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in BEST.split(", ")]
        picked: dict[str, list] = {n: [] for n in names}
        if len(candidates) and len(queries):
            c4, cn = np.stack(candidates["vector"].to_list()).astype("f4"), candidates["vector_norm"].to_numpy("f8")
            q4, qn = np.stack(queries["q"].to_list()).astype("f4"), queries["qn"].to_numpy("f8")
            place, c8 = candidates["start_index"].to_numpy(), c4.astype("f8").T
            start, end = candidates["start_time_ms"].to_numpy(), candidates["end_time_ms"].to_numpy()
            symbol, timeframe, asked = candidates["symbol"].iat[0], candidates["timeframe"].iat[0], queries["query_id"].to_list()
            for at in range(0, len(queries), PRODUCT):
                over = np.outer(qn[at : at + PRODUCT], cn)
                near = np.divide(q4[at : at + PRODUCT].astype("f8") @ c8, over, out=np.zeros(over.shape), where=over > 0)
                for row, line in enumerate(near, at):
                    inside = np.flatnonzero((place >= queries["low"].iat[row]) & (place <= queries["high"].iat[row]))
                    scanned = len(inside)
                    if not scanned:
                        continue
                    if scanned > k:
                        inside = inside[line[inside] >= np.partition(line[inside], scanned - k)[scanned - k] - MATRIX_ERROR]
                    norms = cn[inside] * qn[row]
                    dots = (c4[inside] * q4[row]).astype("f8").sum(axis=1)
                    similar = np.divide(dots, norms, out=np.zeros(len(inside)), where=norms > 0)
                    n = len(inside)
                    made = ([symbol] * n, [timeframe] * n, [asked[row]] * n, place[inside], start[inside], end[inside], similar, place[inside] // BLOCK, [scanned] * n)
                    for column, values in zip(names, made):
                        picked[column].extend(values)
        kinds = {"string": object, "long": "i8", "double": "f8"}
        return pd.DataFrame({n: np.array(picked[n], dtype=kinds[c.split()[1]]) for n, c in zip(names, BEST.split(", "))}).astype({n: object for n in names[:3]})

    return best


def _blocked(candidates: DataFrame, queries: DataFrame, k: int, chunks: int) -> DataFrame:
    """Candidates and queries meet by series, block and chunk; a block goes to every chunk."""
    c = candidates.withColumns({"_block": F.floor(F.col("start_index") / BLOCK), "_chunk": F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))})
    blocks = F.sequence(F.floor(F.col("low") / BLOCK), F.floor(F.col("high") / BLOCK))
    q = queries.withColumns({"_chunk": F.pmod(F.hash("query_id"), F.lit(chunks)), "_block": F.explode(blocks)})
    key = [*SERIES, "_block", "_chunk"]
    c = c.select(*key, "start_index", "start_time_ms", "end_time_ms", "vector", "vector_norm")
    q = q.select(*key, "query_id", "q", "qn", "low", "high")
    return c.groupBy(*key).cogroup(q.groupBy(*key)).applyInPandas(_block_best(k), BEST)


def search(
    spark: SparkSession, path: str, bars: DataFrame, as_of_ms: int, queries: DataFrame | None = None,
    feature: str = "all", size: int = 10, top_k: int = 10, gap: int | None = None, lookback: int = 2000,
) -> DataFrame:
    """The stored windows most like each query window, no two of them closer than gap bars:
    query_id, symbol, timeframe, rank, window_id, start_time_ms, end_time_ms, similarity,
    distance, scanned, from_index.

    queries has query_id (a string), symbol, timeframe and end_time_ms (the beginning of the window's last bar);
    without it, the last window of each series asks. Candidates are of the query's series, end
    before the query does, and begin within its lookback. A feature type and size that the
    index lacks is built first; a query that the index then has nothing for looks through the
    bars' own windows that do not overlap it. A pick hides at most 2 * gap - 1 windows, so that
    the best top_k * 2 * gap of a query hold all its picks: no more are gathered.
    """
    feature = ve.feature_type(feature)
    if not feature:
        raise ValueError("feature_type")
    size, top_k, lookback = min(max(size, 5), 100), min(max(top_k, 1), 50), min(max(lookback, 100), 100_000)
    gap = size if gap is None else gap
    own = lambda: read(spark, path).where((F.col("version") == ve.VERSION) & (F.col("feature_type") == feature) & (F.col("window_size") == size))
    if own().isEmpty():
        update(spark, path, bars, [feature], [size], as_of_ms)
    at = stored(sl.placed(bars.select(*SERIES, "open_time_ms", "open", "high", "low", "close", "volume")), "placed-bars")
    asked = stored(_query_vectors(at, last_windows(bars, size) if queries is None else queries, feature, size, lookback), "query-windows")
    chunks = 1 + asked.count() // CHUNK
    # only series that ask, and of the index only windows that begin with one of the bars
    series = asked.select(*SERIES).distinct()
    places = at.select(*SERIES, F.col("open_time_ms").alias("start_time_ms"), F.col("_i").alias("start_index"))
    candidates = own().where(F.col("vector_dim") == ve.dimension(feature, size)).join(series, SERIES, "left_semi").join(places, [*SERIES, "start_time_ms"])
    k = top_k * 2 * max(gap, 1)
    found = stored(_blocked(candidates, asked, k, chunks).withColumn("from_index", F.lit(True)), "found-windows")
    lacking = asked.join(found.select("query_id").distinct(), "query_id", "left_anti").withColumn("high", F.col("_end") - 2 * size + 1)
    if not lacking.isEmpty():
        few = at.join(lacking.select(*SERIES).distinct(), SERIES, "left_semi")
        found = found.unionByName(_blocked(ve.vectors_of(few, [feature], [size]), lacking, k, chunks).withColumn("from_index", F.lit(False)))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.desc("start_time_ms"))
    item = F.struct((-F.col("similarity")).alias("s"), (-F.col("start_time_ms")).alias("t"), F.col("start_index").alias("index"), "similarity", "start_time_ms", "end_time_ms")
    picked = (
        found.withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= k)
        .groupBy("query_id", *SERIES, "from_index")
        .agg(F.sort_array(F.collect_list(item)).alias("ranked"))
        .select("query_id", *SERIES, "from_index", F.posexplode(ve.greedy_apart(F.col("ranked"), gap, top_k)).alias("rank", "x"))
    )
    # every block that has candidates for a query has one among its best
    scanned = found.groupBy("query_id", "block").agg(F.max("scanned").alias("scanned")).groupBy("query_id").agg(F.sum("scanned").alias("scanned"))
    return picked.join(scanned, "query_id").select(
        "query_id", *SERIES, (F.col("rank") + 1).alias("rank"), F.concat(F.lit("w_"), "x.start_time_ms", F.lit("_"), "x.end_time_ms").alias("window_id"),
        "x.start_time_ms", "x.end_time_ms", "x.similarity", (1 - F.col("x.similarity")).alias("distance"), "scanned", "from_index",
    )
