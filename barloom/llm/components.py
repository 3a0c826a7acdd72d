"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, label): the smallest node that each node reaches.

    Only nodes with an edge to another node are returned. Every round is one group-by
    minimum and one equi-join on each side, so that a node with very many edges is
    pre-aggregated and its join can be split; the edge table never leaves the executors.
    Edges with a null end are ignored; an empty table gives an empty result.
    """
    now = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    before = _state(now)
    while before[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(low, "hi")
            .where("lo <> m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionAll(low.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        now = cut(small)
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionAll(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()
    )
