"""Joins on inequalities as joins on equal keys, so that rows which cannot meet never do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of one that values are told apart by in keys, and the largest value that keys hold;
#: values of one part, and those beyond, are compared themselves.
PARTS, LARGEST = 2.0**20, 2.0**61
LEVELS = 62


def _cell(x: Column) -> Column:
    """A whole number from 0 that never falls as x (double) rises; NaN counts as largest."""
    held = F.greatest(F.least(x * PARTS, F.lit(LARGEST)), F.lit(-LARGEST))
    return F.floor(held).cast("long") + F.lit(int(LARGEST))


def _keys(cell: Column, bit: int) -> Column:
    """(level, prefix) of each bit of the cell that is as given, the prefix being all higher
    bits, and the whole cell as level -1."""
    shift = lambda n: F.call_function("shiftright", cell, n)
    levels = F.filter(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: shift(k).bitwiseAND(F.lit(1)) == bit)
    above = F.transform(levels, lambda k: F.struct(k.alias("level"), shift(k + 1).alias("prefix")))
    return F.concat(above, F.array(F.struct(F.lit(-1).alias("level"), cell.alias("prefix"))))


def less_pairs(low: DataFrame, high: DataFrame, low_col: str, high_col: str, deal_high: bool = False, salts: int = 8) -> DataFrame:
    """All pairs of rows with low_col < high_col, both double; nulls meet nothing. The two sides
    have no column name in common.

    Of two different whole numbers the larger has a one at the first bit in which they differ
    and the smaller a zero, with equal bits above. So each row has a key for each of its ones
    (zeros), and each pair meets at exactly one key; the rows that are made grow with the rows
    and the pairs found, not with their product. The rows of low (deal_high: of high) are dealt
    to `salts` parts of each key and the others copied to all parts, so that a key with many
    pairs is more than one task.
    """
    parts = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    dealt = lambda df: F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")
    less, more = low.where(F.col(low_col).isNotNull()), high.where(F.col(high_col).isNotNull())
    less = less.withColumn("_salt", parts if deal_high else dealt(low)).withColumn("_k", F.explode(_keys(_cell(F.col(low_col)), 0)))
    more = more.withColumn("_salt", dealt(high) if deal_high else parts).withColumn("_k", F.explode(_keys(_cell(F.col(high_col)), 1)))
    met = less.join(more, ["_k", "_salt"])
    return met.where((F.col("_k.level") >= 0) | (F.col(low_col) < F.col(high_col))).drop("_k", "_salt")


def band_pairs(left: DataFrame, right: DataFrame, left_col: str, right_col: str, width: int) -> DataFrame:
    """All pairs of rows with left_col < right_col < left_col + width, all whole numbers. Rows
    meet in buckets of that width: a row of the right in its own and in the one before."""
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    a = left.withColumn("_bucket", bucket(left_col))
    z = right.withColumn("_bucket", F.explode(F.array(bucket(right_col) - 1, bucket(right_col))))
    ahead = F.col(right_col) - F.col(left_col)
    return a.join(z, "_bucket").where((ahead > 0) & (ahead < width)).drop("_bucket")
