"""Windows over bar series."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

SERIES = ["symbol", "timeframe"]
KEY = [*SERIES, "open_time_ms"]


def by_time() -> WindowSpec:
    return Window.partitionBy(*SERIES).orderBy("open_time_ms")


def rows(start: int, end: int) -> WindowSpec:
    return by_time().rowsBetween(start, end)


def so_far() -> WindowSpec:
    return by_time().rowsBetween(Window.unboundedPreceding, 0)


def whole() -> WindowSpec:
    return Window.partitionBy(*SERIES)


def index() -> Column:
    """Place of a bar in its series, from 0."""
    return F.row_number().over(by_time()) - 1


def lag(c: str, n: int = 1) -> Column:
    return F.lag(c, n).over(by_time())


def lead(c: str, n: int = 1) -> Column:
    return F.lead(c, n).over(by_time())
