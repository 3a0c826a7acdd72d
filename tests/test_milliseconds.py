"""Events in the last half millisecond of a bar: their times are rounded as the SQL rounds them."""

import __spark_entry__ as entry
import duckdb
import pytest

from compare import connection, differences

NAMES = [
    "bars_ohlcv_15m", "bars_ohlcv_1h", "asof_metrics", "bollinger", "ema", "funding_zscore", "dataset_page", "ingestion_cycle", "stream_bars", "stream_cooldown", "rule_cooldown",
    *(f"by_series_window_vectors_{x}" for x in ("all", "close", "open", "returns_log", "returns_shape", "volume_norm")),
]


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    """Every fifth event comes 499, 500 or 501 microseconds, or up to 400, before the end of its hour."""
    folder = str(tmp_path_factory.mktemp("edges"))
    duckdb.execute(f"""
        COPY (SELECT * REPLACE (CASE WHEN event_id % 5 = 0 THEN date_trunc('hour', ts) + INTERVAL 1 HOUR
                                     - to_microseconds(CASE event_id % 4 WHEN 0 THEN 499 WHEN 1 THEN 500 WHEN 2 THEN 501 ELSE 1 + event_id % 400 END) ELSE ts END AS ts)
              FROM '/root/testdata/sf0.01/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)""")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_edges(spark, edges, name):
    assert differences(entry.queries()[name](spark, edges), entry.oracle_sql()[name], connection(edges)) == []
