"""Events with numbers of 10^10 and more: first and last of a bar are those of the SQL's order, in which such numbers
reach into the milliseconds."""

import __spark_entry__ as entry
import duckdb
import pytest

from compare import connection, differences

NAMES = [
    "bars_ohlcv_15m", "bars_ohlcv_1h", "asof_metrics", "bollinger", "ema", "funding_zscore", "dataset_page", "ingestion_cycle", "stream_bars",
    *(f"by_series_window_vectors_{x}" for x in ("all", "close", "open", "returns_log", "returns_shape", "volume_norm")),
]


@pytest.fixture(scope="module")
def numbered(tmp_path_factory):
    """Each event has a second one 2 ms later with a smaller number and a higher value."""
    folder = str(tmp_path_factory.mktemp("numbered"))
    duckdb.execute(f"""
        COPY (SELECT event_id + (1 - i) * 1000000000000 AS event_id, ts + to_microseconds(i * 2000) AS ts, user_id, event_type, value + i * (1 + event_id % 50) AS value, props
              FROM '/root/testdata/sf0.01/events.parquet', range(2) copies(i)) TO '{folder}/events.parquet' (FORMAT parquet)""")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_numbers(spark, numbered, name):
    assert differences(entry.queries()[name](spark, numbered), entry.oracle_sql()[name], connection(numbered)) == []
