"""Every registered query on the supplied tables against its SQL."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from helpers import plan

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="supplied tables not there")
QUERIES, ORACLE = entry.QUERIES, entry.ORACLE


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return repr(value)
    return repr(float(value)) if type(value).__name__ == "Decimal" else str(value)


def stays_in_the_engine(name, text):
    """No row-at-a-time Python, no cross join, no aggregation over a sorted copy of the events."""
    for word in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text
    assert "MapInArrow" not in text
    if "indicator" not in name and "metadata" not in name and not name.startswith("stream_"):
        assert "SortAggregate" not in text


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    stays_in_the_engine(name, plan(found))
    result = duck.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(found.columns) == sorted(columns)
    want = sorted(tuple(map(plain, row)) for row in result.fetchall())
    got = sorted(tuple(map(plain, row)) for row in found.select(*columns).collect())
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0].total_stocks > 0


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["latest_stock"](spark, FOLDER))
    assert "SYM0007" in text.split("Exchange")[-1]  # below every shuffle
    text = plan(QUERIES["price_domain"](spark, FOLDER))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in text
    text = plan(QUERIES["market_volatility_15m"](spark, FOLDER))
    assert "GreaterThanOrEqual(ts,2024-01-01T00:00)" in text and "LessThan(ts,2024-01-31T00:00)" in text


def test_top_lists_are_cut_in_every_task(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["top_gainers"](spark, FOLDER))
    for name in ("news_bucket_topn", "indicator_latest_n", "top_movers_union"):
        assert plan(QUERIES[name](spark, FOLDER)).count("WindowGroupLimit") == 2
    assert plan(QUERIES["top_movers_union"](spark, FOLDER)).count("FileScan") == 1
