"""Every registered query against its DuckDB oracle on the smallest fixture
(the driver runs the same comparison at sf0.01)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from paths import SF_SMALL
from crossbook.plans import catalog
from scripts.check_oracles import TABLES, rows_key

STREAMING = {"match_orders_stream", "seeded_match_stream", "drain_available", "replay_equal",
             "src_microbatch"}
NAMES = sorted(catalog.registry())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_query_has_an_oracle_or_is_listed():
    missing = set(NAMES) - set(E.oracle_sql())
    assert not missing, missing


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["symbol", "trade_id", "order_id", "quantity", "price", "action", "status",
                          "timestamp"]


@pytest.mark.parametrize("name", [n for n in NAMES if n not in STREAMING])
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    rel = duck.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    drows = rel.fetchall()
    assert len(rows) == len(drows)
    assert rows_key(df.columns, rows) == rows_key(rel.columns, drows)


@pytest.mark.parametrize("name", ["src_orders", "normalize_epoch", "mid_ticks", "random_trades"])
def test_results_do_not_depend_on_session_time_zone(spark, duck, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = E.queries()[name](spark, SF_SMALL)
        rows = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    rel = duck.sql(E.oracle_sql()[name])
    assert rows_key(df.columns, rows) == rows_key(rel.columns, rel.fetchall())


SCAN_QUERIES = ["book_depth", "match_priority", "queue_position", "rest_orders", "last_price",
                "price_stream", "mid_ticks", "price_heartbeat", "sweep_book", "reconcile_diff",
                "ask_ladder", "bid_ladder", "top_levels"]


@pytest.fixture()
def every_key_hot(spark):
    """Force the split (hot-key) plan of every running scan."""
    from crossbook.functions.scan import MIN_HOT_ROWS_CONF
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(MIN_HOT_ROWS_CONF, "1")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    yield
    spark.conf.unset(MIN_HOT_ROWS_CONF)
    spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("name", SCAN_QUERIES)
def test_split_scans_match_oracle(spark, duck, every_key_hot, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(E.oracle_sql()[name])
    assert rows_key(df.columns, rows) == rows_key(rel.columns, rel.fetchall())
