"""Results do not depend on the order of rows when seq repeats."""

import itertools

import pytest
from pyspark.sql import functions as F

from crossbook.operators import book as B
from crossbook.operators import prices as P
from crossbook.operators import trades as T
from crossbook.plans.match import match_orders, with_arrival

ORDER = "symbol string, seq bigint, order_id string, price double, quantity bigint, timestamp bigint"
ROWS = [("X", 1, "a", 50.0, 10, 0), ("X", 1, "b", 53.0, -10, 0), ("X", 1, "c", 52.0, -4, 0),
        ("X", 1, "d", 52.0, 4, 0), ("X", 1, "d", 52.0, -3, 0), ("X", 2, "e", 50.0, -3, 60_000_000),
        ("X", 2, "f", 49.0, 3, 60_000_000), (None, 1, "a", 50.0, 1, 5), (None, 1, "b", 50.0, -1, 5)]


def results(spark, rows):
    orders = spark.createDataFrame(rows, ORDER).coalesce(1)
    res = match_orders(orders, emit_top=True).checkpoint()
    # the same rows of tops and prints, in another order
    flip = [F.desc("arrival")] if rows != ROWS else [F.asc("arrival")]
    tops, prints = res.top_changes.coalesce(1).sortWithinPartitions(*flip), res.prints.coalesce(1).sortWithinPartitions(*flip)
    points = T.price_points(prints)
    return [sorted(map(str, df.collect())) for df in (
        P.mid_ticks(tops, 20_000_000), P.price_heartbeat(points, 20_000_000), P.price_stream(prints),
        P.last_price(with_arrival(orders), points), B.rest_orders(orders))]


def test_any_row_order_gives_the_same(spark):
    want = results(spark, ROWS)
    assert all(want)
    for rows in itertools.islice(itertools.permutations(ROWS), 1, None, 90_001):
        assert results(spark, list(rows)) == want


def test_last_price_sees_prints_of_its_own_seq(spark):
    orders = spark.createDataFrame([("X", 1, "a", 50.0, 5, 0), ("X", 1, "b", 50.0, -5, 0), ("X", 1, "c", 40.0, 1, 0)], ORDER)
    got = P.last_price(with_arrival(orders), T.price_points(match_orders(orders).prints), initial=1.0)
    assert {r.order_id: (r.arrival, r.last_price) for r in got.collect()} == {"a": (0, 1.0), "b": (1, 1.0), "c": (2, 50.0)}


@pytest.mark.parametrize("arrivals", [[0, 1, 2]])
def test_stream_and_batch_count_alike(spark, arrivals):
    orders = spark.createDataFrame([("X", i, f"o{i}", 50.0, q, 0) for i, q in enumerate((5, 0, -5))], ORDER)
    assert [r.arrival for r in match_orders(orders).prints.collect()] == arrivals[-1:]
    assert sorted(r.arrival for r in with_arrival(orders).collect()) == arrivals
