"""The reduced match equals the plain one, and says what it left in the fold."""

import random

import pytest
from pyspark.sql import functions as F

from crossbook.plans.match import match_orders
from crossbook.plans.reduce import fold_load_reduced, mark_inert, match_orders_reduced

ORDER = "symbol string, seq bigint, order_id string, price double, quantity bigint, timestamp bigint"


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def log(n, spread, seed=1):
    """Buys around 50 - spread, sells around 50 + spread; some odd rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        side = rng.choice((-1, 1))
        price = round(50 - side * spread + rng.gauss(0, 3), 0)
        rows.append((rng.choice(("A", "A", "A", "B", None)), i // 2, f"o{i}", price, side * rng.randint(1, 20), i))
    rows += [("A", n, "zero", 50.0, 0, n), ("A", n, "noprice", None, 3, n), ("B", n, "noqty", 40.0, None, n),
             ("C", 1, "alone", 10.0, 5, 1), ("C", 2, "alone", 10.0, 5, 1), ("C", 2, "alone", 10.0, 5, 1),
             ("D", 1, "s", 3.0, -5, 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("residual", ["tail", "head"])
@pytest.mark.parametrize("spread", [0, 3, 8])
def test_equal_to_the_plain_fold(spark, residual, spread):
    orders = spark.createDataFrame(log(600, spread), ORDER).repartition(3)
    plain = match_orders(orders, residual=residual, emit_orders=True).checkpoint()
    got = match_orders_reduced(orders, residual, min_orders=1, emit_orders=True)
    assert same(got.fills, plain.fills) and same(got.book, plain.book)
    assert same(got.order_states, plain.order_states)


def test_nan_prices_stay_in_the_fold(spark):
    rows = [("X", 1, "a", 10.0, 5, 0), ("X", 2, "b", 90.0, -5, 0), ("X", 3, "c", float("nan"), -2, 0)]
    marked = {r.order_id: r.inert for r in mark_inert(spark.createDataFrame(rows, ORDER), 1).collect()}
    assert marked == {"a": False, "b": True, "c": False}


def test_share_left_in_the_fold(spark):
    wide = spark.createDataFrame(log(600, 8), ORDER)
    row = fold_load_reduced(wide, 1).first()
    marked = mark_inert(wide, 1)
    assert row.orders == marked.count() and row.in_fold == marked.where(~F.col("inert")).count()
    assert row.fold_share < 0.6
    # by default only symbols that fill a partition of the fold are reduced
    default = mark_inert(wide, num_partitions=2).where("inert").select("symbol").distinct().collect()
    assert [r.symbol for r in default] == ["A"]
    none = match_orders_reduced(wide.where("false"), min_orders=1)
    assert none.fills.count() == 0 and none.book.count() == 0
