"""Cases that equal keys, NULLs and NaN bring up: scans, sweeps, ids, resting."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crossbook.functions.scan import running_last, running_next, running_sums
from crossbook.operators import book as B
from crossbook.operators import prices as P
from crossbook.operators import sweep as S
from crossbook.operators import trades as T
from crossbook.plans.match import MatchResult, match_orders
from crossbook.streaming.matcher import match_stream
from crossbook.streaming.pipelines import HeartbeatProcessor, drain, use_rocksdb

BIG = 1733270400123456789
ORDER = "symbol string, seq bigint, order_id string, price double, quantity bigint, timestamp bigint"


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("batch", ["10000", "37"])
def test_split_and_window_scans_are_equal(spark, batch):
    rng = random.Random(4)
    rows = [(None if i % 5 == 0 else "hot" if i % 3 else f"k{i % 11}", rng.choice([None, 1.0, float("nan")]), i,
             rng.choice([None, BIG + i, -i]), rng.choice([None, float("nan"), 0.5 * i]), BIG + i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, p double, o bigint, v bigint, d double, t bigint")
    for keys in (["k"], ["k", "p"]):
        values = {"a": "v", "b": "d", "c": "t"}
        for scan in (running_last, running_next):
            assert same(scan(df, keys, ["o"], values, 8, "window"), scan(df, keys, ["o"], values, 8, "split"))
        small = df.withColumn("v", F.col("v") % 1000003)
        assert same(running_sums(small, keys, ["o"], {"a": "v"}, 8, "window"),
                    running_sums(small, keys, ["o"], {"a": "v"}, 8, "split"))
    w = Window.partitionBy("k").orderBy("o")
    assert same(running_next(df, ["k"], ["o"], {"n": "t"}, 8, "split"), df.withColumn("n", F.lead("t").over(w)))


def test_sweep_with_repeated_seq(spark):
    book = match_orders(spark.createDataFrame(
        [("S", 1, "m1", 10.0, -5, 0), ("S", 2, "m2", 10.0, -9, 0)], ORDER)).book
    takers = spark.createDataFrame([("S", 7, "a", 10.0, 4, 0), ("S", 7, "b", 10.0, 6, 0), ("S", 7, "b", 10.0, 6, 0)],
                                   ORDER)
    got = sorted(tuple(r) for r in S.sweep_book(takers, book).select("taker_order_id", "maker_order_id", "quantity").collect())
    assert got == [("a", "m1", 4)] + [("b", "m1", 5)] * 2 + [("b", "m2", 1)] * 2


def test_zero_quantity_never_crosses(spark):
    top = spark.createDataFrame([("S", 9.0, 11.0)], "symbol string, best_bid double, best_ask double")
    orders = spark.createDataFrame([("S", 1, "z", 1.0, 0, 0), ("S", 2, "s", 9.0, -1, 0), ("S", 3, "b", 11.0, 1, 0)], ORDER)
    assert {r.order_id for r in S.crossing_orders(orders, top).collect()} == {"s", "b"}


def test_trade_ids_of_takers_with_one_seq(spark):
    orders = spark.createDataFrame([(None, 1, "s", 10.0, -10, 0), (None, 2, "b1", 10.0, 4, 0), (None, 2, "b2", 10.0, 6, 0)],
                                   ORDER)
    pairs = T.pair_legs(T.trade_legs(match_orders(orders).fills)).collect()
    assert sorted((r.buy_order_id, r.quantity, r.legs) for r in pairs) == [("b1", 4, 2), ("b2", 6, 2)]


def test_resting_null_price_and_symbol(spark):
    orders = spark.createDataFrame([(None, 1, "a", None, 5, 0), (None, 2, "b", 0.0, 5, 0), ("X", 3, "c", 1.0, -5, 0)], ORDER)
    for priority in ("best_price", "first_seen"):
        got = sorted((r.order_id, r.symbol, r.price, r.queue_pos) for r in B.rest_orders(orders, priority).collect())
        assert got == [("a", None, 0.0, 0), ("b", None, 0.0, 1), ("c", "X", 1.0, 0)]


def test_prices_of_a_taker_with_many_fills(spark):
    fills = spark.createDataFrame([("S", seq, i, 50.0 + i, 0) for seq in (1, 2) for i in range(1200)],
                                  "symbol string, taker_seq bigint, fill_idx int, price double, timestamp bigint")
    got = P.price_stream(fills)
    assert got.select("source", "taker_seq", "k").distinct().count() == got.count() == 3 * 2400
    assert got.where("source = 'trade'").agg(F.count_distinct("ord")).first()[0] == 4800


def test_grids_are_exploded_in_runs(spark):
    df = spark.createDataFrame([(0, 10000), (5, 5), (7, 6), (3, None)], "a bigint, b bigint")
    got = P.explode_grid(df, F.col("a"), F.col("b"), 2, "x").where("a = 0")
    assert [r.x for r in got.orderBy("x").collect()] == list(range(0, 10001, 2))
    assert P.explode_grid(df, F.col("a"), F.col("b"), 2, "x").where("a > 0").count() == 1


def test_stream_equals_batch_with_repeated_and_null_seq(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(12)]), f"o{i}", rng.choice([None, 9.0, 10.0, 11.0]), rng.choice([-7, -3, 0, 4, 8]))
            for i in range(60)]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] is not None, r[2] or 0, r[3]))
    schema = "seq bigint, order_id string, price double, quantity bigint"
    use_rocksdb(spark)
    want = match_orders(spark.createDataFrame(rows, schema)).fills
    for n in (11, 23):
        src = tmp_path / f"in{n}"
        for i in range(0, len(rows), n):  # one file for each micro-batch, in arrival order
            spark.createDataFrame(rows[i:i + n], schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").option("latestFirst", "false").parquet(str(src))
        drain(match_stream(stream), str(tmp_path / f"out{n}"), state_partitions=2)
        got = MatchResult(spark.read.parquet(str(tmp_path / f"out{n}/out"))).fills
        assert same(got, want)


class _Value:
    def update(self, v):
        self.v = v


class _Handle:
    def listTimers(self):
        return []

    def registerTimer(self, t):
        self.timer = t


class _Now:
    def getCurrentProcessingTimeInMs(self):
        return 1000


def test_heartbeat_keeps_the_last_valid_price():
    hb = HeartbeatProcessor(10)
    hb.handle, hb.last = _Handle(), _Value()
    for rows, price in (([(50.0, None), (51.0, None)], 51.0), ([(52.0, 5), (None, 9), (53.0, 4)], 52.0)):
        hb.handleInputRows(("S",), iter([{"price": p, "ts": t} for p, t in rows]), _Now())
        assert hb.last.v == (price,)
