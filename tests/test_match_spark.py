"""The batch plan: traces through Spark, many symbols at once, properties."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crossbook.operators import book as B
from crossbook.operators import sweep as S
from crossbook.operators import trades as T
from crossbook.plans.kernel import Book, RawWriter, fold_symbol
from crossbook.plans.match import match_orders
from traces import EXPECTED, TRACES, trace_rows

ORDER_SCHEMA = "symbol string, seq long, order_id string, price double, quantity long, timestamp long"


def all_traces_df(spark):
    rows = []
    for name in TRACES:
        rows += trace_rows(name, symbol=name)
    return spark.createDataFrame(rows, ORDER_SCHEMA)


@pytest.mark.parametrize("lp,res", [("best_price", "tail"), ("first_seen", "tail"), ("best_price", "head")])
def test_traces_through_spark(spark, lp, res):
    """Every trace is its own symbol; one job matches them all."""
    fills = match_orders(all_traces_df(spark), lp, res, num_partitions=3).fills
    got = {}
    for r in fills.orderBy("symbol", "taker_seq", "fill_idx").collect():
        got.setdefault(r.symbol, []).append((r.taker_order_id, r.maker_order_id, r.quantity, r.price))
    for name in TRACES:
        assert got.get(name, []) == EXPECTED[(name, lp, res)], name


def test_missing_symbol_defaults_to_x(spark):
    df = spark.createDataFrame([(s, o, p, q) for _, s, o, p, q, _ in trace_rows("G")],
                               "seq long, order_id string, price double, quantity long")
    fills = match_orders(df).fills.collect()
    assert {r.symbol for r in fills} == {"X"} and len(fills) == 2


def test_legs_and_price_points(spark):
    fills = match_orders(all_traces_df(spark)).fills
    legs = T.execution_legs(fills)
    per_trade = legs.groupBy("trade_id").agg(F.count("*").alias("n"),
                                             F.countDistinct("action").alias("actions"))
    assert per_trade.where("n != 2 or actions != 2").count() == 0
    assert T.price_points(fills).count() == fills.count()
    g = legs.where("symbol = 'G'").orderBy("taker_seq", "fill_idx", "leg").collect()
    assert [(r.order_id, r.action, r.status) for r in g] == [
        ("b2", "BUY", "closed"), ("s1", "SELL", "partial"),
        ("b3", "BUY", "partial"), ("s1", "SELL", "closed")]


def test_price_ladders(spark):
    """The six-price list drains ascending and descending."""
    rows = [("X", i, f"o{i}", float(p), 5 if side == "b" else -5, 0)
            for i, (p, side) in enumerate([(p, s) for s in "bs" for p in (2, 1, 5, 0, 6, 7)])]
    book = B.rest_orders(spark.createDataFrame(rows, ORDER_SCHEMA))
    asks = [r.price for r in B.ask_ladder(book).collect()]
    bids = [r.price for r in B.bid_ladder(book).collect()]
    assert asks == [0, 1, 2, 5, 6, 7] and bids == [7, 6, 5, 2, 1, 0]
    top = B.top_levels(book, 1).orderBy("side").collect()
    assert [(r.side, r.price) for r in top] == [("BUY", 7.0), ("SELL", 0.0)]


def test_rest_orders_allows_locked_book(spark):
    df = spark.createDataFrame([("X", 0, "b", 10.0, 20, 0), ("X", 1, "s", 10.0, -20, 0)], ORDER_SCHEMA)
    rows = {(r.side, r.price, r.remaining) for r in B.rest_orders(df).collect()}
    assert rows == {("BUY", 10.0, 20), ("SELL", 10.0, -20)}


def _random_log(rng, n, symbols=3):
    return [(f"S{rng.randrange(symbols)}", i, f"o{i}", float(rng.randint(45, 52)),
             rng.choice([-1, 1]) * rng.randint(1, 30), i) for i in range(n)]


def _kernel_fills(rows, lp="best_price", res="tail"):
    out = []
    for sym in sorted({r[0] for r in rows}):
        book, w = Book(lp, res), RawWriter()
        fold_symbol(book, sym, [(s, o, p, q, t) for (y, s, o, p, q, t) in rows if y == sym], w)
        c = w.take()
        out += [(sym, c["seq"][i], c["fill_idx"][i], c["maker_order_id"][i], c["quantity"][i], c["price"][i])
                for i in range(len(c["kind"])) if c["kind"][i] == "fill"]
    return sorted(out)


@pytest.mark.parametrize("lp", ["best_price", "first_seen"])
def test_spark_equals_kernel_on_random_logs(spark, lp):
    rows = _random_log(random.Random(7), 400, symbols=5)
    fills = match_orders(spark.createDataFrame(rows, ORDER_SCHEMA), lp, num_partitions=4).fills
    got = sorted((r.symbol, r.taker_seq, r.fill_idx, r.maker_order_id, r.quantity, r.price)
                 for r in fills.collect())
    assert got == _kernel_fills(rows, lp)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(45, 50), st.integers(-20, 20)), min_size=1, max_size=60),
       st.sampled_from(["best_price", "first_seen"]), st.sampled_from(["tail", "head"]))
def test_kernel_properties(orders, lp, res):
    """Quantity is conserved, fills respect both limits, two sides per fill,
    filled + remaining never exceeds the original, and a best_price book
    is never left crossed."""
    book, w = Book(lp, res), RawWriter()
    rows = [(i, f"o{i}", float(p), q, i) for i, (p, q) in enumerate(orders)]
    fold_symbol(book, "X", rows, w)
    c = w.take()
    by_id = {f"o{i}": (float(p), q) for i, (p, q) in enumerate(orders)}
    filled = {}
    for i in range(len(c["kind"])):
        taker, maker, qty, price = c["order_id"][i], c["maker_order_id"][i], c["quantity"][i], c["price"][i]
        tp, tq = by_id[taker]
        mp, mq = by_id[maker]
        assert qty > 0 and (tq > 0) != (mq > 0)
        assert price == mp
        assert (tp >= price) if tq > 0 else (tp <= price)
        filled[taker] = filled.get(taker, 0) + qty
        filled[maker] = filled.get(maker, 0) + qty
    resting = {}
    for side, price, _l, _p, oid, _s, rem, _t in book.snapshot():
        if oid is not None:
            resting[oid] = rem
    for oid, (_, q) in by_id.items():
        assert filled.get(oid, 0) + resting.get(oid, 0) <= abs(q)
        if lp == "best_price":
            assert filled.get(oid, 0) + resting.get(oid, 0) == abs(q) or q == 0
    if lp == "best_price":
        bid, ask = book.top()
        assert bid is None or ask is None or bid < ask


def test_sweep_equals_brute_force(spark):
    _check_sweep(spark)


def test_sweep_split_path_equals_brute_force(spark):
    """Force the hot-key path (every symbol counts as hot)."""
    from crossbook.functions.scan import MIN_HOT_ROWS_CONF
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(MIN_HOT_ROWS_CONF, "1")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        _check_sweep(spark)
    finally:
        spark.conf.unset(MIN_HOT_ROWS_CONF)
        spark.conf.set("spark.sql.shuffle.partitions", old)


def _check_sweep(spark):
    rng = random.Random(3)
    rows = _random_log(rng, 300, symbols=4)
    orders = spark.createDataFrame(rows, ORDER_SCHEMA)
    book_df = B.rest_orders(orders.where("seq < 200"))
    book_df = book_df.withColumn("remaining", F.abs("remaining"))
    takers = orders.where("seq >= 200")
    got = sorted((r.taker_seq, r.maker_order_id, r.quantity) for r in S.sweep_book(takers, book_df).collect())
    makers = {}
    for r in book_df.collect():
        makers.setdefault((r.symbol, r.side), []).append(r)
    expect = []
    for sym, seq, oid, p, q, _ in rows[200:]:
        if q == 0:
            continue
        side = "SELL" if q > 0 else "BUY"
        ms = sorted(makers.get((sym, side), []), key=lambda m: (m.level_seq, m.queue_pos))
        before = 0
        for m in ms:
            crosses = m.price <= p if q > 0 else m.price >= p
            if crosses and before < abs(q):
                expect.append((seq, m.order_id, min(m.remaining, abs(q) - before)))
            before += m.remaining
    assert got == sorted(expect)


def test_match_to_tables_round_trip(spark, tmp_path):
    from crossbook.plans.jobs import match_to_tables
    df = all_traces_df(spark)
    written = match_to_tables(df, str(tmp_path / "m"), emit_top=True)
    direct = match_orders(df, emit_top=True)
    for view in ("fills", "book", "tops"):
        a, b = getattr(written, view), getattr(direct, view)
        assert a.exceptAll(b.select(*a.columns)).count() == 0
        assert b.select(*a.columns).exceptAll(a).count() == 0


@pytest.mark.parametrize("lp,res", [("best_price", "tail"), ("first_seen", "tail"), ("best_price", "head")])
def test_fold_order_states_equal_join_form(spark, lp, res):
    rows = _random_log(random.Random(17), 500, symbols=4)
    rows += [("S0", 10_000, "zero", 47.0, 0, 10_000)]
    orders = spark.createDataFrame(rows, ORDER_SCHEMA)
    res_ = match_orders(orders, lp, res, emit_orders=True)
    from_fold = res_.order_states
    joined = T.order_fill_state(orders, res_.fills).select(*from_fold.columns)
    assert from_fold.count() == len(rows)
    assert from_fold.exceptAll(joined).count() == 0 and joined.exceptAll(from_fold).count() == 0


def test_assume_clustered_skips_the_shuffle(spark):
    orders = spark.createDataFrame(_random_log(random.Random(5), 300, symbols=6), ORDER_SCHEMA)
    clustered = orders.repartition(4, "symbol")
    res = match_orders(clustered, assume_clustered=True)
    plan = res.raw._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # only the caller's own repartition
    a, b = res.fills, match_orders(orders).fills
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_result_independent_of_partitioning_even_with_repeated_seq(spark):
    rng = random.Random(41)
    rows = [(f"S{rng.randrange(5)}", rng.randrange(60), f"o{i}", float(rng.randint(45, 50)),
             rng.choice([-1, 1]) * rng.randint(1, 20), i) for i in range(400)]
    orders = spark.createDataFrame(rows, ORDER_SCHEMA)
    runs = [match_orders(orders.repartition(k), num_partitions=n).fills
            for k, n in ((1, 3), (5, 7), (9, 2))]
    for other in runs[1:]:
        assert runs[0].exceptAll(other).count() == 0 and other.exceptAll(runs[0]).count() == 0


@pytest.mark.parametrize("sf,orders_n,fills_n,qty", [("0.01", 10_000, 6_716, 87_712),
                                                     ("0.1", 100_000, 67_306, 878_228)])
def test_fixture_totals(spark, sf, orders_n, fills_n, qty):
    """Headline totals of the events adapter under best_price + tail."""
    from crossbook.sources.fixtures import events_orders
    o = events_orders(spark, f"/root/testdata/sf{sf}")
    r = match_orders(o).fills.agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("q")).first()
    assert (o.count(), r["n"], r["q"]) == (orders_n, fills_n, qty)


def test_bucketed_table_needs_no_shuffle(spark, tmp_path):
    orders = spark.createDataFrame(_random_log(random.Random(8), 300, symbols=7), ORDER_SCHEMA)
    orders.write.bucketBy(4, "symbol").option("path", str(tmp_path / "t")).saveAsTable("orders_bucketed")
    key = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    spark.conf.set(key, "false")
    try:
        t = spark.table("orders_bucketed")
        assert t.rdd.getNumPartitions() == 4
        res = match_orders(t, assume_clustered=True)
        assert "Exchange" not in res.raw._jdf.queryExecution().executedPlan().toString()
        a, b = res.fills, match_orders(orders).fills
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    finally:
        spark.conf.unset(key)
        spark.sql("DROP TABLE IF EXISTS orders_bucketed")


def test_kinds_that_are_not_wanted_are_not_built(spark):
    rows = [("A", i, f"o{i}", 50.0, 1 if i % 3 else -2, None) for i in range(200)]
    orders = spark.createDataFrame(rows, "symbol string, seq long, order_id string, price double, "
                                         "quantity long, timestamp long")
    whole = match_orders(orders, emit_orders=True, emit_top=True)
    bare = match_orders(orders, emit_orders=True, emit_top=True, emit_fills=False, emit_book=False)
    kinds = {r["kind"] for r in bare.raw.select("kind").distinct().collect()}
    assert kinds == {"order", "top"}
    for view in ("order_states", "tops"):
        assert getattr(whole, view).exceptAll(getattr(bare, view)).isEmpty()


def test_output_batches_are_bounded(monkeypatch):
    """One symbol with many resting orders leaves in slices, whole and in order."""
    import pyarrow as pa

    from crossbook.plans import match as M

    monkeypatch.setattr(M, "OUTPUT_BATCH_ROWS", 64)
    n = 1000
    batch = pa.record_batch({"symbol": ["A"] * n, "seq": list(range(n)), "order_id": [f"o{i}" for i in range(n)],
                             "price": [10.0] * n, "quantity": [5] * n, "timestamp": pa.nulls(n, pa.int64())})
    out = list(M.fold_batches([batch], emit_orders=True))
    assert max(b.num_rows for b in out) <= 64
    rows = pa.Table.from_batches(out).to_pylist()
    assert [r["order_id"] for r in rows if r["kind"] == "rest"] == [f"o{i}" for i in range(n)]
    assert len([r for r in rows if r["kind"] == "order"]) == n
