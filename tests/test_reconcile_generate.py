"""Keyed diffs, topic config, generators, scalar helpers."""

from pyspark.sql import functions as F

from crossbook.functions import columns as C
from crossbook.operators import generate as G
from crossbook.operators import reconcile as R


def test_reconcile_table(spark):
    declared = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "topic string, partitions int")
    actual = spark.createDataFrame([("a", 1), ("b", 1), ("d", 1)], "topic string, partitions int")
    got = sorted((r.topic, r.step, r.action, r.partitions)
                 for r in R.reconcile_diff(declared, actual).collect())
    assert got == [("a", 0, "READ", None), ("b", 0, "DELETE", None), ("b", 1, "CREATE", 2),
                   ("c", 0, "CREATE", 1), ("d", 0, "DELETE", None)]
    sets = {(r.topic, r.membership) for r in R.key_set_diff(declared, actual).collect()}
    assert sets == {("c", "declared_only"), ("d", "actual_only"), ("a", "both"), ("b", "both")}


def test_topics_yaml(spark):
    text = """
topics:
  - orders.topic:
      partition: 1
  - trades.topic:
      partition: 1
  - order.last_price.topic:
      partition: 1
"""
    rows = sorted(tuple(r) for r in R.topics_from_yaml(spark, text).collect())
    assert rows == [("order.last_price.topic", 1), ("orders.topic", 1), ("trades.topic", 1)]


def test_seed_pair(spark):
    syms = spark.createDataFrame([("X", 5)], "symbol string, timestamp long")
    rows = sorted((r.price, r.quantity, r.timestamp, r.seq) for r in G.seed_orders(syms).collect())
    assert rows == [(49.5, 100, 5, -2), (50.5, -100, 5, -1)]


def test_generators_ranges(spark):
    ids = spark.range(2000).select(F.lit("X").alias("symbol"), F.col("id").alias("event_id"),
                                   F.lit(0).cast("long").alias("timestamp"))
    o = G.random_orders(ids).agg(F.min("price"), F.max("price"), F.min("quantity"), F.max("quantity"),
                                 F.sum((F.col("quantity") == 0).cast("int"))).first()
    assert (o[0], o[1]) == (45.0, 60.0) and o[2] >= -50 and o[3] <= 50 and o[4] == 0
    t = G.random_trades(ids)
    agg = t.agg(F.min("quantity"), F.max("quantity"), F.min("price"), F.max("price"),
                F.countDistinct("trade_id")).first()
    assert 10 <= agg[0] and agg[1] <= 50 and 40.0 <= agg[2] and agg[3] <= 45.0 and agg[4] == 2000
    prices = ids.select("symbol", F.col("event_id").alias("price_id"), F.lit(50.0).alias("price"),
                        "timestamp")
    g = G.orders_from_prices(prices)
    stats = g.select(F.abs("quantity").alias("m"), "quantity", "price").agg(
        F.min("m"), F.max("m"), F.sum((F.col("quantity") > 0).cast("int")),
        F.min(F.when(F.col("quantity") > 0, F.col("price"))),
        F.max(F.when(F.col("quantity") < 0, F.col("price")))).first()
    assert stats[0] >= 10 and stats[1] <= 39 and 800 < stats[2] < 1200
    assert stats[3] >= 50.5 and stats[4] <= 49.5


def test_scalar_helpers(spark):
    df = spark.createDataFrame([(1700000000,), (1700000000000,), (1700000000000000,),
                                (1700000000000000000,)], "v long")
    got = {r[0] for r in df.select(F.unix_micros(C.normalize_epoch(F.col("v")))).collect()}
    assert got == {1700000000000000}
    r = spark.createDataFrame([(" buy ", "PARTIAL", "", 3)], "a string, s string, e string, n long").select(
        C.normalize_action(F.col("a")), C.normalize_status(F.col("s")), C.fallback(F.col("e"), "dflt"),
        C.trader_id(F.col("n")), C.zero_to_one(F.lit(0))).first()
    assert tuple(r) == ("BUY", "partial", "dflt", "Trader-3", 1)


def test_config_entries(spark):
    kv = spark.createDataFrame([("OB__KAFKA__BOOTSTRAP", "b:9092"), ("OB__TASK__POLL_SIZE", "32"),
                                ("OB__BROKEN", "x"), ("OB__A__B__C", "y"), ("XX__KAFKA__GROUP", "g")],
                               "key string, value string")
    got = sorted(tuple(r) for r in C.config_entries(kv, prefix="OB").collect())
    assert got == [("kafka", "bootstrap", "b:9092"), ("task", "poll_size", "32")]
    assert len(C.config_entries(kv).collect()) == 3


def test_declared_topics_of_a_yaml_file_are_reconciled(spark):
    """SRC-6 feeds JN-3: the file's topics against those that exist."""
    declared = R.topics_from_yaml(spark, """
topics:
  - orders.topic: {partition: 3}
  - trades.topic: {partition: 1}
  - new.topic: {}
""")
    actual = spark.createDataFrame([("orders.topic", 1), ("trades.topic", 1), ("old.topic", 2)],
                                   "topic string, partitions int")
    got = sorted(((r.topic, r.step, r.action, r.partitions) for r in R.reconcile_diff(declared, actual).collect()),
                 key=lambda r: r[:2])
    assert got == [("new.topic", 0, "CREATE", 1), ("old.topic", 0, "DELETE", None), ("orders.topic", 0, "DELETE", None),
                   ("orders.topic", 1, "CREATE", 3), ("trades.topic", 0, "READ", None)]
