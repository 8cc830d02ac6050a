"""Named queries over the fixture tables: ``name -> fn(spark, sf_dir) -> DataFrame``.

Each query reads whole tables (or data Spark derives from them). The events
adapter supplies orders; the matching fold runs once per query that needs
it (queries are independent jobs).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossbook.functions import columns as C
from crossbook.operators import book as B
from crossbook.operators import generate as G
from crossbook.operators import reconcile as R
from crossbook.operators import sweep as S
from crossbook.operators import prices as P
from crossbook.operators import trades as T
from crossbook.plans.match import fold_load, match_orders, with_arrival
from crossbook.plans.reduce import fold_load_reduced, match_orders_reduced
from crossbook.sources import ingest as I
from crossbook.sources.contracts import CONTRACTS, validate_records, validate_schema
from crossbook.sources import topics as TP
from crossbook.sources.fixtures import (LINEITEM_TIEBREAK, epoch_micros, events_orders, lineitem_orders,
                                        order_messages, order_topic, read_table)

# The fixture spans 30 days: sample and gap-fill by the hour there.
FIXTURE_TICK_US = P.HOUR_US

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(name: str):
    def register(fn: Query) -> Query:
        _REGISTRY[name] = fn
        return fn
    return register


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


def _match(spark, sf_dir, **kw):
    return match_orders(events_orders(spark, sf_dir), **kw)


def _fills(spark, sf_dir, **kw):
    return _match(spark, sf_dir, emit_book=False, **kw).fills


def _book(spark, sf_dir, **kw):
    return _match(spark, sf_dir, emit_fills=False, **kw).book


# ---------------------------------------------------------------- matching
@query("match_orders")
def q_match_orders(spark, sf_dir):
    return _fills(spark, sf_dir)


@query("match_orders_first_seen")
def q_match_orders_first_seen(spark, sf_dir):
    return _fills(spark, sf_dir, level_priority="first_seen")


@query("match_orders_head")
def q_match_orders_head(spark, sf_dir):
    return _fills(spark, sf_dir, residual="head")


@query("match_lineitem")
def q_match_lineitem(spark, sf_dir):
    """STR-1 on every lineitem row as an order, one symbol per part; seq
    repeats there and the other columns break ties."""
    fills = match_orders(lineitem_orders(spark, sf_dir), tiebreak=LINEITEM_TIEBREAK, emit_book=False).fills
    return fills.select("symbol", "taker_order_id", "maker_order_id", "fill_idx", "taker_side", "price",
                        "quantity", "taker_remaining", "maker_remaining")


@query("book_snapshot")
def q_book_snapshot(spark, sf_dir):
    return _book(spark, sf_dir)


@query("book_snapshot_first_seen")
def q_book_snapshot_first_seen(spark, sf_dir):
    return _book(spark, sf_dir, level_priority="first_seen")


@query("rest_orders")
def q_rest_orders(spark, sf_dir):
    return B.rest_orders(events_orders(spark, sf_dir))


# ---------------------------------------------------------------- trades
@query("trade_legs")
def q_trade_legs(spark, sf_dir):
    return T.trade_legs(_fills(spark, sf_dir))


@query("execution_legs")
def q_execution_legs(spark, sf_dir):
    return T.execution_legs(_fills(spark, sf_dir))


@query("pair_legs")
def q_pair_legs(spark, sf_dir):
    return T.pair_legs(T.trade_legs(_fills(spark, sf_dir)))


@query("price_points")
def q_price_points(spark, sf_dir):
    return T.price_points(_fills(spark, sf_dir))


@query("order_fill_state")
def q_order_fill_state(spark, sf_dir):
    # final order states come out of the fold: no join with the order table
    return match_orders(events_orders(spark, sf_dir), emit_orders=True, emit_fills=False,
                        emit_book=False).order_states


@query("running_remaining")
def q_running_remaining(spark, sf_dir):
    return T.running_remaining(_fills(spark, sf_dir))


# ---------------------------------------------------------------- book
@query("best_bid")
def q_best_bid(spark, sf_dir):
    return B.best_bid(_book(spark, sf_dir))


@query("best_ask")
def q_best_ask(spark, sf_dir):
    return B.best_ask(_book(spark, sf_dir))


@query("mid_price")
def q_mid_price(spark, sf_dir):
    return B.mid_price(_book(spark, sf_dir))


@query("two_sided_books")
def q_two_sided_books(spark, sf_dir):
    return B.two_sided_books(_book(spark, sf_dir))


@query("level_count")
def q_level_count(spark, sf_dir):
    return B.level_count(_book(spark, sf_dir, level_priority="first_seen"))


@query("volume_at_price")
def q_volume_at_price(spark, sf_dir):
    return B.volume_at_price(_book(spark, sf_dir))


@query("level_queues")
def q_level_queues(spark, sf_dir):
    return B.level_queues(_book(spark, sf_dir))


def _checkpointed_book(spark, sf_dir):
    """Book scans measure their input before computing: fold once."""
    return _match(spark, sf_dir, emit_fills=False).checkpoint().book


@query("queue_position")
def q_queue_position(spark, sf_dir):
    return B.queue_position(_book(spark, sf_dir))


@query("match_priority")
def q_match_priority(spark, sf_dir):
    return B.match_priority(_checkpointed_book(spark, sf_dir))


@query("book_depth")
def q_book_depth(spark, sf_dir):
    return B.book_depth(_checkpointed_book(spark, sf_dir))


@query("ask_ladder")
def q_ask_ladder(spark, sf_dir):
    return B.ask_ladder(_checkpointed_book(spark, sf_dir))


@query("bid_ladder")
def q_bid_ladder(spark, sf_dir):
    return B.bid_ladder(_checkpointed_book(spark, sf_dir))


@query("top_levels")
def q_top_levels(spark, sf_dir):
    return B.top_levels(_book(spark, sf_dir), k=3)


@query("queue_cut")
def q_queue_cut(spark, sf_dir):
    return B.queue_cut(_book(spark, sf_dir), index=0)


@query("queue_removed")
def q_queue_removed(spark, sf_dir):
    return B.queue_removed(_book(spark, sf_dir), index=1)


# pages of two orders: the fixture's levels hold a few orders each
FIXTURE_PAGE = 2


def _entries_text(pages):
    return pages.withColumn("entries", F.array_join(F.transform(
        "entries", lambda e: F.concat_ws(":", e["order_id"], e["remaining"].cast("string"))), ","))


@query("level_pages")
def q_level_pages(spark, sf_dir):
    """AGG-3: the queues as arrays, a page at a time."""
    return _entries_text(B.level_pages(_book(spark, sf_dir), FIXTURE_PAGE))


@query("level_pages_cut")
def q_level_pages_cut(spark, sf_dir):
    """SRT-4: the third order leaves every queue, at the edge of its second page."""
    return _entries_text(B.page_cut(B.level_pages(_book(spark, sf_dir), FIXTURE_PAGE), 2))


@query("fold_load")
def q_fold_load(spark, sf_dir):
    return fold_load(lineitem_orders(spark, sf_dir))


def _reduced(spark, sf_dir):
    return match_orders_reduced(lineitem_orders(spark, sf_dir), tiebreak=LINEITEM_TIEBREAK, min_orders=2)


@query("match_reduced")
def q_match_reduced(spark, sf_dir):
    """STR-1 with the orders that can never trade kept out of the fold."""
    return _reduced(spark, sf_dir).fills.select(
        "symbol", "taker_order_id", "maker_order_id", "fill_idx", "taker_side", "price", "quantity",
        "taker_remaining", "maker_remaining")


@query("book_reduced")
def q_book_reduced(spark, sf_dir):
    return _reduced(spark, sf_dir).book.drop("seq")


@query("fold_load_reduced")
def q_fold_load_reduced(spark, sf_dir):
    return fold_load_reduced(lineitem_orders(spark, sf_dir), min_orders=2)


# ---------------------------------------------------------------- prices
@query("price_stream")
def q_price_stream(spark, sf_dir):
    orders = events_orders(spark, sf_dir)
    return P.price_stream(match_orders(orders, emit_book=False).prints, probe=orders.select("symbol"))


@query("last_price")
def q_last_price(spark, sf_dir):
    orders = events_orders(spark, sf_dir)
    return P.last_price(orders, T.price_points(match_orders(orders, emit_book=False).fills))


@query("last_price_lineitem")
def q_last_price_lineitem(spark, sf_dir):
    """WIN-4 on every lineitem row as an order: seq repeats there, and an order
    sees the prints of earlier orders with its own seq."""
    orders = lineitem_orders(spark, sf_dir)
    prints = match_orders(orders, tiebreak=LINEITEM_TIEBREAK, emit_book=False).prints
    return P.last_price(with_arrival(orders, LINEITEM_TIEBREAK), T.price_points(prints)).drop("seq")


@query("top_of_book")
def q_top_of_book(spark, sf_dir):
    return _match(spark, sf_dir, emit_top=True, emit_fills=False, emit_book=False).tops


@query("mid_ticks")
def q_mid_ticks(spark, sf_dir):
    # tops are read for bounds, changes and the hot-key probe: fold once
    res = _match(spark, sf_dir, emit_top=True, emit_fills=False, emit_book=False).checkpoint()
    return P.mid_ticks(res.top_changes, FIXTURE_TICK_US)


@query("price_heartbeat")
def q_price_heartbeat(spark, sf_dir):
    orders = events_orders(spark, sf_dir)
    return P.price_heartbeat(T.price_points(match_orders(orders, emit_book=False).prints), FIXTURE_TICK_US,
                             probe=orders.select("symbol"))


@query("price_topic")
def q_price_topic(spark, sf_dir):
    # fills and top-of-book rows both come from one fold: checkpoint it once
    res = _match(spark, sf_dir, emit_top=True, emit_book=False).checkpoint()
    return P.price_topic(T.price_points(res.fills), P.mid_ticks(res.top_changes, FIXTURE_TICK_US))


# ---------------------------------------------------------------- orders
@query("src_orders")
def q_src_orders(spark, sf_dir):
    return events_orders(spark, sf_dir)


@query("order_side")
def q_order_side(spark, sf_dir):
    return C.with_side(events_orders(spark, sf_dir)).select(
        "symbol", "order_id", "seq", "side", "magnitude")


@query("nonzero_orders")
def q_nonzero_orders(spark, sf_dir):
    """FLT-1 on a log where every seventh order has quantity 0 (a rule of this
    query: the tables hold no such order)."""
    zeroed = F.when(F.col("seq") % 7 == 0, F.lit(0)).otherwise(F.col("quantity")).cast("bigint")
    return C.nonzero_orders(events_orders(spark, sf_dir).withColumn("quantity", zeroed))


# ---------------------------------------------------------------- records
_ORDER_FIELDS = ("order_id", "order_type", "price", "quantity", "timestamp")


@query("parse_orders")
def q_parse_orders(spark, sf_dir):
    return I.parse_orders(order_messages(spark, sf_dir)).select("source", "msg_id", *_ORDER_FIELDS)


@query("quarantine")
def q_quarantine(spark, sf_dir):
    return I.quarantine(order_messages(spark, sf_dir)).select(
        "source", "msg_id", F.length("value").cast("bigint").alias("n_chars"))


@query("ingest_counts")
def q_ingest_counts(spark, sf_dir):
    return I.ingest_counts(I.parse_records(order_messages(spark, sf_dir), "order"))


@query("validate_records")
def q_validate_records(spark, sf_dir):
    checked = validate_records(order_messages(spark, sf_dir), CONTRACTS["order"])
    return checked.select("source", "msg_id", "valid",
                          F.array_join("violations", ",").alias("violations"))


@query("parse_trades")
def q_parse_trades(spark, sf_dir):
    legs = T.trade_legs(_fills(spark, sf_dir))
    msgs = legs.select("symbol", I.to_json_value(legs, "trade").alias("value"))
    return I.parse_trades(msgs).drop("value")


@query("parse_prices")
def q_parse_prices(spark, sf_dir):
    points = T.price_points(_fills(spark, sf_dir))
    msgs = points.select("symbol", "taker_seq", "fill_idx", I.to_json_value(points, "pricepoint").alias("value"))
    return I.parse_prices(msgs).drop("value")


@query("json_round_trip")
def q_json_round_trip(spark, sf_dir):
    """PRJ-5: record -> JSON -> record is the identity, for all three records."""
    orders = events_orders(spark, sf_dir)
    fills = match_orders(orders, emit_book=False).checkpoint().fills  # read by two checks
    parts = []
    for name, df in (("order", orders), ("trade", T.trade_legs(fills)),
                     ("pricepoint", T.price_points(fills))):
        fields = list(CONTRACTS[name]["properties"])
        back = I.parse_records(df.select(*fields, I.to_json_value(df, name).alias("value")).select(
            *[F.col(f).alias(f"orig_{f}") for f in fields], "value"), name)
        same = F.lit(True)
        for f in fields:
            same = same & F.col(f).eqNullSafe(F.col(f"orig_{f}"))
        parts.append(back.agg(F.count(F.lit(1)).alias("records"),
                              F.sum((same & ~F.col("malformed")).cast("bigint")).alias("identical"))
                     .select(F.lit(name).alias("record"), "records", "identical"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("validate_schema")
def q_validate_schema(spark, sf_dir):
    """VAL-2 on the derived order, trade and price tables: schema against
    contract, plus the non-null count of every field."""
    orders = events_orders(spark, sf_dir)
    fills = match_orders(orders, emit_book=False).checkpoint().fills  # read by two checks
    out = None
    for name, df in (("order", orders), ("trade", T.trade_legs(fills)),
                     ("pricepoint", T.price_points(fills))):
        part = validate_schema(spark, df.schema, CONTRACTS[name], data=df)
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- reconcile
def _level_topics(book: DataFrame) -> DataFrame:
    return B.level_count(book).select(
        F.concat_ws(":", "symbol", "side").alias("topic"), F.col("levels").alias("partitions"))


def _declared_actual(spark, sf_dir):
    """declared: level counts of the matched books; actual: level counts of
    the same orders merely rested (no matching)."""
    orders = events_orders(spark, sf_dir)
    # levels of the rested (unmatched) book are the distinct (side, price) of the orders
    rested = orders.select("symbol", C.side(F.col("quantity")).alias("side"), "price")
    return (_level_topics(match_orders(orders, emit_fills=False).book), _level_topics(rested))


@query("reconcile_diff")
def q_reconcile_diff(spark, sf_dir):
    return R.reconcile_diff(*_declared_actual(spark, sf_dir))


@query("key_set_diff")
def q_key_set_diff(spark, sf_dir):
    return R.key_set_diff(*_declared_actual(spark, sf_dir))


# ---------------------------------------------------------------- generators
def _event_ids(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"),
                     "event_id", epoch_micros(F.col("ts")).alias("timestamp"))


def _price_updates(spark, sf_dir):
    pts = T.price_points(_fills(spark, sf_dir))
    return pts.select("symbol", (F.col("taker_seq") * 1000 + F.col("fill_idx")).alias("price_id"),
                      "price", "timestamp")


@query("orders_from_prices")
def q_orders_from_prices(spark, sf_dir):
    return G.orders_from_prices(_price_updates(spark, sf_dir))


@query("trader_order_ids")
def q_trader_order_ids(spark, sf_dir):
    """PRJ-11 on the order log: every user's trader id, and the id of each of
    the user's orders from it and the order's time in nanoseconds."""
    orders = events_orders(spark, sf_dir)
    trader = C.trader_id(F.substring("symbol", 2, 20))
    return orders.select("order_id", trader.alias("trader_id"),
                         C.trader_order_id(trader, F.col("timestamp") * 1000).alias("trader_order_id"))


@query("order_ids")
def q_order_ids(spark, sf_dir):
    gen = G.orders_from_prices(_price_updates(spark, sf_dir))
    return gen.select("symbol", "seq", "order_id")


@query("random_orders")
def q_random_orders(spark, sf_dir):
    return G.random_orders(_event_ids(spark, sf_dir))


@query("random_trades")
def q_random_trades(spark, sf_dir):
    return G.random_trades(_event_ids(spark, sf_dir))


@query("normalize_labels")
def q_normalize_labels(spark, sf_dir):
    """PRJ-10 on the trade legs with their labels written in other cases and
    with blanks (a rule of this query, by the taker's seq)."""
    odd = F.col("taker_seq") % 2 == 1
    legs = T.execution_legs(_fills(spark, sf_dir)).select(
        "trade_id", "order_id",
        F.when(odd, F.concat(F.lit(" "), F.lower("action"))).otherwise(F.initcap("action")).alias("action"),
        F.when(odd, F.concat(F.upper("status"), F.lit(" "))).otherwise(F.initcap("status")).alias("status"))
    return legs.select("trade_id", "order_id", C.normalize_action(F.col("action")).alias("action"),
                       C.normalize_status(F.col("status")).alias("status"))


def _seeds(orders):
    return G.seed_orders(orders.groupBy("symbol").agg(F.min("timestamp").alias("timestamp")))


@query("seed_orders")
def q_seed_orders(spark, sf_dir):
    return _seeds(events_orders(spark, sf_dir))


@query("seeded_match")
def q_seeded_match(spark, sf_dir):
    orders = events_orders(spark, sf_dir)
    return match_orders(_seeds(orders).unionByName(orders), emit_book=False).fills


@query("normalize_epoch")
def q_normalize_epoch(spark, sf_dir):
    """PRJ-9: the same instants written in s, ms, µs and ns all normalise to
    one timestamp (whole seconds for the s column)."""
    us = epoch_micros(F.col("ts"))
    ev = read_table(spark, sf_dir, "events").select("event_id", us.alias("us"))
    units = F.array(
        F.struct(F.lit("s").alias("unit"), F.floor(F.col("us") / 1_000_000).cast("bigint").alias("v")),
        F.struct(F.lit("ms").alias("unit"), F.floor(F.col("us") / 1000).cast("bigint").alias("v")),
        F.struct(F.lit("us").alias("unit"), F.col("us").alias("v")),
        F.struct(F.lit("ns").alias("unit"), (F.col("us") * 1000).alias("v")))
    return (ev.select("event_id", F.explode(units).alias("u"))
            .select("event_id", "u.unit", F.col("u.v").alias("raw"),
                    F.unix_micros(C.normalize_epoch(F.col("u.v"))).alias("micros")))


# ---------------------------------------------------------------- sweeps
@query("sweep_book")
def q_sweep_book(spark, sf_dir):
    orders = events_orders(spark, sf_dir)
    return S.sweep_book(orders, match_orders(orders, emit_fills=False).book)


@query("crossing_orders")
def q_crossing_orders(spark, sf_dir):
    orders = events_orders(spark, sf_dir)
    return S.crossing_orders(orders, B.mid_price(match_orders(orders, emit_fills=False).book))


# ---------------------------------------------------------------- topics
@query("topic_dump")
def q_topic_dump(spark, sf_dir):
    orders = events_orders(spark, sf_dir)
    records = orders.select("seq", "timestamp", I.to_json_value(orders, "order").alias("value"))
    return TP.topic_dump(records, offset=0)


@query("sink_orders_json")
def q_sink_orders_json(spark, sf_dir):
    return TP.as_topic_rows(C.nonzero_orders(events_orders(spark, sf_dir)), "order", "symbol")


@query("sink_trades_json")
def q_sink_trades_json(spark, sf_dir):
    return TP.as_topic_rows(T.trade_legs(_fills(spark, sf_dir)), "trade", "trade_id")


@query("sink_prices_json")
def q_sink_prices_json(spark, sf_dir):
    """SNK-2: fill prices and sampled mids published on one price topic."""
    res = _match(spark, sf_dir, emit_top=True, emit_book=False).checkpoint()
    topic = P.price_topic(T.price_points(res.fills), P.mid_ticks(res.top_changes, FIXTURE_TICK_US))
    return TP.as_topic_rows(topic, "pricepoint", "symbol")


@query("topic_dump_partitions")
def q_topic_dump_partitions(spark, sf_dir):
    """SRC-4 from an offset of its own per partition: the log in four
    partitions by user, the second and third not from their first message on."""
    orders = events_orders(spark, sf_dir)
    records = orders.select(
        F.pmod(F.substring("symbol", 2, 20).cast("bigint"), F.lit(4)).cast("int").alias("partition"),
        "seq", "timestamp", I.to_json_value(orders, "order").alias("value"))
    return TP.topic_dump(records, {0: 0, 1: 300, 2: 500, 3: 0})


def _orders_published(spark, sf_dir, name, orders=None):
    """The order log as a segment topic of four partitions by user; its path."""
    from crossbook.sources.segments import publish
    from crossbook.streaming.pipelines import stream_folder
    orders = events_orders(spark, sf_dir) if orders is None else orders
    path = f"{stream_folder(spark, name)}/log"
    path = path if ":/" in path else f"file://{path}"
    publish(orders.select(
        F.lit(TP.ORDERS_TOPIC).alias("topic"), F.pmod(F.substring("symbol", 2, 20).cast("bigint"), F.lit(4)).alias("partition"),
        F.col("symbol").alias("key"), I.to_json_value(orders, "order").alias("value"), "timestamp", "seq"), path, order=("seq",))
    return path


@query("topic_segments_dump")
def q_topic_segments_dump(spark, sf_dir):
    """SRC-4 from a topic's own offsets: all four partitions, three of them
    not from their first record on."""
    from crossbook.sources.segments import read_topics
    path = _orders_published(spark, sf_dir, "dump")
    starts = {TP.ORDERS_TOPIC: {1: 20, 2: 50, 3: 5}}
    return read_topics(spark, path, [TP.ORDERS_TOPIC], starts).select("partition", "offset", "timestamp", "key", "value")


@query("published_orders")
def q_published_orders(spark, sf_dir):
    """SNK-3: orders published to their topic, those of quantity 0 left out
    (every seventh, a rule of this query), and read back."""
    from crossbook.sources.segments import read_topics
    zeroed = F.when(F.col("seq") % 7 == 0, F.lit(0)).otherwise(F.col("quantity")).cast("bigint")
    orders = C.nonzero_orders(events_orders(spark, sf_dir).withColumn("quantity", zeroed))
    return read_topics(spark, _orders_published(spark, sf_dir, "orders-out", orders)).select("topic", "key", "value")


@query("service_segments")
def q_service_segments(spark, sf_dir):
    """SRC-1, SNK-1, SNK-2, SNK-4: the order service from a segment topic, whose
    offsets are the orders' arrival, to segment topics, a publication per batch."""
    from crossbook.sources.segments import publish, read_topics, stream_topics
    from crossbook.streaming.pipelines import run_order_topic, stream_folder, use_rocksdb
    use_rocksdb(spark)
    path = _orders_published(spark, sf_dir, "orders-in")
    records = stream_topics(spark, path, [TP.ORDERS_TOPIC]).select("key", F.col("offset").alias("seq"), "value")
    out = f"{path}-out"

    def send(rows, batch_id):
        publish(rows, out, 4, txn=f"batch-{batch_id}")

    for q in run_order_topic(records, stream_folder(spark, "segments"), publish=send,
                             state_partitions=spark.sparkContext.defaultParallelism):
        q.awaitTermination()
    return read_topics(spark, out).select("topic", "key", "value")


@query("src_price_inputs")
def q_src_price_inputs(spark, sf_dir):
    """SRC-2: trade and price messages in two topics, read back as one stream,
    split and parsed by topic."""
    from crossbook.streaming.pipelines import drain, stream_folder
    folder = stream_folder(spark, "price-inputs")
    TP.write_topic_files(TP.fill_messages(_fills(spark, sf_dir)), f"{folder}/topics")
    contracts = {TP.TRADES_TOPIC: "trade", TP.PRICES_TOPIC: "pricepoint"}
    messages = TP.file_topics_stream(spark, f"{folder}/topics", list(contracts))
    drain(TP.parse_by_topic(messages, contracts), folder)
    got = spark.read.parquet(f"{folder}/out").where(~F.col("malformed"))
    return got.groupBy("topic").agg(F.count(F.lit(1)).alias("messages"),
                                    F.sum(F.coalesce("trade.price", "pricepoint.price")).alias("price_sum"))


# ---------------------------------------------------------------- streams
def _events_stream(spark, sf_dir, max_files=None):
    from crossbook.streaming.pipelines import file_table_stream
    schema = read_table(spark, sf_dir, "events").schema
    return file_table_stream(spark, sf_dir, "events", schema, max_files)


@query("order_topic_service")
def q_order_topic_service(spark, sf_dir):
    """The whole service on a stream: order topic in, parse and quarantine,
    match, trade and price topics out; all messages it published or set aside."""
    from crossbook.streaming.pipelines import run_order_topic, stream_folder, use_rocksdb
    use_rocksdb(spark)
    folder = stream_folder(spark, "order-topic")
    topic = order_topic(spark, sf_dir)
    topic.write.parquet(f"{folder}/orders")
    messages = spark.readStream.schema(topic.schema).parquet(f"{folder}/orders")
    for q in run_order_topic(messages, folder, state_partitions=spark.sparkContext.defaultParallelism):
        q.awaitTermination()
    published = spark.read.schema("key string, value string, batch_id long, topic string").parquet(
        f"{folder}/topics")
    aside = spark.read.parquet(f"{folder}/quarantine/out")
    return published.select("topic", "key", "value").unionByName(
        aside.select(F.lit("quarantine").alias("topic"), F.lit(None).cast("string").alias("key"), "value"))


@query("book_from_stream")
def q_book_from_stream(spark, sf_dir):
    """STR-4 on a stream: the book out of the state of the matching stream."""
    from crossbook.streaming.pipelines import book_from_state
    _, folder = _run_match_stream(spark, sf_dir, "book")
    return book_from_state(spark, f"{folder}/checkpoint")


@query("mid_ticks_stream")
def q_mid_ticks_stream(spark, sf_dir):
    """STR-5 on a stream: mids on event time, by rows and by event-time timers;
    like ``mid_ticks`` up to each symbol's last top-of-book change."""
    from crossbook.streaming.matcher import stream_mids
    raw, _ = _run_match_stream(spark, sf_dir, "mids", event_tick_us=FIXTURE_TICK_US, watermark_delay="0 seconds")
    ends = raw.where("kind = 'top'").groupBy("symbol").agg(F.max("timestamp").alias("t1"))
    return stream_mids(raw).join(ends, "symbol").where(F.col("tick_ts") <= F.col("t1")).drop("t1")


@query("price_heartbeat_stream")
def q_price_heartbeat_stream(spark, sf_dir):
    """STR-6 on a stream: trades and price points in two topics, read as one
    stream (SRC-2); beats on event time, like ``price_heartbeat`` up to each
    symbol's last price."""
    from crossbook.streaming.pipelines import drain, event_heartbeat_stream, stream_folder, use_rocksdb
    use_rocksdb(spark)
    folder = stream_folder(spark, "heartbeats")
    prints = match_orders(events_orders(spark, sf_dir), emit_book=False).checkpoint().prints
    rows = TP.price_input_messages(P.price_stream(prints))
    rows.write.partitionBy("topic").parquet(f"{folder}/topics")
    contracts = {TP.TRADES_TOPIC: "trade", TP.PRICES_TOPIC: "pricepoint"}
    messages = spark.readStream.schema(rows.schema).parquet(f"{folder}/topics")
    prices = TP.parse_by_topic(messages, contracts).where(~F.col("malformed")).select(
        F.col("key").alias("symbol"), F.coalesce("trade.price", "pricepoint.price").alias("price"),
        F.col("timestamp").alias("ts"), F.col("offset").alias("place"))
    drain(event_heartbeat_stream(prices, FIXTURE_TICK_US, "0 seconds"), folder,
          state_partitions=spark.sparkContext.defaultParallelism)
    ends = prints.groupBy("symbol").agg(F.max("timestamp").alias("t1"))
    return spark.read.parquet(f"{folder}/out").join(ends, "symbol").where(F.col("beat_ts") < F.col("t1")).drop("t1")


def _run_service(spark, sf_dir, name, **kw):
    """The order service over the whole raw order topic; its folder."""
    from crossbook.streaming.pipelines import run_order_topic, stream_folder, use_rocksdb
    use_rocksdb(spark)
    folder = stream_folder(spark, name)
    topic = order_topic(spark, sf_dir)
    topic.write.parquet(f"{folder}/orders")
    messages = spark.readStream.schema(topic.schema).parquet(f"{folder}/orders")
    queries = run_order_topic(messages, folder, state_partitions=spark.sparkContext.defaultParallelism, **kw)
    for q in queries:
        q.awaitTermination()
    return folder, queries


@query("service_price_topic")
def q_service_price_topic(spark, sf_dir):
    """SNK-2 by the service: fill prices and sampled mids on its price topic,
    mids up to the newest order's time."""
    folder, _ = _run_service(spark, sf_dir, "price-topic", event_tick_us=FIXTURE_TICK_US, watermark_delay="0 seconds")
    published = spark.read.schema("key string, value string, batch_id long, topic string").parquet(f"{folder}/topics")
    return published.where(F.col("topic") == TP.PRICES_TOPIC).select("key", "value")


@query("service_counts")
def q_service_counts(spark, sf_dir):
    """OBS-1: what the service consumed, set aside and produced, from the
    observations of its progress."""
    from crossbook.streaming.pipelines import record_counts, stream_folder, total_counts
    counts = stream_folder(spark, "counts")
    recorder = record_counts(spark, counts)
    try:
        _, (matcher,) = _run_service(spark, sf_dir, "counted")
        recorder.wait(matcher)
    finally:
        spark.streams.removeListener(recorder)
    return total_counts(spark, counts)


@query("unique_trades_stream")
def q_unique_trades_stream(spark, sf_dir):
    """SNK-1, STR-8: a trade topic that holds every message twice, consumed once."""
    from crossbook.streaming.pipelines import drain, stream_folder, unique_trades, use_rocksdb
    use_rocksdb(spark)
    folder = stream_folder(spark, "unique-trades")
    legs = T.trade_legs(_fills(spark, sf_dir))
    topic = legs.select(F.explode(F.array_repeat(I.to_json_value(legs, "trade"), 2)).alias("value"))
    topic.write.parquet(f"{folder}/topic")
    messages = spark.readStream.schema(topic.schema).parquet(f"{folder}/topic")
    drain(unique_trades(messages), folder, state_partitions=spark.sparkContext.defaultParallelism)
    return spark.read.parquet(f"{folder}/out").drop("value")


@query("book_after_batch")
def q_book_after_batch(spark, sf_dir):
    """STR-4 after an earlier micro-batch: the log in three files, one per
    batch; the book after the second, out of the state's versions."""
    from crossbook.streaming.matcher import match_stream
    from crossbook.streaming.pipelines import book_from_state, drain, stream_folder, use_rocksdb
    use_rocksdb(spark)
    folder = stream_folder(spark, "book-after")
    orders = events_orders(spark, sf_dir)
    span = orders.agg(F.min("seq").alias("a"), F.max("seq").alias("b")).first()
    for n in range(3):
        third = F.floor((F.col("seq") - span.a) * 3 / (span.b - span.a + 1)) == n
        orders.where(third).coalesce(1).write.parquet(f"{folder}/log/part={n}")
    stream = (spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", "1").parquet(f"{folder}/log"))
    drain(match_stream(stream), folder, state_partitions=spark.sparkContext.defaultParallelism)
    return book_from_state(spark, f"{folder}/checkpoint", batch_id=1)


def _run_match_stream(spark, sf_dir, name, seeds=False, **kw):
    from crossbook.sources.fixtures import events_to_orders
    from crossbook.streaming.matcher import match_stream
    from crossbook.streaming.pipelines import drain, stream_folder, use_rocksdb
    use_rocksdb(spark)
    seed_df = _seeds(events_orders(spark, sf_dir)) if seeds else None
    raw = match_stream(events_to_orders(_events_stream(spark, sf_dir)), seeds=seed_df, **kw)
    folder = stream_folder(spark, name)
    # state partitions: one per core of the cluster, fixed at the first run
    drain(raw, folder, state_partitions=spark.sparkContext.defaultParallelism)
    return spark.read.parquet(f"{folder}/out"), folder


@query("match_orders_stream")
def q_match_orders_stream(spark, sf_dir):
    """STR-1 on Structured Streaming (transformWithState, availableNow)."""
    from crossbook.plans.match import MatchResult
    raw, _ = _run_match_stream(spark, sf_dir, "match_orders")
    return MatchResult(raw).fills


@query("seeded_match_stream")
def q_seeded_match_stream(spark, sf_dir):
    """STR-7 on a stream: seeds enter as the processor's initial state."""
    from crossbook.plans.match import MatchResult
    raw, _ = _run_match_stream(spark, sf_dir, "seeded_match", seeds=True)
    return MatchResult(raw).fills


@query("seeds_in_book")
def q_seeds_in_book(spark, sf_dir):
    """STR-7: the book of a seeded stream. Every user and every part has a
    seeded book; parts have no orders, so their seeds stand by themselves."""
    from crossbook.sources.fixtures import events_to_orders
    from crossbook.streaming.matcher import match_stream
    from crossbook.streaming.pipelines import book_from_state, drain, stream_folder, use_rocksdb
    use_rocksdb(spark)
    folder = stream_folder(spark, "seeds")
    parts = read_table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"), F.lit(0).cast("bigint").alias("timestamp"))
    seeds = _seeds(events_orders(spark, sf_dir)).unionByName(G.seed_orders(parts))
    drain(match_stream(events_to_orders(_events_stream(spark, sf_dir)), seeds=seeds), folder,
          state_partitions=spark.sparkContext.defaultParallelism)
    return book_from_state(spark, f"{folder}/checkpoint", seeded=True)


@query("drain_available")
def q_drain_available(spark, sf_dir):
    """SRC-5: drain the order stream into a sink and stop; the rows that the
    sink then holds."""
    from crossbook.sources.fixtures import events_to_orders
    from crossbook.streaming.pipelines import drain, stream_folder
    folder = stream_folder(spark, "drain")
    drain(events_to_orders(_events_stream(spark, sf_dir)), folder)
    return spark.read.parquet(f"{folder}/out").agg(F.count(F.lit(1)).alias("rows_processed"))


@query("replay_equal")
def q_replay_equal(spark, sf_dir):
    """STR-8: two runs from scratch (fresh checkpoints) emit identical rows,
    ids included: counts of both runs and of their symmetric difference."""
    from crossbook.plans.match import MatchResult
    a = T.trade_legs(MatchResult(_run_match_stream(spark, sf_dir, "replay_a")[0]).fills)
    b = T.trade_legs(MatchResult(_run_match_stream(spark, sf_dir, "replay_b")[0]).fills)
    both = a.withColumn("run", F.lit(1)).unionByName(b.withColumn("run", F.lit(2)))
    per_row = both.groupBy(*a.columns).agg(
        F.sum((F.col("run") == 1).cast("bigint")).alias("n1"),
        F.sum((F.col("run") == 2).cast("bigint")).alias("n2"))
    return per_row.agg(F.sum("n1").alias("first_run"), F.sum("n2").alias("second_run"),
                       F.sum(F.abs(F.col("n1") - F.col("n2"))).alias("differing"))


@query("src_microbatch")
def q_src_microbatch(spark, sf_dir):
    """SRC-3: the raw order topic consumed in bounded micro-batches (one file
    per trigger), parsed per batch; returns the good records."""
    from crossbook.streaming.pipelines import microbatch_parse, stream_folder
    folder = stream_folder(spark, "microbatch")
    msgs = order_messages(spark, sf_dir)
    msgs.write.parquet(f"{folder}/topic")
    stream = (spark.readStream.schema(msgs.schema).option("maxFilesPerTrigger", "1")
              .parquet(f"{folder}/topic"))
    microbatch_parse(stream, folder).awaitTermination()
    out = spark.read.parquet(f"{folder}/batches")
    return out.where(~F.col("malformed")).select("source", "msg_id", *_ORDER_FIELDS)
