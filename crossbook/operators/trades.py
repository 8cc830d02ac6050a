"""Trades derived from fills: legs, pairing, fill state per order.

All plain DataFrame expressions. ``fills`` is ``MatchResult.fills``:
(symbol, taker_seq, fill_idx, taker_order_id, maker_order_id, maker_seq,
taker_side, price, quantity, taker_remaining, maker_remaining, timestamp).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Trade leg labels as emitted by the matcher.
STATUS_CLOSED = "closed"
STATUS_PARTIAL = "partial"


def trade_id(symbol: Column, taker_seq: Column, taker_order_id: Column, fill_idx: Column) -> Column:
    """Deterministic execution id: replays give the same ids. The taker's
    order id keeps executions of takers with one seq apart; a NULL part is
    written as an empty one, never left out."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (symbol, taker_seq, taker_order_id, fill_idx)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def opposite(side: Column) -> Column:
    return F.when(side == "BUY", F.lit("SELL")).otherwise(F.lit("BUY"))


def leg_status(remaining: Column) -> Column:
    """PRJ-7: closed when the order has nothing left after the fill."""
    return F.when(remaining == 0, F.lit(STATUS_CLOSED)).otherwise(F.lit(STATUS_PARTIAL))


def execution_legs(fills: DataFrame) -> DataFrame:
    """SET-3: one execution -> two legs (taker first, maker second) sharing
    one trade id, opposite actions, status per leg."""
    tid = trade_id(F.col("symbol"), F.col("taker_seq"), F.col("taker_order_id"), F.col("fill_idx"))
    taker = F.struct(
        F.col("taker_order_id").alias("order_id"),
        F.col("taker_side").alias("action"),
        leg_status(F.col("taker_remaining")).alias("status"),
    )
    maker = F.struct(
        F.col("maker_order_id").alias("order_id"),
        opposite(F.col("taker_side")).alias("action"),
        leg_status(F.col("maker_remaining")).alias("status"),
    )
    return (
        fills.select("symbol", "taker_seq", "fill_idx", "quantity", "price", "timestamp",
                     tid.alias("trade_id"),
                     F.posexplode(F.array(taker, maker)).alias("leg", "l"))
        .select("symbol", "taker_seq", "fill_idx", F.col("leg").cast("int").alias("leg"),
                "trade_id", "l.order_id", "quantity", "price", "l.action", "l.status",
                "timestamp")
    )


def trade_legs(fills: DataFrame) -> DataFrame:
    """PRJ-7: the trade record of the contract (plus symbol)."""
    return execution_legs(fills).select(
        "symbol", "trade_id", "order_id", "quantity", "price", "action", "status", "timestamp")


def pair_legs(legs: DataFrame) -> DataFrame:
    """JN-2: the two legs of one trade id back into one buyer/seller row.
    Groups hold exactly two rows, so the aggregation never skews."""
    is_buy = F.col("action") == "BUY"
    return legs.groupBy("trade_id").agg(
        F.max(F.when(is_buy, F.col("order_id"))).alias("buy_order_id"),
        F.max(F.when(~is_buy, F.col("order_id"))).alias("sell_order_id"),
        F.max("quantity").alias("quantity"),
        F.max("price").alias("price"),
        F.max("timestamp").alias("timestamp"),
        F.count(F.lit(1)).alias("legs"),
    )


def price_points(fills: DataFrame) -> DataFrame:
    """PRJ-8: exactly one price point per execution (``arrival`` is kept)."""
    arrival = ["arrival"] if "arrival" in fills.columns else []
    return fills.select("symbol", "taker_seq", "fill_idx", "price", "timestamp", *arrival)


def _order_legs(fills: DataFrame) -> DataFrame:
    """Both sides of every fill as (symbol, order_id, ..., leg) in ONE pass
    over the fills (no self-union, so the fold upstream runs once)."""
    sides = F.array(
        F.struct(F.col("taker_order_id").alias("order_id"), F.lit(0).alias("leg")),
        F.struct(F.col("maker_order_id").alias("order_id"), F.lit(1).alias("leg")))
    return (fills.select("symbol", "taker_seq", "fill_idx", "quantity", F.explode(sides).alias("s"))
            .select("symbol", "s.order_id", "taker_seq", "fill_idx", "quantity", "s.leg"))


def order_fill_state(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """AGG-6: filled and remaining quantity and final status per order.

    Fills are reduced per (symbol, order_id) before the join (map-side
    partial aggregation), so the join sees at most one row per order."""
    filled = (_order_legs(fills).groupBy("symbol", "order_id")
              .agg(F.sum("quantity").alias("filled"), F.count(F.lit(1)).alias("n_fills")))
    o = orders.select("symbol", "order_id", "seq",
                      F.abs(F.col("quantity")).alias("original"),
                      F.when(F.col("quantity") > 0, "BUY").otherwise("SELL").alias("side"))
    joined = o.join(filled, ["symbol", "order_id"], "left")
    filled_q = F.coalesce(F.col("filled"), F.lit(0)).cast("bigint")
    remaining = F.col("original") - filled_q
    return joined.select(
        "symbol", "order_id", "seq", "side", "original",
        filled_q.alias("filled"),
        remaining.alias("remaining"),
        F.coalesce(F.col("n_fills"), F.lit(0)).cast("bigint").alias("n_fills"),
        F.when(F.col("original") == 0, "noop")
         .when(remaining == 0, STATUS_CLOSED)
         .when(filled_q > 0, STATUS_PARTIAL)
         .otherwise("open").alias("status"),
    )


def running_remaining(fills: DataFrame) -> DataFrame:
    """WIN-5: remaining quantity and status of each order after each of its
    fills, both sides. The fold carries both remainders on every fill row,
    so this is one fan-out of the fills: no join with the orders and no
    window over an order's fills."""
    sides = F.array(
        F.struct(F.col("taker_order_id").alias("order_id"), F.lit(0).alias("leg"),
                 F.col("taker_remaining").alias("remaining")),
        F.struct(F.col("maker_order_id").alias("order_id"), F.lit(1).alias("leg"),
                 F.col("maker_remaining").alias("remaining")))
    return (fills.select("symbol", "taker_seq", "fill_idx", "quantity", F.explode(sides).alias("s"))
            .select("symbol", "s.order_id", "taker_seq", "fill_idx", "s.leg", "quantity",
                    "s.remaining", leg_status(F.col("s.remaining")).alias("status")))
