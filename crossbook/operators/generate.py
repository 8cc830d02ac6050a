"""Order and trade generators (GEN-1..4) as column expressions.

The original producers draw from wall-clock-seeded RNGs; here every draw is a
deterministic integer mix of a row id and a salt, so a rerun (or a retried
task) produces the same rows, and the DuckDB oracle can compute the same
values. No driver-side loops: each generator is one projection over its
input DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossbook.functions.columns import trader_id, trader_order_id, zero_to_one

# Fixed values of the draws: a Lehmer-style mix modulo the Mersenne prime 2^31-1.
MIX_MOD = 2147483647
MIX_MUL = 48271
MIX_SALT = 16807


def mix(x: Column, salt: int) -> Column:
    """Deterministic pseudo-random integer in [0, MIX_MOD) from a non-negative id."""
    h = ((x % MIX_MOD) * MIX_MUL + salt * MIX_SALT) % MIX_MOD
    return (h * MIX_MUL) % MIX_MOD


def uniform(x: Column, salt: int) -> Column:
    """Pseudo-random double in [0, 1)."""
    return mix(x, salt).cast("double") / float(MIX_MOD)


def orders_from_prices(prices: DataFrame, id_col: str = "price_id", n_traders: int = 600) -> DataFrame:
    """GEN-1: one limit order per price update. Magnitude 10..39, side 50/50;
    a buy bids ``p*(1+u/100)+0.5``, a sell asks ``p*(1-u/100)-0.5``, u in [0,1).
    ``prices`` needs (symbol, <id_col>, price, timestamp)."""
    rid = F.col(id_col)
    magnitude = (F.lit(10) + mix(rid, 1) % 30).cast("bigint")
    is_buy = mix(rid, 2) % 2 == 0
    u = uniform(rid, 3)
    price = F.when(is_buy, F.col("price") * (F.lit(1.0) + u / 100.0) + 0.5).otherwise(
        F.col("price") * (F.lit(1.0) - u / 100.0) - 0.5)
    trader = trader_id(mix(rid, 4) % n_traders)
    return prices.select(
        "symbol",
        trader_order_id(trader, F.col("timestamp") * 1000 + rid % 1000).alias("order_id"),
        F.lit("limit").alias("order_type"),
        price.alias("price"),
        F.when(is_buy, magnitude).otherwise(-magnitude).alias("quantity"),
        F.col("timestamp"),
        rid.alias("seq"),
    )


def random_orders(ids: DataFrame, id_col: str = "event_id", min_quantity: int = -50,
                  max_quantity: int = 50) -> DataFrame:
    """GEN-2: integer price 45..60 and quantity in [min, max], 0 drawn -> 1.
    ``ids`` needs (symbol, <id_col>, timestamp)."""
    rid = F.col(id_col)
    span = max_quantity - min_quantity + 1
    qty = zero_to_one(mix(rid, 6) % span + min_quantity).cast("bigint")
    return ids.select(
        "symbol",
        F.concat(F.lit("R-"), rid.cast("string")).alias("order_id"),
        F.lit("limit").alias("order_type"),
        (F.lit(45) + mix(rid, 5) % 16).cast("double").alias("price"),
        qty.alias("quantity"),
        "timestamp",
        rid.alias("seq"),
    )


def random_trades(ids: DataFrame, id_col: str = "event_id") -> DataFrame:
    """GEN-3: a random execution as two legs (BUY then SELL) sharing one
    trade id: quantity 10..50, price uniform in [40, 45], status PARTIAL."""
    rid = F.col(id_col)
    qty = (F.lit(10) + mix(rid, 7) % 41).cast("bigint")
    price = F.lit(40.0) + uniform(rid, 8) * 5.0
    legs = F.array(
        F.struct(F.lit(0).alias("leg"), F.lit("BUY").alias("action")),
        F.struct(F.lit(1).alias("leg"), F.lit("SELL").alias("action")))
    return (ids.select("symbol", rid.alias("rid"), "timestamp", qty.alias("quantity"),
                       price.alias("price"), F.explode(legs).alias("l"))
            .select("symbol",
                    F.concat(F.lit("T-"), F.col("rid").cast("string")).alias("trade_id"),
                    F.concat_ws("-", F.lit("T"), F.col("rid").cast("string"),
                                F.col("l.leg").cast("string")).alias("order_id"),
                    "quantity", "price", F.col("l.action").alias("action"),
                    F.lit("PARTIAL").alias("status"), "timestamp"))


def seed_orders(symbols: DataFrame, mid: float = 50.0, spread: float = 1.0,
                quantity: int = 100) -> DataFrame:
    """GEN-4: per symbol one bid at mid - spread/2 (x quantity) and one ask
    at mid + spread/2 (x -quantity), same timestamp, seq -2 and -1 so they
    precede every real order. ``symbols`` needs (symbol, timestamp)."""
    sides = F.array(
        F.struct(F.lit("BID").alias("tag"), F.lit(mid - spread / 2).alias("price"),
                 F.lit(quantity).cast("bigint").alias("quantity"), F.lit(-2).cast("bigint").alias("seq")),
        F.struct(F.lit("ASK").alias("tag"), F.lit(mid + spread / 2).alias("price"),
                 F.lit(-quantity).cast("bigint").alias("quantity"), F.lit(-1).cast("bigint").alias("seq")))
    return (symbols.select("symbol", "timestamp", F.explode(sides).alias("s"))
            .select("symbol",
                    F.concat_ws("-", F.lit("SEED"), F.col("symbol"), F.col("s.tag")).alias("order_id"),
                    F.lit("limit").alias("order_type"), "s.price", "s.quantity", "timestamp", "s.seq"))
