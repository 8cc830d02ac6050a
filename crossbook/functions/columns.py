"""Scalar column helpers (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def side(quantity: Column) -> Column:
    """PRJ-6: > 0 buys, anything else (zero included) sells."""
    return F.when(quantity > 0, F.lit("BUY")).otherwise(F.lit("SELL"))


def with_side(orders: DataFrame) -> DataFrame:
    """PRJ-6: side and positive magnitude from the signed quantity."""
    return orders.withColumn("side", side(F.col("quantity"))).withColumn(
        "magnitude", F.abs(F.col("quantity")))


def nonzero_orders(orders: DataFrame) -> DataFrame:
    """FLT-1: zero-quantity orders are never published."""
    return orders.where(F.col("quantity") != 0)


def zero_to_one(quantity: Column) -> Column:
    """FLT-1 (script producer): a drawn 0 becomes 1."""
    return F.when(quantity == 0, F.lit(1)).otherwise(quantity)


def crosses(taker_side: Column, taker_price: Column, maker_price: Column) -> Column:
    """FLT-2: a buy crosses when its limit >= ask, a sell when <= bid."""
    return F.when(taker_side == "BUY", taker_price >= maker_price).otherwise(taker_price <= maker_price)


def normalize_epoch(value: Column) -> Column:
    """PRJ-9: epoch in s / ms / µs / ns (told apart by magnitude) -> TIMESTAMP."""
    a = F.abs(value)
    micros = (F.when(a < F.lit(10**11), value * 1_000_000)
              .when(a < F.lit(10**14), value * 1000)
              .when(a < F.lit(10**17), value)
              .otherwise(F.floor(value.cast("decimal(38,0)") / 1000)))
    return F.timestamp_micros(micros.cast("bigint"))


def normalize_action(action: Column) -> Column:
    """PRJ-10: BUY / SELL whatever the producer's case."""
    return F.upper(F.trim(action))


def normalize_status(status: Column) -> Column:
    """PRJ-10: closed / partial whatever the producer's case."""
    return F.lower(F.trim(status))


def trader_id(n: Column) -> Column:
    """PRJ-11: ``Trader-<n>``."""
    return F.concat(F.lit("Trader-"), n.cast("string"))


def trader_order_id(trader: Column, nanos: Column) -> Column:
    """PRJ-11: ``<trader>-<nanos>``."""
    return F.concat_ws("-", trader, nanos.cast("string"))


def fallback(value: Column, default) -> Column:
    """Empty string -> fallback value."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def config_entries(kv: DataFrame, key_col: str = "key", value_col: str = "value",
                   prefix: str | None = None) -> DataFrame:
    """Environment-style settings -> (section, name, value): keys split on
    ``__`` with exactly three parts (prefix, section, name), section and name
    lower-cased; other keys are ignored. ``prefix`` keeps one prefix only."""
    parts = F.split(F.col(key_col), "__")
    out = kv.where(F.size(parts) == 3)
    if prefix is not None:
        out = out.where(parts.getItem(0) == prefix)
    return out.select(F.lower(parts.getItem(1)).alias("section"),
                      F.lower(parts.getItem(2)).alias("name"),
                      F.col(value_col).alias("value"))
