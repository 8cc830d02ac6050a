"""Matching with the orders left out that can never trade.

Matching is sequential within a symbol, so a hot symbol is one long task. What
shortens that task is proving orders out of it. A buy trades only against a
sell with a price at or below its own, be it resting when the buy arrives or
still to come; so a buy below the lowest sell of the whole log can never
trade, nor can a sell above the highest buy. Such orders rest where they
arrive and change nothing for the others: their price levels lie behind every
level that the fold can touch. Removing them leaves both extremes as they are,
so one pass finds all of them.

    orders -> extremes per symbol (one aggregate)
           -> active orders -> the fold (one task per symbol)
           -> inert orders  -> levels and queue places by running counts,
                               spread over all tasks even for one hot symbol

Only symbols with at least ``min_orders`` orders are reduced; by default those
that fill an average partition of the fold, of which there are no more than
partitions, so their extremes can be sent to every task. ``best_price`` only:
under ``first_seen`` the order of level insertion decides who trades.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossbook.functions.scan import running_count
from crossbook.plans.match import RAW_SCHEMA, MatchResult, match_orders, total_order
from crossbook.session import reliable_checkpoint


def _partitions(orders: DataFrame, num_partitions: int | None) -> int:
    return num_partitions or int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _typed(orders: DataFrame) -> DataFrame:
    symbol = F.col("symbol") if "symbol" in orders.columns else F.lit("X")
    return orders.withColumns({
        "symbol": symbol.cast("string"), "price": F.coalesce(F.col("price").cast("double"), F.lit(0.0)),
        "quantity": F.coalesce(F.col("quantity").cast("bigint"), F.lit(0))})


def price_extremes(orders: DataFrame) -> DataFrame:
    """(symbol, n, lowest_sell, highest_buy) over each symbol's whole log; an
    extreme is NULL without orders of that side. A NaN price crosses every
    price in the fold, so it counts as the utmost one."""
    inf = float("inf")
    price = F.col("price")
    return _typed(orders).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("quantity") < 0, F.when(F.isnan(price), -inf).otherwise(price))).alias("lowest_sell"),
        F.max(F.when(F.col("quantity") > 0, F.when(F.isnan(price), inf).otherwise(price))).alias("highest_buy"))


def _never_trades():
    """The order can rest without entering the fold."""
    price = F.col("price")
    alone = F.when(F.col("quantity") > 0, F.col("lowest_sell").isNull() | (price < F.col("lowest_sell"))).when(
        F.col("quantity") < 0, F.col("highest_buy").isNull() | (price > F.col("highest_buy")))
    return F.coalesce(F.col("n").isNotNull() & ~F.isnan(price) & alone, F.lit(False))


def mark_inert(orders: DataFrame, min_orders: int | None = None,
               num_partitions: int | None = None) -> DataFrame:
    """``orders`` (typed) with ``inert``: true for the orders of large symbols
    that can never trade."""
    parts = _partitions(orders, num_partitions)
    per = reliable_checkpoint(price_extremes(orders))  # one row per symbol, read twice
    if min_orders is None:
        total = per.agg(F.sum("n")).first()[0] or 0
        large = F.broadcast(per.where(F.col("n") * parts >= total))  # at most ``parts`` symbols
    else:
        large = per.where(F.col("n") >= min_orders)  # any number: Spark picks the join
    large = large.withColumnRenamed("symbol", "_large")
    return (_typed(orders).join(large, F.col("symbol").eqNullSafe(F.col("_large")), "left")
            .withColumn("inert", _never_trades()).drop("_large", "n", "lowest_sell", "highest_buy"))


def fold_load_reduced(orders: DataFrame, min_orders: int | None = None,
                      num_partitions: int | None = None) -> DataFrame:
    """What the reduction leaves in the fold, before a match runs: all orders,
    those in the fold and their share, and the largest symbol's two counts."""
    marked = mark_inert(orders, min_orders, num_partitions)
    per = marked.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"),
                                       F.sum((~F.col("inert")).cast("bigint")).alias("in_fold"))
    return per.agg(F.sum("n").alias("orders"), F.sum("in_fold").alias("in_fold"),
                   (F.sum("in_fold") / F.sum("n")).alias("fold_share"),
                   F.max("n").alias("largest_symbol_orders"), F.max("in_fold").alias("largest_symbol_in_fold"))


@dataclass(frozen=True)
class ReducedMatch:
    """Fills, book and order states of a reduced match; rows as ``MatchResult`` has them."""

    fold: MatchResult
    resting: DataFrame

    @property
    def fills(self) -> DataFrame:
        return self.fold.fills

    @property
    def book(self) -> DataFrame:
        return self.fold.book.unionByName(self.resting.select(self.fold.book.columns))

    @property
    def order_states(self) -> DataFrame:
        never = self.resting.select(
            "symbol", "order_id", "seq", "side", F.col("remaining").alias("original"),
            F.lit(0).cast("bigint").alias("filled"), "remaining", F.lit(0).cast("bigint").alias("n_fills"),
            F.lit("open").alias("status"))
        return self.fold.order_states.unionByName(never)


def match_orders_reduced(orders: DataFrame, residual: str = "tail", tiebreak=(), min_orders: int | None = None,
                         num_partitions: int | None = None, emit_orders: bool = False) -> ReducedMatch:
    """``match_orders`` (best_price) with inert orders kept out of the fold.

    Fills, book and order states are those of the plain match. The fold's
    output and the marked orders are written once (checkpoint), as both are
    read more than once. The arrival counts of the fold leave out inert
    orders, so ``MatchResult.prints`` is not offered here."""
    marked = reliable_checkpoint(mark_inert(orders, min_orders, num_partitions))
    active = marked.where(~F.col("inert")).drop("inert")
    raw = match_orders(active, residual=residual, tiebreak=tiebreak, num_partitions=num_partitions,
                       emit_orders=emit_orders).raw
    fold = MatchResult(reliable_checkpoint(raw.withColumn("arrival", F.lit(None).cast("bigint")).select(
        RAW_SCHEMA.names)))
    return ReducedMatch(fold, _resting(marked.where("inert"), fold.book, tiebreak))


def _resting(inert: DataFrame, folded: DataFrame, tiebreak) -> DataFrame:
    """Book rows of the inert orders: their levels come after the fold's."""
    side = F.when(F.col("quantity") > 0, "BUY").otherwise("SELL")
    extra = [c for c in tiebreak if c in inert.columns]
    rows = inert.withColumns({
        "side": side, "remaining": F.abs("quantity"), "order_id": F.col("order_id").cast("string"),
        "timestamp": F.col("timestamp").cast("bigint") if "timestamp" in inert.columns else F.lit(None).cast("bigint")})
    rows = running_count(rows, ["symbol", "side", "price"], total_order(extra), "_queued")
    levels = rows.select("symbol", "side", "price").distinct().withColumn(
        "_k", F.when(F.col("side") == "BUY", -F.col("price")).otherwise(F.col("price")))
    levels = running_count(levels, ["symbol", "side"], ["_k"], "_rank", probe=rows.select("symbol", "side"))
    before = folded.groupBy("symbol", "side").agg((F.max("level_seq") + 1).alias("_before"))

    def same(other: DataFrame, keys):
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(other[f"_{k}"])
        return cond

    before = before.select(F.col("symbol").alias("_symbol"), F.col("side").alias("_side"), "_before")
    levels = levels.join(before, same(before, ("symbol", "side")), "left").select(
        F.col("symbol").alias("_symbol"), F.col("side").alias("_side"), F.col("price").alias("_price"),
        (F.coalesce("_before", F.lit(0)) + F.col("_rank") - 1).cast("int").alias("level_seq"))
    return rows.join(levels, same(levels, ("symbol", "side", "price"))).select(
        "symbol", "side", "price", "level_seq", (F.col("_queued") - 1).cast("int").alias("queue_pos"),
        "order_id", "seq", "remaining", "timestamp")
