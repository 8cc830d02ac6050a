"""What-if sweeps of independent takers against a static book (JN-1, FLT-2).

A taker with limit p and quantity Q meets the opposite side in priority
order; it fills maker i when i crosses and the depth before i is below Q.
Both conditions select a prefix of the priority order, so the fills of a
taker are ranks 0..k-1 with

    k = min(#makers crossing p, #makers with depth_before < Q).

Each count is an as-of lookup (union + last over a per-side sort), and the
fills are an equi-join on (symbol, side, rank). Nothing pairs every taker
with every maker: the output is exactly the fills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossbook.functions.columns import crosses, nonzero_orders, side as side_of
from crossbook.functions.scan import has_hot_key, running_last, running_sums
from crossbook.session import reliable_checkpoint


def _depth(book: DataFrame, strategy: str = "auto") -> DataFrame:
    """Live makers with their priority rank and depth before them (a
    skew-safe running count and sum per side)."""
    live = book.where(F.col("order_id").isNotNull()).select(
        "symbol", "side", "price", "level_seq", "queue_pos", "order_id", "remaining",
        F.lit(1).cast("bigint").alias("_one"))
    scanned = running_sums(live, ["symbol", "side"], ["level_seq", "queue_pos"],
                           {"_n": "_one", "_cum": "remaining"}, strategy=strategy)
    return scanned.select("symbol", "side", "price", "order_id", "remaining",
                          (F.col("_n") - 1).cast("int").alias("rank"),
                          (F.col("_cum") - F.col("remaining")).cast("bigint").alias("before"))


def _asof_count(makers: DataFrame, takers: DataFrame, maker_key, taker_key,
                maker_first: bool, name: str, strategy: str) -> DataFrame:
    """``takers`` with one more column: 1 + the highest maker rank whose key sorts before the
    taker's key (ties: makers first when ``maker_first``). A running
    "last non-null rank" over the merged, key-ordered rows of each side."""
    m = makers.select("symbol", F.col("side").alias("mside"), maker_key.alias("key"),
                      F.lit(0 if maker_first else 1).alias("tie"), "rank")
    t = takers.select("symbol", "mside", taker_key.alias("key"),
                      F.lit(1 if maker_first else 0).alias("tie"),
                      F.struct("*").alias("taker"))
    # takers with equal keys all see the same makers, so their order is free
    carried = running_last(m.unionByName(t, allowMissingColumns=True), ["symbol", "mside"],
                           ["key", "tie", "rank", "taker"], {"_last_rank": "rank"}, strategy=strategy)
    return carried.where(F.col("taker").isNotNull()).select(
        "taker.*", (F.coalesce(F.col("_last_rank"), F.lit(-1)) + 1).alias(name))


def sweep_book(takers: DataFrame, book: DataFrame) -> DataFrame:
    """JN-1: fills each taker would get against ``book`` (best_price
    priority), every taker evaluated independently.

    ``takers`` needs (symbol, seq, order_id, price, quantity signed)."""
    t = takers.select(
        "symbol", F.col("seq").alias("tid"), F.col("order_id").alias("taker_order_id"),
        F.col("price").alias("limit"), F.abs("quantity").alias("want"),
        side_of(F.col("quantity")).alias("taker_side"),
        F.when(F.col("quantity") > 0, "SELL").otherwise("BUY").alias("mside"))
    t = t.where(F.col("want") > 0)
    # one measurement of the per-(symbol, side) load, on the taker scan; it
    # also bounds the book (a book holds at most the orders that came in)
    n = int(takers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    strategy = "split" if has_hot_key(t, ["symbol", "mside"], n) else "window"
    # read three times below: written once, so the book and its depth are computed once
    makers = reliable_checkpoint(_depth(book, strategy))
    # asks cross a buy when price <= limit; bids cross a sell when price >= limit
    signed = F.when(F.col("side") == "SELL", F.col("price")).otherwise(-F.col("price"))
    t_signed = F.when(F.col("mside") == "SELL", F.col("limit")).otherwise(-F.col("limit"))
    # the takers go through both scans with all their columns: nothing is joined back
    counted = _asof_count(makers, t, signed, t_signed, True, "n_cross", strategy)
    counted = _asof_count(makers, counted, F.col("before"), F.col("want"), False, "n_depth", strategy)
    k = counted.withColumn("k", F.least("n_cross", "n_depth")).where(F.col("k") > 0)
    hits = k.select("symbol", "tid", "taker_order_id", "taker_side", "mside", "want",
                    F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("rank"))
    m = makers.select("symbol", F.col("side").alias("mside"), "rank", "price",
                      F.col("order_id").alias("maker_order_id"), "remaining", "before")
    return (hits.join(m, ["symbol", "mside", "rank"])
            .select("symbol", F.col("tid").alias("taker_seq"), "taker_order_id", "taker_side",
                    "rank", "maker_order_id", "price",
                    F.least(F.col("remaining"), F.col("want") - F.col("before")).alias("quantity")))


def crossing_orders(orders: DataFrame, top: DataFrame) -> DataFrame:
    """FLT-2: orders whose limit crosses the opposite best of ``top``
    (symbol, best_bid, best_ask): a buy when limit >= ask, a sell when
    limit <= bid (inclusive). Zero-quantity orders never cross. One row per symbol on the right side."""
    o = nonzero_orders(orders).select("symbol", "seq", "order_id", "price", "quantity",
                                      side_of(F.col("quantity")).alias("side"))
    j = o.join(top.select("symbol", "best_bid", "best_ask"), "symbol")
    opposite = F.when(F.col("side") == "BUY", F.col("best_ask")).otherwise(F.col("best_bid"))
    return j.where(F.coalesce(crosses(F.col("side"), F.col("price"), opposite), F.lit(False))).select(
        "symbol", "seq", "order_id", "side", "price", opposite.alias("opposite_best"))
