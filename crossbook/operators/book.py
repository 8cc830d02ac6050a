"""Book-state queries over a resting-order table.

A book table has one row per resting order:
(symbol, side, price, level_seq, queue_pos, order_id, seq, remaining, timestamp)
``level_seq`` is the level's priority rank on its side (0 = the level a
taker meets first) and ``queue_pos`` the FIFO position inside the level.
The first_seen policy can leave an empty ("ghost") level; it appears as one
row with NULL order_id and remaining 0, so level counts and best prices see
it the way the matcher does, while sums and order counts ignore it.

Every query is a grouped aggregate or a running scan; aggregates run
map-side first, so a hot symbol costs one small partial row per task, and
running positions/depths use ``functions.scan``, which measures the largest
key and splits a hot symbol over several tasks instead of running one
window task for it. The scans read their input twice (measure, compute):
pass a materialised book (``MatchResult.checkpoint()``) when it comes
straight from the fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossbook.functions.scan import has_hot_key, running_count, running_sums

BOOK_COLUMNS = ("symbol", "side", "price", "level_seq", "queue_pos", "order_id", "seq",
                "remaining", "timestamp")


def rest_orders(orders: DataFrame, level_priority: str = "best_price") -> DataFrame:
    """STR-3 + WIN-1: insert every order into its book without matching.

    Side from the sign, quantity kept signed, a crossed or locked book is
    allowed; a NULL price rests at 0.0 as in the fold, a NULL symbol is a book
    of its own. Level rank: by price (best_price) or by the level's first
    arrival (first_seen); FIFO position inside the level by seq, then by the
    other columns, as in the fold."""
    o = orders.select(
        "symbol",
        F.when(F.col("quantity") > 0, "BUY").otherwise("SELL").alias("side"),
        F.coalesce(F.col("price"), F.lit(0.0)).alias("price"), "order_id", "seq", F.col("quantity").alias("remaining"), "timestamp")
    levels = o.groupBy("symbol", "side", "price").agg(F.min("seq").alias("first_seq"))
    if level_priority == "first_seen":
        levels = levels.withColumn("_lk", F.col("first_seq"))
    else:
        levels = levels.withColumn(
            "_lk", F.when(F.col("side") == "BUY", -F.col("price")).otherwise(F.col("price")))
    # level rank = running count over the distinct levels of a side (measured
    # on the order scan, which bounds the level count from above)
    ranked = running_count(levels, ["symbol", "side"], ["_lk"], "_rank",
                           probe=o.select("symbol", "side")).select(
        F.col("symbol").alias("_symbol"), F.col("side").alias("_side"), F.col("price").alias("_price"),
        (F.col("_rank") - 1).cast("int").alias("level_seq"))
    with_level = o.join(ranked, F.col("symbol").eqNullSafe(F.col("_symbol"))
                        & (F.col("side") == F.col("_side")) & (F.col("price") == F.col("_price")))
    # queue position inside a level: a running count by seq. The join only
    # enriches rows, so hot levels are measured on the cheap order scan.
    keys = ["symbol", "side", "price"]
    n = int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    strategy = "split" if has_hot_key(o, keys, n) else "window"
    queued = running_count(with_level, keys, ["seq", "order_id", "remaining", "timestamp"], "queue_pos", strategy=strategy)
    return queued.select("symbol", "side", "price", "level_seq",
                         (F.col("queue_pos") - 1).cast("int").alias("queue_pos"),
                         "order_id", "seq", "remaining", "timestamp")


def _best(side: str):
    """min over (level_seq, price) structs of one side: the level a taker meets first."""
    return F.min(F.when(F.col("side") == side, F.struct("level_seq", "price")))["price"]


def best_bid(book: DataFrame) -> DataFrame:
    """AGG-1: best bid per symbol (symbols without bids are absent)."""
    return (book.where(F.col("side") == "BUY").groupBy("symbol")
            .agg(_best("BUY").alias("best_bid")))


def best_ask(book: DataFrame) -> DataFrame:
    """AGG-2: best ask per symbol."""
    return (book.where(F.col("side") == "SELL").groupBy("symbol")
            .agg(_best("SELL").alias("best_ask")))


def mid_price(book: DataFrame) -> DataFrame:
    """AGG-7 (+FLT-3): top of book and mid per symbol in one aggregation.
    mid is NULL unless both sides exist and the best bid is above 0."""
    top = book.groupBy("symbol").agg(_best("BUY").alias("best_bid"),
                                     _best("SELL").alias("best_ask"))
    two_sided = F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull() & (F.col("best_bid") > 0)
    return top.withColumn(
        "mid_price", F.when(two_sided, (F.col("best_bid") + F.col("best_ask")) / 2))


def two_sided_books(book: DataFrame) -> DataFrame:
    """FLT-3: symbols whose mid would be published."""
    return mid_price(book).where(F.col("mid_price").isNotNull())


def level_count(book: DataFrame) -> DataFrame:
    """AGG-4: live levels per side (ghost levels included, as the matcher
    counts them)."""
    levels = book.select("symbol", "side", "price").distinct()
    return levels.groupBy("symbol", "side").agg(F.count(F.lit(1)).alias("levels"))


def volume_at_price(book: DataFrame) -> DataFrame:
    """AGG-5: resting volume and order count at each price."""
    return book.groupBy("symbol", "side", "price").agg(
        F.sum("remaining").cast("bigint").alias("volume"),
        F.count("order_id").alias("orders"))


def level_queues(book: DataFrame) -> DataFrame:
    """AGG-3: each price level's FIFO queue, summarised without collecting
    it: size, volume, head and tail order. The ordered queue itself is the
    book table ordered by queue_pos (see ``queue_position``)."""
    live = book.where(F.col("order_id").isNotNull())
    return live.groupBy("symbol", "side", "price").agg(
        F.min("level_seq").alias("level_seq"),
        F.count(F.lit(1)).alias("orders"),
        F.sum("remaining").cast("bigint").alias("volume"),
        F.min_by("order_id", "queue_pos").alias("head_order_id"),
        F.max_by("order_id", "queue_pos").alias("tail_order_id"),
    )


#: Orders of one page of a level's queue.
PAGE_ORDERS = 64


def level_pages(book: DataFrame, size: int = PAGE_ORDERS) -> DataFrame:
    """AGG-3 as arrays: each level's FIFO queue cut into pages of ``size``
    orders, (symbol, side, price, page, first_pos, entries) with entries
    (order_id, remaining) in queue order. A hot level is many pages, spread
    like any others; no array grows with its level."""
    live = book.where(F.col("order_id").isNotNull())
    entry = F.struct("queue_pos", "order_id", "remaining")
    pages = live.groupBy("symbol", "side", "price", F.floor(F.col("queue_pos") / size).cast("int").alias("page")).agg(
        F.array_sort(F.collect_list(entry)).alias("_entries"))
    return pages.select(
        "symbol", "side", "price", "page", (F.col("page") * size).alias("first_pos"),
        F.transform("_entries", lambda e: F.struct(e["order_id"].alias("order_id"), e["remaining"].alias("remaining"))
                    ).alias("entries"))


def page_cut(pages: DataFrame, index: int) -> DataFrame:
    """SRT-4 on pages: the order at ``index`` (0-based) leaves its level's
    queue. Only its page's array changes, later pages start one place sooner;
    a queue that is not that long stays as it is, an emptied page goes."""
    at = F.lit(index) - F.col("first_pos")
    here = (at >= 0) & (at < F.size("entries"))
    rest = F.concat(F.slice("entries", 1, at), F.slice("entries", at + 2, F.greatest(F.size("entries") - at - 1, F.lit(0))))
    cut = pages.select("symbol", "side", "price", "page",
                       F.when(F.col("first_pos") > index, F.col("first_pos") - 1).otherwise(F.col("first_pos")).alias("first_pos"),
                       F.when(here, rest).otherwise(F.col("entries")).alias("entries"))
    return cut.where(F.size("entries") > 0)


def page_element(pages: DataFrame, index: int) -> DataFrame:
    """The order that ``page_cut`` takes out of each level that is that long."""
    found = F.try_element_at("entries", F.lit(index) - F.col("first_pos") + 1)
    return pages.where((F.col("first_pos") <= index) & (F.lit(index) - F.col("first_pos") < F.size("entries"))).select(
        "symbol", "side", "price", found["order_id"].alias("order_id"), found["remaining"].alias("remaining"))


def page_orders(pages: DataFrame) -> DataFrame:
    """The rows of the book's queues again: (symbol, side, price, order_id, remaining, queue_pos)."""
    return pages.select("symbol", "side", "price", "first_pos", F.posexplode("entries").alias("p", "e")).select(
        "symbol", "side", "price", "e.order_id", "e.remaining", (F.col("first_pos") + F.col("p")).cast("int").alias("queue_pos"))


def queue_position(book: DataFrame) -> DataFrame:
    """WIN-1: FIFO position within a level, 1-based (the fold numbers queues)."""
    live = book.where(F.col("order_id").isNotNull()).select(
        "symbol", "side", "price", "queue_pos", "order_id", "remaining")
    return live.withColumn("position", (F.col("queue_pos") + 1).cast("int")).drop("queue_pos")


def match_priority(book: DataFrame) -> DataFrame:
    """WIN-2: the order in which a sweep meets the resting orders."""
    live = book.where(F.col("order_id").isNotNull()).select(
        "symbol", "side", "price", "level_seq", "queue_pos", "order_id", "remaining")
    return running_count(live, ["symbol", "side"], ["level_seq", "queue_pos"], "priority").drop(
        "level_seq", "queue_pos")


def book_depth(book: DataFrame) -> DataFrame:
    """WIN-3: cumulative quantity met by a sweep, from the best level outward."""
    live = book.where(F.col("order_id").isNotNull()).select(
        "symbol", "side", "price", "level_seq", "queue_pos", "order_id", "remaining")
    return running_sums(live, ["symbol", "side"], ["level_seq", "queue_pos"],
                        {"cum_depth": "remaining"}).drop("level_seq", "queue_pos")


def _ladder(book: DataFrame, side: str, ascending: bool) -> DataFrame:
    levels = book.where(F.col("side") == side).groupBy("symbol", "price").agg(
        F.sum("remaining").cast("bigint").alias("volume"))
    levels = levels.withColumn("_lk", F.col("price") if ascending else -F.col("price"))
    return running_count(levels, ["symbol"], ["_lk"], "rank").drop("_lk")


def ask_ladder(book: DataFrame) -> DataFrame:
    """SRT-1: ask prices ascending per symbol."""
    return _ladder(book, "SELL", True)


def bid_ladder(book: DataFrame) -> DataFrame:
    """SRT-2: bid prices descending per symbol."""
    return _ladder(book, "BUY", False)


def top_levels(book: DataFrame, k: int = 3) -> DataFrame:
    """SRT-3: the k levels a taker meets first, per symbol and side (top-k
    report; the limit is the feature)."""
    return book.where(F.col("level_seq") < k).groupBy("symbol", "side", "price").agg(
        F.min("level_seq").alias("level_seq"),
        F.sum("remaining").cast("bigint").alias("volume")).withColumn(
        "rank", (F.col("level_seq") + 1).cast("int"))


def queue_cut(book: DataFrame, index: int = 0) -> DataFrame:
    """SRT-4: remove the ``index``-th order (0-based) of every level's queue
    and close the gap; out of range leaves a queue unchanged."""
    live = book.where(F.col("order_id").isNotNull() & (F.col("queue_pos") != index))
    shift = F.when(F.col("queue_pos") > index, F.lit(1)).otherwise(F.lit(0))
    return live.select("symbol", "side", "price", "order_id", "remaining",
                       (F.col("queue_pos") - shift).cast("int").alias("queue_pos"))


def queue_removed(book: DataFrame, index: int = 0) -> DataFrame:
    """SRT-4, the other half: per level the order that ``queue_cut`` takes out,
    or NULL and ``in_range`` false where the queue is not that long."""
    live = book.where(F.col("order_id").isNotNull())
    taken = F.col("queue_pos") == index
    return live.groupBy("symbol", "side", "price").agg(
        F.max(F.when(taken, F.col("order_id"))).alias("removed_order_id"),
        F.max(F.when(taken, F.col("remaining"))).alias("removed_quantity"),
        F.max(taken).alias("in_range"))
