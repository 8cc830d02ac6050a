"""Price streams: merged price topics, carried prices, sampled mids, gap fill.

Time is epoch microseconds (BIGINT) throughout, as in the order records.
Sampling and heartbeats take the tick as a parameter (1 s by default; the
30-day fixtures use 1 hour). The as-of steps are "union + carry the last
non-null value" per symbol (``functions.scan``: a window, or a split scan
when a symbol is hot); no join pairs grid points with prices.

Rows of one symbol and time are ordered by ``arrival`` where they have it
(``MatchResult.prints``, ``top_changes``, ``plans.match.with_arrival``), which
never repeats; without it by seq, which must be unique within a symbol then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossbook.functions.scan import running_count, running_last, running_next

SECOND_US = 1_000_000
HOUR_US = 3600 * SECOND_US
# Fixed value: the trader pool's price before it has seen any.
INITIAL_PRICE = 50.0


def _place(df: DataFrame, seq: str):
    """What tells the order of a symbol's rows."""
    return F.col("arrival" if "arrival" in df.columns else seq).cast("bigint").alias("_place")


#: Grid points of one first-level step of ``explode_grid``.
GRID_CHUNK = 3600


def explode_grid(df: DataFrame, start, stop, step: int, name: str) -> DataFrame:
    """One row per ``start, start + step, ... <= stop``: runs of GRID_CHUNK
    points first, then the points of each run, so that no array grows with
    the span."""
    run = GRID_CHUNK * step
    runs = df.where(start <= stop).withColumn("_stop", stop).withColumn(
        "_run", F.explode(F.sequence(start, stop, F.lit(run))))
    last = F.least(F.col("_run") + (run - step), F.col("_stop"))
    return runs.withColumn(name, F.explode(F.sequence(F.col("_run"), last, F.lit(step)))).drop("_run", "_stop")


def price_stream(fills: DataFrame, probe: DataFrame | None = None) -> DataFrame:
    """SET-1: trade prices (two legs per fill) and price points (one per
    fill) merged into one stream, ordered by (timestamp, source, taker's place, k).
    One pass over the fills: each fill fans out to its three messages; the
    per-symbol ordinal is a skew-aware running count (``probe``: a cheap
    DataFrame with the symbol distribution, e.g. the orders)."""
    msgs = F.array(
        F.struct(F.lit("trade").alias("source"), (F.col("fill_idx") * 2).alias("k")),
        F.struct(F.lit("trade").alias("source"), (F.col("fill_idx") * 2 + 1).alias("k")),
        F.struct(F.lit("price").alias("source"), F.col("fill_idx").alias("k")))
    merged = (fills.select("symbol", "timestamp", "taker_seq", "price", _place(fills, "taker_seq"), F.explode(msgs).alias("m"))
              .select("symbol", "timestamp", F.col("m.source").alias("source"), "taker_seq",
                      F.col("m.k").cast("int").alias("k"), "price", "_place"))
    return running_count(merged, ["symbol"], ["timestamp", "source", "_place", "k"], "ord",
                         probe=probe if probe is not None else merged).drop("_place")


def last_price(orders: DataFrame, points: DataFrame, initial: float = INITIAL_PRICE) -> DataFrame:
    """WIN-4: for each order, the last price its symbol printed before it
    arrived (``initial`` before the first). A running "last non-null" per
    symbol over orders and prints, split across tasks when a symbol is hot
    (measured on the order scan)."""
    # an order sorts before its own fills (same place): it sees earlier prints only
    kept = [c for c in orders.columns if c in ("order_id", "arrival")] if "arrival" in orders.columns else []
    o = orders.select("symbol", "seq", *kept, _place(orders, "seq"), F.lit(None).cast("double").alias("price"),
                      F.lit(0).alias("kind"), F.lit(0).alias("fill_idx"))
    p = points.select("symbol", F.col("taker_seq").alias("seq"), _place(points, "taker_seq"), "price",
                      F.lit(1).alias("kind"), "fill_idx")
    carried = running_last(o.unionByName(p, allowMissingColumns=True), ["symbol"], ["_place", "kind", "fill_idx"],
                           {"_last": "price"}, probe=orders.select("symbol"))
    return carried.where(F.col("kind") == 0).select(
        "symbol", "seq", *kept, F.coalesce(F.col("_last"), F.lit(initial)).alias("last_price"))


# An empty side is carried as -inf so that bid and ask, both non-null on
# every top-of-book change, are carried together by a last-non-null scan.
_EMPTY_SIDE = float("-inf")


def mid_ticks(tops: DataFrame, tick_us: int = SECOND_US, probe: DataFrame | None = None) -> DataFrame:
    """STR-5 (batch): the mid price on a fixed grid of ``tick_us``, as of each
    grid time (top-of-book changes at the same instant come first), only
    where both sides exist and the bid is above 0.

    The grid spans each symbol's first to last top-of-book change
    (span / tick points, from a per-symbol aggregate); the as-of is a
    skew-aware carry of the last change. ``tops`` is read twice (bounds and
    changes): pass a materialised one (``MatchResult.checkpoint().top_changes``)."""
    bounds = tops.groupBy("symbol").agg(F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"))
    first = F.ceil(F.col("t0") / tick_us).cast("bigint") * tick_us
    last = F.floor(F.col("t1") / tick_us).cast("bigint") * tick_us
    grid = (explode_grid(bounds, first, last, tick_us, "ts")
            .select("symbol", "ts", F.lit(None).cast("long").alias("_place"), F.lit(1).alias("is_grid"),
                    F.lit(None).cast("double").alias("bid"), F.lit(None).cast("double").alias("ask")))
    changes = tops.select("symbol", F.col("timestamp").alias("ts"), _place(tops, "seq"), F.lit(0).alias("is_grid"),
                          F.coalesce("best_bid", F.lit(_EMPTY_SIDE)).alias("bid"),
                          F.coalesce("best_ask", F.lit(_EMPTY_SIDE)).alias("ask"))
    carried = running_last(changes.unionByName(grid), ["symbol"], ["ts", "is_grid", "_place"],
                           {"_bid": "bid", "_ask": "ask"},
                           probe=probe if probe is not None else tops.select("symbol"))
    asof = carried.where(F.col("is_grid") == 1).select(
        "symbol", F.col("ts").alias("tick_ts"),
        F.when(F.col("_bid") != _EMPTY_SIDE, F.col("_bid")).alias("best_bid"),
        F.when(F.col("_ask") != _EMPTY_SIDE, F.col("_ask")).alias("best_ask"))
    return (asof.where(F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull()
                       & (F.col("best_bid") > 0))
            .withColumn("mid_price", (F.col("best_bid") + F.col("best_ask")) / 2))


def price_heartbeat(points: DataFrame, tick_us: int = SECOND_US, probe: DataFrame | None = None) -> DataFrame:
    """STR-6 (batch): after each price, repeat it every ``tick_us`` while no
    new price arrives (the timer restarts on every price; not a fixed grid).
    The last price of a stream gets no beats: the batch ends there. The next
    print's time is a skew-aware ``lead`` per symbol."""
    spaced = running_next(points.select("symbol", "timestamp", _place(points, "taker_seq"), "fill_idx", "price"),
                          ["symbol"], ["timestamp", "_place", "fill_idx"], {"next_ts": "timestamp"},
                          probe=probe)
    start = F.col("timestamp") + tick_us
    return explode_grid(spaced, start, F.col("next_ts") - 1, tick_us, "beat_ts").select(
        "symbol", "price", F.col("timestamp").alias("source_ts"), "beat_ts")


def price_topic(points: DataFrame, ticks: DataFrame) -> DataFrame:
    """SET-2: fill prices and sampled mids share one price topic."""
    fills = points.select("symbol", "timestamp", F.lit("fill").alias("source"), "price")
    mids = ticks.select("symbol", F.col("tick_ts").alias("timestamp"), F.lit("mid").alias("source"),
                        F.col("mid_price").alias("price"))
    return fills.unionByName(mids)
