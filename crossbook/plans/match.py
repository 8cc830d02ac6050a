"""Batch matching plan (STR-1, STR-2, STR-4).

    orders -> project -> hash shuffle by symbol -> sort (symbol, seq, ties)
           -> mapInArrow(fold) -> raw rows (kind = fill | rest | top | order)

One shuffle, keyed by symbol; the sort is Spark's external sort, so it
spills instead of failing on large partitions. The fold streams Arrow
batches and keeps only the current symbol's book in memory, so a task's
memory is bounded by one book, not by its partition. The partition count is
``spark.sql.shuffle.partitions`` unless given: the fold is CPU-bound per row,
so the shuffle is not left to AQE to coalesce by bytes.

Limit: matching is sequential within a symbol, so one symbol is one task.
A symbol holding a third of all orders runs as one long task (still
streaming, still spilling in the sort); nothing is dropped or sampled.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType,
                               StructField, StructType)

from crossbook.functions.scan import running_count
from crossbook.plans.kernel import (RAW_COLUMNS, Book, RawWriter, write_resting_orders,
                                   write_snapshot)
from crossbook.session import ensure_checkpoint_dir, reliable_checkpoint

RAW_SCHEMA = StructType([
    StructField("kind", StringType(), False),
    StructField("symbol", StringType(), True),
    StructField("seq", LongType(), True),
    StructField("fill_idx", IntegerType(), True),
    StructField("order_id", StringType(), True),
    StructField("maker_order_id", StringType(), True),
    StructField("maker_seq", LongType(), True),
    StructField("side", StringType(), True),
    StructField("price", DoubleType(), True),
    StructField("quantity", LongType(), True),
    StructField("taker_remaining", LongType(), True),
    StructField("maker_remaining", LongType(), True),
    StructField("timestamp", LongType(), True),
    StructField("level_seq", IntegerType(), True),
    StructField("queue_pos", IntegerType(), True),
    StructField("best_bid", DoubleType(), True),
    StructField("best_ask", DoubleType(), True),
    StructField("final_remaining", LongType(), True),
    StructField("n_fills", IntegerType(), True),
    StructField("arrival", LongType(), True),
])
assert tuple(f.name for f in RAW_SCHEMA.fields) == RAW_COLUMNS

ARROW_SCHEMA = pa.schema([
    ("kind", pa.string()), ("symbol", pa.string()), ("seq", pa.int64()),
    ("fill_idx", pa.int32()), ("order_id", pa.string()),
    ("maker_order_id", pa.string()), ("maker_seq", pa.int64()),
    ("side", pa.string()), ("price", pa.float64()), ("quantity", pa.int64()),
    ("taker_remaining", pa.int64()), ("maker_remaining", pa.int64()),
    ("timestamp", pa.int64()), ("level_seq", pa.int32()), ("queue_pos", pa.int32()),
    ("best_bid", pa.float64()), ("best_ask", pa.float64()),
    ("final_remaining", pa.int64()), ("n_fills", pa.int32()), ("arrival", pa.int64()),
])

FOLD_INPUT = ("symbol", "seq", "order_id", "price", "quantity", "timestamp")
OUTPUT_BATCH_ROWS = 1 << 15


def ship_package() -> None:
    """Pickle this package by value so executors need no install of it."""
    cloudpickle.register_pickle_by_value(sys.modules["crossbook"])


def _arrow(values, typ) -> pa.Array:
    """Python values -> Arrow; numeric columns without nulls go through numpy."""
    if (pa.types.is_integer(typ) or pa.types.is_floating(typ)) and None not in values:
        return pa.array(np.array(values, dtype=typ.to_pandas_dtype()), type=typ)
    return pa.array(values, type=typ)


def _to_batches(writer: RawWriter):
    """One Arrow batch per kind of row; columns a kind never sets are null
    arrays (no per-element conversion)."""
    for kind, fields, cols in writer.take_parts():
        n = len(cols[0])
        by_name = dict(zip(fields, cols))
        arrays = []
        for f in ARROW_SCHEMA:
            if f.name == "kind" and kind is not None:
                arrays.append(pa.array([kind] * n, type=f.type))
            elif f.name in by_name:
                arrays.append(_arrow(by_name[f.name], f.type))
            else:
                arrays.append(pa.nulls(n, type=f.type))
        yield pa.RecordBatch.from_arrays(arrays, schema=ARROW_SCHEMA)


def _column_lists(batch: pa.RecordBatch):
    """Input columns as Python lists (numpy-backed conversion: much faster
    than Arrow's per-element to_pylist)."""
    out = []
    for name in FOLD_INPUT:
        col = batch.column(name)
        if col.null_count:
            out.append(col.to_pylist())
        else:
            out.append(col.to_numpy(zero_copy_only=False).tolist())
    return out


def _close_symbol(book, symbol, writer, emit_orders, emit_book):
    """Rows of a finished symbol's resting orders, in batches of bounded size."""
    for wanted, write in ((emit_orders, write_resting_orders), (emit_book, write_snapshot)):
        if not wanted:
            continue
        rows = write(book, symbol, writer)
        while True:
            room = max(1, OUTPUT_BATCH_ROWS - writer.n)
            if sum(1 for _ in islice(rows, room)) < room:
                break
            yield from _to_batches(writer)


def fold_batches(batches, level_priority="best_price", residual="tail", emit_top=False,
                 emit_orders=False, emit_fills=True, emit_book=True):
    """mapInArrow body: input sorted by (symbol, seq) within the partition.

    ``emit_top`` adds a ``top`` row (best bid, best ask) after every order
    that changed the top of the book; ``emit_orders`` one ``order`` row per
    order with its final state (when it completes, is deleted, or is still
    resting at the end). ``emit_fills`` and ``emit_book`` off leave out the
    ``fill`` and the ``rest`` rows."""
    writer = RawWriter()
    book = None
    current = None
    last_top = (None, None)
    out = []
    done = [] if emit_orders else None
    for batch in batches:
        for symbol, seq, order_id, price, quantity, ts in zip(*_column_lists(batch)):
            if symbol != current or book is None:
                if book is not None:
                    yield from _close_symbol(book, current, writer, emit_orders, emit_book)
                book = Book(level_priority, residual)
                current = symbol
                last_top = (None, None)
            book.process(order_id, price, quantity, seq, ts, out, done)
            if out:
                if emit_fills:
                    writer.fills(symbol, seq, order_id, ts, out, book.arrivals)
                    if len(writer.fill_rows) >= OUTPUT_BATCH_ROWS:
                        yield from _to_batches(writer)
                out.clear()
            if done:
                writer.orders(symbol, done)
                done.clear()
            if emit_top:
                top = book.top()
                if top != last_top:
                    writer.top(symbol, seq, ts, top[0], top[1], book.arrivals)
                    last_top = top
            book.arrivals += 1
        if writer.n >= OUTPUT_BATCH_ROWS:
            yield from _to_batches(writer)
    if book is not None:
        yield from _close_symbol(book, current, writer, emit_orders, emit_book)
    yield from _to_batches(writer)


@dataclass(frozen=True)
class MatchResult:
    """Output of one matching run. ``raw`` is the single fold output; derive
    several views from it after ``persist()`` / ``checkpoint()`` to avoid
    re-running the fold."""

    raw: DataFrame

    @property
    def fills(self) -> DataFrame:
        """One row per execution (taker x maker)."""
        return self.raw.where(F.col("kind") == "fill").select(
            "symbol",
            F.col("seq").alias("taker_seq"),
            "fill_idx",
            F.col("order_id").alias("taker_order_id"),
            "maker_order_id",
            "maker_seq",
            F.col("side").alias("taker_side"),
            "price",
            "quantity",
            "taker_remaining",
            "maker_remaining",
            "timestamp",
        )

    @property
    def prints(self) -> DataFrame:
        """``fills`` with ``arrival``, the taker's place among the orders of
        its symbol (from 0): unlike ``seq`` it never repeats."""
        return self._with_arrival("fill", self.fills)

    def _with_arrival(self, kind: str, view: DataFrame) -> DataFrame:
        old = {"taker_seq": "seq", "taker_order_id": "order_id", "taker_side": "side"}
        return self.raw.where(F.col("kind") == kind).select(
            *[F.col(old.get(c, c)).alias(c) for c in view.columns], "arrival")

    @property
    def book(self) -> DataFrame:
        """Resting orders after the last order of each symbol (STR-4)."""
        return self.raw.where(F.col("kind") == "rest").select(
            "symbol", "side", "price", "level_seq", "queue_pos", "order_id",
            "seq", F.col("quantity").alias("remaining"), "timestamp",
        )

    @property
    def tops(self) -> DataFrame:
        """Best bid / ask after each order that changed them (needs
        ``emit_top=True``)."""
        return self.raw.where(F.col("kind") == "top").select(
            "symbol", "seq", "timestamp", "best_bid", "best_ask")

    @property
    def top_changes(self) -> DataFrame:
        """``tops`` with ``arrival`` (see ``prints``)."""
        return self._with_arrival("top", self.tops)

    @property
    def order_states(self) -> DataFrame:
        """AGG-6 from the fold itself (needs ``emit_orders=True``): one row
        per order with original, filled and remaining quantity, number of
        fills and status. No join with the order table."""
        original = F.col("quantity")
        remaining = F.col("final_remaining")
        filled = original - remaining
        return self.raw.where(F.col("kind") == "order").select(
            "symbol", "order_id", "seq", "side",
            original.alias("original"), filled.alias("filled"), remaining.alias("remaining"),
            F.col("n_fills").cast("bigint").alias("n_fills"),
            F.when(original == 0, "noop").when(remaining == 0, "closed")
             .when(filled > 0, "partial").otherwise("open").alias("status"))

    def checkpoint(self, eager: bool = True) -> "MatchResult":
        """Cut lineage into the session's reliable checkpoint folder."""
        if not eager:
            ensure_checkpoint_dir(self.raw.sparkSession)
            return MatchResult(self.raw.checkpoint(eager=False))
        return MatchResult(reliable_checkpoint(self.raw))


def total_order(tiebreak=()) -> list[str]:
    """The order in which a symbol's orders are matched. Every input column
    breaks ties, so a retried task (or a rerun) sees the same order even when
    seq repeats: the fold's output is deterministic."""
    return ["seq", *tiebreak, *[c for c in ("order_id", "price", "quantity", "timestamp") if c not in tiebreak]]


def with_arrival(orders: DataFrame, tiebreak=()) -> DataFrame:
    """``orders`` with ``arrival``, their place (from 0) in the order in which
    their symbol's book receives them, as in ``MatchResult.prints``."""
    counted = running_count(orders, ["symbol"], total_order(tiebreak), "arrival", probe=orders.select("symbol"))
    return counted.withColumn("arrival", F.col("arrival").cast("bigint") - 1)


def _prepare(orders: DataFrame, tiebreak, num_partitions, assume_clustered=False) -> DataFrame:
    cols = set(orders.columns)
    symbol = F.col("symbol") if "symbol" in cols else F.lit("X")
    ts = F.col("timestamp").cast("bigint") if "timestamp" in cols else F.lit(None).cast("bigint")
    extra = [c for c in tiebreak if c in cols]
    df = orders.select(
        symbol.cast("string").alias("symbol"),
        F.col("seq").cast("bigint").alias("seq"),
        F.col("order_id").cast("string").alias("order_id"),
        F.col("price").cast("double").alias("price"),
        F.col("quantity").cast("bigint").alias("quantity"),
        ts.alias("timestamp"),
        *extra,
    )
    if not assume_clustered:
        # An explicit count: AQE must not coalesce this shuffle down to a few
        # tasks, because the fold is CPU-bound per row, not bytes-bound.
        n = num_partitions or int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(n, "symbol")
    return df.sortWithinPartitions("symbol", *total_order(extra)).select(*FOLD_INPUT)


def fold_load(orders: DataFrame) -> DataFrame:
    """How evenly a match of ``orders`` will spread, before it runs: one row
    with the number of symbols and orders and the largest symbol, whose orders
    one task folds. Without a symbol column all orders are one book."""
    symbol = F.col("symbol") if "symbol" in orders.columns else F.lit("X")
    per = orders.groupBy(symbol.alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    largest = F.max(F.struct("n", "symbol"))
    return per.agg(F.count(F.lit(1)).alias("symbols"), F.sum("n").alias("orders"),
                   largest["symbol"].alias("largest_symbol"), largest["n"].alias("largest_orders"),
                   (largest["n"] / F.sum("n")).alias("largest_share"))


def match_orders(orders: DataFrame, level_priority: str = "best_price",
                 residual: str = "tail", tiebreak=(), num_partitions: int | None = None,
                 emit_top: bool = False, emit_orders: bool = False,
                 assume_clustered: bool = False, emit_fills: bool = True,
                 emit_book: bool = True) -> MatchResult:
    """Match limit orders per symbol in ``seq`` order.

    ``orders`` needs ``seq, order_id, price, quantity`` (signed: >0 buy,
    otherwise sell) and optionally ``symbol`` (default 'X') and
    ``timestamp``. ``tiebreak`` orders rows with equal seq. Rows of a kind
    that is not read (``emit_fills``, ``emit_book`` off) are never built: no
    filter above reaches into the fold.

    ``assume_clustered``: every input partition already holds whole symbols,
    so the shuffle is skipped and only the per-partition sort remains. True
    for a frame just repartitioned by symbol, or for a table bucketed by
    symbol read as one partition per bucket: set
    ``spark.sql.sources.bucketing.autoBucketedScan.enabled=false``, since
    nothing in this plan asks for the bucketing and Spark would otherwise
    split or merge bucket files by size. Wrong results if the promise does
    not hold.
    """
    Book(level_priority, residual)  # validate policies on the driver
    ship_package()
    prepared = _prepare(orders, tiebreak, num_partitions, assume_clustered)

    def fold(batches):
        return fold_batches(batches, level_priority, residual, emit_top, emit_orders, emit_fills, emit_book)

    return MatchResult(prepared.mapInArrow(fold, RAW_SCHEMA))

