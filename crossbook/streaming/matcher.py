"""Continuous matching on Structured Streaming (STR-1, STR-2, STR-5, STR-7).

    orders stream -> groupBy(symbol).transformWithState(MatchProcessor)

State per symbol (RocksDB when configured): the book's levels with their FIFO
queues and the index of their prices (``state_book``), plus the last processed
row. A micro-batch folds its rows with the same ``Book`` kernel and in the same
total order as the batch plan (seq, then every other column, NULL first),
loading only the levels it touches and writing back only those. Rows that are
not above the last processed row of their symbol in that order (redelivery, or
an out-of-order producer) are emitted as ``late`` and never matched.

A symbol's rows of one micro-batch are sorted in bounded memory: up to RUN_ROWS
in one go; more become sorted runs, kept in state in pieces of PIECE_ROWS, that
are merged while the fold reads them.

Mid prices (STR-5) come on a fixed grid, from one of two clocks.
``event_tick_us``: the orders' own timestamps. A grid time is sampled when a
later order of its symbol arrives, and with ``watermark_delay`` also by an
event-time timer once the watermark passes it; the mids are the same on every
replay. ``mid_tick_ms``: a processing-time timer, for a live display.

Output rows use the batch plan's raw schema: kind = fill | late | mid | top | order.
They leave the processor packed, a symbol's rows of one kind as arrays, and the
mids between two changes of the book as their first time and number; Spark
expands both (``unpack``).
"""

from __future__ import annotations

import heapq
from itertools import batched, islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from crossbook.plans.kernel import BUY, RAW_COLUMNS, SELL, Book, RawWriter, fold_symbol
from crossbook.plans.match import RAW_SCHEMA, ship_package
from crossbook.streaming.state_book import StateBook


SEED_ROW = "seq long, order_id string, price double, quantity long, timestamp long"
ROW_FIELDS = ("seq", "order_id", "price", "quantity", "timestamp")
RUN_KEY = "run long, piece long"
RUN_VALUE = ("seq array<long>, order_id array<string>, price array<double>, quantity array<long>, "
             "timestamp array<long>")

#: Rows sorted at a time, rows of a piece of a sorted run in state, and rows
#: folded before their output leaves.
RUN_ROWS = 50_000
PIECE_ROWS = 1_000
OUTPUT_ROWS = 4_096


def arrival_key(row):
    """Sort key of (seq, order_id, price, quantity, timestamp) that orders
    rows as the batch plan's sort does: NULL first, NaN last."""
    return tuple((0, 0) if v is None else (2, 0) if v != v else (1, v) for v in row)


def _rows(writer: RawWriter):
    cols = writer.take()
    for i in range(len(cols["kind"])):
        yield Row(**{name: cols[name][i] for name in RAW_COLUMNS})


class SortedRuns:
    """Rows in arrival order, whatever their number: more than RUN_ROWS wait
    in state as sorted runs."""

    def __init__(self, state, run_rows: int | None = None, piece_rows: int | None = None):
        self.state = state
        self.run_rows, self.piece_rows = run_rows or RUN_ROWS, piece_rows or PIECE_ROWS

    def ordered(self, rows):
        """``rows`` one by one in arrival order. At most run_rows, or one piece
        of each run, are held; pieces leave state as they are read."""
        rows = iter(rows)
        first = sorted(islice(rows, self.run_rows), key=arrival_key)
        if len(first) < self.run_rows:
            return iter(first)
        sizes = []
        while first:
            for n, piece in enumerate(batched(first, self.piece_rows)):
                self.state.updateValue((len(sizes), n), tuple(list(c) for c in zip(*piece)))
            sizes.append(n + 1)
            first = sorted(islice(rows, self.run_rows), key=arrival_key)
        return heapq.merge(*[self._read(run, n) for run, n in enumerate(sizes)], key=arrival_key)

    def _read(self, run: int, pieces: int):
        for n in range(pieces):
            columns = self.state.getValue((run, n))
            self.state.removeKey((run, n))
            yield from zip(*columns)


class EventTicks:
    """Mids on a grid of event time, as of each grid time: changes at the same
    instant come first. Holds the next grid time to sample; none before the
    first top-of-book change."""

    def __init__(self, tick_us: int, due: int | None):
        self.tick_us, self.due, self.was = tick_us, due, due

    def upto(self, stop: int, top):
        """The samples due before ``stop``, if the book has both sides and a
        bid above 0: [(first grid time, their number, bid, ask)], or []."""
        bid, ask = top
        if self.due is None or self.due >= stop:
            return []
        first, n = self.due, -(-(stop - self.due) // self.tick_us)
        self.due += n * self.tick_us
        return [(first, n, bid, ask)] if bid is not None and ask is not None and bid > 0 else []

    def start(self, ts: int) -> None:
        if self.due is None:
            self.due = -(-ts // self.tick_us) * self.tick_us


class MatchProcessor(StatefulProcessor):
    """One book per grouping key (the symbol)."""

    def __init__(self, level_priority: str = "best_price", residual: str = "tail",
                 mid_tick_ms: int | None = None, emit_orders: bool = False, seeded: bool = False,
                 event_tick_us: int | None = None, timers: bool = False, run_rows: int | None = None,
                 piece_rows: int | None = None, packed: bool = False):
        Book(level_priority, residual)  # validate
        self.level_priority = level_priority
        self.residual = residual
        self.mid_tick_ms = mid_tick_ms
        self.emit_orders = emit_orders
        self.seeded = seeded
        self.event_tick_us = event_tick_us
        self.timers = timers
        self.run_rows, self.piece_rows = run_rows, piece_rows
        self.packed = packed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = StateBook(handle)
        self.runs = SortedRuns(handle.getMapState("runs", RUN_KEY, RUN_VALUE), self.run_rows, self.piece_rows)
        if self.event_tick_us:
            self.due = handle.getValueState("due", "due long")
        if self.seeded:
            self.seeds = handle.getListState("seeds", SEED_ROW)

    # -- state io -------------------------------------------------------
    def _load(self):
        book, last, self._next_level = self.state.load(self.level_priority, self.residual)
        return book, last

    def _save(self, book: Book, last) -> None:
        self.state.save(book, last, self._next_level)

    def _ticks(self) -> EventTicks | None:
        if not self.event_tick_us:
            return None
        due = self.due.get()
        return EventTicks(self.event_tick_us, None if due is None else due[0])

    def _keep(self, ticks: EventTicks | None) -> None:
        """Write the next grid time, and wake up for it."""
        if ticks is None or ticks.due == ticks.was:
            return
        self.due.update((ticks.due,))
        if self.timers:
            if ticks.was is not None:
                self.handle.deleteTimer(-(-ticks.was // 1000))
            self.handle.registerTimer(-(-ticks.due // 1000))

    def _emit(self, symbol, writer: RawWriter, spans=()):
        """Output rows of what was written and of samples."""
        if self.packed:
            yield from _packed(symbol, writer, spans)
        else:
            yield from _rows(writer)
            yield from _mids(symbol, self.event_tick_us, spans)

    def _arm_timer(self, timer_values) -> None:
        if not self.mid_tick_ms:
            return
        if not list(self.handle.listTimers()):
            now = timer_values.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(now - now % self.mid_tick_ms + self.mid_tick_ms)

    # -- callbacks ------------------------------------------------------
    def handleInputRows(self, key, rows, timerValues):
        symbol = key[0]
        book, last = self._load()
        writer = RawWriter()
        ticks = self._ticks()
        fold_symbol(book, symbol, self._waiting_seeds(), writer, late_check=False,
                    emit_orders=self.emit_orders)
        done = None if last is None else arrival_key(last)
        # match_stream's rows are the symbol and ROW_FIELDS, by place
        fields = slice(1, 1 + len(ROW_FIELDS))
        ordered = self.runs.ordered(r[fields] if self.packed else tuple(r[f] for f in ROW_FIELDS) for r in rows)
        for some in batched(ordered, OUTPUT_ROWS):
            fresh = some if done is None else [r for r in some if arrival_key(r) > done]
            for seq, order_id, price, quantity, timestamp in some[:len(some) - len(fresh)]:
                writer.rest(symbol, BUY if (quantity or 0) > 0 else SELL, price, None, None, order_id,
                            seq, quantity, timestamp, kind="late")
            if ticks is None:
                fold_symbol(book, symbol, fresh, writer, late_check=False, emit_orders=self.emit_orders)
                yield from self._emit(symbol, writer)
            else:
                yield from self._fold_ticking(book, symbol, fresh, writer, ticks)
            last = fresh[-1] if fresh else last
        yield from self._emit(symbol, writer)
        self._save(book, last)
        self._keep(ticks)
        self._arm_timer(timerValues)

    def _fold_ticking(self, book: Book, symbol, rows, writer: RawWriter, ticks: EventTicks):
        """Fold rows one by one, sampling the grid times before each, with a
        row per change of the top of the book."""
        top = book.top()
        spans = []
        for row in rows:
            ts = row[4]
            if ts is not None:
                spans += ticks.upto(ts, top)
            fold_symbol(book, symbol, (row,), writer, late_check=False, emit_orders=self.emit_orders)
            now = book.top()
            if now != top:
                top = now
                writer.top(symbol, row[0], ts, top[0], top[1], book.arrivals - 1)
                if ts is not None:
                    ticks.start(ts)
            if writer.n >= OUTPUT_ROWS:
                yield from self._emit(symbol, writer, spans)
                spans = []
        yield from self._emit(symbol, writer, spans)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """STR-7: seed orders (e.g. one bid and one ask) wait for the symbol's
        first order; they are folded before it, in arrival order, and their own
        fills come out with its. They make no order late. All of a symbol's
        seeds come in one row, as arrays."""
        self.seeds.put(list(zip(*(initialState[f] for f in ROW_FIELDS))))

    def _waiting_seeds(self):
        if not self.seeded or not self.seeds.exists():
            return []
        rows = sorted((tuple(r) for r in self.seeds.get()), key=arrival_key)
        self.seeds.clear()
        return rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """STR-5: sample the mid once per tick while both sides exist. Event
        time: all grid times up to the watermark, which no later order precedes."""
        top = self.state.top()
        if self.event_tick_us:
            ticks = self._ticks()
            spans = ticks.upto(timerValues.getCurrentWatermarkInMs() * 1000 + 1, top)
            yield from self._emit(key[0], RawWriter(), spans)
            self._keep(ticks)
            return
        fired = expiredTimerInfo.getExpiryTimeInMs()
        if self.mid_tick_ms:
            self.handle.registerTimer(fired + self.mid_tick_ms)
        if top[0] is not None and top[1] is not None and top[0] > 0:
            yield from self._emit(key[0], RawWriter(), [(fired * 1000, 1, *top)])

    def close(self) -> None:
        pass


def _mids(symbol, tick_us, spans):
    """``mid`` rows of samples, see EventTicks.upto."""
    empty = dict.fromkeys(RAW_COLUMNS)
    for first, n, bid, ask in spans:
        for i in range(n):
            yield Row(**(empty | {"kind": "mid", "symbol": symbol, "timestamp": first + i * (tick_us or 0),
                                  "price": (bid + ask) / 2, "best_bid": bid, "best_ask": ask}))


MID_FIELDS = ("kind", "symbol", "timestamp", "best_bid", "best_ask", "price", "ticks")
PACKED_COLUMNS = (*RAW_COLUMNS, "ticks")
PACKED_SCHEMA = StructType([StructField(f.name, ArrayType(f.dataType)) for f in RAW_SCHEMA.fields]
                           + [StructField("ticks", ArrayType(LongType()))])


def _packed(symbol, writer: RawWriter, spans):
    """One row of arrays per kind of output; a column that a kind never sets is null."""
    parts = writer.take_parts()
    if spans:
        first, n, bid, ask = zip(*spans)
        mids = ("mid",) * len(n), (symbol,) * len(n), first, bid, ask, tuple((b + a) / 2 for b, a in zip(bid, ask)), n
        parts.append((None, MID_FIELDS, mids))
    empty = dict.fromkeys(PACKED_COLUMNS)
    for kind, fields, columns in parts:
        row = empty | dict(zip(fields, columns))
        if kind is not None:
            row["kind"] = (kind,) * len(columns[0])
        yield Row(**row)


def unpack(packed: DataFrame, tick_us: int | None) -> DataFrame:
    """Packed rows as rows of RAW_SCHEMA; the ``ticks`` mids from one time on
    as a row each."""
    none = F.array()
    zipped = F.arrays_zip(*[F.coalesce(F.col(f.name), none.cast(f.dataType)) for f in PACKED_SCHEMA.fields])
    rows = ArrayType(StructType([StructField(f.name, f.dataType.elementType) for f in PACKED_SCHEMA.fields]))
    out = packed.select(F.inline(zipped.cast(rows)))
    if tick_us:
        more = F.when(F.col("ticks") > 1, F.sequence(F.lit(0).cast("long"), F.col("ticks") - 1)).otherwise(
            F.array(F.lit(0).cast("long")))
        out = out.withColumn("n", F.explode(more)).withColumn("timestamp", F.col("timestamp") + F.col("n") * tick_us)
    return out.select(*RAW_COLUMNS)


def match_stream(orders: DataFrame, level_priority: str = "best_price", residual: str = "tail",
                 mid_tick_ms: int | None = None, seeds: DataFrame | None = None,
                 emit_orders: bool = False, event_tick_us: int | None = None,
                 watermark_delay: str | None = None, run_rows: int | None = None,
                 piece_rows: int | None = None) -> DataFrame:
    """Streaming form of ``match_orders``: a streaming DataFrame of raw rows
    (kind = fill | late | mid, and with ``emit_orders`` an ``order`` row when
    an order completes: filled, a no-op, or deleted with its level).
    ``orders`` needs seq, order_id, price, quantity and, as in the batch form,
    may have symbol (default 'X') and timestamp; ``seeds`` (batch DataFrame, same
    columns) becomes the initial state, folded with each symbol's first order.

    ``event_tick_us`` adds ``mid`` rows on a grid of the orders' timestamps
    (epoch microseconds, which must not fall within a symbol) and ``top`` rows.
    With ``watermark_delay`` (such as "1 hour") event-time timers sample grid
    times that no later order of the symbol has passed yet. Spark then drops
    orders that are later than that behind the newest timestamp, or without a
    timestamp, before they get here; without it nothing is dropped.
    ``run_rows``, ``piece_rows``: see SortedRuns."""
    if mid_tick_ms and event_tick_us:
        raise ValueError("mids come from one clock: mid_tick_ms or event_tick_us")
    ship_package()
    timers = bool(event_tick_us and watermark_delay)

    def typed(df):
        symbol = F.col("symbol") if "symbol" in df.columns else F.lit("X")
        ts = F.col("timestamp") if "timestamp" in df.columns else F.lit(None)
        return df.select(
            symbol.cast("string").alias("symbol"), F.col("seq").cast("bigint").alias("seq"),
            F.col("order_id").cast("string").alias("order_id"), F.col("price").cast("double").alias("price"),
            F.col("quantity").cast("bigint").alias("quantity"), ts.cast("bigint").alias("timestamp"))

    rows = typed(orders)
    if timers:
        rows = rows.withColumn("event_time", F.timestamp_micros("timestamp")).withWatermark(
            "event_time", watermark_delay)
    initial = None
    if seeds is not None:
        # a symbol's seeds in one row: one call of the processor and one write
        by_symbol = typed(seeds).groupBy("symbol").agg(F.collect_list(F.struct(*ROW_FIELDS)).alias("rows"))
        initial = by_symbol.select("symbol", *[F.col(f"rows.{f}").alias(f) for f in ROW_FIELDS]).groupBy("symbol")
    packed = rows.groupBy("symbol").transformWithState(
        MatchProcessor(level_priority, residual, mid_tick_ms, emit_orders, seeds is not None, event_tick_us, timers,
                       run_rows, piece_rows, packed=True),
        PACKED_SCHEMA, "Append", "ProcessingTime" if mid_tick_ms else "EventTime" if timers else "None",
        initialState=initial)
    return unpack(packed, event_tick_us)


def stream_fills(raw: DataFrame) -> DataFrame:
    """Fills of a raw output (same columns as ``MatchResult.fills``)."""
    from crossbook.plans.match import MatchResult
    return MatchResult(raw).fills


def stream_mids(raw: DataFrame) -> DataFrame:
    """Sampled mids of a raw output (the columns of ``operators.prices.mid_ticks``)."""
    return raw.where(F.col("kind") == "mid").select(
        "symbol", F.col("timestamp").alias("tick_ts"), "best_bid", "best_ask", F.col("price").alias("mid_price"))
