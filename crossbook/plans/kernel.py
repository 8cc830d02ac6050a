"""The per-symbol matching fold.

This is the one piece of row-at-a-time logic in the library: matching is a
sequential fold (the book after order n decides order n+1), so no aggregate
or join can compute it. Spark partitions the work by symbol, sorts each
partition by (symbol, seq) and streams it through this fold in Arrow batches;
only one symbol's book is held at a time. The streaming matcher uses the same
``Book`` class as its per-symbol state.

Policies (see README):
  level_priority  ``best_price``  best price level first (price-time priority)
                  ``first_seen``  the first-inserted surviving level is "best";
                                  an emptied level removes the most recently
                                  inserted level (parity with the original service)
  residual        ``tail``  a partially filled maker re-queues at the end
                  ``head``  it keeps its place
"""

from __future__ import annotations

import heapq
from collections import deque

BUY = "BUY"
SELL = "SELL"
LEVEL_PRIORITIES = ("best_price", "first_seen")
RESIDUALS = ("tail", "head")

# Column order of the fold's output (see ``RAW_SCHEMA`` in plans.match).
RAW_COLUMNS = (
    "kind", "symbol", "seq", "fill_idx", "order_id", "maker_order_id",
    "maker_seq", "side", "price", "quantity", "taker_remaining",
    "maker_remaining", "timestamp", "level_seq", "queue_pos", "best_bid", "best_ask",
    "final_remaining", "n_fills", "arrival",
)


class _Side:
    """One side of one book: price -> FIFO queue of resting entries.

    An entry is a list ``[order_id, remaining, seq, timestamp, original, n_fills]``.
    """

    __slots__ = ("is_bid", "queues", "levels", "heap")

    def __init__(self, is_bid: bool):
        self.is_bid = is_bid
        self.queues: dict[float, deque] = {}
        self.levels: list[float] = []  # first_seen: insertion order
        self.heap: list[float] = []    # best_price: price (asks) / -price (bids)

    def best_price_level(self):
        heap, queues = self.heap, self.queues
        while heap:
            price = -heap[0] if self.is_bid else heap[0]
            if price in queues:
                return price
            heapq.heappop(heap)
        return None

    def add(self, price: float, entry: list, first_seen: bool) -> None:
        queue = self.queues.get(price)
        if queue is not None:
            queue.append(entry)
            return
        self.queues[price] = deque((entry,))
        if first_seen:
            self.levels.append(price)
        else:
            heapq.heappush(self.heap, -price if self.is_bid else price)

    def ordered_levels(self, first_seen: bool) -> list[float]:
        if first_seen:
            return list(self.levels)
        return sorted(self.queues, reverse=self.is_bid)


class Book:
    """Limit order book of one symbol."""

    __slots__ = ("bids", "asks", "first_seen", "head", "arrivals")

    def __init__(self, level_priority: str = "best_price", residual: str = "tail"):
        if level_priority not in LEVEL_PRIORITIES:
            raise ValueError(f"level_priority must be one of {LEVEL_PRIORITIES}")
        if residual not in RESIDUALS:
            raise ValueError(f"residual must be one of {RESIDUALS}")
        self.bids = _Side(True)
        self.asks = _Side(False)
        self.first_seen = level_priority == "first_seen"
        self.head = residual == "head"
        self.arrivals = 0  # orders processed so far; counted by the folds

    # -- matching -------------------------------------------------------
    def process(self, order_id, price, quantity, seq, timestamp, out, done=None) -> None:
        """Match one order; appends one tuple per fill to ``out``:
        (fill_idx, maker_order_id, maker_seq, qty, level_price, taker_side,
        taker_remaining, maker_remaining). With a ``done`` list, every order
        that reaches its final state (fully filled, a no-op, or deleted with
        its level) appends (order_id, seq, side, original, remaining, n_fills).

        This is the per-row hot path, so the best-price loop, the FIFO fill
        and the final rest are written inline."""
        if quantity is None:
            quantity = 0
        price = 0.0 if price is None else float(price)
        if quantity > 0:
            is_buy, taker_side, opp, own, remaining = True, BUY, self.asks, self.bids, quantity
            maker_side = SELL
        else:
            # zero quantity takes this branch too and is a no-op
            is_buy, taker_side, opp, own, remaining = False, SELL, self.bids, self.asks, -quantity
            maker_side = BUY
            if remaining <= 0:
                if done is not None:
                    done.append((order_id, seq, SELL, 0, 0, 0))
                return
        original = remaining
        queues = opp.queues
        fill_idx = 0
        head = self.head
        if self.first_seen:
            levels = opp.levels
            if levels and ((price >= levels[0]) if is_buy else (price <= levels[0])):
                level = levels[0]
                queue = queues[level]
                remaining, fill_idx = self._fill_queue(
                    queue, level, remaining, taker_side, fill_idx, out, done, maker_side)
                if not queue:
                    if remaining == 0:
                        last = levels.pop()
                        if done is not None:
                            self._dropped(queues[last], maker_side, done)
                        del queues[last]
                    else:
                        if done is not None:
                            for lv in levels:
                                self._dropped(queues[lv], maker_side, done)
                        levels.clear()
                        queues.clear()
        else:
            heap = opp.heap
            sign = -1.0 if opp.is_bid else 1.0
            while heap:
                level = sign * heap[0]
                if level not in queues:          # stale heap entry
                    heapq.heappop(heap)
                    continue
                if (price < level) if is_buy else (price > level):
                    break
                queue = queues[level]
                while queue:
                    maker = queue.popleft()
                    avail = maker[1]
                    qty = remaining if remaining < avail else avail
                    remaining -= qty
                    avail -= qty
                    maker[1] = avail
                    maker[5] += 1
                    out.append((fill_idx, maker[0], maker[2], qty, level, taker_side, remaining, avail))
                    fill_idx += 1
                    if avail > 0:
                        if head:
                            queue.appendleft(maker)
                        else:
                            queue.append(maker)
                    elif done is not None:
                        done.append((maker[0], maker[2], maker_side, maker[4], 0, maker[5]))
                    if remaining == 0:
                        break
                if not queue:
                    del queues[level]
                    heapq.heappop(heap)
                if remaining == 0:
                    break
        if remaining == 0:
            if done is not None:
                done.append((order_id, seq, taker_side, original, 0, fill_idx))
            return
        if remaining > 0:
            entry = [order_id, remaining, seq, timestamp, original, fill_idx]
            own_queues = own.queues
            queue = own_queues.get(price)
            if queue is not None:
                queue.append(entry)
            else:
                own_queues[price] = deque((entry,))
                if self.first_seen:
                    own.levels.append(price)
                else:
                    heapq.heappush(own.heap, -price if own.is_bid else price)

    def _fill_queue(self, queue, level, remaining, taker_side, fill_idx, out, done=None,
                    maker_side=None):
        while remaining > 0 and queue:
            maker = queue.popleft()
            qty = remaining if remaining < maker[1] else maker[1]
            remaining -= qty
            maker[1] -= qty
            maker[5] += 1
            out.append((fill_idx, maker[0], maker[2], qty, level, taker_side, remaining, maker[1]))
            fill_idx += 1
            if maker[1] > 0:
                if self.head:
                    queue.appendleft(maker)
                else:
                    queue.append(maker)
            elif done is not None:
                done.append((maker[0], maker[2], maker_side, maker[4], 0, maker[5]))
        return remaining, fill_idx

    @staticmethod
    def _dropped(queue, side, done) -> None:
        """first_seen: orders deleted together with their level end here."""
        for e in queue:
            done.append((e[0], e[2], side, e[4], e[1], e[5]))

    def rest(self, order_id, price, quantity, seq, timestamp) -> None:
        """Insert without matching (signed quantity kept as given)."""
        side = self.bids if (quantity or 0) > 0 else self.asks
        side.add(price, [order_id, quantity, seq, timestamp, abs(quantity or 0), 0], self.first_seen)

    # -- snapshot -------------------------------------------------------
    def snapshot(self):
        """Yield ``(side, price, level_seq, queue_pos, order_id, seq, remaining,
        timestamp)`` in priority order. An empty ("ghost") level of the
        first_seen policy is yielded once with order_id None."""
        for side_name, side in ((BUY, self.bids), (SELL, self.asks)):
            for level_seq, price in enumerate(side.ordered_levels(self.first_seen)):
                queue = side.queues[price]
                if not queue:
                    yield side_name, price, level_seq, None, None, None, 0, None
                    continue
                for pos, e in enumerate(queue):
                    yield side_name, price, level_seq, pos, e[0], e[2], e[1], e[3]

    def resting(self):
        """(side, entry) for every resting order."""
        for side_name, side in ((BUY, self.bids), (SELL, self.asks)):
            for queue in side.queues.values():
                for e in queue:
                    yield side_name, e

    @classmethod
    def from_snapshot(cls, rows, level_priority="best_price", residual="tail"):
        """Rebuild a book from ``snapshot()`` rows (any row order)."""
        book = cls(level_priority, residual)
        ordered = sorted(rows, key=lambda r: (r[0], r[2], -1 if r[3] is None else r[3]))
        for side_name, price, _level_seq, pos, oid, oseq, rem, ots in ordered:
            side = book.bids if side_name == BUY else book.asks
            if price not in side.queues:
                side.queues[price] = deque()
                if book.first_seen:
                    side.levels.append(price)
                else:
                    heapq.heappush(side.heap, -price if side.is_bid else price)
            if pos is not None:
                side.queues[price].append([oid, rem, oseq, ots, rem, 0])
        return book

    def top(self):
        """(best bid, best ask); None for an empty side. first_seen reads
        the first level even when it is a ghost."""
        if self.first_seen:
            bid = self.bids.levels[0] if self.bids.levels else None
            ask = self.asks.levels[0] if self.asks.levels else None
            return bid, ask
        return self.bids.best_price_level(), self.asks.best_price_level()


# Fields of each output kind, in tuple order (the rest of RAW_COLUMNS is NULL).
FILL_FIELDS = ("symbol", "seq", "fill_idx", "order_id", "maker_order_id", "maker_seq", "side",
               "price", "quantity", "taker_remaining", "maker_remaining", "timestamp", "arrival")
REST_FIELDS = ("kind", "symbol", "seq", "order_id", "side", "price", "quantity", "timestamp",
               "level_seq", "queue_pos")
TOP_FIELDS = ("symbol", "seq", "timestamp", "best_bid", "best_ask", "arrival")
ORDER_FIELDS = ("symbol", "order_id", "seq", "side", "quantity", "final_remaining", "n_fills")


class RawWriter:
    """Collects fold output as tuples, one list per kind of row."""

    __slots__ = ("fill_rows", "rest_rows", "top_rows", "order_rows")

    def __init__(self):
        self.fill_rows, self.rest_rows, self.top_rows, self.order_rows = [], [], [], []

    @property
    def n(self) -> int:
        return len(self.fill_rows) + len(self.rest_rows) + len(self.top_rows) + len(self.order_rows)

    def orders(self, symbol, done) -> None:
        """Final-state rows from ``Book.process(..., done=...)`` tuples."""
        add = self.order_rows.append
        for oid, seq, side, original, remaining, n_fills in done:
            add((symbol, oid, seq, side, original, remaining, n_fills))

    def fills(self, symbol, seq, order_id, timestamp, fills, arrival=None) -> None:
        """Rows for the tuples ``Book.process`` appended to ``fills``;
        ``arrival`` is the taker's place among all orders of its symbol."""
        add = self.fill_rows.append
        for fill_idx, m_oid, m_seq, qty, level, side, t_rem, m_rem in fills:
            add((symbol, seq, fill_idx, order_id, m_oid, m_seq, side, level, qty, t_rem, m_rem, timestamp,
                 arrival))

    def top(self, symbol, seq, timestamp, bid, ask, arrival=None) -> None:
        self.top_rows.append((symbol, seq, timestamp, bid, ask, arrival))

    def rest(self, symbol, side, price, level_seq, queue_pos, order_id, seq,
             remaining, timestamp, kind="rest") -> None:
        self.rest_rows.append((kind, symbol, seq, order_id, side, price, remaining, timestamp,
                               level_seq, queue_pos))

    def take_parts(self):
        """[(kind or None, fields, columns)] per non-empty kind; resets."""
        parts = []
        for kind, fields, rows in (("fill", FILL_FIELDS, self.fill_rows),
                                   (None, REST_FIELDS, self.rest_rows),
                                   ("top", TOP_FIELDS, self.top_rows),
                                   ("order", ORDER_FIELDS, self.order_rows)):
            if rows:
                parts.append((kind, fields, list(zip(*rows))))
        self.fill_rows, self.rest_rows, self.top_rows, self.order_rows = [], [], [], []
        return parts

    def take(self) -> dict:
        """All rows as columns (name -> list) in RAW_COLUMNS; resets."""
        out = {name: [] for name in RAW_COLUMNS}
        for kind, fields, cols in self.take_parts():
            n = len(cols[0])
            by_name = dict(zip(fields, cols))
            if kind is not None:
                by_name["kind"] = [kind] * n
            for name in RAW_COLUMNS:
                out[name].extend(by_name.get(name, (None,) * n))
        return out


def fold_symbol(book: Book, symbol, rows, writer: RawWriter, last_seq=None, late_check=True,
                emit_orders=False):
    """Run ``rows`` = iterable of (seq, order_id, price, quantity, timestamp)
    through ``book``; write fills, and ``late`` rows for rows whose seq is
    not above the last one processed (when ``late_check``). Returns the last
    seq processed."""
    out = []
    done = [] if emit_orders else None
    for seq, order_id, price, quantity, timestamp in rows:
        if late_check and last_seq is not None and seq is not None and seq <= last_seq:
            writer.rest(symbol, BUY if (quantity or 0) > 0 else SELL, price, None,
                        None, order_id, seq, quantity, timestamp, kind="late")
            continue
        book.process(order_id, price, quantity, seq, timestamp, out, done)
        if out:
            writer.fills(symbol, seq, order_id, timestamp, out, book.arrivals)
            out.clear()
        if done:
            writer.orders(symbol, done)
            done.clear()
        book.arrivals += 1
        if seq is not None:
            last_seq = seq if last_seq is None else max(last_seq, seq)
    return last_seq


def write_resting_orders(book: Book, symbol, writer: RawWriter):
    """Final-state rows for the orders still resting at the end; yields after
    each, so that the caller can take what was written."""
    for side, e in book.resting():
        writer.order_rows.append((symbol, e[0], e[2], side, e[4], e[1], e[5]))
        yield


def write_snapshot(book: Book, symbol, writer: RawWriter):
    """Rows of the resting book; yields after each."""
    for side, price, level_seq, pos, oid, oseq, rem, ots in book.snapshot():
        writer.rest(symbol, side, price, level_seq, pos, oid, oseq, rem, ots)
        yield
