"""A symbol's book kept in transformWithState state, read from the top of the book.

State per symbol:
  queues  MapState (side, price) -> the level: its insertion counter and its
          FIFO queue as parallel arrays
  pages   MapState (side, page) -> best_price: a page of the price-ordered
          index of the levels (at most PAGE_KEYS prices or child pages)
  firsts  MapState (side, n) -> first_seen: the n-th level in insertion order
  meta    ValueState (last processed row as JSON, counters, best prices, and
          for each side the root page, the next page number, the level count)

A micro-batch reads the best level of a side through the index, each further
level only when the fold takes the one before it, and any other level by its
price. It writes back the levels it touched and the index pages of created and
removed ones. Its cost follows the levels it touches (and the index's height),
not the levels or orders that rest. State is not asked for what is known: a
symbol without meta has nothing there, and a best_price level is there if its
price is in the index. A timer reads the best prices alone.
"""

from __future__ import annotations

import heapq
import json
from bisect import bisect_left, bisect_right, insort
from collections import deque

from crossbook.plans.kernel import BUY, SELL, Book

LEVEL_KEY = "side string, price double"
QUEUE_VALUE = ("level_seq long, ids array<string>, remaining array<long>, seqs array<long>, ts array<long>, "
               "original array<long>, n_fills array<long>")
PAGE_KEY = "side string, page long"
PAGE_VALUE = "leaf boolean, keys array<double>, kids array<long>"
FIRST_KEY = "side string, n long"
FIRST_VALUE = "price double"
META = ("last string, next_level_seq long, best_bid double, best_ask double, arrivals long, "
        "bid_root long, bid_pages long, bid_levels long, ask_root long, ask_pages long, ask_levels long")
EMPTY_META = ("null", 0, None, None, 0, 0, 1, 0, 0, 1, 0)

#: Prices or child pages of one index page.
PAGE_KEYS = 64


class LevelIndex:
    """The prices of one side in the order in which a taker meets them, as a
    tree of pages. Keys are prices for asks and negated prices for bids, so the
    least key is the best level."""

    def __init__(self, side_name: str, state, root: int, pages: int, fresh: bool = False):
        self.side_name, self.state, self.fresh = side_name, state, fresh
        self.root, self.pages = root, pages
        self.held: dict[int, tuple[bool, list, list]] = {}
        self.changed: set[int] = set()
        self.gone: set[int] = set()

    def _page(self, n: int) -> tuple[bool, list, list]:
        if n not in self.held:
            key = (self.side_name, n)
            # only the first page may not have been written yet
            there = n or (not self.fresh and self.state.containsKey(key))
            leaf, keys, kids = self.state.getValue(key) if there else (True, (), ())
            self.held[n] = (leaf, list(keys), list(kids))
        return self.held[n]

    def _new(self, leaf: bool, keys: list, kids: list) -> int:
        n, self.pages = self.pages, self.pages + 1
        self.held[n] = (leaf, keys, kids)
        self.changed.add(n)
        return n

    def _path(self, key: float) -> list[tuple[int, int]]:
        """(page, child taken) from the root to the leaf where ``key`` belongs."""
        path, n = [], self.root
        while True:
            leaf, keys, kids = self._page(n)
            if leaf:
                return path + [(n, -1)]
            i = max(0, bisect_right(keys, key) - 1)
            path.append((n, i))
            n = kids[i]

    def _least(self, n: int):
        leaf, keys, kids = self._page(n)
        while not leaf:
            leaf, keys, kids = self._page(kids[0])
        return keys[0] if keys else None

    def first(self):
        return self._least(self.root)

    def holds(self, key: float) -> bool:
        keys = self._page(self._path(key)[-1][0])[1]
        i = bisect_left(keys, key)
        return i < len(keys) and keys[i] == key

    def after(self, key: float):
        """The least key above ``key``."""
        path = self._path(key)
        keys = self._page(path[-1][0])[1]
        i = bisect_right(keys, key)
        if i < len(keys):
            return keys[i]
        for n, taken in reversed(path[:-1]):
            kids = self._page(n)[2]
            if taken + 1 < len(kids):
                return self._least(kids[taken + 1])
        return None

    def __iter__(self):
        key = self.first()
        while key is not None:
            yield key
            key = self.after(key)

    def add(self, key: float) -> None:
        path = self._path(key)
        n = path[-1][0]
        insort(self._page(n)[1], key)
        self.changed.add(n)
        for depth in range(len(path) - 1, -1, -1):
            n = path[depth][0]
            leaf, keys, kids = self._page(n)
            if len(keys) <= PAGE_KEYS:
                return
            half = len(keys) // 2
            right = self._new(leaf, keys[half:], kids[half:])
            edge = keys[half]
            del keys[half:], kids[half:]
            if depth == 0:
                self.root = self._new(False, [keys[0], edge], [n, right])
                return
            above, taken = path[depth - 1]
            _, keys, kids = self._page(above)
            keys.insert(taken + 1, edge)
            kids.insert(taken + 1, right)
            self.changed.add(above)

    def remove(self, key: float) -> None:
        path = self._path(key)
        n = path[-1][0]
        keys = self._page(n)[1]
        i = bisect_left(keys, key)
        if i == len(keys) or keys[i] != key:
            return
        del keys[i]
        self.changed.add(n)
        # an empty page leaves its parent; an empty root is an empty leaf
        for depth in range(len(path) - 1, 0, -1):
            n = path[depth][0]
            if self._page(n)[1]:
                return
            self.gone.add(n)
            above, taken = path[depth - 1]
            _, keys, kids = self._page(above)
            del keys[taken], kids[taken]
            self.changed.add(above)
        leaf, keys, _ = self._page(self.root)
        if not leaf and not keys:
            self.held[self.root] = (True, [], [])

    def save(self) -> None:
        for n in self.changed - self.gone:
            self.state.updateValue((self.side_name, n), self.held[n])
        for n in self.gone:
            key = (self.side_name, n)
            if self.state.containsKey(key):
                self.state.removeKey(key)


class LazyLevels:
    """first_seen: the prices of one side in insertion order, of which only the
    first and the last are ever read. A stack over state."""

    def __init__(self, side_name: str, state, count: int):
        self.side_name, self.state = side_name, state
        self.initial = self.kept = count  # levels in state, and those of them that still live
        self.new: list[float] = []
        self.dropped: list[float] = []

    def _read(self, n: int) -> float:
        return self.state.getValue((self.side_name, n))[0]

    def __len__(self) -> int:
        return self.kept + len(self.new)

    def __getitem__(self, i: int) -> float:
        if i < 0:
            i += len(self)
        return self._read(i) if i < self.kept else self.new[i - self.kept]

    def __iter__(self):
        for n in range(len(self)):
            yield self[n]

    def append(self, price: float) -> None:
        self.new.append(price)

    def pop(self) -> float:
        price = self[-1]
        if self.new:
            self.new.pop()
        else:
            self.kept -= 1
        return price

    def clear(self) -> None:
        self.dropped += list(self)
        self.kept, self.new = 0, []

    def save(self) -> None:
        for i, price in enumerate(self.new):
            self.state.updateValue((self.side_name, self.kept + i), (price,))
        for n in range(len(self), self.initial):
            self.state.removeKey((self.side_name, n))


class LazyQueues(dict):
    """price -> deque of entries; a level is read from state on first access.
    Remembers created and removed levels for the write-back. ``levels`` is the
    side's index (best_price) or its LazyLevels (first_seen)."""

    def __init__(self, side_name: str, state, levels, heap, fresh: bool = False):
        super().__init__()
        self.fresh = fresh
        self.side_name, self.state, self.levels, self.heap = side_name, state, levels, heap
        self.sign = -1.0 if side_name == BUY else 1.0
        self.in_state: dict[float, int] = {}  # levels found in state, and their counters
        self.absent: set = set()              # prices that state has no level for, or no longer
        self.created: dict[float, None] = {}
        self.indexed = isinstance(levels, LevelIndex)
        self.frontier = levels.first() if self.indexed else None
        if self.frontier is not None:
            heap.append(self.frontier)

    def _there(self, price) -> bool:
        """Whether state has a level at the price. The index knows, but for
        what it does not tell apart or order: 0.0 and -0.0, NaN, None."""
        if self.fresh:
            return False
        if self.indexed and price and price == price:
            return self.levels.holds(self.sign * price)
        return self.state.containsKey((self.side_name, price))

    def _load(self, price) -> bool:
        """Whether state has the level; if so it is held from now on."""
        key = (self.side_name, price)
        if price in self.absent or not self._there(price):
            self.absent.add(price)
            return False
        value = self.state.getValue(key)
        self.in_state[price] = value[0]
        dict.__setitem__(self, price, deque(list(e) for e in zip(*value[1:])))
        return True

    def __contains__(self, price) -> bool:
        return dict.__contains__(self, price) or self._load(price)

    def __getitem__(self, price):
        if price in self:
            return dict.__getitem__(self, price)
        raise KeyError(price)

    def get(self, price, default=None):
        return dict.__getitem__(self, price) if price in self else default

    def __setitem__(self, price, queue) -> None:
        if price not in self:
            self.created[price] = None
        dict.__setitem__(self, price, queue)

    def __delitem__(self, price) -> None:
        if price not in self:
            raise KeyError(price)
        dict.__delitem__(self, price)
        self.created.pop(price, None)
        self.absent.add(price)
        if self.indexed and self.sign * price == self.frontier:
            # the fold has taken the best level of the index: the next one follows
            self.frontier = self.levels.after(self.frontier)
            if self.frontier is not None:
                heapq.heappush(self.heap, self.frontier)

    def clear(self) -> None:
        """first_seen: every level goes; LazyLevels lists those not read yet."""
        self.absent |= set(dict.keys(self)) | set(self.levels.dropped)
        self.created.clear()
        dict.clear(self)

    def __iter__(self):
        """Every live price (reads the whole index; for snapshots)."""
        known = list(self.levels) if not self.indexed else [self.sign * k for k in self.levels]
        return iter([p for p in dict.fromkeys([*known, *dict.keys(self)]) if p in self])

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def removed(self) -> list[float]:
        """Levels of state that are no more."""
        unread = [] if self.indexed else [p for p in self.levels.dropped if p not in self.in_state]
        return [p for p in dict.fromkeys([*self.in_state, *unread])
                if not dict.__contains__(self, p) and self._there(p)]


class StateBook:
    """Load a Book from state, and write back what changed."""

    def __init__(self, handle):
        self.queues = handle.getMapState("queues", LEVEL_KEY, QUEUE_VALUE)
        self.pages = handle.getMapState("pages", PAGE_KEY, PAGE_VALUE)
        self.firsts = handle.getMapState("firsts", FIRST_KEY, FIRST_VALUE)
        self.meta = handle.getValueState("meta", META)

    def load(self, level_priority: str, residual: str):
        book = Book(level_priority, residual)
        meta = self.meta.get()
        fresh, meta = meta is None, meta or EMPTY_META
        last, next_level, _, _, book.arrivals = meta[:5]
        for side_name, side, (root, pages, count) in ((BUY, book.bids, meta[5:8]), (SELL, book.asks, meta[8:11])):
            if book.first_seen:
                side.levels = levels = LazyLevels(side_name, self.firsts, count)
            else:
                levels = LevelIndex(side_name, self.pages, root, pages, fresh)
            side.queues = LazyQueues(side_name, self.queues, levels, side.heap, fresh)
        return book, json.loads(last), next_level

    def save(self, book: Book, last, next_level: int) -> None:
        top = book.top()
        sides = []
        for side_name, side in ((BUY, book.bids), (SELL, book.asks)):
            q: LazyQueues = side.queues
            for price in q.removed():
                if q.indexed:
                    q.levels.remove(q.sign * price)
                self.queues.removeKey((side_name, price))
            for price in q.created if book.first_seen else sorted(q.created):
                if q.indexed and price not in q.in_state:  # one that came back is in the index
                    q.levels.add(q.sign * price)
                q.in_state[price] = next_level
                next_level += 1
            for price, queue in dict.items(q):
                columns = [list(c) for c in zip(*queue)] if queue else [[] for _ in range(6)]
                self.queues.updateValue((side_name, price), (q.in_state[price], *columns))
            q.levels.save()
            sides += [0, 1, len(q.levels)] if book.first_seen else [q.levels.root, q.levels.pages, 0]
        self.meta.update((json.dumps(last), next_level, *top, book.arrivals, *sides))

    def top(self):
        """(best bid, best ask) after the last micro-batch; no level is read."""
        meta = self.meta.get()
        return tuple(meta[2:4]) if meta is not None else (None, None)
