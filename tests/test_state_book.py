"""The level-wise streaming state gives the same fills and book as the plain
kernel, for any split of the order log into micro-batches."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crossbook.plans.kernel import Book, RawWriter, fold_symbol
from crossbook.streaming import state_book
from crossbook.streaming.state_book import LevelIndex, StateBook


class FakeMap:
    def __init__(self):
        self.d = {}
        self.read = self.written = 0

    def containsKey(self, k):
        return k in self.d

    def getValue(self, k):
        self.read += 1
        return self.d[k]

    def updateValue(self, k, v):
        self.written += 1
        self.d[k] = tuple(tuple(x) if isinstance(x, list) else x for x in v)

    def removeKey(self, k):
        self.d.pop(k, None)

    def iterator(self):
        return iter(list(self.d.items()))


class FakeValue:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = tuple(v)


class FakeHandle:
    def __init__(self):
        self.maps, self.values = {}, {}

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, FakeMap())

    def getValueState(self, name, *_):
        return self.values.setdefault(name, FakeValue())


def _fills(writer):
    c = writer.take()
    return [(c["seq"][i], c["fill_idx"][i], c["maker_order_id"][i], c["quantity"][i], c["price"][i])
            for i in range(len(c["kind"])) if c["kind"][i] == "fill"]


@pytest.fixture(autouse=True, scope="module", params=[64, 3])
def page_keys(request):
    """Pages of the usual size, and pages so small that every book has many."""
    old, state_book.PAGE_KEYS = state_book.PAGE_KEYS, request.param
    yield request.param
    state_book.PAGE_KEYS = old


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(45, 49), st.integers(-15, 15)), min_size=1, max_size=50),
       st.lists(st.integers(1, 8), min_size=1, max_size=10),
       st.sampled_from(["best_price", "first_seen"]), st.sampled_from(["tail", "head"]))
def test_state_book_equals_kernel(orders, cuts, lp, res):
    rows = [(i, f"o{i}", float(p), q, i) for i, (p, q) in enumerate(orders)]
    ref, w = Book(lp, res), RawWriter()
    fold_symbol(ref, "X", rows, w)
    expected = _fills(w)

    state = StateBook(FakeHandle())
    got, start, k = [], 0, 0
    while start < len(rows):
        size = cuts[k % len(cuts)]
        k += 1
        book, last, nxt = state.load(lp, res)
        w = RawWriter()
        last = fold_symbol(book, "X", rows[start:start + size], w, last_seq=last)
        state.save(book, last, nxt)
        got += _fills(w)
        start += size
    assert got == expected
    final, _, _ = state.load(lp, res)
    assert list(final.snapshot()) == list(ref.snapshot())
    assert final.top() == ref.top()


def test_reads_follow_the_levels_touched(page_keys):
    """A book of 100,000 ask levels: a micro-batch that takes three levels,
    adds one far away and one new best reads those and a few index pages."""
    if page_keys != 64:
        pytest.skip("of pages of the usual size")
    n = 100_000
    handle = FakeHandle()
    state = StateBook(handle)
    book, last, nxt = state.load("best_price", "tail")
    fold_symbol(book, "X", [(i, f"s{i}", 1000.0 + 7919 * i % n, -10, i) for i in range(n)], RawWriter())
    state.save(book, None, nxt)
    assert len(handle.maps["queues"].d) == n and all(len(v[1]) <= 64 for v in handle.maps["pages"].d.values())
    for m in handle.maps.values():
        m.read = m.written = 0
    book, last, nxt = state.load("best_price", "tail")
    w = RawWriter()
    fold_symbol(book, "X", [(n, "b", 1002.0, 30, n), (n + 1, "far", 50_000.5, -1, n), (n + 2, "near", 999.0, -1, n),
                            (n + 3, "same", 60_000.0, -1, n)], w, late_check=False)
    state.save(book, last, nxt)
    assert [(f[2], f[4]) for f in _fills(w)] == [(f"s{i}", 1000.0 + k) for k, i in enumerate(
        sorted(range(n), key=lambda i: 7919 * i % n)[:3])]
    assert handle.maps["queues"].read == 5 - 1 and handle.maps["queues"].written == 3
    assert handle.maps["pages"].read <= 16 and handle.maps["pages"].written <= 12
    assert state.top() == (None, 999.0)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 300)), max_size=400), st.integers(1, 40))
def test_level_index_is_an_ordered_set(steps, every):
    state, want = FakeMap(), set()
    index = LevelIndex("SELL", state, 0, 1)
    for i, (add, key) in enumerate(steps):
        if add and key not in want:
            index.add(float(key))
            want.add(key)
        elif not add:
            index.remove(float(key))
            want.discard(key)
        if i % every == 0:
            index.save()
            index = LevelIndex("SELL", state, index.root, index.pages)
    assert list(index) == sorted(want) and index.first() == min(want, default=None)
