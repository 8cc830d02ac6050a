"""State is not asked for what is known."""

from crossbook.plans.kernel import RawWriter, fold_symbol
from crossbook.streaming.state_book import StateBook
from tests.test_state_book import FakeHandle


class _Asked:
    def __init__(self, state, log):
        self.state, self.log = state, log

    def containsKey(self, key):
        self.log.append(key)
        return self.state.containsKey(key)

    def __getattr__(self, name):
        return getattr(self.state, name)


def _asked(handle):
    log, state = [], StateBook(handle)
    state.queues, state.pages = _Asked(state.queues, log), _Asked(state.pages, log)
    return state, log


def _batch(state, rows):
    book, last, nxt = state.load("best_price", "tail")
    fold_symbol(book, "X", rows, RawWriter(), late_check=False)
    state.save(book, last, nxt)


def test_state_is_not_asked_for_levels_it_is_known_to_hold_or_not():
    handle = FakeHandle()
    state, log = _asked(handle)
    _batch(state, [(i, f"o{i}", 50.0 + i % 9, -5, i) for i in range(40)])
    assert log == []  # a symbol without meta has nothing in state
    _batch(state, [(100, "a", 53.0, -5, 1), (101, "b", 70.0, -5, 1), (102, "c", 60.0, 33, 1)])
    assert len(log) <= 2  # the first page of either side; levels are known by the index
    book, _, _ = state.load("best_price", "tail")
    assert book.top() == (None, 51.0) and {p for _, p, *_ in book.snapshot()} == {51.0 + i for i in range(8)} | {70.0}


def test_prices_that_the_index_cannot_tell_apart_are_asked_for():
    state, log = _asked(FakeHandle())
    _batch(state, [(0, "z", 0.0, -5, 0)])
    _batch(state, [(1, "y", 0.0, -3, 0)])
    assert ("SELL", 0.0) in log
    book, _, _ = state.load("best_price", "tail")
    assert [r[6] for r in book.snapshot()] == [5, 3]
