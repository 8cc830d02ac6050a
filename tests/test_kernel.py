"""The matching fold on its own: golden traces, step-by-step book states."""

import pytest

from crossbook.plans.kernel import Book, RawWriter, fold_symbol
from traces import EXPECTED, EXPECTED_BOOK, TRACES, trace_rows


def run(name, level_priority, residual):
    book = Book(level_priority, residual)
    writer = RawWriter()
    rows = [(seq, oid, p, q, ts) for _, seq, oid, p, q, ts in trace_rows(name)]
    fold_symbol(book, "X", rows, writer)
    c = writer.take()
    fills = [(c["order_id"][i], c["maker_order_id"][i], c["quantity"][i], c["price"][i])
             for i in range(len(c["kind"])) if c["kind"][i] == "fill"]
    return fills, book


def live_book(book):
    out = {"BUY": [], "SELL": []}
    for side, price, _lvl, _pos, oid, _seq, rem, _ts in book.snapshot():
        if oid is not None:
            out[side].append((price, oid, rem))
    return out


@pytest.mark.parametrize("key", sorted(EXPECTED))
def test_trace_fills(key):
    name, lp, res = key
    fills, _ = run(name, lp, res)
    assert fills == EXPECTED[key]


@pytest.mark.parametrize("key", sorted(EXPECTED_BOOK))
def test_trace_books(key):
    name, lp, res = key
    _, book = run(name, lp, res)
    assert live_book(book) == EXPECTED_BOOK[key]


def test_g_step_by_step_first_seen():
    """Book after each step of G and the peek that pins first-seen priority."""
    book = Book("first_seen", "tail")
    steps = []
    for oid, p, q in TRACES["G"]:
        book.process(oid, float(p), q, len(steps), 0, [])
        steps.append(live_book(book))
    assert steps[0] == {"BUY": [(10, "b1", 20)], "SELL": []}
    assert steps[1] == {"BUY": [(10, "b1", 20)], "SELL": [(11, "s1", 25)]}
    assert steps[2] == {"BUY": [(10, "b1", 20)], "SELL": [(11, "s1", 5)]}
    assert steps[3] == {"BUY": [(10, "b1", 20), (11, "b3", 15)], "SELL": []}
    assert book.top() == (10.0, None)
    assert len(book.bids.levels) == 2 and len(book.asks.levels) == 0


def test_g_best_price_peek():
    _, book = run("G", "best_price", "tail")
    assert book.top() == (11.0, None)


def test_y_leaves_ghost_level_then_drops_all():
    """first_seen: after b1 empties s1's level the 12 level (most recent) is
    deleted and 11 stays as an empty ghost; b2 crossing the ghost drops it."""
    book = Book("first_seen", "tail")
    for i, (oid, p, q) in enumerate(TRACES["Y"][:3]):
        book.process(oid, float(p), q, i, 0, [])
    assert book.asks.levels == [11.0] and len(book.asks.queues[11.0]) == 0
    assert book.top() == (None, 11.0)
    snap = list(book.snapshot())
    assert ("SELL", 11.0, 0, None, None, None, 0, None) in snap


def test_rest_without_matching():
    """BUY 10 x 20 and SELL 10 x -20 rest side by side, no trade."""
    book = Book()
    book.rest("b", 10.0, 20, 0, 0)
    book.rest("s", 10.0, -20, 1, 0)
    assert live_book(book) == {"BUY": [(10.0, "b", 20)], "SELL": [(10.0, "s", -20)]}


def test_zero_quantity_is_noop():
    book = Book()
    fills = []
    book.process("b", 10.0, 5, 0, 0, fills)
    book.process("z", 1.0, 0, 1, 0, fills)
    assert fills == [] and live_book(book) == {"BUY": [(10.0, "b", 5)], "SELL": []}


def test_zero_price_sell_acts_as_market_sell():
    book = Book()
    fills = []
    book.process("b", 10.0, 5, 0, 0, fills)
    book.process("s", None, -5, 1, 0, fills)
    assert len(fills) == 1 and fills[0][4] == 10.0


def test_snapshot_round_trip():
    for lp in ("best_price", "first_seen"):
        _, book = run("Y", lp, "tail")
        again = Book.from_snapshot(list(book.snapshot()), lp, "tail")
        assert list(again.snapshot()) == list(book.snapshot())
        assert again.top() == book.top()


def test_late_rows_are_not_matched():
    book = Book()
    w = RawWriter()
    last = fold_symbol(book, "X", [(5, "a", 10.0, 5, 0)], w)
    last = fold_symbol(book, "X", [(5, "dup", 10.0, -5, 0), (4, "old", 10.0, -5, 0),
                                   (6, "b", 10.0, -5, 0)], w, last_seq=last)
    c = w.take()
    kinds = list(zip(c["kind"], c["order_id"]))
    assert ("late", "dup") in kinds and ("late", "old") in kinds
    assert ("fill", "b") in kinds and last == 6
