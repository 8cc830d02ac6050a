"""Packed rows out of the matching processor, a symbol's seeds in one write."""

from crossbook.streaming import matcher as M
from tests.test_round3 import SECOND, TimerHandle


def test_mids_between_two_changes_leave_as_one_packed_row():
    handle = TimerHandle()
    p = M.MatchProcessor(event_tick_us=SECOND, timers=True, packed=True)
    p.init(handle)
    rows = [("X", 0, "b", 49.0, 5, 1_500_000), ("X", 1, "s", 51.0, -5, 1_600_000), ("X", 2, "t", 52.0, -5, 900_000_000)]
    out = list(p.handleInputRows(("X",), iter(rows), None))
    assert len(out) == 2  # tops, mids
    mids = out[-1]
    assert (mids.kind, mids.timestamp, mids.ticks, mids.price) == (("mid",), (2_000_000,), (898,), (50.0,))
    assert handle.listTimers() == [900_000]


def test_unpacked_rows(spark):
    rows = [("X", {"kind": ["fill", "fill"], "symbol": ["X", "X"], "seq": [1, 2], "quantity": [3, None]}),
            ("X", {"kind": ["mid"], "symbol": [None], "timestamp": [5_000_000], "price": [1.5], "ticks": [3]})]
    data = [tuple(d.get(c) for c in M.PACKED_COLUMNS) for _, d in rows]
    got = M.unpack(spark.createDataFrame(data, M.PACKED_SCHEMA), SECOND)
    assert got.columns == list(M.RAW_COLUMNS)
    assert sorted((r.kind, r.seq, r.quantity) for r in got.where("kind = 'fill'").collect()) == [("fill", 1, 3), ("fill", 2, None)]
    assert sorted((r.timestamp, r.price) for r in got.where("kind = 'mid'").collect()) == [
        (5_000_000, 1.5), (6_000_000, 1.5), (7_000_000, 1.5)]


def test_a_symbols_seeds_are_one_write():
    class Lists(TimerHandle):
        puts = []

        def getListState(self, *_):
            return self

        def put(self, rows):
            self.puts.append(rows)

    handle = Lists()
    p = M.MatchProcessor(seeded=True, packed=True)
    p.init(handle)
    p.handleInitialState(("X",), {"seq": [0, 1], "order_id": ["b", None], "price": [1.0, 2.0], "quantity": [5, -5],
                                  "timestamp": [None, 3]}, None)
    assert handle.puts == [[(0, "b", 1.0, 5, None), (1, None, 2.0, -5, 3)]]
