"""Beats leave the processor as spans."""

from crossbook.streaming import pipelines as L
from tests.test_round3 import SECOND, TimerHandle


def test_beats_of_one_price_leave_as_one_span():
    handle = TimerHandle()
    p = L.EventHeartbeat(SECOND, True, packed=True)
    p.init(handle)
    row = lambda price, ts: {"price": price, "ts": ts, "place": 0}
    (out,) = p.handleInputRows(("X",), iter([row(1.0, 0), row(2.0, 500_000_000)]), None)
    assert (out.price, out.source_ts, out.beat_ts, out.beats) == ((1.0,), (0,), (1_000_000,), (499,))
    assert handle.listTimers() == [501_000]
