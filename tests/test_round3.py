"""Event-time mids and beats, sorted runs, books after a batch, counts, pages."""

import random
from types import SimpleNamespace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crossbook.operators import book as B
from crossbook.operators import prices as P
from crossbook.operators import trades as T
from crossbook.plans.match import MatchResult, match_orders
from crossbook.sources.ingest import to_json_value
from crossbook.streaming import matcher as M
from crossbook.streaming import pipelines as L
from test_state_book import FakeHandle, FakeMap

ORDER = "symbol string, seq bigint, order_id string, price double, quantity bigint, timestamp bigint"
SECOND = 1_000_000


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def log(n, symbols=3, seed=2):
    """Orders whose times ascend with seq, some alike, some seconds apart."""
    rng = random.Random(seed)
    rows, ts = [], 10 * SECOND
    for i in range(n):
        ts += rng.choice((0, 1, 200_000, SECOND, 5 * SECOND))
        rows.append((f"S{rng.randrange(symbols)}", i, f"o{i}", float(rng.randint(45, 50)),
                     rng.choice((-1, 1)) * rng.randint(1, 25), ts))
    return rows


def chunks(spark, rows, folder, sizes):
    start = 0
    for k, size in enumerate(sizes):
        spark.createDataFrame(rows[start:start + size], ORDER).coalesce(1).write.parquet(f"{folder}/part={k:03d}")
        start += size
    return spark.readStream.schema(ORDER).option("maxFilesPerTrigger", "1").parquet(folder)


@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 9)), st.one_of(st.none(), st.floats(allow_nan=True)))),
       st.integers(1, 7), st.integers(1, 3))
@settings(max_examples=60, deadline=None)
def test_sorted_runs_give_arrival_order_and_leave_no_state(rows, run_rows, piece_rows):
    rows = [(seq, f"o{i}", price, i, None) for i, (seq, price) in enumerate(rows)]
    state = FakeMap()
    got = list(M.SortedRuns(state, run_rows, piece_rows).ordered(rows))
    assert list(map(str, got)) == list(map(str, sorted(rows, key=M.arrival_key))) and not state.d


def test_sorted_runs_hold_few_rows():
    """One piece of each run is held while 5,000 rows are merged."""
    class Counted(FakeMap):
        live = most = 0

        def getValue(self, k):
            value = super().getValue(k)
            Counted.live += len(value[0])
            Counted.most = max(Counted.most, Counted.live)
            return value

    rng = random.Random(1)
    rows = [(rng.randrange(10**6), "o", 1.0, 1, 1) for _ in range(5000)]
    out = []
    for r in M.SortedRuns(Counted(), 500, 20).ordered(rows):
        out.append(r)
        Counted.live -= 1
    assert out == sorted(rows) and Counted.most <= 11 * 20


def test_a_whole_log_in_one_batch_and_runs_equal_batch(spark, tmp_path):
    L.use_rocksdb(spark)
    rows = log(900, symbols=1)
    rng = random.Random(3)
    late = rows[100:110]
    batch = match_orders(spark.createDataFrame(rows, ORDER)).checkpoint()
    for sizes in ([900], [300, 600]):
        src, out = f"{tmp_path}/src{len(sizes)}", f"{tmp_path}/run{len(sizes)}"
        shuffled, start = [], 0
        for size in sizes:
            part = rows[start:start + size]
            rng.shuffle(part)
            shuffled += part
            start += size
        stream = chunks(spark, shuffled + late, src, [*sizes, len(late)])
        L.drain(M.match_stream(stream, run_rows=64, piece_rows=10), out, state_partitions=2)
        raw = spark.read.parquet(f"{out}/out")
        assert same(MatchResult(raw).prints, batch.prints)
        assert raw.where("kind = 'late'").count() == len(late)
        assert same(L.book_from_state(spark, f"{out}/checkpoint"), batch.book)


def test_book_after_each_batch_and_its_changes(spark, tmp_path):
    L.use_rocksdb(spark)
    rows = log(240)
    L.drain(M.match_stream(chunks(spark, rows, f"{tmp_path}/src", [80, 80, 80])), f"{tmp_path}/run", state_partitions=2)
    checkpoint = f"{tmp_path}/run/checkpoint"
    for n in range(3):
        want = match_orders(spark.createDataFrame(rows[:80 * (n + 1)], ORDER)).book
        assert same(L.book_from_state(spark, checkpoint, batch_id=n), want)
    # the last change of every level is the level as it stands
    changes = L.book_changes(spark, checkpoint, 0)
    last = changes.groupBy("symbol", "side", "price").agg(F.max_by(F.struct("change", "orders", "volume"), "batch_id").alias("c"))
    live = last.where("c.change = 'update'").select("symbol", "side", "price", F.col("c.volume").alias("volume"),
                                                    F.col("c.orders").alias("orders"))
    assert same(live, B.volume_at_price(match_orders(spark.createDataFrame(rows, ORDER)).book))


@pytest.mark.parametrize("sizes", [[300], [100, 100, 100], [7, 150, 143]])
def test_event_mids_are_the_same_for_any_split(spark, tmp_path, sizes):
    L.use_rocksdb(spark)
    rows = log(300)
    res = match_orders(spark.createDataFrame(rows, ORDER), emit_top=True).checkpoint()
    want = P.mid_ticks(res.top_changes, SECOND)
    raw = M.match_stream(chunks(spark, rows, f"{tmp_path}/src", sizes), event_tick_us=SECOND, watermark_delay="1 hour")
    L.drain(raw, f"{tmp_path}/run", state_partitions=2)
    out = spark.read.parquet(f"{tmp_path}/run/out")
    assert same(MatchResult(out).top_changes, res.top_changes) and same(MatchResult(out).fills, res.fills)
    ends = res.tops.groupBy("symbol").agg(F.max("timestamp").alias("t1"))
    mids = M.stream_mids(out).join(ends, "symbol").where("tick_ts < t1").drop("t1")
    assert same(mids, want.join(ends, "symbol").where("tick_ts < t1").drop("t1")) and mids.count() > 50
    assert M.stream_mids(out).count() == M.stream_mids(out).select("symbol", "tick_ts").distinct().count()


class TimerHandle(FakeHandle):
    """State and event-time timers without Spark."""

    def __init__(self):
        super().__init__()
        self.timers = set()

    def listTimers(self):
        return sorted(self.timers)

    def deleteTimer(self, t):
        self.timers.discard(t)

    def registerTimer(self, t):
        self.timers.add(t)


def fire(processor, handle, watermark_ms):
    """Expired timers of key X, as Spark runs them."""
    out = []
    times = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark_ms)
    for t in [t for t in handle.listTimers() if t <= watermark_ms]:
        handle.deleteTimer(t)
        out += processor.handleExpiredTimer(("X",), times, SimpleNamespace(getExpiryTimeInMs=lambda t=t: t))
    return out


def test_timers_sample_grid_times_that_no_order_passes():
    handle = TimerHandle()
    p = M.MatchProcessor(event_tick_us=SECOND, timers=True)
    p.init(handle)
    rows = [dict(zip(M.ROW_FIELDS, r)) for r in [(0, "b", 49.0, 5, 1_500_000), (1, "s", 51.0, -5, 1_600_000)]]
    first = list(p.handleInputRows(("X",), iter(rows), None))
    assert [r.kind for r in first if r.kind == "mid"] == [] and handle.listTimers() == [2000]
    assert fire(p, handle, 1999) == []
    assert [r.timestamp for r in fire(p, handle, 4200)] == [2_000_000, 3_000_000, 4_000_000]
    assert handle.listTimers() == [5000]
    late = [dict(zip(M.ROW_FIELDS, (2, "t", 51.0, 5, 5_000_000))), dict(zip(M.ROW_FIELDS, (3, "u", 60.0, -1, 6_500_000)))]
    mids = [(r.timestamp, r.price) for r in p.handleInputRows(("X",), iter(late), None) if r.kind == "mid"]
    assert mids == []  # at 5 s the ask side has gone, at 6 s it is still empty
    assert [(r.timestamp, r.price) for r in fire(p, handle, 7000)] == [(7_000_000, 54.5)]


def test_heartbeats_restart_with_every_price():
    handle = TimerHandle()
    p = L.EventHeartbeat(SECOND, True)
    p.init(handle)
    row = lambda price, ts, place: {"price": price, "ts": ts, "place": place}
    got = list(p.handleInputRows(("X",), iter([row(3.0, 3_200_000, 2), row(1.0, 0, 0), row(2.0, 0, 1), row(None, 9, 3)]), None))
    assert [(r.price, r.beat_ts) for r in got] == [(2.0, 1_000_000), (2.0, 2_000_000), (2.0, 3_000_000)]
    assert handle.listTimers() == [4200]
    assert [(r.price, r.beat_ts) for r in fire(p, handle, 5300)] == [(3.0, 4_200_000), (3.0, 5_200_000)]
    got = list(p.handleInputRows(("X",), iter([row(4.0, 6_300_000, 0)]), None))
    assert [(r.price, r.source_ts, r.beat_ts) for r in got] == [(3.0, 3_200_000, 6_200_000)]
    assert handle.listTimers() == [7300]


def test_trades_delivered_twice_and_bounded_state(spark, tmp_path):
    L.use_rocksdb(spark)
    legs = T.trade_legs(match_orders(spark.createDataFrame(log(400, symbols=1), ORDER)).fills)
    values = [(r.value,) for r in legs.select(to_json_value(legs, "trade").alias("value"), "timestamp").orderBy("timestamp").collect()]
    step = -(-len(values) // 4)
    for n in range(4):  # each file holds its messages twice, and the last ones of the file before
        part = values[max(0, n * step - 5):(n + 1) * step]
        spark.createDataFrame(part + part + [("no json",)], "value string").coalesce(1).write.parquet(f"{tmp_path}/t/n={n}")
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/t")
    q = L.drain(L.unique_trades(stream, "2 minutes"), f"{tmp_path}/run", state_partitions=2)
    got = spark.read.parquet(f"{tmp_path}/run/out").drop("value").select([c for c in legs.columns if c != "symbol"])
    assert same(got, legs.drop("symbol"))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) < len(values) and held[-1] < len(values) / 2


def test_pages_of_a_queue(spark):
    book = spark.createDataFrame([("X", "BUY", 10.0, i, f"o{i}", i + 1) for i in range(7)] + [("X", "SELL", 11.0, 0, "s", 3),
                                 (None, "SELL", 12.0, None, None, 0)],
                                 "symbol string, side string, price double, queue_pos int, order_id string, remaining bigint")
    pages = B.level_pages(book, 3)
    assert pages.count() == 4 and pages.where("size(entries) > 3").count() == 0
    queue = ["symbol", "side", "price", "order_id", "remaining", "queue_pos"]
    assert same(B.page_orders(pages), book.where("order_id is not null").select(queue))
    for index in range(9):
        cut = B.page_cut(pages, index)
        assert same(B.page_orders(cut), B.queue_cut(book, index).select(queue)), index
        gone = {(r.side, r.order_id) for r in B.page_element(pages, index).collect()}
        want = {(r.side, r.removed_order_id) for r in B.queue_removed(book, index).where("in_range").collect()}
        assert gone == want
    # two cuts in a row, across a page edge
    twice = B.page_cut(B.page_cut(pages, 2), 2)
    assert [r.order_id for r in B.page_orders(twice).where("side = 'BUY'").orderBy("queue_pos").collect()] == [
        "o0", "o1", "o4", "o5", "o6"]


def test_counts_of_a_restarted_service_count_each_batch_once(spark, tmp_path):
    rows = [("r1", 0, "ingest", "messages", 5), ("r1", 1, "ingest", "messages", 7)]
    for n, part in enumerate((rows, [("r2", 1, "ingest", "messages", 7), ("r2", 2, "ingest", "messages", 1)])):
        spark.createDataFrame(part, L.COUNT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/c")
    got = L.total_counts(spark, f"{tmp_path}/c").first()
    assert (got.name, got.metric, got.value) == ("ingest", "messages", 13)
