"""Structured Streaming: batch = stream for any micro-batch split, late
rows, initial state, processing-time timers."""

import random
import time

from pyspark.sql import functions as F

from crossbook.plans.match import MatchResult, match_orders
from crossbook.streaming.matcher import match_stream
from crossbook.streaming.pipelines import heartbeat_stream, run_to_parquet, use_rocksdb

SCHEMA = "symbol string, seq long, order_id string, price double, quantity long, timestamp long"


def _log(n, seed=11, symbols=4):
    rng = random.Random(seed)
    return [(f"S{rng.randrange(symbols)}", i, f"o{i}", float(rng.randint(45, 50)),
             rng.choice([-1, 1]) * rng.randint(1, 25), i * 1000) for i in range(n)]


def _write_chunks(spark, rows, folder, sizes):
    start = 0
    for k, size in enumerate(sizes):
        spark.createDataFrame(rows[start:start + size], SCHEMA).coalesce(1).write.parquet(
            f"{folder}/part={k:03d}")
        start += size
        time.sleep(0.05)
    return start


def _stream_raw(spark, src, out, **kw):
    use_rocksdb(spark)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(src)
    q = run_to_parquet(match_stream(stream, **kw), out)
    q.awaitTermination()
    return spark.read.parquet(f"{out}/out"), q


def test_stream_equals_batch_for_splits(spark, tmp_path):
    rows = _log(600)
    batch = match_orders(spark.createDataFrame(rows, SCHEMA)).fills
    for sizes in ([600], [1, 99, 250, 250], [200, 200, 200]):
        src = tmp_path / f"src{len(sizes)}"
        _write_chunks(spark, rows, str(src), sizes)
        raw, q = _stream_raw(spark, str(src), str(tmp_path / f"run{len(sizes)}"))
        assert len(q.recentProgress) >= len(sizes)
        fills = MatchResult(raw).fills
        assert fills.exceptAll(batch).count() == 0 and batch.exceptAll(fills).count() == 0


def test_stream_first_seen(spark, tmp_path):
    rows = _log(300, seed=5)
    batch = match_orders(spark.createDataFrame(rows, SCHEMA), "first_seen").fills
    _write_chunks(spark, rows, str(tmp_path / "src"), [100, 100, 100])
    raw, _ = _stream_raw(spark, str(tmp_path / "src"), str(tmp_path / "run"), level_priority="first_seen")
    fills = MatchResult(raw).fills
    assert fills.exceptAll(batch).count() == 0 and batch.exceptAll(fills).count() == 0


def test_late_rows_diverted(spark, tmp_path):
    rows = _log(100)
    src = str(tmp_path / "src")
    _write_chunks(spark, rows, src, [100])
    replay = [(s, q, f"again-{o}", p, qty, t) for (s, q, o, p, qty, t) in rows[:10]]
    spark.createDataFrame(replay, SCHEMA).coalesce(1).write.parquet(f"{src}/part=999")
    raw, _ = _stream_raw(spark, src, str(tmp_path / "run"))
    late = raw.where("kind = 'late'").select("order_id").collect()
    assert sorted(r.order_id for r in late) == sorted(r[2] for r in replay)
    assert raw.where("kind = 'fill' and order_id like 'again-%'").count() == 0


def test_initial_state_seeds(spark, tmp_path):
    rows = [("X", 0, "b", 51.0, 10, 0)]
    seeds = spark.createDataFrame([("X", -2, "seed-bid", 49.5, 100, 0), ("X", -1, "seed-ask", 50.5, -100, 0)],
                                  SCHEMA)
    _write_chunks(spark, rows, str(tmp_path / "src"), [1])
    raw, _ = _stream_raw(spark, str(tmp_path / "src"), str(tmp_path / "run"), seeds=seeds)
    fills = [(r.order_id, r.maker_order_id, r.quantity, r.price) for r in raw.where("kind='fill'").collect()]
    assert fills == [("b", "seed-ask", 10, 50.5)]


def _poll(spark, path, where, n, timeout_s=120):
    """Wait until the parquet sink at ``path`` holds ``n`` rows matching ``where``."""
    deadline = time.time() + timeout_s
    rows = []
    while time.time() < deadline:
        time.sleep(2)
        try:
            rows = spark.read.parquet(path).where(where).collect()
        except Exception:  # noqa: BLE001 - sink not created yet
            continue
        if len(rows) >= n:
            break
    return rows


def test_mid_tick_timer_fires_without_input(spark, tmp_path):
    use_rocksdb(spark)
    src = str(tmp_path / "src")
    _write_chunks(spark, [("X", 0, "b", 49.0, 5, 0), ("X", 1, "s", 51.0, -5, 0)], src, [2])
    stream = spark.readStream.schema(SCHEMA).parquet(src)
    q = run_to_parquet(match_stream(stream, mid_tick_ms=500), str(tmp_path / "run"),
                       available_now=False, processing_time="250 milliseconds")
    try:
        mids = _poll(spark, str(tmp_path / "run/out"), "kind = 'mid'", 2)
    finally:
        q.stop()
    assert len(mids) >= 2 and all(r.price == 50.0 for r in mids)


def test_heartbeat_repeats_last_price(spark, tmp_path):
    use_rocksdb(spark)
    src = str(tmp_path / "prices")
    spark.createDataFrame([("X", 50.0), ("X", 51.0)], "symbol string, price double").coalesce(1) \
        .write.parquet(src)
    stream = spark.readStream.schema("symbol string, price double").parquet(src)
    out = str(tmp_path / "beats")
    q = (heartbeat_stream(stream, tick_ms=500).writeStream.format("parquet")
         .option("path", out + "/out").option("checkpointLocation", out + "/ck")
         .trigger(processingTime="250 milliseconds").start())
    try:
        beats = _poll(spark, out + "/out", "true", 2)
    finally:
        q.stop()
    assert len(beats) >= 2 and {r.price for r in beats} <= {50.0, 51.0}


def test_observed_ingest_counts(spark, tmp_path):
    from crossbook.sources.ingest import parse_records
    from crossbook.streaming.pipelines import observe_ingest
    src = str(tmp_path / "msgs")
    rows = [('{"order_id":"a","order_type":"limit","price":1.0,"quantity":1,"timestamp":1}',),
            ("not json",), ('{"order_id":"b","order_type":"limit","price":1.0,"quantity":-1,"timestamp":2}',)]
    spark.createDataFrame(rows, "value string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("value string").parquet(src)
    observed = observe_ingest(parse_records(stream, "order"))
    out = str(tmp_path / "out")
    q = (observed.writeStream.format("parquet").option("path", out + "/data")
         .option("checkpointLocation", out + "/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    metrics = [p["observedMetrics"]["ingest"] for p in q.recentProgress if p.get("observedMetrics")]
    assert metrics and metrics[0]["messages"] == 3 and metrics[0]["consumed"] == 2 \
        and metrics[0]["malformed"] == 1


def test_restart_from_checkpoint_resumes_state(spark, tmp_path):
    """Stop after part of the log, restart on the same checkpoint with more
    input: books and offsets come back from the checkpoint, so the combined
    output equals one batch run (no replay, no lost resting orders)."""
    rows = _log(400, seed=23)
    batch = match_orders(spark.createDataFrame(rows, SCHEMA)).fills
    src, run = str(tmp_path / "src"), str(tmp_path / "run")
    use_rocksdb(spark)
    spark.createDataFrame(rows[:150], SCHEMA).coalesce(1).write.parquet(f"{src}/part=000")
    for _ in range(2):
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        run_to_parquet(match_stream(stream), run).awaitTermination()
        spark.createDataFrame(rows[150:], SCHEMA).coalesce(1).write.mode("ignore").parquet(
            f"{src}/part=001")
    fills = MatchResult(spark.read.parquet(f"{run}/out")).fills
    assert fills.exceptAll(batch).count() == 0 and batch.exceptAll(fills).count() == 0


def test_stream_emits_completed_order_states(spark, tmp_path):
    rows = _log(300, seed=31)
    batch = (match_orders(spark.createDataFrame(rows, SCHEMA), emit_orders=True).order_states
             .where("remaining = 0"))
    src = str(tmp_path / "src")
    _write_chunks(spark, rows, src, [100, 100, 100])
    use_rocksdb(spark)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(src)
    run = str(tmp_path / "run")
    run_to_parquet(match_stream(stream, emit_orders=True), run).awaitTermination()
    got = MatchResult(spark.read.parquet(f"{run}/out")).order_states
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_seeds_fold_in_order_and_their_fills_come_out(spark, tmp_path):
    """Three seeds of which two cross, over several micro-batches: the fills
    are those of one batch run over seeds and orders together."""
    seeds = [(f"S{k}", -3 + i, f"seed{i}", price, qty, 0) for k in range(4)
             for i, (price, qty) in enumerate([(48.0, 30), (47.0, -20), (50.0, -30)])]
    rows = _log(300, seed=41)
    seed_df = spark.createDataFrame(seeds, SCHEMA)
    batch = match_orders(spark.createDataFrame(seeds + rows, SCHEMA)).fills
    assert batch.where("taker_order_id like 'seed%'").count() == 4
    _write_chunks(spark, rows, str(tmp_path / "src"), [100, 200])
    raw, _ = _stream_raw(spark, str(tmp_path / "src"), str(tmp_path / "run"), seeds=seed_df)
    fills = MatchResult(raw).fills
    assert fills.exceptAll(batch).isEmpty() and batch.exceptAll(fills).isEmpty()


def test_book_from_state_equals_batch(spark, tmp_path):
    from crossbook.streaming.pipelines import book_from_state
    rows = _log(300, seed=43)
    _write_chunks(spark, rows, str(tmp_path / "src"), [100, 200])
    for policy in ("best_price", "first_seen"):
        run = str(tmp_path / policy)
        _stream_raw(spark, str(tmp_path / "src"), run, level_priority=policy)
        got = book_from_state(spark, f"{run}/checkpoint", policy)
        batch = match_orders(spark.createDataFrame(rows, SCHEMA), policy).book
        assert got.columns == batch.columns
        assert got.exceptAll(batch).isEmpty() and batch.exceptAll(got).isEmpty()


def test_order_topic_over_several_batches_and_a_restart(spark, tmp_path):
    """Messages of several micro-batches, some malformed, some zero, some
    without a key: published once each, also when the job starts again."""
    import json

    from crossbook.sources import topics as TP
    from crossbook.streaming.pipelines import run_order_topic
    use_rocksdb(spark)
    rows = _log(240, seed=47)
    messages = [(None if s == "S0" else s, seq, json.dumps(
        {"order_id": o, "order_type": "limit", "price": p, "quantity": 0 if seq % 9 == 0 else q, "timestamp": t}))
        for s, seq, o, p, q, t in rows]
    messages += [("S1", 1000 + i, "{not json") for i in range(5)]
    src, run = str(tmp_path / "orders"), str(tmp_path / "run")
    for k in range(3):
        spark.createDataFrame(messages[k * 82:(k + 1) * 82], "key string, seq long, value string").coalesce(
            1).write.parquet(f"{src}/part={k}")
        time.sleep(0.05)

    def start():
        stream = spark.readStream.schema("key string, seq long, value string").option(
            "maxFilesPerTrigger", "1").parquet(src)
        for q in run_order_topic(stream, run):
            q.awaitTermination()

    start()
    start()  # nothing new: nothing more is published
    expected = match_orders(spark.createDataFrame(
        [("X" if s == "S0" else s, seq, o, p, 0 if seq % 9 == 0 else q, t) for s, seq, o, p, q, t in rows],
        SCHEMA)).fills
    got = spark.read.parquet(f"{run}/topics").select("topic", "key", "value")
    want = TP.fill_messages(expected).select("topic", "key", "value")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert spark.read.parquet(f"{run}/quarantine/out").count() == 5
