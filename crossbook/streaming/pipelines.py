"""Stream runners: sinks with checkpoints, drains, bounded micro-batches,
price heartbeats (SRC-3, SRC-5, STR-6, STR-8, STR-9).

Checkpoints and sink folders live under the session's shared checkpoint
folder (``spark.checkpoint.dir``), so a restarted driver or a lost executor
resumes from committed state instead of replaying into an empty book.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from crossbook.functions.columns import nonzero_orders
from crossbook.operators.book import rest_orders
from crossbook.plans.match import RAW_SCHEMA, MatchResult, ship_package
from crossbook.session import ensure_checkpoint_dir
from crossbook.sources.ingest import parse_records
from crossbook.sources.topics import fill_messages, mid_messages, write_topic_files
from crossbook.streaming.matcher import match_stream, stream_mids

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep operator state off the JVM heap (books can be large), and write per
    micro-batch what changed, not whole snapshots (``book_changes`` reads it)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def stream_folder(spark: SparkSession, name: str, fresh: bool = True) -> str:
    """A folder under the shared checkpoint root for one stream run."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    suffix = f"-{uuid.uuid4().hex[:12]}" if fresh else ""
    return f"{root}/streams/{name}{suffix}"


def file_table_stream(spark: SparkSession, folder: str, table: str, schema,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream one table's parquet file(s) out of a folder of several tables."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(folder)


def start_with_state_partitions(writer, spark: SparkSession, state_partitions: int | None):
    """Start a stream whose stateful operators get ``state_partitions``
    partitions. The count is fixed by the first run and kept in the
    checkpoint; the session setting is only changed while starting (the
    stream runs on a clone of the session's configuration)."""
    if not state_partitions:
        return writer.start()
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, str(state_partitions))
    try:
        return writer.start()
    finally:
        spark.conf.set(key, old)


def run_to_parquet(stream_df: DataFrame, folder: str, available_now: bool = True,
                   processing_time: str | None = None, state_partitions: int | None = None):
    """Start ``stream_df`` into an exactly-once parquet sink at
    ``folder/out`` with its checkpoint at ``folder/checkpoint``."""
    writer = (stream_df.writeStream.format("parquet")
              .option("path", f"{folder}/out")
              .option("checkpointLocation", f"{folder}/checkpoint")
              .outputMode("append"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return start_with_state_partitions(writer, stream_df.sparkSession, state_partitions)


def drain(stream_df: DataFrame, folder: str, state_partitions: int | None = None):
    """SRC-5: process everything available now, then stop (no error on the
    end of the input). Returns the finished query."""
    q = run_to_parquet(stream_df, folder, available_now=True, state_partitions=state_partitions)
    q.awaitTermination()
    return q


def progress_rows(spark: SparkSession, query) -> DataFrame:
    """Input counts of a query's latest micro-batches (driver metadata: Spark
    keeps spark.sql.streaming.numRecentProgressUpdates of them). For totals
    count what the sink holds."""
    rows = [(int(p["batchId"]), int(p["numInputRows"])) for p in query.recentProgress]
    return spark.createDataFrame(rows, "batch_id long, input_rows long")


def observe_ingest(parsed: DataFrame, name: str = "ingest") -> DataFrame:
    """OBS-1 (stream): consumed / malformed counts per micro-batch, reported
    in each progress event's ``observedMetrics`` (no extra job)."""
    return parsed.observe(
        name,
        F.count(F.lit(1)).alias("messages"),
        F.sum((~F.col("malformed")).cast("long")).alias("consumed"),
        F.sum(F.col("malformed").cast("long")).alias("malformed"))


#: Kind of a raw row that is a message set aside.
MALFORMED = "malformed"

COUNT_SCHEMA = "run_id string, batch_id long, name string, metric string, value long"


class CountRecorder(StreamingQueryListener):
    """OBS-1: appends every observed metric of a session's streams to a table,
    one row per query run, micro-batch and metric. Micro-batches that a restart
    repeats have another run_id; keep the last one of each batch_id."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.done: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rows = [(str(p.runId), int(p.batchId), name, metric, int(value or 0))
                for name, row in p.observedMetrics.items() for metric, value in row.asDict().items()]
        if rows:
            self.spark.createDataFrame(rows, COUNT_SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)

    def onQueryTerminated(self, event) -> None:
        self.done.add(str(event.runId))

    def wait(self, query, seconds: float = 60.0) -> None:
        """Until the last progress of a finished query has been recorded."""
        until = time.monotonic() + seconds
        while str(query.runId) not in self.done:
            if time.monotonic() > until:
                raise TimeoutError(f"no end of query {query.runId} was reported")
            time.sleep(0.05)


def record_counts(spark: SparkSession, folder: str) -> CountRecorder:
    """Start recording; ``spark.streams.removeListener`` ends it."""
    recorder = CountRecorder(spark, folder)
    spark.streams.addListener(recorder)
    return recorder


def total_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(name, metric, value) over all recorded micro-batches, each counted
    once, as its last run reported it."""
    rows = spark.read.schema(COUNT_SCHEMA).parquet(folder).withColumn("file", F.col("_metadata.file_modification_time"))
    last = rows.groupBy("batch_id", "name", "metric").agg(F.max_by("value", "file").alias("value"))
    return last.groupBy("name", "metric").agg(F.sum("value").alias("value"))


def unique_trades(messages: DataFrame, delay: str = "1 hour", time_col: str = "timestamp") -> DataFrame:
    """SNK-1, STR-8 (consumer): trade messages (value = JSON) that a topic
    delivers at least once, each leg once. A leg's key is its trade id and
    action; a second delivery within ``delay`` of event time is recognised, and
    state holds no key for longer. Malformed messages are left out."""
    legs = parse_records(messages, "trade").where(~F.col("malformed")).drop("malformed")
    timed = legs.withColumn("event_time", F.timestamp_micros(time_col)).withWatermark("event_time", delay)
    return timed.dropDuplicatesWithinWatermark(["trade_id", "action"]).drop("event_time")


def microbatch_parse(messages: DataFrame, folder: str, contract: str = "order"):
    """SRC-3: bounded micro-batches (the source's maxFilesPerTrigger /
    maxOffsetsPerTrigger bounds each), parsed with the contract and written
    per batch with a ``malformed`` flag (good rows and quarantine in one
    table). Each batch overwrites its own ``batch_id=`` folder, so a
    replayed batch replaces its rows and never duplicates them."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_records(batch, contract).withColumn("batch_id", F.lit(batch_id))
        parsed.write.mode("overwrite").parquet(f"{folder}/batches/batch_id={batch_id}")

    return (messages.writeStream.foreachBatch(handle)
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True).start())


def run_order_topic(messages: DataFrame, folder: str, level_priority: str = "best_price",
                    residual: str = "tail", seeds: DataFrame | None = None, publish=None,
                    available_now: bool = True, state_partitions: int | None = None,
                    event_tick_us: int | None = None, watermark_delay: str | None = None):
    """The order service from end to end: ``messages`` (key = symbol, seq,
    value = JSON order) are parsed and matched, and each execution's trade and
    price messages are published; returns the started query, in a tuple.

    Good orders go through ``match_stream``. A micro-batch's raw rows are
    written once to ``folder/raw/batch_id=N`` (late rows stay there), then
    ``publish(messages, batch_id)`` gets its (topic, key, value) rows; by
    default they overwrite ``folder/topics/batch_id=N/topic=...``, so a replayed
    batch replaces its rows. A null key is the symbol 'X', as without a symbol.
    Malformed messages pass the matching by in the same query and overwrite
    ``folder/quarantine/out/batch_id=N``, so what is set aside and what is
    published always stand at the same micro-batch.

    ``event_tick_us`` (with ``watermark_delay``, see ``match_stream``) publishes
    sampled mids beside the fill prices, on one price topic. Each batch's
    progress carries two observations: ``ingest`` (messages, consumed,
    malformed) and ``produced`` (trades, prices); ``record_counts`` keeps them."""
    parsed = parse_records(messages.select(F.coalesce(F.col("key").cast("string"), F.lit("X")).alias("symbol"),
                                           "seq", "value"), "order")
    counted = observe_ingest(parsed)
    good = nonzero_orders(counted.where(~F.col("malformed")))
    # resting or not, a zero order changes nothing: it is left out before the shuffle
    raw = match_stream(good, level_priority, residual, seeds=seeds, event_tick_us=event_tick_us,
                       watermark_delay=watermark_delay)
    fills = F.sum((F.col("kind") == "fill").cast("long"))
    raw = raw.observe("produced", F.coalesce(2 * fills, F.lit(0)).alias("trades"), F.coalesce(
        fills + F.sum((F.col("kind") == "mid").cast("long")), F.lit(0)).alias("prices"))

    def to_files(rows: DataFrame, batch_id: int) -> None:
        write_topic_files(rows, f"{folder}/topics/batch_id={batch_id}", mode="overwrite")

    send = publish or to_files

    def handle(batch: DataFrame, batch_id: int) -> None:
        own = f"{folder}/raw/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(own)
        stored = batch.sparkSession.read.schema(batch.schema).parquet(own)
        aside = stored.where(F.col("kind") == MALFORMED).select("symbol", "seq", "value")
        aside.write.mode("overwrite").parquet(f"{folder}/quarantine/out/batch_id={batch_id}")
        written = stored.where(F.col("kind") != MALFORMED).select(*RAW_SCHEMA.names)
        out = fill_messages(MatchResult(written).fills)
        send(out.unionByName(mid_messages(stream_mids(written))) if event_tick_us else out, batch_id)

    bad = parsed.where(F.col("malformed")).select(F.lit(MALFORMED).alias("kind"), "symbol", "seq", "value")
    matcher = (raw.unionByName(bad, allowMissingColumns=True)
               .writeStream.foreachBatch(handle).outputMode("append")
               .option("checkpointLocation", f"{folder}/checkpoint"))
    if available_now:
        matcher = matcher.trigger(availableNow=True)
    return (start_with_state_partitions(matcher, messages.sparkSession, state_partitions),)


def book_from_state(spark: SparkSession, checkpoint: str, level_priority: str = "best_price",
                    batch_id: int | None = None, seeded: bool = False) -> DataFrame:
    """STR-4 (stream): the resting orders after the last committed micro-batch
    of a matching stream, or after micro-batch ``batch_id`` (as far back as the
    state store keeps versions, spark.sql.streaming.minBatchesToRetain), read
    from its state store by its checkpoint folder; of a stream with seeds
    (``seeded``) also those of symbols that have had no order yet, as they rest;
    the columns and rows of ``MatchResult.book``. The stream itself does no
    extra work for it."""
    def state(name: str) -> DataFrame:
        reader = spark.read.format("statestore").option("stateVarName", name)
        if batch_id is not None:
            reader = reader.option("batchId", str(batch_id))
        return reader.load(checkpoint)

    levels = state("queues").select(F.col("key.symbol").alias("symbol"), F.col("user_map_key.*"),
                                    F.col("user_map_value.*"))
    order = F.col("level_seq") if level_priority == "first_seen" else F.when(
        F.col("side") == "BUY", -F.col("price")).otherwise(F.col("price"))
    by_level = Window.partitionBy("symbol", "side").orderBy(order)
    levels = levels.withColumn("level_seq", F.row_number().over(by_level) - 1)
    queue = F.arrays_zip("ids", "remaining", "seqs", "ts")
    book = levels.select("symbol", "side", "price", "level_seq", F.posexplode_outer(queue).alias("queue_pos", "e")).select(
        "symbol", "side", "price", F.col("level_seq").cast("int").alias("level_seq"),
        F.col("queue_pos").cast("int").alias("queue_pos"), F.col("e.ids").alias("order_id"),
        F.col("e.seqs").alias("seq"),
        # an empty level of first_seen is one row without an order
        F.coalesce("e.remaining", F.lit(0)).alias("remaining"), F.col("e.ts").alias("timestamp"))
    if not seeded:
        return book
    waiting = state("seeds").select(F.col("key.symbol").alias("symbol"), F.col("list_element.*"))
    rested = rest_orders(nonzero_orders(waiting), level_priority).withColumn("remaining", F.abs("remaining"))
    return book.unionByName(rested)


def book_changes(spark: SparkSession, checkpoint: str, start_batch: int, end_batch: int | None = None) -> DataFrame:
    """The price levels that each committed micro-batch from ``start_batch``
    to ``end_batch`` (the last one) wrote or removed, from the state store's
    change feed: (batch_id, symbol, side, price, change, orders, volume)."""
    reader = (spark.read.format("statestore").option("stateVarName", "queues")
              .option("readChangeFeed", "true").option("changeStartBatchId", str(start_batch)))
    if end_batch is not None:
        reader = reader.option("changeEndBatchId", str(end_batch))
    left = F.col("user_map_value.remaining")
    return reader.load(checkpoint).select(
        "batch_id", F.col("key.symbol").alias("symbol"), F.col("user_map_key.side").alias("side"),
        F.col("user_map_key.price").alias("price"), F.col("change_type").alias("change"),
        F.when(left.isNotNull(), F.size(left)).cast("bigint").alias("orders"),
        F.aggregate(left, F.lit(0).cast("bigint"), lambda a, q: a + q).alias("volume"))


class HeartbeatProcessor(StatefulProcessor):
    """STR-6 (stream): repeat the last price after every ``tick_ms`` without
    a new price. The timer is deleted and re-armed on every price."""

    def __init__(self, tick_ms: int = 1000):
        self.tick_ms = tick_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "price double")

    def handleInputRows(self, key, rows, timerValues):
        # the latest by time; without a time the last row seen. A row without
        # a price repeats nothing and hides no other
        latest = None
        for r in rows:
            if r["price"] is None:
                continue
            if latest is None or r["ts"] is None or latest["ts"] is None or r["ts"] >= latest["ts"]:
                latest = r
        price = None if latest is None else latest["price"]
        if price is None:
            return iter(())
        self.last.update((price,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.tick_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        fired = expiredTimerInfo.getExpiryTimeInMs()
        self.handle.registerTimer(fired + self.tick_ms)
        if self.last.exists():
            yield Row(symbol=key[0], price=self.last.get()[0], beat_ms=fired)

    def close(self) -> None:
        pass


class EventHeartbeat(StatefulProcessor):
    """STR-6 (stream, event time): after each price, repeat it every
    ``tick_us`` while no new price arrives. Beats between two prices come out
    when the second arrives; with ``timers`` those after the last price when
    the watermark passes them. Every price deletes the timer and sets it anew.
    ``packed``: one row per call, arrays of price, source_ts, first beat and number."""

    def __init__(self, tick_us: int, timers: bool, packed: bool = False):
        self.tick_us, self.timers, self.packed = tick_us, timers, packed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "price double, ts long, due long")

    def _beats(self, price, ts, due, stop):
        """Beats due before ``stop``: [(price, ts, the first, their number)], or []."""
        return [(price, ts, due, -(-(stop - due) // self.tick_us))] if due < stop else []

    def _emit(self, symbol, spans):
        if not self.packed:
            for price, ts, first, n in spans:
                for i in range(n):
                    yield Row(symbol=symbol, price=price, source_ts=ts, beat_ts=first + i * self.tick_us)
        elif spans:
            yield Row(symbol=symbol, **dict(zip(("price", "source_ts", "beat_ts", "beats"), zip(*spans))))

    def _keep(self, was, price, ts, due) -> None:
        self.last.update((price, ts, due))
        if self.timers:
            if was is not None:
                self.handle.deleteTimer(-(-was // 1000))
            self.handle.registerTimer(-(-due // 1000))

    def handleInputRows(self, key, rows, timerValues):
        new = sorted((r["ts"], r["place"], r["price"]) for r in rows if r["ts"] is not None and r["price"] is not None)
        last = self.last.get()
        was = None if last is None else last[2]
        spans = []
        for ts, _, price in new:
            if last is not None:
                spans += self._beats(*last, ts)
            last = (price, ts, ts + self.tick_us)
        yield from self._emit(key[0], spans)
        if new:
            self._keep(was, *last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        price, ts, due = self.last.get()
        spans = self._beats(price, ts, due, timerValues.getCurrentWatermarkInMs() * 1000 + 1)
        yield from self._emit(key[0], spans)
        self._keep(due, price, ts, due + sum(s[3] for s in spans) * self.tick_us)

    def close(self) -> None:
        pass


def event_heartbeat_stream(prices: DataFrame, tick_us: int = 1_000_000, watermark_delay: str | None = None) -> DataFrame:
    """``prices`` (symbol, price, ts in epoch microseconds, place: order among
    rows of one ts, not null) -> (symbol, price, source_ts, beat_ts), the beats of
    ``operators.prices.price_heartbeat`` and, with ``watermark_delay``, those
    after the last price up to the watermark. Prices of a symbol come in ts
    order from one micro-batch to the next; rows without ts or price are left out."""
    ship_package()
    rows = prices.select("symbol", F.col("price").cast("double").alias("price"), F.col("ts").cast("long").alias("ts"),
                         F.col("place").cast("long").alias("place"))
    if watermark_delay:
        rows = rows.withColumn("event_time", F.timestamp_micros("ts")).withWatermark("event_time", watermark_delay)
    packed = rows.groupBy("symbol").transformWithState(
        EventHeartbeat(tick_us, bool(watermark_delay), packed=True),
        "symbol string, price array<double>, source_ts array<long>, beat_ts array<long>, beats array<long>",
        "Append", "EventTime" if watermark_delay else "None")
    spans = packed.select("symbol", F.inline(F.arrays_zip("price", "source_ts", "beat_ts", "beats")))
    beats = F.sequence(F.lit(0).cast("long"), F.col("beats") - 1)
    return spans.select("symbol", "price", "source_ts", "beat_ts", F.explode(beats).alias("n")).select(
        "symbol", "price", "source_ts", (F.col("beat_ts") + F.col("n") * tick_us).alias("beat_ts"))


def heartbeat_stream(prices: DataFrame, tick_ms: int = 1000, ts_col: str | None = None) -> DataFrame:
    """``prices`` (symbol, price[, ts_col]) stream -> (symbol, price, beat_ms)
    beats; with ``ts_col`` the latest price of a micro-batch wins, else the
    last row seen."""
    ship_package()
    ts = F.col(ts_col).cast("long") if ts_col else F.lit(None).cast("long")
    return prices.select("symbol", "price", ts.alias("ts")).groupBy("symbol").transformWithState(
        HeartbeatProcessor(tick_ms), "symbol string, price double, beat_ms long",
        "Append", "ProcessingTime")
