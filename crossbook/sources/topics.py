"""Topic sources and sinks (SRC-1..5, SNK-1..4, SRC-3 micro-batches).

The order pipeline reads and writes JSON records on three topics. On a
cluster these are Kafka topics: the builders below only set the reader and
writer options (the Kafka connector jar is a deployment dependency). The
same pipelines run unchanged on a file stand-in: a folder of JSON-lines or
parquet files read as a stream, which is what the tests use.
"""

from __future__ import annotations

import json

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossbook.operators.trades import execution_legs
from crossbook.sources.ingest import parse_records, to_json_value

# Topic names and producer settings of the pipeline.
ORDERS_TOPIC = "orders.topic"
TRADES_TOPIC = "trades.topic"
PRICES_TOPIC = "order.last_price.topic"
PRODUCER_OPTIONS = {
    "kafka.acks": "all",
    "kafka.enable.idempotence": "true",
    "kafka.max.in.flight.requests.per.connection": "1",
    "kafka.retries": "5",
}


# ---------------------------------------------------------------- sources
def kafka_orders_stream(spark: SparkSession, bootstrap: str, topic: str = ORDERS_TOPIC,
                        partition: int | None = None, max_offsets_per_trigger: int | None = None):
    """SRC-1: the order topic from the oldest offset, all partitions or one;
    ``offset`` becomes ``seq``. With the symbol as message key a symbol lies in
    one partition, so offsets order its messages. Returns the reader (call
    ``.load()`` where the Kafka connector is on the classpath)."""
    reader = (spark.readStream.format("kafka")
              .option("kafka.bootstrap.servers", bootstrap)
              .option("startingOffsets", "earliest"))
    if partition is None:
        reader = reader.option("subscribe", topic)
    else:
        reader = reader.option("assign", json.dumps({topic: [partition]}))
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", str(max_offsets_per_trigger))
    return reader


def kafka_price_inputs_stream(spark: SparkSession, bootstrap: str):
    """SRC-2: trades and price points in one stream, split on ``topic``."""
    return (spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", bootstrap)
            .option("subscribe", f"{TRADES_TOPIC},{PRICES_TOPIC}")
            .option("startingOffsets", "earliest"))


def kafka_topic_dump(spark: SparkSession, bootstrap: str, topic: str, offset: int | dict[int, int],
                     partition: int = 0):
    """SRC-4: batch read of one partition from ``offset`` to the end, or of
    each partition that a dict names from its own."""
    starts = offset if isinstance(offset, dict) else {partition: offset}
    return (spark.read.format("kafka")
            .option("kafka.bootstrap.servers", bootstrap)
            .option("assign", json.dumps({topic: sorted(starts)}))
            .option("startingOffsets", json.dumps({topic: {str(p): at for p, at in starts.items()}}))
            .option("endingOffsets", "latest"))


def kafka_records(raw: DataFrame) -> DataFrame:
    """Kafka rows -> (key, seq, timestamp, partition, value) with the offset as arrival order."""
    return raw.select(F.col("key").cast("string").alias("key"), F.col("offset").alias("seq"),
                      F.col("timestamp"), F.col("partition"), F.col("value").cast("string").alias("value"))


def file_messages_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None):
    """File stand-in for a topic: JSON-lines text files, one message per line.
    ``maxFilesPerTrigger`` bounds each micro-batch (SRC-3, STR-9)."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(folder)


TOPIC_FILE_SCHEMA = "key string, value string, topic string"


def write_topic_files(rows: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Topic rows (topic, key, value) as one folder per topic."""
    rows.select("topic", "key", "value").write.mode(mode).partitionBy("topic").parquet(folder)


def file_topics_stream(spark: SparkSession, folder: str, topics, max_files_per_trigger: int | None = None):
    """File stand-in for one subscription to several topics: a single stream
    of (key, value, topic) that reads those topics' folders alone."""
    reader = spark.readStream.schema(TOPIC_FILE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(folder).where(F.col("topic").isin(*topics))


def parse_by_topic(messages: DataFrame, contracts: dict[str, str]) -> DataFrame:
    """SRC-2: messages of several topics split on ``topic`` and each parsed by
    its topic's contract, in one pass: (topic, key, malformed, and a struct per
    contract that is null for messages of other topics). A message of a topic
    that ``contracts`` does not name is left out. ``timestamp`` and ``offset``
    of a message stay where it has them."""
    place = [c for c in ("timestamp", "offset") if c in messages.columns]
    out = messages.where(F.col("topic").isin(*contracts)).select("topic", "key", "value", *place)
    flags = []
    for topic, contract in contracts.items():
        own = F.col("topic") == topic
        parsed = parse_records(
            out.select(F.struct("*").alias("_row"), F.when(own, F.col("value")).alias("_text")),
            contract, "_text")
        fields = [c for c in parsed.columns if c not in ("_row", "_text", "malformed")]
        out = parsed.select("_row.*", F.when(own, F.struct(*fields)).alias(contract),
                            F.col("malformed").alias(f"_bad_{contract}"))
        flags.append(own & F.col(f"_bad_{contract}"))
    bad = reduce(lambda a, b: a | b, flags)
    return out.select("topic", "key", *place, bad.alias("malformed"), *contracts.values())


def topic_dump(records: DataFrame, offset: int | dict[int, int] = 0) -> DataFrame:
    """SRC-4 on any record table with (seq, timestamp, value): rows from
    ``offset`` on. With a dict, ``records`` also has ``partition`` and each
    partition starts at its own offset; partitions that it does not name are
    not read (the offset filter is the feature)."""
    if not isinstance(offset, dict):
        return records.where(F.col("seq") >= offset).select(
            "timestamp", F.col("seq").alias("offset"), "value")
    wanted = [(F.col("partition") == p) & (F.col("seq") >= start) for p, start in offset.items()]
    return records.where(reduce(lambda a, b: a | b, wanted, F.lit(False))).select(
        "partition", "timestamp", F.col("seq").alias("offset"), "value")


# ---------------------------------------------------------------- sinks
def fill_messages(fills: DataFrame) -> DataFrame:
    """SNK-1, SNK-2: the messages of each execution, two trade legs and one
    price point, as (topic, key, value) rows in one pass over the fills."""
    legs = execution_legs(fills)
    trade = F.struct(F.lit(TRADES_TOPIC).alias("topic"), F.col("trade_id").alias("key"),
                     to_json_value(legs, "trade").alias("value"))
    price = F.struct(F.lit(PRICES_TOPIC).alias("topic"), F.col("symbol").alias("key"),
                     to_json_value(legs, "pricepoint").alias("value"))
    messages = F.when(F.col("leg") == 0, F.array(trade, price)).otherwise(F.array(trade))
    return legs.select(F.explode(messages).alias("m")).select("m.*")


def mid_messages(mids: DataFrame) -> DataFrame:
    """SNK-2: sampled mids (symbol, mid_price) as rows of the price topic."""
    points = mids.select("symbol", F.col("mid_price").alias("price"))
    return points.select(F.lit(PRICES_TOPIC).alias("topic"), F.col("symbol").alias("key"),
                         to_json_value(points, "pricepoint").alias("value"))


def price_input_messages(stream: DataFrame) -> DataFrame:
    """The messages of a merged price stream (``operators.prices.price_stream``)
    as they lie in the two topics: (topic, key, value, timestamp, offset), the
    offset being the place in the symbol's stream."""
    topic = F.when(F.col("source") == "trade", TRADES_TOPIC).otherwise(PRICES_TOPIC)
    return stream.select(topic.alias("topic"), F.col("symbol").alias("key"),
                         F.to_json(F.struct("price")).alias("value"), "timestamp", F.col("ord").cast("bigint").alias("offset"))


def as_topic_rows(df: DataFrame, contract: str, key_col: str | None = None) -> DataFrame:
    """SNK-*: records -> (key, value) rows ready for any topic sink."""
    key = F.col(key_col).cast("string") if key_col else F.lit(None).cast("string")
    return df.select(key.alias("key"), to_json_value(df, contract).alias("value"))


def kafka_sink(stream_df: DataFrame, bootstrap: str, topic: str, checkpoint: str):
    """SNK-1/2/3: streaming writer with the pipeline's producer settings.
    Spark's Kafka sink is at-least-once; consumers dedupe on trade_id."""
    writer = (stream_df.writeStream.format("kafka")
              .option("kafka.bootstrap.servers", bootstrap)
              .option("topic", topic)
              .option("checkpointLocation", checkpoint))
    for k, v in PRODUCER_OPTIONS.items():
        writer = writer.option(k, v)
    return writer


def kafka_batch_sink(df: DataFrame, bootstrap: str, topic: str):
    """SNK-4: produce and flush a batch of messages."""
    writer = df.write.format("kafka").option("kafka.bootstrap.servers", bootstrap).option("topic", topic)
    for k, v in PRODUCER_OPTIONS.items():
        writer = writer.option(k, v)
    return writer
