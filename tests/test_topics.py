"""Topic source/sink builders: Kafka option builders construct without a
broker; the file stand-in streams text messages in bounded micro-batches."""

from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, DataStreamWriter

from crossbook.sources import topics as TP
from crossbook.sources.ingest import parse_orders


def test_kafka_builders_construct(spark):
    assert isinstance(TP.kafka_orders_stream(spark, "broker:9092", max_offsets_per_trigger=1000),
                      DataStreamReader)
    assert isinstance(TP.kafka_price_inputs_stream(spark, "broker:9092"), DataStreamReader)
    rate = spark.readStream.format("rate").load().select(F.col("value").cast("string").alias("value"))
    assert isinstance(TP.kafka_sink(rate, "broker:9092", TP.TRADES_TOPIC, "/unused"), DataStreamWriter)


def test_file_messages_stream_bounded_batches(spark, tmp_path):
    src = tmp_path / "topic"
    src.mkdir()
    for i in range(3):
        (src / f"m{i}.json").write_text(
            f'{{"order_id":"o{i}","order_type":"limit","price":50.0,"quantity":{i + 1},"timestamp":{i}}}\n')
    stream = TP.file_messages_stream(spark, str(src), max_files_per_trigger=1)
    out = tmp_path / "out"
    q = (parse_orders(stream).writeStream.format("parquet").option("path", str(out / "data"))
         .option("checkpointLocation", str(out / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) == 3
    got = sorted(r.order_id for r in spark.read.parquet(str(out / "data")).collect())
    assert got == ["o0", "o1", "o2"]


def test_topic_dump_from_offset(spark):
    df = spark.createDataFrame([(i, i * 10, f"m{i}") for i in range(5)], "seq long, timestamp long, value string")
    assert [r.offset for r in TP.topic_dump(df, offset=3).orderBy("offset").collect()] == [3, 4]


def test_topic_dump_from_an_offset_per_partition(spark):
    df = spark.createDataFrame([(p, i, i * 10, f"m{i}") for p in range(3) for i in range(5)],
                               "partition int, seq long, timestamp long, value string")
    got = TP.topic_dump(df, {0: 3, 2: 4}).collect()
    assert sorted((r.partition, r.offset) for r in got) == [(0, 3), (0, 4), (2, 4)]
    assert TP.topic_dump(df, {}).count() == 0


def test_parse_by_topic_splits_and_flags(spark):
    rows = [("prices", "A", '{"price": 2.5}'), ("prices", "A", "oops"), ("trades", "t", None),
            ("trades", "t", '{"trade_id":"t","order_id":"o","quantity":3,"price":2.5,"action":"BUY",'
                            '"status":"closed","timestamp":1}'), ("other", "k", "{}")]
    df = spark.createDataFrame(rows, "topic string, key string, value string")
    got = TP.parse_by_topic(df, {"trades": "trade", "prices": "pricepoint"}).collect()
    assert sorted((r.topic, r.malformed) for r in got) == [
        ("prices", False), ("prices", True), ("trades", False), ("trades", True)]
    good = {r.topic: r for r in got if not r.malformed}
    assert good["prices"].pricepoint.price == 2.5 and good["prices"].trade is None
    assert good["trades"].trade.quantity == 3 and good["trades"].pricepoint is None
