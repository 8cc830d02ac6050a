"""Order adapters over the driver's parquet tables.

The fixture tables hold no orders, so two fixed rules turn existing rows into
limit orders. Integer arithmetic only, so Spark and DuckDB agree exactly.
Both adapters are plain projections: Catalyst prunes the scan to the columns
used and pushes any later filter into the parquet reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER_COLUMNS = ("symbol", "order_id", "order_type", "price", "quantity", "timestamp", "seq")

# Fixed values of the adapters: price band 45..60 and magnitudes 10..39.
PRICE_BASE = 45.0
PRICE_LEVELS = 16
QTY_BASE = 10
QTY_SPREAD = 30
QTY_MULT = 31


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def epoch_micros(col: Column) -> Column:
    """Epoch microseconds of a TIMESTAMP_NTZ wall-clock value read as UTC.
    A difference to the NTZ epoch involves no time zone, so the result does
    not depend on the session's time zone (a cast to TIMESTAMP would)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col)


def events_to_orders(events: DataFrame) -> DataFrame:
    """events(event_id, ts, user_id, value, props) -> orders, one symbol per user."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    magnitude = F.lit(QTY_BASE) + (F.col("event_id") * QTY_MULT) % QTY_SPREAD
    return events.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"),
        F.concat(F.lit("E-"), F.col("event_id").cast("string")).alias("order_id"),
        F.lit("limit").alias("order_type"),
        (F.lit(PRICE_BASE) + (F.floor("value") % PRICE_LEVELS)).cast("double").alias("price"),
        (magnitude * F.when(k % 2 == 0, F.lit(1)).otherwise(F.lit(-1))).cast("bigint").alias("quantity"),
        epoch_micros(F.col("ts")).alias("timestamp"),
        F.col("event_id").alias("seq"),
    )


def events_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_to_orders(read_table(spark, sf_dir, "events"))


# lineitem has repeated (l_orderkey, l_linenumber) pairs, so arrival order is
# (seq, then every remaining column); fully equal rows are interchangeable.
LINEITEM_TIEBREAK = ("l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
                     "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def lineitem_to_orders(lineitem: DataFrame) -> DataFrame:
    """lineitem -> orders, one symbol per part (the bench input)."""
    sign = F.when(F.col("l_linenumber") % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    return lineitem.select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol"),
        F.concat_ws("-", F.lit("L"), F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string")).alias("order_id"),
        F.lit("limit").alias("order_type"),
        (F.lit(PRICE_BASE) + (F.floor("l_extendedprice") % PRICE_LEVELS)).cast("double").alias("price"),
        (F.col("l_quantity").cast("bigint") * sign).alias("quantity"),
        epoch_micros(F.col("l_shipdate")).alias("timestamp"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        *LINEITEM_TIEBREAK,
    )


def lineitem_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_to_orders(read_table(spark, sf_dir, "lineitem"))


def order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw order topic derived from the fixtures: (source, msg_id, value).

    ``order``  the adapted orders as JSON order records
    ``props``  events.props: JSON objects that carry none of the order fields
    ``chat``   conversations.text: free text, not JSON at all

    ``msg_id`` (text) is unique within a source.
    """
    orders = events_orders(spark, sf_dir)
    as_json = F.to_json(F.struct("order_id", "order_type", "price", "quantity", "timestamp"))
    msgs = orders.select(F.lit("order").alias("source"), F.col("seq").cast("string").alias("msg_id"),
                         as_json.alias("value"))
    props = read_table(spark, sf_dir, "events").select(
        F.lit("props").alias("source"), F.col("event_id").cast("string").alias("msg_id"),
        F.col("props").alias("value"))
    chat = read_table(spark, sf_dir, "conversations").select(
        F.lit("chat").alias("source"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("msg_id"),
        F.col("text").alias("value"))
    return msgs.unionByName(props).unionByName(chat)


def order_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw order topic with message keys: (key, seq, value). Orders carry
    their symbol as key and their place as seq; the other messages have neither."""
    orders = events_orders(spark, sf_dir)
    as_json = F.to_json(F.struct("order_id", "order_type", "price", "quantity", "timestamp"))
    others = order_messages(spark, sf_dir).where("source <> 'order'")
    return orders.select(F.col("symbol").alias("key"), "seq", as_json.alias("value")).unionByName(
        others.select(F.lit(None).cast("string").alias("key"), F.lit(None).cast("bigint").alias("seq"), "value"))
