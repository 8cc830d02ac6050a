"""Skew-safe running sums equal the window form, also with one hot key."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crossbook.functions.scan import running_count, running_sums


def test_running_sums_match_window_with_hot_key(spark):
    df = spark.range(0, 60000).select(
        F.when(F.col("id") < 40000, F.lit("HOT")).otherwise(
            F.concat(F.lit("K"), (F.col("id") % 50).cast("string"))).alias("k"),
        (F.col("id") % 2).cast("string").alias("side"),
        F.col("id").alias("o"), (F.col("id") % 7 - 3).alias("v"))
    got = running_sums(df, ["k", "side"], ["o"], {"cs": "v"}, num_partitions=12, strategy="split")
    got = running_count(got, ["k", "side"], ["o"], "rn", num_partitions=12, strategy="split")
    w = Window.partitionBy("k", "side").orderBy("o")
    exp = df.withColumn("cs", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))) \
            .withColumn("rn", F.row_number().over(w))
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0
    # the hot key really was split over several partitions
    parts = (df.repartitionByRange(12, "k", "side", "o").withColumn("p", F.spark_partition_id())
             .where("k = 'HOT'").select("p").distinct().count())
    assert parts > 1


def test_auto_detects_hot_key(spark):
    from crossbook.functions.scan import MIN_HOT_ROWS_CONF, has_hot_key
    df = spark.range(0, 20000).select(
        F.when(F.col("id") < 15000, F.lit("HOT")).otherwise((F.col("id") % 100).cast("string")).alias("k"))
    spark.conf.set(MIN_HOT_ROWS_CONF, "1000")
    try:
        assert has_hot_key(df, ["k"], 8)
        assert not has_hot_key(df.where("k <> 'HOT'"), ["k"], 8)
    finally:
        spark.conf.unset(MIN_HOT_ROWS_CONF)


def test_running_last_matches_window_with_hot_key(spark):
    from crossbook.functions.scan import running_last
    df = spark.range(0, 50000).select(
        F.when(F.col("id") < 30000, F.lit("HOT")).otherwise(
            F.concat(F.lit("K"), (F.col("id") % 40).cast("string"))).alias("k"),
        F.col("id").alias("o"),
        F.when(F.col("id") % 97 == 0, (F.col("id") % 1000).cast("double")).alias("v"),
        F.when(F.col("id") % 89 == 0, F.col("id")).alias("w"))
    got = running_last(df, ["k"], ["o"], {"lv": "v", "lw": "w"}, num_partitions=10, strategy="split")
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.withColumn("lv", F.last("v", ignorenulls=True).over(w)).withColumn(
        "lw", F.last("w", ignorenulls=True).over(w))
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_running_next_matches_lead_with_hot_key(spark):
    from crossbook.functions.scan import running_next
    df = spark.range(0, 50000).select(
        F.when(F.col("id") < 30000, F.lit("HOT")).otherwise(
            F.concat(F.lit("K"), (F.col("id") % 40).cast("string"))).alias("k"),
        F.col("id").alias("o"), (F.col("id") * 3).alias("t"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "997")
    try:
        got = running_next(df, ["k"], ["o"], {"nt": "t"}, num_partitions=10, strategy="split")
        exp = df.withColumn("nt", F.lead("t").over(Window.partitionBy("k").orderBy("o")))
        assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
