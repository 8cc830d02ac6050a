"""A partition's segments are written by several tasks."""

import json

from pyspark.sql import functions as F

from crossbook.sources import segments as S


def test_one_partition_is_written_by_several_tasks_in_order(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = spark.range(20_000, numPartitions=4).select(F.lit("t").alias("topic"), F.lit("k").alias("key"),
                                                       F.col("id").cast("string").alias("value"), F.col("id").alias("seq"))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as in a stream's micro-batch
    try:
        S.publish(rows.orderBy(F.rand(1)), path, 1, order=("seq",))
        S.publish(rows.drop("seq"), path, 1)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    for n in (0, 1):
        with open(f"{tmp_path}/log/manifests/{n}.json") as f:
            sizes = [s[2] for s in json.load(f)["segments"]]
        assert sum(sizes) == 20_000 and len(sizes) >= 4 and max(sizes) < 10_000
    got = S.read_topics(spark, path, ["t"], ending={"t": {"0": 20_000}})
    assert got.where(F.col("offset") != F.col("value").cast("long")).count() == 0 and got.count() == 20_000
