"""Segment topics: offsets per partition, skipped segments, bounded triggers,
restarts, and publications that appear whole or not at all."""

import json
import os

import pytest
from pyspark.sql import functions as F

from crossbook.sources import segments as S


def rows_of(df):
    return sorted((r.topic, r.partition, r.offset, r.key, r.value) for r in df.collect())


def messages(spark, n, topic="t", start=0):
    return spark.range(start, start + n).select(
        F.lit(topic).alias("topic"), F.concat(F.lit("k"), (F.col("id") % 7).cast("string")).alias("key"),
        F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"), "id")


def test_offsets_are_gapless_and_keys_stay_in_order(spark, tmp_path):
    path = str(tmp_path / "log")
    for n, part in enumerate((messages(spark, 100), messages(spark, 50, start=100), messages(spark, 9, "u"))):
        S.publish(part.repartition(4), path, {"t": 3, "u": 1}, order=("id",))
    got = rows_of(S.read_topics(spark, path))
    assert len(got) == 159 and {g[0] for g in got} == {"t", "u"}
    for place in {g[:2] for g in got}:
        own = [g for g in got if g[:2] == place]
        assert [g[2] for g in own] == list(range(len(own)))
        for key in {g[3] for g in own}:
            ids = [int(g[4][1:]) for g in own if g[3] == key]
            assert ids == sorted(ids)
    assert {g[3]: g[1] for g in got if g[0] == "t"}.items() == {(g[3], g[1]) for g in got if g[0] == "t"}
    assert rows_of(S.read_topics(spark, path, ["u"])) == [g for g in got if g[0] == "u"]


def test_only_segments_in_range_are_opened(spark, tmp_path):
    path = str(tmp_path / "log")
    for n in range(5):
        S.publish(messages(spark, 40, start=40 * n), path, 2, order=("id",))
    whole = rows_of(S.read_topics(spark, path))
    start, end = {"t": {"0": 60, "1": 35}}, {"t": {"0": 70, "1": 10_000}}
    want = [r for r in whole if (r[1] == 0 and 60 <= r[2] < 70) or (r[1] == 1 and r[2] >= 35)]
    needed = {p.file for p in S.plan(path, {"t/0": 60, "t/1": 35}, {"t/0": 70, "t/1": 10_000})}
    files = os.listdir(f"{path}/segments")
    assert 0 < len(needed) < len(files)
    for f in files:
        if f not in needed:  # no reader may touch these
            with open(f"{path}/segments/{f}", "wb") as broken:
                broken.write(b"not a segment")
    assert rows_of(S.read_topics(spark, path, starting=start, ending=end)) == want


def run(spark, path, out, max_records):
    stream = S.stream_topics(spark, path, max_records=max_records, progress=f"{out}/position")
    q = (stream.writeStream.format("parquet").option("path", f"{out}/data")
         .option("checkpointLocation", f"{out}/ck").start())
    try:
        q.processAllAvailable()
        return [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    finally:
        q.stop()


def test_bounded_triggers_and_restart(spark, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "run")
    S.publish(messages(spark, 100), path, 3, order=("id",))
    sizes = run(spark, path, out, 32)
    assert sum(sizes) == 100 and max(sizes) <= 32 and len(sizes) == 4
    assert run(spark, path, out, 32) == []  # a restart repeats nothing
    S.publish(messages(spark, 40, start=100), path, 3, order=("id",))
    sizes = run(spark, path, out, 32)
    assert sum(sizes) == 40 and max(sizes) <= 32
    assert rows_of(spark.read.schema(S.SCHEMA).parquet(f"{out}/data")) == rows_of(S.read_topics(spark, path))


def test_a_failed_publication_leaves_nothing_visible(spark, tmp_path):
    path = str(tmp_path / "log")
    S.publish(messages(spark, 10), path)
    fails = F.udf(lambda v: v if v != "v37" else 1 / 0, "string")
    bad = messages(spark, 60, start=10).unionByName(messages(spark, 60, "prices"))
    with pytest.raises(Exception, match="ZeroDivision|division by zero"):
        S.publish(bad.withColumn("value", fails("value")), path)
    got = rows_of(S.read_topics(spark, path))
    assert len(got) == 10 and {g[0] for g in got} == {"t"}
    both = messages(spark, 5, start=10).unionByName(messages(spark, 5, "prices"))
    S.publish(both, path, txn="batch-0")
    assert len(os.listdir(f"{path}/manifests")) == 2  # one manifest shows both topics
    S.publish(both, path, txn="batch-0")  # a repeated batch changes nothing
    assert len(rows_of(S.read_topics(spark, path))) == 20
    last = json.load(open(f"{path}/manifests/1.json"))
    assert last["ends"] == {"t/0": 15, "prices/0": 5}


def test_odd_messages_and_an_empty_topic(spark, tmp_path):
    path = str(tmp_path / "log")
    assert S.read_topics(spark, path).count() == 0
    odd = spark.createDataFrame([("t", None, None, None), ("t", "", "", 5), ("t", "é", "x" * 100_000, -1), ("a/b", "k", "v", 0)],
                                "topic string, key string, value string, timestamp long")
    S.publish(odd.where("false"), path)
    assert S.read_topics(spark, path).count() == 0
    S.publish(odd, path, 4)
    got = S.read_topics(spark, path)
    assert sorted(map(str, ((r.topic, r.key, r.value, r.timestamp) for r in got.collect()))) == sorted(
        map(str, map(tuple, odd.collect())))
    assert got.where("key is null").first().partition == 0
    assert S.read_topics(spark, path, ["a/b"]).count() == 1
