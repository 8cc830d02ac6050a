"""Sharding by sampled splitters.

Records are ordered by a key: hash of the text, then doc_id, then a row hash,
so that equal texts lie together. A size-weighted sample of keys gives
splitters at the quantiles of many narrow ranges; records are dealt out by
range, range totals are summed, and shard borders are put at equal steps of
the exact running size: a range that a border crosses, or that is over-full
(one text may hold a third of all rows), is divided there.

Equal texts are a group. A group of at most WHOLE_GROUP of a shard's fair size
stays together, the border moves to its nearer end; a larger one is divided
record by record.

Law ``bytes``: shard sizes differ by about the largest record, or group that
stays together, at most.

Defined cases: a null text has size 16 and the digest of an empty text; rows
that are equal throughout are told apart by their place in the scan; a null
doc_id sorts first; an empty table has no rows; with fewer records than
shards some shards are empty. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossbook.llm.common import checkpointed, join_small

SHARDS = 40
OVERHEAD = 16
#: Expected keys in the sample, and narrow ranges per shard.
SAMPLE_KEYS = 20_000
RANGES_PER_SHARD = 16
#: Groups up to this share of a shard stay together; a group with more than so
#: many splitters is larger and lies in several ranges.
WHOLE_GROUP = 0.25
GROUP_SPLITTERS = 8
FIRST_KEY = -1 << 63


def records(docs: DataFrame) -> DataFrame:
    """Narrow records, written once: doc_id, size, text_crc32 and the key (k1, k2, k3)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return checkpointed(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1 << 63)).alias("k2"),
        F.monotonically_increasing_id().alias("k3")))


def sample_splitters(recs: DataFrame, total: int, ranges: int, expected: int = SAMPLE_KEYS) -> pd.DataFrame:
    """Keys at the quantiles of a size-weighted sample of about ``expected``
    keys: a record is drawn with a chance in proportion to its size."""
    draw = F.pmod(F.xxhash64("k3", "k2", "k1"), F.lit(1 << 53)) / float(1 << 53)
    keys = recs.where(draw < F.col("size") * (expected / max(total, 1))).select("k1", "k2", "k3", "size")
    # rows beyond the expected chance of 1 stand for their own size, the others for an equal share
    sample = keys.toPandas().sort_values(["k1", "k2", "k3"], ignore_index=True)
    if sample.empty:
        return sample[["k1", "k2", "k3"]]
    weight = np.maximum(sample["size"].to_numpy(float), max(total, 1) / expected)
    upto = np.cumsum(weight)
    at = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges, "left")
    found = sample.iloc[np.unique(np.minimum(at, len(sample) - 1))][["k1", "k2", "k3"]]
    # a group that a few splitters cut lies whole in the range that begins with it
    inside = found.groupby("k1")["k1"].transform("size") > GROUP_SPLITTERS
    starts = found[["k1"]].drop_duplicates().assign(k2=FIRST_KEY, k3=FIRST_KEY)
    return pd.concat([starts, found[inside]]).sort_values(["k1", "k2", "k3"], ignore_index=True)


def range_of(splitters: pd.DataFrame, k1: np.ndarray, k2: np.ndarray, k3: np.ndarray) -> np.ndarray:
    """Number of splitters at or before each key."""
    s1, s2, s3 = (splitters[c].to_numpy() for c in ("k1", "k2", "k3"))
    low, high = np.searchsorted(s1, k1, "left"), np.searchsorted(s1, k1, "right")
    out = low.copy()
    tied = np.flatnonzero(high > low)
    for value in np.unique(k1[tied]):
        rows = tied[k1[tied] == value]
        a, b = low[rows[0]], high[rows[0]]
        low2, high2 = np.searchsorted(s2[a:b], k2[rows], "left"), np.searchsorted(s2[a:b], k2[rows], "right")
        place = low2.copy()
        for r in np.flatnonzero(high2 > low2):
            place[r] += np.searchsorted(s3[a + low2[r]:a + high2[r]], k3[rows[r]], "right")
        out[rows] = a + place
    return out


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every document."""
    spark = docs.sparkSession
    recs = records(docs)
    total = recs.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = shards * RANGES_PER_SHARD
    splitters = sample_splitters(recs, total, ranges)  # under twice ``ranges`` keys
    sent = spark.sparkContext.broadcast(splitters)
    divided = F.col("k1").isin([int(k) for k in splitters["k1"][splitters["k1"].duplicated()].unique()])

    @F.pandas_udf("int")
    def place(k1: pd.Series, k2: pd.Series, k3: pd.Series) -> pd.Series:
        return pd.Series(range_of(sent.value, k1.to_numpy(), k2.to_numpy(), k3.to_numpy()).astype(np.int32))

    ranged = recs.withColumn("rng", place("k1", "k2", "k3"))
    sums = ranged.groupBy("rng").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    # at most twice ``ranges`` rows: the totals before each range
    bases = checkpointed(sums.select(
        "rng", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before")))
    inside = Window.partitionBy("rng").orderBy("k1", "k2", "k3")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("rng", "k1")
    placed = join_small(ranged, bases, 2 * ranges, ["rng"], "inner").select(
        "doc_id", "size", "text_crc32", "rng", "k1",
        (F.col("rows_before") + F.row_number().over(inside) - 1).alias("row"),
        (F.col("size_before") + F.coalesce(F.sum("size").over(upto), F.lit(0))).alias("at"))
    placed = placed.select("*", F.sum("size").over(group).alias("group_size"), F.min("at").over(group).alias("group_at"))
    whole = ~divided & (F.col("group_size") <= WHOLE_GROUP * total / shards)
    middle = F.when(whole, F.col("group_at") + F.col("group_size") / 2).otherwise(F.col("at") + F.col("size") / 2)
    rows = placed.select(
        "doc_id", "size", "text_crc32", "rng", "row",
        F.least(F.floor(middle * shards / max(total, 1)), F.lit(shards - 1)).cast("int").alias("shard"))
    rows = checkpointed(rows)
    # the order is global, so a shard is a run of rows
    first = rows.groupBy("shard").agg(F.min("row").alias("first"))
    return join_small(rows, first, shards, ["shard"], "inner").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))
