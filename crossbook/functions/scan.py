"""Skew-aware running scans (sum, last value, next value per key in a given order).

A window over a whole key sends every row of the key to one task, so one hot
key (a symbol holding a third of the book) serialises the job. The split form
computes the same column in three steps:

1. ``repartitionByRange(n, key, order)``: a hot key's rows are spread over
   several consecutive ranges. The rows are checkpointed with their range
   number (bounds are sampled per execution, so all uses must read one
   materialisation).
2. The same window function per (range, key): a hot key becomes many small
   window groups.
3. One row per (range, key) carries what the earlier (or later) ranges of
   that key contribute; it is joined back null-safely.

Both forms are Spark's own window functions over the same order, so NULL keys,
NULL values, NaN and 64-bit integers come out alike. ``strategy`` picks the
plan only: ``auto`` measures the largest key with one small aggregate and
splits when a key is hot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crossbook.session import reliable_checkpoint

PID = "_scan_pid"


# A key is "hot" when it alone holds more than HOT_FACTOR average partitions
# of rows and at least MIN_HOT_ROWS rows (below that one task is cheap).
HOT_FACTOR = 2.0
MIN_HOT_ROWS_CONF = "crossbook.scan.minHotRows"
MIN_HOT_ROWS_DEFAULT = 1_000_000


def hot_key_rows(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(rows of the largest key, all rows): one aggregation, one row back."""
    r = df.groupBy(*keys).count().agg(F.max("count").alias("m"), F.sum("count").alias("t")).first()
    return int(r["m"] or 0), int(r["t"] or 0)


def has_hot_key(df: DataFrame, keys: list[str], num_partitions: int) -> bool:
    spark = df.sparkSession
    min_rows = int(spark.conf.get(MIN_HOT_ROWS_CONF, str(MIN_HOT_ROWS_DEFAULT)))
    biggest, total = hot_key_rows(df, keys)
    return biggest >= min_rows and biggest > HOT_FACTOR * total / max(num_partitions, 1)


def _ranged(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The rows with the number of their (key, order) range, written once."""
    return reliable_checkpoint(
        df.repartitionByRange(n, *keys, *order).withColumn(PID, F.spark_partition_id()))


def _with_edges(local: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on (range, key), NULL keys included; Spark picks the join."""
    names = [PID, *keys]
    right = edges.select(*[F.col(c).alias(f"_edge_{c}") for c in names],
                         *[c for c in edges.columns if c not in names])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_edge_{c}")) for c in names])
    return local.join(right, same, "left")


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    return num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _is_split(df: DataFrame, keys: list[str], n: int, strategy: str, probe: DataFrame | None) -> bool:
    if strategy == "auto":
        return has_hot_key(probe if probe is not None else df, keys, n)
    return strategy == "split"


def running_sums(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str],
                 num_partitions: int | None = None, strategy: str = "auto",
                 probe: DataFrame | None = None) -> DataFrame:
    """Adds ``out = running sum of values[out]`` per ``keys`` in ``order``
    (current row included; NULL values are skipped, NULL before the first),
    as BIGINT. ``order`` must be unique within a key. ``probe`` is a cheaper
    DataFrame with the same key distribution to measure instead of ``df``."""
    n = _partitions(df, num_partitions)

    def sums(by):
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return {o: F.sum(v).over(w).cast("bigint") for o, v in values.items()}

    if not _is_split(df, keys, n, strategy, probe):
        return df.select("*", *[c.alias(o) for o, c in sums(keys).items()])
    ranged = _ranged(df, keys, order, n)
    local = ranged.select("*", *[c.alias(f"_local_{o}") for o, c in sums([PID, *keys]).items()])
    totals = ranged.groupBy(PID, *keys).agg(*[F.sum(v).alias(f"_total_{o}") for o, v in values.items()])
    before = Window.partitionBy(*keys).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    edges = totals.select(PID, *keys, *[F.sum(f"_total_{o}").over(before).alias(f"_before_{o}") for o in values])

    def whole(o):
        here, earlier = F.col(f"_local_{o}"), F.col(f"_before_{o}")
        return F.when(here.isNull(), earlier).otherwise(here + F.coalesce(earlier, F.lit(0)))

    return _with_edges(local, edges, keys).select(
        *df.columns, *[whole(o).cast("bigint").alias(o) for o in values])


def running_count(df: DataFrame, keys: list[str], order: list[str], out: str,
                  num_partitions: int | None = None, strategy: str = "auto",
                  probe: DataFrame | None = None) -> DataFrame:
    """1-based position of each row within its key in ``order`` (a skew-safe
    ``row_number()``), as INT. ``probe``: see ``running_sums``."""
    tmp = df.withColumn("_scan_one", F.lit(1).cast("bigint"))
    res = running_sums(tmp, keys, order, {out: "_scan_one"}, num_partitions, strategy, probe)
    return res.drop("_scan_one").withColumn(out, F.col(out).cast("int"))


def running_last(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str],
                 num_partitions: int | None = None, strategy: str = "auto",
                 probe: DataFrame | None = None) -> DataFrame:
    """Adds ``out = last non-null values[out]`` per key up to and including
    the row (``last(x, ignorenulls)`` over a running window)."""
    n = _partitions(df, num_partitions)

    def lasts(by):
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return {o: F.last(v, ignorenulls=True).over(w) for o, v in values.items()}

    if not _is_split(df, keys, n, strategy, probe):
        return df.select("*", *[c.alias(o) for o, c in lasts(keys).items()])
    ranged = _ranged(df, keys, order, n)
    local = ranged.select("*", *[c.alias(f"_local_{o}") for o, c in lasts([PID, *keys]).items()])
    tails = ranged.groupBy(PID, *keys).agg(
        *[F.max(F.when(F.col(v).isNotNull(), F.struct(*order, F.col(v).alias("_value"))))["_value"]
          .alias(f"_tail_{o}") for o, v in values.items()])
    before = Window.partitionBy(*keys).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    edges = tails.select(PID, *keys, *[F.last(f"_tail_{o}", ignorenulls=True).over(before).alias(f"_before_{o}")
                                       for o in values])
    return _with_edges(local, edges, keys).select(
        *df.columns, *[F.coalesce(f"_local_{o}", f"_before_{o}").alias(o) for o in values])


def running_next(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str],
                 num_partitions: int | None = None, strategy: str = "auto",
                 probe: DataFrame | None = None) -> DataFrame:
    """Adds ``out = lead(values[out])`` per key in ``order`` (NULL for a
    key's last row)."""
    n = _partitions(df, num_partitions)

    def nexts(by):
        w = Window.partitionBy(*by).orderBy(*order)
        return {o: F.lead(v).over(w) for o, v in values.items()}

    if not _is_split(df, keys, n, strategy, probe):
        return df.select("*", *[c.alias(o) for o, c in nexts(keys).items()])
    ranged = _ranged(df, keys, order, n)
    in_range = Window.partitionBy(PID, *keys).orderBy(*order)
    local = ranged.select("*", *[c.alias(f"_local_{o}") for o, c in nexts([PID, *keys]).items()],
                          F.lead(F.lit(True)).over(in_range).isNull().alias("_ends_range"))
    first = F.min(F.struct(*order, *[F.col(v).alias(f"_head_{o}") for o, v in values.items()]))
    heads = ranged.groupBy(PID, *keys).agg(first.alias("_first"))
    after = Window.partitionBy(*keys).orderBy(PID)
    edges = heads.select(PID, *keys, *[F.lead(f"_first._head_{o}").over(after).alias(f"_after_{o}")
                                       for o in values])
    return _with_edges(local, edges, keys).select(
        *df.columns, *[F.when(F.col("_ends_range"), F.col(f"_after_{o}")).otherwise(F.col(f"_local_{o}")).alias(o)
                       for o in values])
