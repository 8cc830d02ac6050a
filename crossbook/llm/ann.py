"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length one (nearness is the cosine) and hashed TABLES
times: HASHES Gaussian projections, shifted, divided by WIDTH and rounded down,
name a bucket. A query visits its own bucket and, per table, the PROBES - 1
others reached by moving some projections to the next cell, in order of the
estimated success: the smaller the sum of squared distances to the cell walls
crossed, the sooner. The candidates of all tables are merged and reranked by
their exact cosine in double precision. A query whose buckets hold fewer than
k other ids is compared with all vectors of its dimension, block by block.

Equal vectors are hashed once; as ties go to the smaller vec_id, the k + 1
smallest ids of a vector are all that any query can return. Index rows are
dealt out by bucket; a bucket group that grows beyond GROUP_ROWS is cut into
parts by a hash of the vector, each of which the group's queries visit.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and null ids, take no part, any other length does (vectors are
scaled before norms are taken, so 1e200 and 1e-200 count); only vectors of a query's own
dimension are its candidates; rows with the query's vec_id are not its
candidates; a vec_id with several vectors counts with its nearest; an empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossbook.llm.common import checkpointed

TABLES = 16
HASHES = 8
WIDTH = 2.0
PROBES = 80
GROUP_ROWS = 40_000
BLOCK_QUERIES = 2_000
BLOCK_CELLS = 4_000_000  # cosines held at a time
SEED = 17

FOUND_SCHEMA = "qkey bigint, vec_id bigint, score double"


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v, key) of the vectors that take part, as they are given;
    the key is a 64-bit hash of the vector."""
    v = F.col("v")
    kind = "float" if vectors.select(vec_col).dtypes[0][1] == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"),
                          F.col(vec_col).cast(f"array<{kind}>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    rows = rows.where(~F.coalesce(bad, F.lit(True))).where(F.exists(v, lambda x: x != 0))
    rows = rows.withColumn("v", F.transform(v, lambda x: x + F.lit(0.0).cast(kind)))  # -0.0 becomes 0.0
    return rows.withColumn("key", F.xxhash64("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """List column of one common length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row over the power of two at its largest component, so that the
    squares of its norm neither overflow nor vanish; directions stay as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _by_dimension(column: pa.Array):
    """(dimension, rows) of each vector length in a list column."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(size):
        yield int(d), np.flatnonzero(size == d)


_DRAWN: dict[int, tuple] = {}


def _projections(dim: int):
    """Projections, shifts and the odd multipliers that fold codes into a
    bucket name, drawn once for each worker process and dimension."""
    if dim not in _DRAWN:
        _DRAWN[dim] = _drawn(dim)
    return _DRAWN[dim]


def _drawn(dim: int):
    rng = np.random.default_rng([SEED, dim])
    a = rng.standard_normal((TABLES, HASHES, dim))
    b = rng.uniform(0, WIDTH, (TABLES, HASHES))
    fold = rng.integers(1, 1 << 62, (TABLES, HASHES), dtype=np.int64) | 1
    start = rng.integers(1, 1 << 62, TABLES, dtype=np.int64)
    return a, b, fold, start


def _cells(x: np.ndarray, table: int):
    """Fractional cell coordinates and bucket names in one table."""
    a, b, fold, start = _projections(x.shape[1])
    x = _scaled(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    place = (unit @ a[table].T + b[table]) / WIDTH
    cell = np.floor(place)
    name = start[table] + (cell.astype(np.int64) * fold[table]).sum(axis=1)
    return place - cell, name, fold[table]


def probe_order(gap: np.ndarray, probes: int) -> list[tuple[int, ...]]:
    """The ``probes`` sets of moves with the smallest sums of squared gaps, own
    bucket first. ``gap``: distances to the lower walls, then to the upper
    ones, of all projections; a set moves no projection twice."""
    cost = gap ** 2
    order = np.argsort(cost, kind="stable")
    cost = cost[order]
    half = len(gap) // 2
    out, heap = [()], [(float(cost[0]), (0,))]
    while heap and len(out) < probes:
        total, picked = heapq.heappop(heap)
        moves = tuple(int(order[i]) for i in picked)
        if len({m % half for m in moves}) == len(moves):
            out.append(moves)
        last = picked[-1]
        if last + 1 < len(gap):
            heapq.heappush(heap, (total + float(cost[last + 1]), picked + (last + 1,)))
            heapq.heappush(heap, (total - float(cost[last]) + float(cost[last + 1]),
                                  picked[:-1] + (last + 1,)))
    return out


def probe_buckets(x: np.ndarray) -> np.ndarray:
    """Bucket names that each query visits, all tables (rows: queries)."""
    out = np.zeros((len(x), TABLES, PROBES), np.int64)
    for t in range(TABLES):
        part, own, fold = _cells(x, t)
        gaps = np.concatenate([part, 1 - part], axis=1)
        for i in range(len(x)):
            moves = probe_order(gaps[i], PROBES)
            step = [sum(-int(fold[m]) if m < HASHES else int(fold[m - HASHES]) for m in s) for s in moves]
            step += [0] * (PROBES - len(step))
            out[i, t] = own[i] + np.array([((s + (1 << 63)) % (1 << 64)) - (1 << 63) for s in step], np.int64)
    return out.reshape(len(x), -1)


def index_rows(distinct: DataFrame, groups: int, parts: int) -> DataFrame:
    """One row per table and distinct vector, with its bucket group and part."""

    def run(batches):
        for batch in batches:
            for _, rows in _by_dimension(batch.column(1)):
                take = pa.array(rows)
                v, ids = batch.column(1).take(take), batch.column(0).take(take)
                part = (batch.column(2).take(take).to_numpy(zero_copy_only=False) >> 7) % parts
                x = _matrix(v)
                for t in range(TABLES):
                    _, name, _ = _cells(x, t)
                    yield pa.record_batch({
                        "g": pa.array(((name >> 5) % groups).astype(np.int32)),
                        "part": pa.array(part.astype(np.int32)), "bucket": pa.array(name),
                        "vec_ids": ids, "v": v})

    kind = dict(distinct.dtypes)["v"]
    return distinct.select("vec_ids", "v", "key").mapInArrow(
        run, f"g int, part int, bucket bigint, vec_ids array<bigint>, v {kind}")


def probe_rows(queries: DataFrame, groups: int) -> DataFrame:
    """One row per distinct query vector and bucket group that it visits."""

    def run(batches):
        for batch in batches:
            for _, rows in _by_dimension(batch.column(1)):
                for at in range(0, len(rows), 512):
                    take = pa.array(rows[at:at + 512])
                    keys, v = batch.column(0).take(take), batch.column(1).take(take)
                    names = probe_buckets(_matrix(v))
                    group = (names >> 5) % groups
                    order = np.argsort(group, axis=1, kind="stable")
                    names = np.take_along_axis(names, order, axis=1)
                    group = np.take_along_axis(group, order, axis=1)
                    first = np.concatenate([np.ones((len(names), 1), bool), group[:, 1:] != group[:, :-1]], axis=1)
                    starts = np.flatnonzero(first.ravel())
                    owner = pa.array(starts // names.shape[1])
                    yield pa.record_batch({
                        "g": pa.array(group.ravel()[starts].astype(np.int32)),
                        "qkey": keys.take(owner), "v": v.take(owner),
                        "buckets": pa.ListArray.from_arrays(
                            pa.array(np.append(starts, names.size).astype(np.int32)), pa.array(names.ravel()))})

    kind = dict(queries.dtypes)["v"]
    return queries.select("key", "v").mapInArrow(
        run, f"g int, qkey bigint, v {kind}, buckets array<bigint>")


def _best(qkey: np.ndarray, vec_id: np.ndarray, score: np.ndarray, k: int):
    """The k best of each query: larger score first, then smaller id; an id counts once."""
    order = np.lexsort((-score, vec_id, qkey))
    q, v = qkey[order], vec_id[order]
    order = order[np.concatenate([[True], (q[1:] != q[:-1]) | (v[1:] != v[:-1])])] if len(order) else order
    order = order[np.lexsort((vec_id[order], -score[order], qkey[order]))]
    q = qkey[order]
    first = np.searchsorted(q, q, "left")
    return order[np.arange(len(order)) - first < k]


def match_group(index: pd.DataFrame, probes: pd.DataFrame, k: int) -> pd.DataFrame:
    """Exact cosines of all candidates of a group, the k best of each query."""
    kept = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    if len(index) and len(probes):
        visited = np.concatenate(probes["buckets"].to_list())
        owner = np.repeat(np.arange(len(probes)), [len(b) for b in probes["buckets"]])
        pairs = np.unique(np.stack([visited, owner]), axis=1)
        bucket = index["bucket"].to_numpy()
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        dim_q, dim_v = probes["v"].map(len).to_numpy(), index["v"].map(len).to_numpy()[order]
        qkeys, found, size = probes["qkey"].to_numpy(), [], 0
        names, at = np.unique(pairs[0], return_index=True)
        for name, lo, hi in zip(names, at, np.append(at[1:], pairs.shape[1])):
            a, b = np.searchsorted(bucket, [name, name + 1] if name < np.iinfo(np.int64).max else [name, name])
            for dim in np.unique(dim_v[a:b]):
                rows = order[a:b][dim_v[a:b] == dim]
                who = pairs[1][lo:hi][dim_q[pairs[1][lo:hi]] == dim]
                if not len(rows) or not len(who):
                    continue
                x, q = (_scaled(np.stack(c.to_numpy()[r]).astype(np.float64))
                        for c, r in ((index["v"], rows), (probes["v"], who)))
                x_norm, q_norm = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
                ids = index["vec_ids"].to_numpy()[rows]
                place = np.repeat(np.arange(len(rows)), list(map(len, ids)))
                ids = np.concatenate(ids)
                by_id = np.argsort(ids, kind="stable")
                place, (ids, first) = place[by_id], np.unique(ids[by_id], return_index=True)
                top, step = min(k, len(ids)), max(1, BLOCK_CELLS // len(place))
                for start in range(0, len(who), step):
                    some = slice(start, start + step)
                    cos = (q[some] @ x.T) / q_norm[some, None] / x_norm[None, :]
                    # an id counts with its nearest vector before anything is cut
                    cos = np.maximum.reduceat(cos[:, place], first, axis=1)
                    # ties at the cut must all stay until ids are compared
                    edge = -np.partition(-cos, top - 1, axis=1)[:, top - 1]
                    i, j = np.nonzero(cos >= edge[:, None] - 1e-12)
                    found.append((qkeys[who[some][i]], ids[j], cos[i, j]))
                    size += len(i)
                    if size > 200_000:
                        kept, found, size = _merge(kept, found, k), [], 0
        kept = _merge(kept, found, k)
    return pd.DataFrame({"qkey": kept[0], "vec_id": kept[1], "score": kept[2]})


def _merge(kept, found, k):
    columns = [np.concatenate([c, *[f[i] for f in found]]) for i, c in enumerate(kept)]
    best = _best(*columns, k)
    return [c[best] for c in columns]


def exact(distinct: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best of each of the query vectors (key, v) among all vectors of
    its dimension: blocks of queries meet blocks of vectors."""
    index = distinct.withColumn("g", F.size("v"))
    probes = asked.select(F.size("v").alias("g"), F.col("key").alias("qkey"), "v")
    index = index.join(F.broadcast(probes.select("g").distinct()), "g", "left_semi")
    parts = max(1, -(-index.count() // GROUP_ROWS))
    blocks = max(1, -(-probes.count() // BLOCK_QUERIES))

    def dealt(column, n):
        return F.pmod(F.shiftright(column, 7), F.lit(n)).cast("int")

    def each(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    zero = F.lit(0).cast("bigint")
    index = (index.withColumn("part", dealt("key", parts)).withColumn("block", each(blocks))
             .select("g", "part", "block", zero.alias("bucket"), "vec_ids", "v"))
    probes = (probes.withColumn("block", dealt("qkey", blocks)).withColumn("part", each(parts))
              .select("g", "part", "block", "qkey", "v", F.array(zero).alias("buckets")))

    def match(index_part: pd.DataFrame, probe_part: pd.DataFrame) -> pd.DataFrame:
        return match_group(index_part, probe_part, k)

    return (index.groupBy("g", "part", "block").cogroup(probes.groupBy("g", "part", "block"))
            .applyInPandas(match, FOUND_SCHEMA))


def best_of(found: DataFrame, k: int) -> DataFrame:
    """(qkey, best): the k best ids of each query vector, in order."""
    return (found.groupBy("qkey", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(
                Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")))
            .where(F.col("rank") <= k)
            .groupBy("qkey").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("best")))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
            vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row."""
    spark = vectors.sparkSession
    valid = usable(vectors, id_col, vec_col)
    asked = usable(queries, id_col, vec_col)
    # the k + 1 smallest ids of each distinct vector; Spark limits the groups before the shuffle
    by_id = Window.partitionBy("key", "v").orderBy("vec_id")
    distinct = checkpointed(
        valid.distinct().withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1)
        .groupBy("key", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("vec_ids")))
    rows = distinct.count() * TABLES
    groups = max(1, -(-rows // GROUP_ROWS))
    largest = index_rows(distinct, groups, 1).groupBy("g").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-largest // (2 * GROUP_ROWS)))
    index = index_rows(distinct, groups, parts)
    probes = probe_rows(asked.select("key", "v").distinct(), groups).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    wanted = k + 1

    def match(index_part: pd.DataFrame, probe_part: pd.DataFrame) -> pd.DataFrame:
        return match_group(index_part, probe_part, wanted)

    found = (index.groupBy("g", "part").cogroup(probes.groupBy("g", "part"))
             .applyInPandas(match, FOUND_SCHEMA))
    ids = asked.select(F.col("vec_id").alias("query_id"), F.col("key").alias("qkey")).distinct()
    others = F.filter("best", lambda b: b.vec_id != F.col("query_id"))
    best = checkpointed(best_of(found, wanted))
    few = checkpointed(ids.join(best, "qkey", "left").where(F.coalesce(F.size(others), F.lit(0)) < k)
                       .select(F.col("qkey").alias("key")).distinct())
    if not few.isEmpty():
        again = exact(distinct, asked.select("key", "v").distinct().join(few, "key", "left_semi"), wanted)
        best = best.join(few, F.col("qkey") == F.col("key"), "left_anti").union(best_of(again, wanted))
    return (ids.join(best, "qkey").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("p", "b"))
            .select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "b.vec_id", "b.score"))
