"""Nearest neighbours and sharding against brute force."""

import zlib

import numpy as np
import pandas as pd
import pytest

from crossbook.llm import ann, queries, sharding


def brute(vectors, k=5):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[q]
        others = [(-s, i) for s, i in zip(score, ids) if i != ids[q]]
        out[int(ids[q])] = sorted(others)[:k]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    want = brute([(r.vec_id, r.embedding) for r in rows])
    got = {}
    for r in queries.op3_nearest_neighbours(spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q, best in want.items():
        mine = sorted(got.get(q, []))
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
        assert [m[2] for m in mine] == sorted((m[2] for m in mine), reverse=True)
        exact = {i: -s for s, i in best}
        hits += sum(m[1] in exact for m in mine)
        total += len(best)
        assert all(abs(exact[m[1]] - m[2]) < 1e-9 for m in mine if m[1] in exact)
    assert hits / total >= 0.9


def test_odd_vectors_ties_and_parts(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    same = [(i, [1.0, 2.0, 3.0]) for i in range(0, 3000, 10)]
    rows = same + [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 1.0]), (5, [nan, 1.0, 1.0]),
                   (6, [inf, 1.0, 1.0]), (None, [1.0, 2.0, 3.0]), (7, [2.0, 4.0, 6.0]), (8, [1.0, 2.0]),
                   (0, [1.0, 2.0, 3.0]), (9, [-0.0, 1.0, 0.0]), (50, [5.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows],
                               "vec_id bigint, embedding array<float>, v string, key int")
    for size in (40_000, 2):
        monkeypatch.setattr(ann, "GROUP_ROWS", size)
        got = {}
        for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        # ids 0, 7 (the same direction), 10, 20 ... are all at cosine 1
        assert [v for _, v, _ in sorted(got[1000])][:5] == sorted(v for _, v, _ in got[1000])
        assert {0, 10, 20} <= {v for _, v, _ in got[1000]} | {7}
        assert all(abs(s - 1) < 1e-12 for _, _, s in got[1000])
        assert 0 not in {v for _, v, _ in got[0]} and len(got[0]) == 5
        assert not {2, 3, 4, 5, 6, 8} & {v for rs in got.values() for _, v, _ in rs}
    assert ann.nearest(df.where("false"), df.where("false")).count() == 0


def test_probe_order_is_by_estimated_success():
    gap = np.array([0.1, 0.6, 0.3, 0.9, 0.4, 0.7])
    got = ann.probe_order(gap, 12)
    cost = [sum(gap[m] ** 2 for m in s) for s in got]
    assert got[0] == () and cost == sorted(cost) and len(set(map(frozenset, got))) == len(got)
    valid = [s for n in range(1 << 6) for s in [[m for m in range(6) if n >> m & 1]]
             if len({m % 3 for m in s}) == len(s)]
    best = sorted(sum(gap[m] ** 2 for m in s) for s in valid)[:12]
    assert np.allclose(cost, best)


def test_sharding(spark, sf, rows):
    got = queries.op10_sharding(spark, sf).collect()
    text = {r.doc_id: (r.text or "").encode() for r in rows}
    assert sorted(r.doc_id for r in got) == sorted(text)
    slots, sizes = {}, {}
    for r in got:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (
            len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id]), "bytes", None)
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    mean, largest = sum(sizes.values()) / 40, max(r.size for r in got)
    assert all(abs(sizes.get(s, 0) - mean) <= largest for s in range(40))


def test_sharding_a_hot_text_and_edges(spark, odd, none):
    docs = spark.createDataFrame([(i % 7, "same text " * 20) for i in range(3000)] + [(i, f"t{i}") for i in range(999)],
                                 "doc_id bigint, text string")
    sizes = [r["sum(size)"] for r in sharding.shard_by_bytes(docs).groupBy("shard").sum("size").collect()]
    assert len(sizes) == 40 and max(sizes) - min(sizes) <= 2 * 216
    out = sharding.shard_by_bytes(odd).collect()
    assert len(out) == odd.count() and sum(r.size for r in out) == sum(
        len((r.text or "").encode()) + 16 for r in odd.collect())
    assert sharding.shard_by_bytes(none).count() == 0


def test_small_groups_of_equal_texts_stay_together(spark):
    """400 texts in 1 to 12 copies, and one text with a third of all rows."""
    rng = np.random.default_rng(6)
    texts = [f"text {i} " + "x" * int(n) for i, n in enumerate(rng.integers(1, 400, 4000))]
    body = [t for t in texts for _ in range(int(rng.integers(1, 13)))]
    body += ["hot"] * (len(body) // 2)
    docs = spark.createDataFrame([(int(i), body[j]) for i, j in enumerate(rng.permutation(len(body)))],
                                 "doc_id bigint, text string").repartition(6)
    got = sharding.shard_by_bytes(docs).collect()
    text_of = {r.doc_id: r.text for r in docs.collect()}
    shards, sizes, slots = {}, {}, {}
    for r in got:
        shards.setdefault(text_of[r.doc_id], set()).add(r.shard)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(s) == 1 for t, s in shards.items() if t != "hot") and len(shards["hot"]) > 1
    fair = sum(sizes.values()) / 40
    assert len(sizes) == 40 and all(abs(n - fair) <= 12 * 430 for n in sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == len(body)


def test_ranges_of_keys():
    splitters = pd.DataFrame({"k1": [1, 5, 5, 5, 9], "k2": [0, 1, 1, 4, 0], "k3": [0, 2, 6, 0, 0]})
    keys = [(0, 0, 0), (1, 0, 0), (5, 0, 9), (5, 1, 2), (5, 1, 5), (5, 1, 6), (5, 4, 0), (7, 0, 0), (9, 9, 9)]
    got = sharding.range_of(splitters, *[np.array(c) for c in zip(*keys)])
    ordered = list(splitters.itertuples(index=False, name=None))
    assert got.tolist() == [sum(s <= k for s in ordered) for k in keys]


def crowded():
    """The query's own id and a hot id with a hundred near vectors each, ten ids farther off."""
    rng = np.random.default_rng(3)
    near = [1.0, 0.0, 0.0] + rng.normal(0, 1e-5, (200, 3))
    rows = [(0, v) for v in near[:100]] + [(7, v) for v in near[100:]]
    return rows + [(i, np.array([1.0, 1e-4 * i, 0.0])) for i in range(11, 21)]


@pytest.mark.parametrize("cells", [4_000_000, 1])
def test_an_id_with_many_vectors_takes_one_place_in_a_bucket(monkeypatch, cells):
    monkeypatch.setattr(ann, "BLOCK_CELLS", cells)
    rows = crowded()
    index = pd.DataFrame({"bucket": 5, "vec_ids": [np.array([i]) for i, _ in rows], "v": [v for _, v in rows]})
    probes = pd.DataFrame({"qkey": [1, 2], "v": [rows[0][1], rows[150][1]], "buckets": [np.array([5])] * 2})
    got = ann.match_group(index, probes, 6)
    for key, (_, q) in ((1, rows[0]), (2, rows[150])):
        mine = got[got.qkey == key]
        assert set(mine.vec_id) == {0, 7, 11, 12, 13, 14}
        score = {i: max(q @ v / np.linalg.norm(q) / np.linalg.norm(v) for j, v in rows if j == i) for i in mine.vec_id}
        assert all(abs(score[i] - s) < 1e-12 for i, s in zip(mine.vec_id, mine.score))


def test_an_id_with_many_vectors_takes_one_place(spark):
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in crowded()],
                               "vec_id bigint, embedding array<double>").coalesce(1)
    got = ann.nearest(df, df.limit(1)).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 7), (0, 11), (0, 12), (0, 13), (0, 14)]


@pytest.mark.parametrize("n", [2, 3, 6])
def test_small_tables_give_all_candidates(spark, monkeypatch, n):
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 2)
    # opposite vectors share no bucket; the last has a dimension of its own
    rows = [(i, v) for i, v in enumerate([s * e for e in np.eye(3) for s in (1.0, -1.0)][:n])]
    rows.append((99, np.array([1.0, 2.0])))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows],
                               "vec_id bigint, embedding array<double>").coalesce(1)
    got = {}
    for r in ann.nearest(df, df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(n))
    for q, mine in got.items():
        want = sorted((-float(rows[q][1] @ v), i) for i, v in rows[:n] if i != q)[:5]
        assert [(r, i) for r, i, _ in sorted(mine)] == [(r + 1, i) for r, (_, i) in enumerate(want)]
        assert all(abs(s + w) < 1e-12 for (_, _, s), (w, _) in zip(sorted(mine), want))


@pytest.mark.parametrize("size", [1e200, 1e-200, 1e-310, 1.0])
def test_extreme_lengths_take_part(spark, size):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4) * size) for i in (0, 50, 1, 2, 3)]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute([(i, v / size) for i, v in rows], 4)
    for q in (0, 50):
        mine = sorted(got[q])
        assert [v for _, v, _ in mine] == [i for _, i in want[q]] and len(mine) == 4
        assert all(abs(s + w) < (1e-12 if size != 1e-310 else 1e-9) for (_, _, s), (w, _) in zip(mine, want[q]))
