"""Ranked search against scoring every document in plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossbook.llm import lexical, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """(item_id, rank, doc_id, score) from the definition, every document scored."""
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_words = len(held), sum(sum(c.values()) for _, c in held)
    frequency = Counter(t for _, c in held for t in c)
    wanted = {}
    for item, text in items:
        if item is not None:
            wanted.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, query in wanted.items():
        ranking = []
        for doc, count in held:
            m = 100 - 75 + (75 * sum(count.values()) * n_docs) // n_words
            score = 0
            for t, times in query.items():
                if t in count:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency[t] + 1)))
                    score += times * w * ((1_000_000_000 * count[t]) // (1000 * count[t] + 8 * m))
            if score > 0:
                ranking.append((-score, doc is None, doc))
        ranking.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(item, n + 1, doc, -score) for n, (score, _, doc) in enumerate(ranking[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_matches_brute_force(spark, sf, rows):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = queries.op13_lexical_search(spark, sf)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute([(r.doc_id, r.text) for r in rows], items)
    assert found(got) == want and len(want) > len(items)


def test_odd_rows_on_both_sides(spark, odd, none):
    items = spark.createDataFrame(
        [(1, "the QUICK onion, and the"), (2, None), (3, "!!"), (None, "thin line"), (10, "thin line of words"),
         (2, "émile ÉTAIT"), (4, "34 nobody unknownword"), (1, "another text")], "item_id bigint, text string")
    items = items.withColumn("terms", F.lit("x")).withColumn("rank", F.lit(1))
    want = brute([(r.doc_id, r.text) for r in odd.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(lexical.search_documents(odd, items)) == want and want
    assert lexical.search_documents(none, items).count() == 0
    assert lexical.search_documents(odd, items.where("false")).count() == 0


@pytest.mark.parametrize("shard,block,first", [(1 << 20, 1 << 20, 32), (2000, 200, 1), (200, 1 << 20, 2)])
def test_shards_blocks_and_mask_steps(spark, monkeypatch, shard, block, first):
    """Equal rankings for any cut into shards, blocks of items and groups of
    masks, with ties, copies and a word in every document."""
    monkeypatch.setattr(lexical, "SHARD_BYTES", shard)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical, "FIRST_MASKS", first)
    rng = np.random.default_rng(2)
    vocabulary = [f"w{int(x)}" for x in rng.zipf(1.3, 4000) % 300]
    texts = [" ".join(["the", *rng.choice(vocabulary, int(rng.integers(0, 60)))]) for _ in range(200)]
    texts += texts[:20] + [texts[5]] * 30 + ["", None, "the"]
    ids = [int(x) for x in rng.permutation(len(texts))]
    docs = list(zip(ids, texts)) + [(None, texts[3])]
    items = [(i, " ".join(rng.choice(vocabulary, 80))) for i in range(12)] + [(50, "the the"), (51, texts[5])]
    got = lexical.search_documents(
        spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3),
        spark.createDataFrame(items, "item_id bigint, text string"))
    assert found(got) == brute(docs, items)


def test_masks_end_early_and_cover_all_terms():
    """Of many documents only the groups whose maximum can still enter are scored."""
    calls = []
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(200)], 20)) for _ in range(3000)]
    import pyarrow as pa
    from crossbook.llm.common import WORD_TABLE, split_words
    offsets, codes, words = split_words(pa.array(texts), WORD_TABLE)
    scored = lexical._scores

    def counting(chosen, *rest):
        calls.append(len(chosen))
        return scored(chosen, *rest)

    rows = []

    class Frame:  # the index is built by the same function as in tasks
        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            rows.extend(f(iter([pa.record_batch({"doc_id": pa.array(range(3000), pa.int64()), "text": pa.array(texts)})])))
            return self

    saved = lexical.checkpointed
    lexical.checkpointed, lexical._scores = (lambda df: df), counting
    try:
        lexical.build_index(Frame())
        shard = {n: rows[0].column(n)[0] for n in rows[0].schema.names}
        shard = {n: (v.values if pa.types.is_list(v.type) else v.as_py()) for n, v in shard.items()}
        shard["doc_ids"] = shard["doc_ids"].to_numpy()
        words = [f"w{i}" for i in range(12)]
        block = {"terms": words, "items": [(np.arange(12), np.full(12, 1000))]}
        best = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        lexical._rank_shard(shard, block, 3000, 60000, best, 10)
    finally:
        lexical.checkpointed, lexical._scores = saved, scored
    assert 0 < sum(calls) < 1500 and len(best[0][0]) == 10
