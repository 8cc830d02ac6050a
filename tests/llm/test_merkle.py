"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from crossbook.llm import merkle, queries

FAN = 16
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    fields = [None if f is None else str(f) for f in (r.doc_id, r.source, r.lang, r.n_chars, text)]
    return H(*["-" if f is None else f"{len(f.encode())}:{f}" for f in fields])


def tree(leaves):
    """(root, for every leaf the [left, right] siblings of each level)."""
    level, groups, paths = leaves, [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(level) > 1:
        nodes, below = [], []
        for a in range(0, len(level), FAN):
            run = level[a:a + FAN]
            for slot in range(len(run)):
                for leaf in groups[a + slot]:
                    paths[leaf].append(("".join(run[:slot]), "".join(run[slot + 1:])))
            nodes.append(H(*run))
            below.append([x for g in groups[a:a + FAN] for x in g])
        level, groups = nodes, below
    return level[0], paths


def brute(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        sources[s].sort(key=lambda x: x[:3])
        built[s] = tree([x[2] for x in sources[s]])
    root, above = tree([built[s][0] for s in order])
    out = []
    for s, up in zip(order, above):
        for (_, _, leaf, r), path in zip(sources[s], built[s][1]):
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
            text = r.text.translate(LOWER) if hit and r.text is not None else r.text
            node = leaf_of(r, text)
            for left, right in path + up:
                node = H(left, node, right)
            proof = H(*[x for step in path + up for x in step])
            out.append((r.doc_id, leaf, built[s][0], root, proof, node, node == root))
    return sorted(out, key=str)


def digests(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_matches_brute_force(spark, sf, rows):
    got = queries.op12_merkle_manifest(spark, sf)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = brute(rows)
    assert digests(got) == want and {v[-1] for v in want} == {True, False}


def test_nulls_ties_repeats_and_empty(odd, none):
    assert digests(merkle.digest_manifest(odd)) == brute(odd.collect())
    assert merkle.digest_manifest(none).count() == 0
    one = odd.where("doc_id = 6")
    assert digests(merkle.digest_manifest(one)) == brute(one.collect())


@pytest.mark.parametrize("counts", [(1,), (16, 17, 1), (256, 257, 300), (4097, 2)])
def test_levels_of_every_depth(spark, counts):
    rows = [(s * 10_000 + i, f"Text {i} of {s}", "en", f"src{s}" if s else None, i)
            for s, n in enumerate(counts) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert digests(merkle.digest_manifest(docs.repartition(5))) == brute(docs.collect())


def test_many_sources_and_one_large(spark):
    rows = [(i, f"T{i}", None, f"s{i % 600}" if i % 3 else "hot", None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert digests(merkle.digest_manifest(docs)) == brute(docs.collect())


def test_proof_of_one_row_and_altered_fields(spark, docs):
    rows = merkle.manifest(docs, {"lang": F.lit("xx")})
    assert merkle.verify(rows).where("verified").count() == 0
    same = merkle.verify(merkle.manifest(docs))
    assert same.where("not verified").count() == 0 and same.where("other is not null").count() == 0
    r = same.first()
    node = r.leaf
    for step in r.path:
        node = hashlib.sha256((step.left + node + step.right).hex().encode()).digest()
    assert bytes(node) == bytes(r.root)


def test_missing_columns_are_null(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    full = docs.select("*", *[F.lit(None).cast(t).alias(c) for c, t in
                              (("lang", "string"), ("source", "string"), ("n_chars", "bigint"))])
    assert digests(merkle.digest_manifest(docs)) == digests(merkle.digest_manifest(full))
