"""Decontamination, line dedup, repeated passages, SimHash, language and
quality against brute force or held-out accuracy."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from crossbook.llm import (decontaminate, langid, line_dedup, packing, quality, queries, simhash,
                           suffix_dedup)
from crossbook.llm.components import connected_components

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_hits(docs, items, window=10):
    """(n_words, n_hit, items) per document, by comparing every place."""
    wanted = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(len(w), window)
        for s in range(len(w) - n + 1 if w else 0):
            wanted[tuple(w[s:s + n])].add(str(item))
    sizes = {len(k) for k in wanted}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                own = wanted.get(tuple(w[s:s + n]))
                if own:
                    hit.update(range(s, s + n))
                    found |= own
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return out


def frame(sql, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rel = con.sql(sql)
    return sorted(map(str, [dict(zip(rel.columns, r)) for r in rel.fetchall()]))


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_sql(spark, sf, name):
    got = queries.registry()[name](spark, sf).collect()
    assert sorted(str(r.asDict()) for r in got) == frame(queries.oracles()[name], sf)


def test_decontamination_brute_force(spark, sf, rows):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {d: (n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0)
            for d, n, h, i in brute_hits([(r.doc_id, r.text) for r in rows], items)}
    got = {r[0]: tuple(r)[1:] for r in queries.op1_decontamination(spark, sf).collect()}
    assert got == want and any(v[4] for v in want.values())


def test_decontamination_edges_and_blocks(spark, odd, none, monkeypatch):
    items = spark.createDataFrame(
        [(1, "the QUICK onion, and the"), (2, None), (3, "!!"), (None, "thin line"), (10, "thin line of words"),
         (2, "émile ÉTAIT"), (4, "words that nobody ever wrote before today the quick onion and")],
        "item_id bigint, text string")
    usable = [(r.item_id, r.text) for r in items.collect() if r.item_id is not None]
    want = sorted(map(str, brute_hits([(r.doc_id, r.text) for r in odd.collect()], usable)))
    for size in (1 << 20, 1):  # one block, and one for each item
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = decontaminate.match_documents(odd, items)
        assert sorted(str((r.doc_id, r.n_words, r.n_hit, r["items"])) for r in got.collect()) == want
    assert decontaminate.match_documents(none, items).count() == 0
    assert decontaminate.match_documents(odd, items.where("false")).where("n_hit > 0").count() == 0
    kept = decontaminate.remove_contaminated(odd, items)
    assert kept.columns == odd.columns
    clean = [w for w in brute_hits([(r.doc_id, r.text) for r in odd.collect()], usable) if not w[2]]
    assert kept.count() == len(clean)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "beta alpha gamma"), (4, "gamma"), (3, "alpha y y y y beta gamma")],
                                 "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    hits = {r.doc_id: r.n_hit > 0 for r in decontaminate.match_documents(docs, items, slop=2).collect()}
    assert hits == {1: True, 2: True, 3: False, 4: False}
    assert decontaminate.match_documents(docs, items).where("n_hit > 0").count() == 0


def test_line_dedup_edges(spark, odd, none):
    many = spark.createDataFrame(
        [(i, f"own {i}\nshared\n\nshared", f"s{i}", 1) for i in range(11)] + [(None, "shared", None, 1)],
        "doc_id bigint, text string, source string, n_chars bigint")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(many).collect()}
    assert out[0].text == "own 0\nshared\n\nshared" and out[3].text == "own 3\n" and out[3].n_removed == 2
    assert out[None].text == "" and out[None].n_lines == 1
    few = line_dedup.dedup_lines(many.where("doc_id < 9 or doc_id is null"))
    assert few.agg(F.sum("n_removed")).first()[0] == 0
    whole = line_dedup.dedup_lines(odd, min_sites=3)
    assert whole.count() == odd.count() and set(odd.columns) <= set(whole.columns)
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_uses_sketches_then_exact_counts(spark, monkeypatch):
    rows = [(i, f"line {i % 7}", f"s{i % (3 + i % 7)}", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    sites = defaultdict(set)
    for _, t, s, _ in rows:
        sites[t].add(s)
    for threshold in (2, 3, 5):
        bad = {t for t, s in sites.items() if len(s) >= threshold}
        first = {t: min(i for i, x, _, _ in rows if x == t) for t in bad}
        want = {i for i, t, _, _ in rows if t in bad and first[t] != i}
        got = line_dedup.dedup_lines(docs, threshold).where("n_removed > 0")
        assert {r.doc_id for r in got.collect()} == want


def brute_passages(docs, n=50):
    """Word positions of each document in windows that another text has too."""
    where, own = defaultdict(set), {}
    for i, (doc_id, text) in enumerate(docs):
        own[i] = words(text)
        for s in range(len(own[i]) - n + 1):
            where[tuple(own[i][s:s + n])].add((i, s))
    seen = defaultdict(set)
    for places in where.values():
        if len({docs[i][0] for i, _ in places}) > 1 or len({docs[i][1] for i, _ in places}) > 1:
            for i, s in places:
                seen[i].update(range(s, s + n))
    for i, (doc_id, text) in enumerate(docs):  # copies under two ids repeat throughout
        if len(own[i]) >= n and len({d for d, t in docs if t == text}) > 1:
            seen[i] = set(range(len(own[i])))
    return {(docs[i][0], p) for i, ps in seen.items() for p in ps}


def test_repeated_passages(spark, sf, rows, odd, none):
    want = brute_passages([(r.doc_id, r.text) for r in rows])
    got = queries.op7_suffix_dedup(spark, sf).collect()
    assert {(r.doc_id, p) for r in got for p in range(r.start, r.start + r.length)} == want and want
    assert suffix_dedup.repeated_passages(none).count() == 0
    got = suffix_dedup.repeated_passages(odd).collect()
    assert {r.doc_id for r in got} >= {6} or not got


@pytest.mark.parametrize("partitions", [1, 5])
def test_windows_settled_in_a_partition_or_between(spark, partitions):
    """Window rows over several partitions and Arrow batches of a few rows: a
    row stays if its window stands in two texts, wherever they lie. One window
    is very common: of it no more rows than one per partition meet again."""
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 60)), int(rng.integers(0, 40)), n) for n in range(150)]
    rows += [(1000, t, 1000 + t) for t in range(300)] + [(2000, 7, 5000 + n) for n in range(40)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        windows = spark.createDataFrame(rows, "win bigint, text_key bigint, pos int").repartition(partitions)
        got = sorted(tuple(r) for r in suffix_dedup.repeated_windows(windows).collect())
        again = suffix_dedup.settled_windows(windows).where(f"win = 1000 and state <> {suffix_dedup.SETTLED}")
        met = again.count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    texts = defaultdict(set)
    for win, key, _ in rows:
        texts[win].add(key)
    assert got == sorted((key, pos) for win, key, pos in rows if len(texts[win]) > 1)
    # a run's first Arrow batch may hold a single row, which then stays open
    assert met <= 2 * partitions


def test_repeated_passages_of_partial_overlap(spark):
    word = [f"w{i}" for i in range(400)]
    texts = ["a b " + " ".join(word[0:60]) + " c d", "e " + " ".join(word[0:60]) + " f",
             "g " + " ".join(word[20:200]) + " h", " ".join(word[150:199]) + " i", " ".join(word[120:175]),
             " ".join(word[300:400]), " ".join(word[300:400]), None, "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = suffix_dedup.repeated_passages(docs).collect()
    assert {(r.doc_id, p) for r in got for p in range(r.start, r.start + r.length)} == brute_passages(
        list(enumerate(texts)))
    assert {r.doc_id for r in got if r.whole} == {5, 6}


def brute_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, bits=4):
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    least = {c: min((ids[i] for i in range(len(ids)) if label[i] == c and ids[i] is not None), default=None)
             for c in set(label)}
    return [least[c] for c in label]


def test_simhash(spark, sf, rows, odd, none):
    prints = [brute_fingerprint(r.text) for r in rows]
    comps = brute_components([r.doc_id for r in rows], prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash(spark, sf).collect()}
    assert got == {r.doc_id: (f"{p:016x}", c) for r, p, c in zip(rows, prints, comps)}
    o = odd.collect()
    prints = [brute_fingerprint(r.text) for r in o]
    comps = brute_components([r.doc_id for r in o], prints)
    got = simhash.group_documents(odd).select("doc_id", simhash.hex_digits().alias("f"), "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(
        str((r.doc_id, f"{p:016x}", c)) for r, p, c in zip(o, prints, comps))
    assert simhash.group_documents(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(brute_components(list(range(len(o))), prints)))


@pytest.mark.parametrize("small", [2, 64])
def test_simhash_links_span_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL_CELL", small)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    prints = np.unique([int(c) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False))
                        for c in centres for k in rng.integers(0, 6, 25)])
    df = spark.createDataFrame([(int(p) - (1 << 64) if p >= 1 << 63 else int(p),) for p in prints.tolist()], "fp bigint")
    comps = {r.node % (1 << 64): r.component for r in connected_components(simhash.links(df)).collect()}
    want = brute_components(list(range(len(prints))), [int(p) for p in prints])
    groups = defaultdict(set)
    for p, c in zip(prints.tolist(), want):
        groups[c].add(p)
    for members in groups.values():
        if len(members) > 1:
            assert len({comps[m] for m in members}) == 1
        else:
            assert not members & set(comps)
    linked = defaultdict(set)
    for m, c in comps.items():
        linked[c].add(m)
    assert sorted(map(sorted, linked.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    bound = simhash.manhattan(simhash.segment_counts(x), simhash.segment_counts(y))
    slow = [sum(abs((a >> 2 * i & 3).bit_count() - (b >> 2 * i & 3).bit_count()) for i in range(32))
            for a, b in zip(x.tolist(), y.tolist())]
    assert bound.tolist() == slow and (bound <= np.bitwise_count(x ^ y)).all()


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1000), (2001, 2000)], "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 2000: 2000, 2001: 2000}
    assert connected_components(edges.where("false")).count() == 0


def test_language(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op9_language(spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(lang)
    out = langid.identify_language(odd).collect()
    assert len(out) == odd.count()
    assert {r.lang_pred for r in out if r.doc_id in (3, 4, 5, 7)} == {"und"}
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.lang_pred != "und" for r in out)
    assert langid.identify_language(none).count() == 0
    assert {r.lang_pred for r in langid.identify_language(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_string_kernel_counts_shared_grams():
    import pyarrow as pa
    texts = ["Ab, ab", "abé", "", "x" * 5000]
    bits = langid.presence(pa.array(texts))

    def code(gram):  # the hash of one n-gram, written out
        value = 0
        for byte in gram.encode():
            value = (value * 257 + byte) % 2 ** 32
        return (value + len(gram)) * 2654435769 % 2 ** 32 >> 32 - langid.BITS

    own = " ab ab "
    assert set(np.flatnonzero(bits[0]).tolist()) == {
        code(own[i:i + n]) for n in (1, 2, 3) for i in range(len(own) - n + 1)}
    assert (langid.presence(pa.array(texts[1:]))[0] == bits[1]).all()  # no text sees its neighbour


def test_quality(spark, odd, none):
    sf = "/root/testdata/sf0.1"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op5_quality(spark, sf).collect()
    assert len({r.doc_id for r in got}) == len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.score, label[r.doc_id]) for r in got if r.held_out and r.doc_id in label]
    pos, neg = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.85, auc
    assert all((r.score >= 0.3) == bool(r.predicted) and 0 <= r.score <= 1 for r in got)
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, 1, 0), (None, 1, 1), (2, None, 0), (7, 3, 0)],
                                   "doc_id bigint, quality int, toxic int")
    out = quality.score_quality(odd, quality.fit_quality(odd, labels)).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in quality.score_quality(odd, quality.fit_quality(odd, labels.where("false"))).collect()} == {0.5}
    assert quality.score_quality(none, None).count() == 0


def test_factorisation_machine_interactions_are_the_pair_sum():
    rng = np.random.default_rng(1)
    fm = quality.FactorisationMachine()
    fm.w = rng.normal(size=quality.SIZE).astype(np.float32)
    number, value = np.array([3, 9, 77, 2000]), rng.normal(size=4).astype(np.float32)
    pairs = sum(float(fm.v[number[i]] @ fm.v[number[j]]) * value[i] * value[j] for i in range(4) for j in range(i))
    assert fm.margins(np.array([0, 4]), number, value)[0] == pytest.approx(float(fm.w[number] @ value) + pairs, abs=1e-5)


def brute_line_dedup(docs, min_sites=10):
    """Each document's text without boilerplate lines, by plain counting."""
    sites, first = defaultdict(set), {}
    for r in docs:
        for line in (r.text or "").split("\n"):
            if line and r.source is not None:
                sites[line].add(r.source)
            if line:
                first[line] = min(first.get(line, r.doc_id), r.doc_id)
    bad = {line for line, s in sites.items() if len(s) >= min_sites}
    return {r.doc_id: None if r.text is None else "\n".join(
        x for x in r.text.split("\n") if x not in bad or first[x] == r.doc_id) for r in docs}


def packed_as_brute_force(docs, pieces):
    """Every id of every document in one piece, by the plain tokenizer, and
    sequences filled without gaps, each but the last."""
    from tokenizers import Tokenizer

    from crossbook.llm.tokens import default_tokenizer
    plain = Tokenizer.from_file(default_tokenizer())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for r in docs:
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [2]
        at = 0
        for p in sorted(by_doc[r.doc_id], key=lambda p: p.start):
            own = np.array(ids[p.start:p.start + p.length], "<u4").tobytes()
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(own))
            at += p.length
        assert at == len(ids)
    sizes = {}
    for s, own in by_sequence.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        sizes[s] = at
    assert max(sizes.values()) <= 4096 and sum(n < 4096 for n in sizes.values()) <= 1


def test_pipeline_stages(spark, sf, docs, rows, odd, none, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "simhash_dedup", "decontamination", "packing"]
    current = docs
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = current.collect()
        stage(spark, current, sf).write.parquet(f"{tmp_path}/{n}")
        current = spark.read.parquet(f"{tmp_path}/{n}")
        after = current.collect()
        kept = {r.doc_id for r in after}
        if name == "packing":
            assert kept == {r.doc_id for r in before} and sum(r.length for r in after) == sum(
                {r.doc_id: r.doc_tokens for r in after}.values())
            packed_as_brute_force(before, after)
            break
        assert current.columns == docs.columns
        if name == "language_id":
            assert kept == {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}
        if name == "simhash_dedup":
            comps = brute_components([r.doc_id for r in before], [brute_fingerprint(r.text) for r in before])
            assert sorted(r.doc_id for r in after) == sorted(set(comps))
        if name == "decontamination":
            assert kept == {d for d, _, h, _ in brute_hits([(r.doc_id, r.text) for r in before], items) if not h}
        if name == "line_dedup":
            assert len(after) == len(before) and all(r.n_chars == len(r.text) for r in after)
            want = brute_line_dedup(before)
            assert {r.doc_id: r.text for r in after} == want
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
        got = stage(spark, odd, sf)
        assert got.count() >= 0 and (name == "packing" or got.columns == odd.columns or "n_lines" in odd.columns)
    whole = corpus_pipeline.run(spark, sf)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = {tuple(r) for r in whole.select("doc_id", "doc_tokens").collect()}
    assert got == {(r.doc_id, r.doc_tokens) for r in after} and packing.WINDOW == 4096
    assert sum(r.length for r in whole.select(columns).collect()) == sum(r.length for r in after)


def test_language_sample_holds_every_language(spark):
    """Neither letterless rows nor many rows of one doc_id take the places of learnable documents."""
    body = [(i, "1234 !?", "bb") for i in range(2000)] + [(i, f"zwei drei {i}", "bb") for i in range(2000, 2040)]
    body += [(i, f"one two {i % 50} and {k}", "aa") for i in range(-20, 0) for k in range(200)]
    body += [(5000 + i, "same text", "cc") for i in range(20) for _ in range(30)]
    df = spark.createDataFrame(body, "doc_id bigint, text string, lang string")
    model = langid.fit_language(df, 2)
    assert model.langs == ["aa", "bb", "cc"]


def test_too_many_languages_are_an_error(spark):
    body = [(i, f"some text {i}", f"l{i % 65}") for i in range(65 * 20)]
    df = spark.createDataFrame(body, "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError, match="64"):
        langid.fit_language(df, 2)
    assert len(langid.fit_language(df.where("lang <> 'l64'"), 2).langs) == 64


def test_language_stage_with_too_many_languages(spark):
    body = [(i, f"some text {i}" if i % 10 else "123", f"l{i % 65}") for i in range(65 * 20)]
    kept = langid.keep_identified(spark.createDataFrame(body, "doc_id bigint, text string, lang string"))
    assert kept.count() == sum(1 for _, t, _ in body if t != "123")


def test_language_stage_without_a_model_keeps_texts_with_a_letter(odd):
    unknown = odd.withColumn("lang", F.lit(None).cast("string"))
    kept = langid.keep_identified(unknown)
    assert kept.columns == odd.columns
    assert sorted(kept.toPandas()["text"]) == sorted(
        r.text for r in odd.collect() if r.text and any(c.isalpha() for c in r.text))


def test_quality_sample_is_not_taken_over(spark):
    """Neither one doc_id with many rows nor labels without documents take the
    places of other labelled documents."""
    body = [(i, f"word{i} good text", 10) for i in range(100)] + [(7, f"copy {k}", 10) for k in range(500)]
    docs = spark.createDataFrame(body, "doc_id bigint, text string, n_chars bigint")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(i, 1) for i in range(1000, 6000)],
                                   "doc_id bigint, quality int")
    learned = []
    fit = quality.FactorisationMachine.fit

    def watched(self, at, number, value, target):
        learned.append(target.tolist())
        return fit(self, at, number, value, target)

    quality.FactorisationMachine.fit = watched
    try:
        assert quality.fit_quality(docs, labels, 40) is not None
        assert quality.fit_quality(docs, labels) is not None
    finally:
        quality.FactorisationMachine.fit = fit
    outside = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    assert len(learned[0]) == 40 and len(learned[1]) == len(outside)
    assert sum(learned[1]) == sum(i % 2 for i in outside) and 5 < sum(learned[0]) < 35


def test_an_empty_site_counts(spark):
    docs = spark.createDataFrame([(1, "line", "a"), (2, "line", "b"), (3, "line", ""), (4, "line", None)],
                                 "doc_id bigint, text string, source string")
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, 3).collect()}
    assert out == {1: "line", 2: "", 3: "", 4: ""}
    assert line_dedup.dedup_lines(docs.where("source <> ''"), 3).where("n_removed > 0").count() == 0
