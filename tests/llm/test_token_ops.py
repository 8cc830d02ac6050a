"""Token files and packing against the plain tokenizer."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from crossbook.llm import packing, queries, token_files
from crossbook.llm.common import gather_runs, split_words, text_slices
from crossbook.llm.tokens import MEMO_PIECES, PieceEncoder, default_tokenizer, encoder


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(plain, text, end):
    return plain.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


TEXTS = st.text(alphabet=st.one_of(
    st.sampled_from(list("aAbBzZéÉßİΣς'. ,!?|$#<>0129\n\t́ ǅŉ")), st.characters(exclude_categories=["Cs"])), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_pieces_give_the_tokenizers_ids(texts):
    enc = encoder(default_tokenizer())
    offsets, ids = enc.encode(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, offsets[:-1], offsets[1:]):
        assert ids[a:b].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def test_special_tokens_contractions_and_null():
    enc = PieceEncoder(default_tokenizer())
    texts = ["Don't x's <|endoftext|>a b<|startoftext|> it's. ''s", None, "", "a.b,c;; 12.5%"]
    offsets, ids = enc.encode(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, offsets[:-1], offsets[1:]):
        assert ids[a:b].tolist() == enc.tokenizer.encode(t or "", add_special_tokens=False).ids
    assert len(enc.memo) <= MEMO_PIECES


def test_splitting_and_slices_lose_nothing():
    batch = pa.record_batch({"id": pa.array(range(5)), "text": pa.array(["a b", None, "", "c" * 50, " d "])})
    assert [s.num_rows for s in text_slices(batch, "text", 10)] == [3, 1, 1]
    offsets, codes, words = split_words(batch.slice(1).column(1))
    assert [words[int(c)].as_py() for c in codes] == ["c" * 50, "d"] and offsets.tolist() == [0, 0, 0, 1, 2]
    assert gather_runs(np.array([5, 0]), np.array([2, 1])).tolist() == [5, 6, 0]


def test_token_files_describe_every_document(spark, sf, rows, plain):
    got = {r.doc_id: r for r in queries.op2_token_output(spark, sf).collect()}
    start = 0
    for r in rows:
        ids = ids_of(plain, r.text, 1)
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(got) == len(rows)


def test_token_files_read_single_documents(spark, docs, rows, plain, tmp_path):
    folder = f"file://{tmp_path}/tok"
    files = token_files.write_files(docs, folder, default_tokenizer(), 1).orderBy("part").collect()
    dictionary = token_files.read_dictionary(folder)
    assert len(dictionary) > 1000
    k = 0
    for f in files:
        source = token_files.TokenFile(folder, f.file, dictionary)
        for row in range(f.n_docs):
            assert source.document(row).tolist() == ids_of(plain, rows[k].text, 1)
            k += 1
    assert k == len(rows)
    with pytest.raises(ValueError):
        token_files.TokenFile(folder, files[0].file, b"other")


def test_token_files_edge_cases(spark, odd, none, plain):
    got = token_files.token_output(odd, default_tokenizer()).orderBy("start").collect()
    want = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in got] == [r.doc_id for r in want]
    assert sorted((r.doc_id or 0, r.ids_crc32) for r in got) == sorted(
        (r.doc_id or 0, crc(ids_of(plain, r.text, 1))) for r in want)
    assert token_files.token_output(none, default_tokenizer()).count() == 0


def test_packing_cuts_the_concatenation(spark, sf, rows, plain):
    pieces = queries.op4_packing(spark, sf).collect()
    ids = {r.doc_id: ids_of(plain, r.text, 2) for r in rows}
    by_sequence = {}
    covered = {}
    for p in pieces:
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own) and p.ids_crc32 == crc(own[p.start:p.start + p.length])
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length, p.sequence_length))
        covered.setdefault(p.doc_id, []).append((p.start, p.length))
    for d, parts in covered.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == len(ids[d])
    assert len(covered) == len(rows)
    last = max(by_sequence)
    assert sorted(by_sequence) == list(range(last + 1))
    for s, parts in by_sequence.items():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096 and (at == 4096 or s == last)
        assert {x[2] for x in parts} == {at if at & (at - 1) == 0 else 4096}


def test_sequences_and_edge_cases(spark, odd, none, plain):
    pieces = packing.pack_documents(odd, default_tokenizer(), 2, window=64, with_ids=True)
    whole = packing.sequences(pieces).orderBy("sequence_id").collect()
    joined = np.concatenate([np.frombuffer(s.ids, "<u4") for s in whole]).tolist()
    want = [ids_of(plain, r.text, 2) for r in odd.collect()]
    assert sorted(joined) == sorted(i for ids in want for i in ids)
    assert sum(b.length for s in whole for b in s.boundaries) == len(joined)
    assert all(sum(b.length for b in s.boundaries) == 64 for s in whole[:-1])
    assert packing.pack_documents(none, default_tokenizer()).count() == 0


def test_dictionary_sample_reaches_the_whole_text(spark):
    long = "a" * 8192 + "".join(chr(97 + i % 26) for i in range(40_000)) + "z" * 10_000
    df = spark.createDataFrame([("short é" * 100,), ("x" * 8192,), (long,), (long[:8193],)], "text string")
    got = [r[0] for r in df.select(token_files.sample_pieces()).collect()]
    assert got[0] == ["short é" * 100] and got[1] == ["x" * 8192]
    for text, pieces in ((long, got[2]), (long[:8193], got[3])):
        assert [len(p) for p in pieces] == [2048] * 4
        quarter = len(text) // 4
        assert all(p in text[i * quarter:(i + 1) * quarter] for i, p in enumerate(pieces))


def test_dictionary_learns_what_stands_late(spark, plain, monkeypatch):
    seen = []

    class Trained:
        def as_bytes(self):
            return b""

    monkeypatch.setattr(token_files.zstandard, "train_dictionary", lambda size, arrays: seen.extend(arrays) or Trained())
    df = spark.createDataFrame([(i, "a b " * 2100 + "q z " * 9000) for i in range(20)], "doc_id bigint, text string")
    token_files.train_dictionary(df, default_tokenizer())
    dtype = token_files.id_dtype(default_tokenizer())
    late = np.array(ids_of(plain, "q z q z q z", 1)[2:-1], dtype).tobytes()
    assert any(late in a for a in seen)
