"""The registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossbook.llm import (ann, chat, decontaminate, langid, lexical, line_dedup, merkle, packing, quality,
                           sharding, simhash, suffix_dedup, token_files)
from crossbook.llm.common import read_table
from crossbook.llm.tokens import default_tokenizer


def op1_decontamination(spark, sf_dir):
    found = decontaminate.match_documents(read_table(spark, sf_dir, "documents"),
                                          read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op2_token_output(spark, sf_dir):
    return token_files.token_output(read_table(spark, sf_dir, "documents"), default_tokenizer(), 1).select(
        "doc_id", "start", "n_tokens", "ids_crc32")


def op3_nearest_neighbours(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op4_packing(spark, sf_dir):
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), default_tokenizer(), 2)


def op5_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, read_table(spark, sf_dir, "labels")))


def op6_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed",
                      F.length("text").cast("bigint").alias("n_chars_kept"),
                      F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeated_passages(read_table(spark, sf_dir, "documents"))


def op8_simhash(spark, sf_dir):
    return simhash.group_documents(read_table(spark, sf_dir, "documents")).select(
        "doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op9_language(spark, sf_dir):
    return langid.identify_language(read_table(spark, sf_dir, "documents"))


def op10_sharding(spark, sf_dir):
    return sharding.shard_by_bytes(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op11_chat_format(spark, sf_dir):
    return chat.digest_conversations(chat.with_tricky(read_table(spark, sf_dir, "conversations")))


def op12_merkle_manifest(spark, sf_dir):
    return merkle.digest_manifest(read_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark, sf_dir):
    return lexical.search_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def registry():
    return {f.__name__: f for f in (
        op1_decontamination, op2_token_output, op3_nearest_neighbours, op4_packing, op5_quality,
        op6_line_dedup, op7_suffix_dedup, op8_simhash, op9_language, op10_sharding,
        op11_chat_format, op12_merkle_manifest, op13_lexical_search)}


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Windows of items and documents as joined words; an item's window length is 10 or its own.
DECONTAMINATION_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark
      WHERE item_id IS NOT NULL AND text IS NOT NULL),
il AS (SELECT item, w, least(len(w), 10) AS n FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS phrase
       FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM il)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS phrase
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
             FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.n, dw.s, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.phrase = iw.phrase),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
              FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, n, s FROM hits))
              GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item) AS n_items,
                     array_to_string(list_sort(list(DISTINCT item)), ',') AS items
              FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN hit_items t ON d.doc_id = t.doc_id
"""


def oracles():
    return {"op1_decontamination": DECONTAMINATION_SQL, "op6_line_dedup": line_dedup.LINE_DEDUP_SQL,
            "op11_chat_format": chat.chat_sql(), "op12_merkle_manifest": merkle.merkle_sql(),
            "op13_lexical_search": lexical.LEXICAL_SQL}
