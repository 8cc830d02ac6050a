"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the number of byte n-grams (lengths 1 to 3, hashed)
present in both, over the root of the product of both numbers. Landmark texts
give the Nyström map; one ridge regression per language (one against the rest)
is fitted in the mapped space. A batch of texts is scored by two matrix
products: presence x landmark presence, then x (map x ridge weights).

Everything is fitted on a bounded sample: at most PER_LANGUAGE documents with a
letter of each language, those with the smallest hash of their id, LANDMARKS of
them as landmarks; repeated rows are learned once. More than MAX_LANGUAGES
languages are an error. Every whole text is scored.

Defined cases: a null text or one without a letter is ``und`` with score 0; a
null language is not learned from; a null doc_id is scored but never held out;
repeated rows score alike; without learnable rows all texts are ``und``; an
empty table has no rows. Extra columns are ignored (or kept, by the filter).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossbook.llm.common import (byte_table, checkpointed, plain, raw_bytes, rebuilt, row_columns, text_slices,
                                  translate, whole_rows)
from crossbook.llm.quality import in_fold

LENGTHS = (1, 2, 3)
BITS = 13
SIZE = 1 << BITS
LANDMARKS = 160
PER_LANGUAGE = 500
MAX_LANGUAGES = 64
#: Parts in which a language's documents are cut first.
PARTS = 256
RIDGE = 1e-3
SHARPNESS = 4.0
UNKNOWN = "und"
SEED = 11

#: Lower-case ASCII letters and bytes of other characters stay, all else is a space.
_TABLE = byte_table("abcdefghijklmnopqrstuvwxyz")
_MIX = np.uint32(2654435769)  # odd multiplier of a multiplicative hash


#: Text bytes handled at a time when texts are scored.
SCORE_BYTES = 1 << 20


class TooManyLanguages(ValueError):
    """More languages than one sample and one model are meant to hold."""


def has_letter(texts: pa.Array) -> np.ndarray:
    """Texts with a letter of any script (false for null)."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    found = pc.match_substring_regex(texts, r"[A-Za-z]").to_numpy(zero_copy_only=False).astype(bool)
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return found


def presence(texts: pa.Array) -> np.ndarray:
    """0/1 matrix of hashed n-grams per text; runs of other bytes count as one space."""
    plain = translate(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")), _TABLE)
    plain = pc.binary_join_element_wise("", pc.ascii_trim_whitespace(plain), "", " ")
    offsets, raw = raw_bytes(plain)
    n = len(texts)
    out = np.zeros((n, SIZE), np.uint8)
    repeated = np.zeros(len(raw), bool)
    repeated[1:] = (raw[1:] == 32) & (raw[:-1] == 32)
    repeated[offsets[:-1][np.diff(offsets) > 0]] = False
    upto = np.concatenate([[0], np.cumsum(~repeated)])
    raw, offsets = raw[~repeated], upto[offsets]
    row = np.repeat(np.arange(n, dtype=np.int64) * SIZE, np.diff(offsets))
    flat, gram = out.reshape(-1), np.zeros(len(raw), np.uint32)
    wide = raw.astype(np.uint32)
    for k in range(1, max(LENGTHS) + 1):
        # gram i: bytes i .. i+k-1, within one text
        count = len(raw) - k + 1
        if count <= 0:
            break
        gram = gram[:count] * np.uint32(257) + wide[k - 1:]
        if k in LENGTHS:
            same = row[:count] == row[k - 1:]
            code = ((gram + np.uint32(k)) * _MIX) >> np.uint32(32 - BITS)
            flat[(row[:count] + code)[same]] = 1
    return out


def normalised(bits: np.ndarray) -> np.ndarray:
    out = bits.astype(np.float32)
    return out / np.sqrt(np.maximum(out.sum(axis=1, keepdims=True), 1))


class LanguageModel:
    """Landmark presence vectors and the weights of each language."""

    def __init__(self, bits: np.ndarray, langs: np.ndarray):
        self.langs = sorted(set(langs.tolist()))
        x = normalised(bits)
        chosen = np.random.default_rng(SEED).permutation(len(x))[:LANDMARKS]
        self.landmarks = np.ascontiguousarray(x[chosen].T)
        # Nyström: phi = K(x, L) K(L, L)^(-1/2)
        values, vectors = np.linalg.eigh((x[chosen] @ self.landmarks).astype(np.float64))
        kept = values > 1e-6 * values.max()
        root = vectors[:, kept] / np.sqrt(values[kept])
        phi = (x @ self.landmarks).astype(np.float64) @ root
        phi = np.hstack([phi, np.ones((len(phi), 1))])
        target = np.where(langs[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        size = np.bincount(np.searchsorted(self.langs, langs), minlength=len(self.langs))
        weight = 1 / size[np.searchsorted(self.langs, langs)]
        weight = weight / weight.mean()
        gram = phi.T @ (phi * weight[:, None]) + RIDGE * len(phi) * np.eye(phi.shape[1])
        solved = np.linalg.solve(gram, phi.T @ (target * weight[:, None]))
        self.weights = (root @ solved[:-1]).astype(np.float32)
        self.bias = solved[-1].astype(np.float32)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Share of each language, rows sum to 1."""
        margin = normalised(presence(texts)) @ self.landmarks @ self.weights + self.bias
        power = np.exp(SHARPNESS * (margin - margin.max(axis=1, keepdims=True)).astype(np.float64))
        return power / power.sum(axis=1, keepdims=True)


def fit_language(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """Fitted on documents outside the held-out fold; their packed presence
    bits (SIZE / 8 bytes each), not their texts, come to the driver."""
    usable = docs.where("lang is not null and doc_id is not null").where(~in_fold(F.col("doc_id"), 3, 1))
    text = F.col("text").cast("string")
    usable = usable.where(text.rlike(r"\p{L}")).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.col("lang").cast("string").alias("lang"),
        F.xxhash64(text).alias("h"))
    # the keys first (no texts); rows alike are one. Parts of a language are cut
    # before the language, so at most PARTS x per_language rows of it meet in a task
    keys = usable.select("doc_id", "lang", "h", F.pmod(F.xxhash64("h", "doc_id"), F.lit(PARTS)).alias("part"))
    for group in (["lang", "part"], ["lang"]):
        by_hash = Window.partitionBy(*group).orderBy(F.xxhash64("doc_id"), "doc_id", "h")
        keys = (keys.withColumn("n", F.dense_rank().over(by_hash)).where(F.col("n") <= per_language)
                .select("doc_id", "lang", "h", "part").distinct())
    chosen = checkpointed(keys.drop("part"))
    found = chosen.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if found > MAX_LANGUAGES:
        raise TooManyLanguages(f"lang has more than {MAX_LANGUAGES} values to learn from")
    # at most per_language rows for each of at most MAX_LANGUAGES languages
    sample = usable.join(F.broadcast(chosen), ["doc_id", "lang", "h"])

    def pack(batches):
        for batch in batches:
            for piece in text_slices(batch, "text"):
                for rows in _runs(piece, 256):
                    keep = has_letter(rows.column(1))
                    packed = np.packbits(presence(rows.column(1)), axis=1)
                    yield pa.record_batch({
                        "doc_id": rows.column(0), "lang": rows.column(2), "h": rows.column(3),
                        "bits": pa.array([b.tobytes() for b in packed], pa.binary())}).filter(pa.array(keep))

    rows = (sample.select("doc_id", "text", "lang", "h")
            .mapInArrow(pack, "doc_id bigint, lang string, h bigint, bits binary")
            .groupBy("doc_id", "lang", "h").agg(F.min("bits").alias("bits"))
            .orderBy("doc_id", "lang", "bits").collect())
    if not rows:
        return None
    bits = np.unpackbits(np.array([np.frombuffer(r.bits, np.uint8) for r in rows]), axis=1)
    return LanguageModel(bits, np.array([r.lang for r in rows], object).astype(str))


def _runs(batch: pa.RecordBatch, rows: int):
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def predict_language(texts: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Every row of ``texts`` (columns row, text) as row, lang_pred, score."""
    sent = texts.sparkSession.sparkContext.broadcast(plain(model))  # SIZE x LANDMARKS floats

    def run(batches):
        lm = rebuilt(LanguageModel, sent.value)
        for batch in batches:
            for piece in text_slices(batch, "text", SCORE_BYTES):
                for rows in _runs(piece, 256):
                    known = has_letter(rows.column(1)) if lm is not None else np.zeros(rows.num_rows, bool)
                    name = np.full(rows.num_rows, UNKNOWN, object)
                    score = np.zeros(rows.num_rows)
                    if known.any():
                        share = lm.scores(rows.column(1).filter(pa.array(known)))
                        name[known] = np.array(lm.langs, object)[share.argmax(axis=1)]
                        score[known] = share.max(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0), pa.array(name.tolist(), pa.string()), pa.array(score)],
                        names=["row", "lang_pred", "score"])

    schema = texts.select("row").schema.add("lang_pred", "string").add("score", "double")
    return texts.select("row", "text").mapInArrow(run, schema)


def identify_language(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    narrow = docs.select(F.struct(F.col("doc_id").cast("bigint").alias("doc_id"),
                                  in_fold(F.col("doc_id"), 3, 1).alias("held_out")).alias("row"),
                         F.col("text").cast("string").alias("text"))
    return predict_language(narrow, fit_language(docs)).select("row.*", "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` with a letter: those without are ``und``. No score rejects a
    document. Where no model can tell languages (nothing to learn from, or more
    than MAX_LANGUAGES languages) a letter alone decides, with the same result."""
    rows = whole_rows(docs, F.col("text").cast("string").alias("text"))
    try:
        model = fit_language(docs)
    except TooManyLanguages:
        model = None
    if model is None:
        found = rows.where(F.col("text").rlike(r"\p{L}"))
    else:
        found = predict_language(rows, model).where(F.col("lang_pred") != UNKNOWN)
    return found.select(*row_columns(docs.columns))
