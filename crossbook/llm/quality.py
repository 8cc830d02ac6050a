"""Quality classifier: a factorisation machine.

A document becomes a sparse vector of hashed words (square root of the count,
normalised), statistics of its structure and its metadata (the declared
``n_chars``). Pairwise interactions have low rank, so a score takes linear
time: sum over factors of ((sum v x)^2 - sum (v x)^2) / 2. The model is fitted
on a bounded sample of labelled rows (``SAMPLE`` below) and scores every whole
text in one pass without a shuffle of texts.

Defined cases: a null text scores as an empty one, a null n_chars as 0; a null
doc_id scores like any other and is never held out; repeated rows score alike;
a label other than 0 or 1, or without a document, is not learned from; a doc_id
counts once for each of its labels, with the text of the smallest hash if it
has several; without learnable labels every score is 0.5; an empty table has no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossbook.llm.common import checkpointed, plain, raw_bytes, rebuilt, split_words, text_slices

#: Labelled documents that the model is fitted on: of the labels that have a
#: document, those with the smallest hash of the id.
SAMPLE = 4000
BUCKETS = 1 << 14
FACTORS = 8
EPOCHS = 12
RATE = 0.05
RIDGE = 1e-4
THRESHOLD = 0.3
SEED = 13

_KINDS = np.zeros(256, np.uint8)  # byte kinds: 0 control, then as below
for _b in range(256):
    _c = chr(_b)
    _KINDS[_b] = (7 if _b >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit()
                  else 4 if _c in " \t" else 5 if _c == "\n" else 6 if _b > 32 else 0)
N_KINDS = 8
N_STATS = 14
SIZE = BUCKETS + N_STATS


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``folds``, equals ``fold`` (false for null)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def structure(texts: pa.Array, n_chars: np.ndarray, offsets: np.ndarray, codes: np.ndarray,
              words: pa.Array) -> np.ndarray:
    """Statistics of each text, about 0 to 1 each."""
    n = len(texts)
    at, raw = raw_bytes(texts)
    size = np.diff(at)
    doc = np.repeat(np.arange(n) * N_KINDS, size)
    kinds = np.bincount(doc + _KINDS[raw], minlength=n * N_KINDS).reshape(n, N_KINDS).astype(float)
    total = np.maximum(size, 1)[:, None]
    share = kinds / total
    letters = np.maximum(kinds[:, 1] + kinds[:, 2] + kinds[:, 7] / 2, 1)
    n_words = np.diff(offsets)
    owner = np.repeat(np.arange(n), n_words)
    distinct = np.bincount(np.unique(np.stack([owner, codes]), axis=1)[0], minlength=n) if len(codes) else np.zeros(n)
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    marked = pc.match_substring_regex(words, r"[^\w\s'.,;:!?-]").to_numpy(zero_copy_only=False)
    mean_length = np.bincount(owner, weights=lengths[codes], minlength=n) if len(codes) else np.zeros(n)
    odd = np.bincount(owner, weights=marked[codes].astype(float), minlength=n) if len(codes) else np.zeros(n)
    lists = pc.split_pattern(pc.fill_null(texts.cast(pa.string()), ""), "\n")
    lines = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    n_lines = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    line_owner = np.repeat(np.arange(n), n_lines)
    own_lines = np.bincount(np.unique(np.stack([line_owner, lines]), axis=1)[0], minlength=n)
    many = np.maximum(n_words, 1)
    return np.stack([
        kinds[:, 2] / letters, share[:, 3] * 5, share[:, 4], share[:, 6], share[:, 7],
        share[:, 0] * 10, np.log1p(n_words) / 10, mean_length / many / 10, distinct / many, odd / many,
        np.log1p(n_lines) / 8, own_lines / np.maximum(n_lines, 1),
        np.log1p(n_words / np.maximum(n_lines, 1)) / 8, np.log1p(n_chars) / 12], axis=1)


def features(texts: pa.Array, n_chars: np.ndarray):
    """Sparse vectors: (offsets, feature numbers, values)."""
    n = len(texts)
    offsets, codes, words = split_words(texts)
    bucket = np.fromiter((zlib.crc32(w.encode("utf-8")) % BUCKETS for w in words.to_pylist()),
                         np.int64, len(words))
    owner = np.repeat(np.arange(n), np.diff(offsets))
    pair, count = np.unique(owner * SIZE + bucket[codes], return_counts=True)
    doc, number, value = pair // SIZE, pair % SIZE, np.sqrt(count)
    norm = np.sqrt(np.bincount(doc, weights=value ** 2, minlength=n))
    value = value / np.maximum(norm[doc], 1e-9)
    stats = structure(texts, n_chars, offsets, codes, words)
    doc = np.concatenate([doc, np.repeat(np.arange(n), N_STATS)])
    number = np.concatenate([number, np.tile(np.arange(BUCKETS, SIZE), n)])
    value = np.concatenate([value, stats.ravel()])
    order = np.argsort(doc, kind="stable")
    at = np.searchsorted(doc[order], np.arange(n + 1))
    return at, number[order], value[order].astype(np.float32)


class FactorisationMachine:
    """w0 + w.x + sum over i<j of <v_i, v_j> x_i x_j, with a logistic output."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.bias = 0.0
        self.w = np.zeros(SIZE, np.float32)
        self.v = rng.normal(0, 0.05, (SIZE, FACTORS)).astype(np.float32)

    def margins(self, at: np.ndarray, number: np.ndarray, value: np.ndarray) -> np.ndarray:
        return self._forward(at, number, value)[0]

    def _forward(self, at, number, value):
        """Margins and, for the gradient, the sum of v x per row and factor."""
        starts = at[:-1]
        vx = self.v[number] * value[:, None]
        linear = np.add.reduceat(self.w[number] * value, starts, dtype=np.float64)
        s = np.add.reduceat(vx, starts, axis=0, dtype=np.float64)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts, dtype=np.float64)
        return self.bias + linear + 0.5 * ((s * s).sum(axis=1) - squares), s

    def fit(self, at, number, value, target):
        """Adaptive gradient steps over shuffled batches of 128 rows."""
        rng = np.random.default_rng(SEED)
        self.bias = float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
        gw, gv, gb = np.full(SIZE, 1e-6), np.full((SIZE, FACTORS), 1e-6), 1e-6
        for _ in range(EPOCHS):
            for rows in np.array_split(rng.permutation(len(target)), max(1, len(target) // 128)):
                length = at[rows + 1] - at[rows]
                pick = np.repeat(at[rows] - np.cumsum(length) + length, length) + np.arange(length.sum())
                own_at = np.concatenate([[0], np.cumsum(length)])
                num, val = number[pick], value[pick].astype(np.float64)
                margin, s = self._forward(own_at, num, val)
                error = (1 / (1 + np.exp(-margin)) - target[rows]) / len(rows)
                each = np.repeat(error, length)
                used, back = np.unique(num, return_inverse=True)
                step = np.bincount(back, weights=each * val) + RIDGE * self.w[used]
                gw[used] += step ** 2
                self.w[used] -= (RATE * step / np.sqrt(gw[used])).astype(np.float32)
                pull = (each * val)[:, None] * (np.repeat(s, length, axis=0) - self.v[num] * val[:, None])
                for f in range(FACTORS):
                    step = np.bincount(back, weights=pull[:, f]) + RIDGE * self.v[used, f]
                    gv[used, f] += step ** 2
                    self.v[used, f] -= (RATE * step / np.sqrt(gv[used, f])).astype(np.float32)
                gb += error.sum() ** 2
                self.bias -= float(RATE * error.sum() / np.sqrt(gb))
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorisationMachine | None:
    """The model fitted on at most ``sample`` labelled documents outside the
    held-out fold; their sparse vectors (not their texts) come to the driver."""
    usable = labels.where("quality in (0, 1) and doc_id is not null").where(~in_fold(F.col("doc_id"), 5, 0))
    targets = usable.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                            F.col("quality").cast("double").alias("target")).distinct()
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"),
                        F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"),
                        F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)).alias("n_chars"))
    # labels of documents that exist, each id with one of its texts; texts stay in the scan
    held = texts.select("doc_id", "h").join(targets, "doc_id").groupBy("doc_id", "target").agg(F.min("h").alias("h"))
    chosen = checkpointed(held.orderBy(F.xxhash64("doc_id"), "doc_id", "target").limit(sample))
    joined = (texts.join(F.broadcast(chosen), ["doc_id", "h"])  # at most ``sample`` rows
              .groupBy("doc_id", "target").agg(F.min(F.struct("text", "n_chars")).alias("row"))
              .select("doc_id", "row.text", "row.n_chars", "target"))

    def vectors(batches):
        for batch in batches:
            for piece in text_slices(batch, "text"):
                at, number, value = features(piece.column(1), piece.column(2).to_numpy(zero_copy_only=False))
                at = pa.array(at.astype(np.int32))
                yield pa.record_batch({
                    "doc_id": piece.column(0), "target": piece.column(3),
                    "number": pa.ListArray.from_arrays(at, pa.array(number.astype(np.int32))),
                    "value": pa.ListArray.from_arrays(at, pa.array(value))})

    rows = (joined.mapInArrow(vectors, "doc_id bigint, target double, number array<int>, value array<float>")
            .orderBy("doc_id", "target").toArrow())
    if rows.num_rows == 0:
        return None
    rows = rows.combine_chunks()
    number = rows["number"].chunk(0)
    at = number.offsets.to_numpy().astype(np.int64) - number.offsets[0].as_py()
    return FactorisationMachine().fit(
        at, number.flatten().to_numpy().astype(np.int64), rows["value"].chunk(0).flatten().to_numpy(),
        rows["target"].to_numpy())


def score_quality(docs: DataFrame, model: FactorisationMachine | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(plain(model))  # SIZE x (FACTORS + 1) numbers

    def score(batches):
        fm = rebuilt(FactorisationMachine, sent.value)
        for batch in batches:
            for piece in text_slices(batch, "text", 2 << 20):
                if fm is None:
                    p = np.full(piece.num_rows, 0.5)
                else:
                    n_chars = piece.column(3).to_numpy(zero_copy_only=False)
                    margin = fm.margins(*features(piece.column(2), n_chars))
                    p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
                yield pa.record_batch({"doc_id": piece.column(0), "held_out": piece.column(1),
                                       "score": pa.array(p),
                                       "predicted": pa.array((p >= THRESHOLD).astype(np.int32))})

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                         in_fold(F.col("doc_id"), 5, 0).alias("held_out"),
                         F.col("text").cast("string").alias("text"),
                         F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)).alias("n_chars"))
    return narrow.mapInArrow(score, "doc_id bigint, held_out boolean, score double, predicted int")
