"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` cuts the training documents into shards of bounded size and
writes, for each shard, the sorted position list of every term. A search
takes test windows in blocks of bounded size; within each shard it starts
from the list of a window's rarest term and intersects the offset-adjusted
lists of the others, shortest first. ``slop`` 0 gives exact phrases, a larger
one proximity matches (each term at most that far from its place).

Defined cases: a null or wordless text has no words and no hits; a test item
without words or with a null id takes no part; an item shorter than the
window is one window; items that share an id count once; repeated documents
are each reported; an empty table on either side gives no hits. Very long
texts form a shard of their own. Extra columns are ignored here.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossbook.llm.common import (WORD_TABLE, checkpointed, gather_runs, plain, rebuilt, row_columns, split_words,
                                  text_slices, whole_rows)

WINDOW = 10
#: Text bytes of one index shard, and of the test items of one search block.
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 1 << 20

INDEX_SCHEMA = ("shard string, doc_ids array<bigint>, n_words array<int>, terms array<string>, "
                "term_counts array<int>, postings binary")
HIT_SCHEMA = ("shard string, doc_row int, spans array<struct<start:int,end:int>>, "
              "items array<string>")


def build_index(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per shard: its documents, their word counts, its terms and the
    position lists of all terms (ascending, one after the other, as
    differences, zstandard-compressed). Written once to the shared folder."""

    def shards(batches):
        part = TaskContext.get().partitionId()
        pack = zstandard.ZstdCompressor(level=1)
        n = 0
        for batch in batches:
            for piece in text_slices(batch, "text", SHARD_BYTES):
                offsets, codes, words = split_words(piece.column(1), WORD_TABLE)
                counts = np.bincount(codes, minlength=len(words)).astype(np.int32)
                positions = np.argsort(codes, kind="stable").astype(np.int32)
                steps = np.diff(positions, prepend=np.int32(0))
                yield pa.record_batch({
                    "shard": pa.array([f"{part}-{n}"]),
                    "doc_ids": pa.array([piece.column(0)], pa.list_(pa.int64())),
                    "n_words": pa.array([np.diff(offsets).astype(np.int32)], pa.list_(pa.int32())),
                    "terms": pa.array([words], pa.list_(pa.string())),
                    "term_counts": pa.array([counts], pa.list_(pa.int32())),
                    "postings": pa.array([pack.compress(steps.tobytes())], pa.binary()),
                })
                n += 1

    narrow = docs.select(F.col(doc_col).cast("bigint").alias("doc_id"),
                         F.col(text_col).cast("string").alias("text"))
    return checkpointed(narrow.mapInArrow(shards, INDEX_SCHEMA))


class Windows:
    """The distinct windows of one block of items, as a matrix of term codes."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        offsets, codes, words = split_words(pa.array([t for _, t in items], pa.string()), WORD_TABLE)
        self.terms = words.to_pylist()
        owners: dict[tuple, set[str]] = defaultdict(set)
        for (item, _), a, b in zip(items, offsets[:-1], offsets[1:]):
            own = codes[a:b].tolist()
            for s in range(max(1, len(own) - window + 1) if own else 0):
                owners[tuple(own[s:s + window])].add(item)
        self.length = np.array([len(w) for w in owners], np.int64)
        self.matrix = np.full((len(owners), window), -1, np.int64)
        for row, w in enumerate(owners):
            self.matrix[row, :len(w)] = w
        ids = sorted({i for own in owners.values() for i in own})
        number = {item: n for n, item in enumerate(ids)}
        self.items = np.array(ids, object)
        listed = [sorted(number[i] for i in own) for own in owners.values()]
        self.n_items = np.array([len(x) for x in listed], np.int64)
        self.owned = np.array([i for x in listed for i in x], np.int64)
        self.first_item = np.cumsum(self.n_items) - self.n_items


def item_blocks(items: DataFrame, id_col: str, text_col: str, window: int):
    """The test items in blocks of at most BLOCK_BYTES of text, one at a time."""
    block, size = [], 0
    rows = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    for row in rows.where("i is not null and t is not null").toLocalIterator():
        block.append((row.i, row.t))
        size += len(row.t.encode("utf-8"))
        if size >= BLOCK_BYTES:
            yield Windows(block, window)
            block, size = [], 0
    if block:
        yield Windows(block, window)


def _near(ordered: np.ndarray, wanted: np.ndarray, slop: int) -> np.ndarray:
    """Which of ``wanted`` have an entry of ``ordered`` at most ``slop`` away."""
    at = np.searchsorted(ordered, wanted - slop)
    found = at < len(ordered)
    found[found] = ordered[at[found]] <= wanted[found] + slop
    return found


def _shard_hits(row: dict, block: Windows, slop: int):
    """(document row, start, length, window) of every match in one shard."""
    n_words = np.asarray(row["n_words"], np.int64)
    counts = np.asarray(row["term_counts"], np.int64)
    place = pc.index_in(pa.array(block.terms, pa.string()), value_set=row["terms"])
    place = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    frequency = np.where(place >= 0, counts[place] if len(counts) else 0, 0)
    used = block.matrix >= 0
    rarity = np.where(used, frequency[block.matrix], np.iinfo(np.int64).max)
    alive = np.flatnonzero(rarity.min(axis=1, initial=np.iinfo(np.int64).max) > 0)
    if not len(alive):
        return None
    steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["postings"]), np.int32)
    positions = np.cumsum(steps, dtype=np.int64)
    # documents lie so far apart that no window with its slop meets two of them
    gap = block.matrix.shape[1] + 2 * slop
    documents = np.arange(len(n_words))
    positions = positions + gap * np.repeat(documents, n_words)[positions]
    first = np.cumsum(n_words) - n_words
    spaced = first + gap * documents
    upto = np.cumsum(counts)

    def postings(term: int) -> np.ndarray:
        t = place[term]
        return positions[upto[t] - counts[t]:upto[t]]

    found = []
    for w in alive:
        length = int(block.length[w])
        order = np.argsort(rarity[w, :length], kind="stable")
        rarest = order[0]
        at = postings(block.matrix[w, rarest])
        for k in order[1:]:
            if not len(at):
                break
            at = at[_near(postings(block.matrix[w, k]), at + (k - rarest), slop)]
        if len(at):
            doc = np.searchsorted(spaced, at, "right") - 1
            start = at - rarest - spaced[doc]
            end = np.minimum(start + length, n_words[doc])
            start = np.maximum(start, 0)
            found.append((doc, first[doc] + start, end - start, np.full(len(at), w)))
    if not found:
        return None
    return [np.concatenate(x) for x in zip(*found)]


def _documents_hit(row: dict, block: Windows, slop: int) -> pa.RecordBatch | None:
    """The hits of a shard by document: merged word spans and item ids."""
    hits = _shard_hits(row, block, slop)
    if hits is None:
        return None
    doc, start, length, window = hits
    n_words = np.asarray(row["n_words"], np.int64)
    first = np.cumsum(n_words) - n_words
    total = int(n_words.sum())
    edge = (np.bincount(start, minlength=total + 1)
            - np.bincount(start + length, minlength=total + 1))
    covered = np.concatenate([[False], np.cumsum(edge)[:total] > 0, [False]])
    # a span ends with its document even if the next one starts covered
    opens = np.flatnonzero(covered[1:-1] & (~covered[:-2] | np.isin(np.arange(total), first)))
    closes = np.flatnonzero(covered[1:-1] & (~covered[2:] | np.isin(np.arange(1, total + 1), first))) + 1
    span_doc = np.searchsorted(np.cumsum(n_words), opens, "right")
    pairs = np.stack([np.repeat(doc, block.n_items[window]),
                      block.owned[gather_runs(block.first_item[window], block.n_items[window])]])
    pairs = np.unique(pairs, axis=1)
    docs = np.unique(doc)
    span_at = np.searchsorted(span_doc, np.append(docs, len(n_words))).astype(np.int32)
    item_at = np.searchsorted(pairs[0], np.append(docs, len(n_words))).astype(np.int32)
    spans = pa.StructArray.from_arrays(
        [pa.array((x - first[span_doc]).astype(np.int32)) for x in (opens, closes)], ["start", "end"])
    return pa.record_batch({
        "shard": pa.array([row["shard"]] * len(docs)),
        "doc_row": pa.array(docs.astype(np.int32)),
        "spans": pa.ListArray.from_arrays(pa.array(span_at), spans),
        "items": pa.ListArray.from_arrays(pa.array(item_at),
                                          pa.array(block.items[pairs[1]].tolist(), pa.string())),
    })


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text",
           window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Documents with matches: (shard, doc_row, spans, items), where spans are
    merged word ranges. Every block of items meets every shard once."""
    sc = index.sparkSession.sparkContext
    found = []
    for block in item_blocks(items, id_col, text_col, window):
        sent = sc.broadcast(plain(block))  # bounded by BLOCK_BYTES of text and one more item

        def run(batches, sent=sent):
            windows = rebuilt(Windows, sent.value)
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {name: batch.column(name)[i] for name in batch.schema.names}
                    row = {k: (v.values if pa.types.is_list(v.type) else v.as_py()) for k, v in row.items()}
                    out = _documents_hit(row, windows, slop)
                    if out is not None:
                        yield out

        found.append(index.mapInArrow(run, HIT_SCHEMA))
    if not found:
        return index.sparkSession.createDataFrame([], HIT_SCHEMA)
    if len(found) == 1:
        return found[0]
    return reduce(DataFrame.unionAll, found).groupBy("shard", "doc_row").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def covered_words(spans: Column) -> Column:
    """Words inside any of the spans."""
    step = F.aggregate(
        F.array_sort(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct(
            (a.n + F.greatest(s.end - F.greatest(s.start, a.upto), F.lit(0))).alias("n"),
            F.greatest(s.end, a.upto).alias("upto")),
        lambda a: a.n)
    return step


def match_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Every document: doc_id, n_words, n_hit, spans, items (sorted as strings)."""
    index = build_index(docs)
    base = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "n_words"))).select(
        "shard", F.col("pos").alias("doc_row"), F.col("col.doc_ids").alias("doc_id"),
        F.col("col.n_words").cast("bigint").alias("n_words"))
    hits = search(index, items, window=window, slop=slop)
    return base.join(hits, ["shard", "doc_row"], "left").select(
        "doc_id", "n_words",
        F.coalesce(covered_words(F.col("spans")), F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        F.coalesce(F.array_sort("items"), F.array().cast("array<string>")).alias("items"))


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a whole window of an item.
    Whether a document goes depends on its text alone, so the join is on a
    hash of the text and equal texts share the decision."""
    text_key = F.xxhash64(F.col("text").cast("string"))
    numbered = docs.select(text_key.alias("doc_id"), "text")
    bad = match_documents(numbered, items, window).where("n_hit > 0")
    bad = bad.select(F.col("doc_id").alias("text_key")).distinct()
    return whole_rows(docs, text_key.alias("text_key")).join(bad, "text_key", "left_anti").select(
        *row_columns(docs.columns))
