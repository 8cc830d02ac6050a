"""Ranked lexical search by presence masks.

``build_index`` cuts the documents into shards of bounded size and writes, for
each shard, its documents and every term's postings (document, occurrences),
its most occurrences and its shortest document. Two small aggregates give the
statistics of the whole corpus: documents, words, and the document frequency
of each term that a query holds.

A search takes items in blocks of bounded size. Within a shard every term of
the block has a bitmap of its documents; an item stacks the bitmaps of its
terms and reads off the mask of matched terms of every document. Documents are
grouped by mask. A mask's maximum score is the sum over its terms of weight
times the best a document of the shard could get for that term (most
occurrences, shortest length). Distinct masks are evaluated by descending
maximum, whole groups at a time, until the next maximum lies below the k-th
best score that the task has found: no document left can then enter the item's
ranking. A task carries its best k over all its shards, and the tasks' best
are merged in two steps.

Scores are 64-bit integers; a term's weight floor(1000 ln((2N+2) / (2df+1)))
is taken in double precision.

Defined cases: a null text or one without words has no terms and is in no
ranking, nor counted; an item without terms or with a null id has no rows;
rows that share an item_id are one item, its terms those of all its rows;
repeated documents are each ranked; equal scores go by ascending doc_id, a
null doc_id last; documents with score 0 are left out; an empty table on
either side gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossbook.llm.common import WORD_TABLE, checkpointed, split_words, text_slices

TOP = 10
#: Text bytes of one index shard, and of the items of one search block.
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20
#: Masks evaluated before the bound is looked at again (grows with each step).
FIRST_MASKS = 32
#: Parts in which an item's candidates of all tasks are merged first.
MERGE_PARTS = 64

WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INDEX_SCHEMA = ("doc_ids array<bigint>, lengths array<bigint>, terms array<string>, counts array<int>, "
                "most array<int>, shortest array<bigint>, postings binary")
FOUND_SCHEMA = "item int, doc_id bigint, score bigint, part int"


def build_index(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per shard; documents without words are left out. Postings are
    the documents (as differences) and occurrences of all terms, one after
    the other, zstandard-compressed. Written once to the shared folder."""

    def shards(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for piece in text_slices(batch, "text", SHARD_BYTES):
                offsets, codes, words = split_words(piece.column(1), WORD_TABLE)
                lengths = np.diff(offsets)
                worded = np.flatnonzero(lengths)
                if not len(worded):
                    continue
                row = np.repeat(np.arange(len(worded)), lengths[worded])
                pairs, often = np.unique(codes * len(worded) + row, return_counts=True)
                term, row = np.divmod(pairs, len(worded))
                counts = np.bincount(term, minlength=len(words))
                # a blank may leave a word that no text holds
                first = (np.cumsum(counts) - counts)[counts > 0]
                steps = np.diff(row, prepend=0).astype(np.int32)
                data = steps.tobytes() + often.astype(np.int32).tobytes()
                yield pa.record_batch({
                    "doc_ids": pa.array([piece.column(0).take(pa.array(worded))], pa.list_(pa.int64())),
                    "lengths": pa.array([lengths[worded]], pa.list_(pa.int64())),
                    "terms": pa.array([words.filter(pa.array(counts > 0))], pa.list_(pa.string())),
                    "counts": pa.array([counts[counts > 0].astype(np.int32)], pa.list_(pa.int32())),
                    "most": pa.array([np.maximum.reduceat(often, first).astype(np.int32)], pa.list_(pa.int32())),
                    "shortest": pa.array([np.minimum.reduceat(lengths[worded][row], first)], pa.list_(pa.int64())),
                    "postings": pa.array([pack.compress(data)], pa.binary()),
                })

    narrow = docs.select(F.col(doc_col).cast("bigint").alias("doc_id"),
                         F.col(text_col).cast("string").alias("text"))
    return checkpointed(narrow.mapInArrow(shards, INDEX_SCHEMA))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, block, terms with their repeats), written once. Items are
    dealt to as many blocks as their bytes need, by a hash of the id."""
    lowered = F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = items.select(F.col(id_col).alias("item_id"),
                        F.regexp_extract_all(lowered, F.lit(WORD_PATTERN), F.lit(0)).alias("words"),
                        F.octet_length(lowered).alias("size")).where("item_id is not null and size(words) > 0")
    size = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    counted = (rows.select("item_id", F.explode("words").alias("term"))
               .groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")))
    return checkpointed(counted.groupBy("item_id").agg(
        F.collect_list(F.struct("term", "times")).alias("terms")).withColumn(
            "block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")))


def corpus_counts(index: DataFrame) -> tuple[int, int]:
    """Documents with words, and words, of the whole index."""
    row = index.agg(
        F.coalesce(F.sum(F.size("lengths").cast("bigint")), F.lit(0)),
        F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, n: a + n)), F.lit(0))).first()
    return int(row[0]), int(row[1])


def document_frequencies(index: DataFrame, terms: list[str]) -> dict[str, int]:
    """Documents that hold each of ``terms`` (the distinct terms of one block)."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def counts(batches):
        total = np.zeros(len(sent.value), np.int64)
        wanted = pa.array(sent.value, pa.string())
        for batch in batches:
            for i in range(batch.num_rows):
                place = _places(wanted, batch.column(0)[i].values)
                found = place >= 0
                total[found] += np.asarray(batch.column(1)[i].values, np.int64)[place[found]]
        held = np.flatnonzero(total)
        yield pa.record_batch({"term": pa.array(held.astype(np.int32)), "df": pa.array(total[held])})

    rows = (index.select("terms", "counts").mapInArrow(counts, "term int, df bigint")
            .groupBy("term").agg(F.sum("df").alias("df")).collect())  # the block's terms at most
    return {terms[r.term]: int(r.df) for r in rows}


def _places(wanted: pa.Array, terms: pa.Array) -> np.ndarray:
    """Place of each wanted term in a shard's list, -1 where it is not."""
    return pc.index_in(wanted, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def block_arrays(rows, frequency: dict[str, int], n_docs: int) -> dict:
    """The items of one block as plain arrays: distinct terms, and per item
    the numbers of its terms that some document holds and weight x repeats."""
    number: dict[str, int] = {}
    items = []
    for r in rows:
        known = [(t.term, t.times) for t in r.terms if frequency.get(t.term)]
        own = np.array([number.setdefault(t, len(number)) for t, _ in known], np.int64)
        weight = np.array([n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency[t] + 1)))
                           for t, n in known], np.int64)
        items.append((own[weight > 0], weight[weight > 0]))
    return {"terms": list(number), "items": items}


def _gain(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's occurrences are worth in a document of relative length m."""
    return 1_000_000_000 * times // (1000 * times + 8 * m)


def _rank_shard(shard: dict, block: dict, n_docs: int, n_words: int, best: list, k: int) -> None:
    """Merge a shard's documents into ``best``: per item (scores, doc ids),
    highest first. A missing doc id is the largest int64 and marked by None later."""
    place = _places(pa.array(block["terms"], pa.string()), shard["terms"])
    if not (place >= 0).any():
        return
    lengths = np.asarray(shard["lengths"], np.int64)
    m = 100 - 75 + (75 * lengths * n_docs) // n_words
    counts = np.asarray(shard["counts"], np.int64)
    raw = zstandard.ZstdDecompressor().decompress(shard["postings"])
    half = len(raw) // 2
    steps, often = (np.frombuffer(part, np.int32) for part in (raw[:half], raw[half:]))
    upto = np.cumsum(counts)
    documents = np.cumsum(steps, dtype=np.int64)
    # bitmaps of the block's terms over the shard's documents, built when first used
    bits = {}

    def postings(term: int) -> slice:
        p = place[term]
        return slice(upto[p] - counts[p], upto[p])

    def bitmap(term: int) -> np.ndarray:
        if term not in bits:
            held = np.zeros(len(lengths), bool)
            held[documents[postings(term)]] = True
            bits[term] = np.packbits(held)
        return bits[term]

    most = np.asarray(shard["most"], np.int64)[place]
    shortest = np.asarray(shard["shortest"], np.int64)[place]
    ceiling = _gain(most, 100 - 75 + (75 * shortest * n_docs) // n_words)
    ids = shard["doc_ids"]
    for item, (own, weight) in enumerate(block["items"]):
        here = place[own] >= 0
        terms, w = own[here], weight[here]
        if not len(terms):
            continue
        stacked = np.unpackbits(np.stack([bitmap(t) for t in terms]), axis=1, count=len(lengths))
        masks, group = _grouped(np.packbits(stacked, axis=0).T)
        present = np.unpackbits(masks, axis=1, count=len(terms)).astype(np.int64)
        highest = present @ (w * ceiling[terms])
        order = np.argsort(-highest, kind="stable")
        order = order[highest[order] > 0]
        rank_of = np.full(len(masks), len(masks), np.int64)
        rank_of[order] = np.arange(len(order))
        by_rank = np.argsort(rank_of[group], kind="stable")
        edge = np.searchsorted(rank_of[group][by_rank], np.arange(len(order) + 1))
        done, step = 0, FIRST_MASKS
        while done < len(order):
            scores, _ = best[item]
            if len(scores) >= k and highest[order[done]] < scores[k - 1]:
                break
            upper = min(done + step, len(order))
            chosen = np.sort(by_rank[edge[done]:edge[upper]])
            best[item] = _merged(best[item], _scores(chosen, terms, w, postings, documents, often, m),
                                 ids[chosen], k)
            done, step = upper, step * 2


def _grouped(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a byte matrix and the number of each row's."""
    masks = np.ascontiguousarray(masks)
    as_one = masks.view(np.dtype((np.void, masks.shape[1]))).ravel()
    _, first, group = np.unique(as_one, return_index=True, return_inverse=True)
    return masks[first], group.ravel()


def _scores(chosen, terms, w, postings, documents, often, m) -> np.ndarray:
    """Exact scores of the chosen documents."""
    out = np.zeros(len(chosen), np.int64)
    for term, weight in zip(terms, w):
        where = postings(term)
        held = documents[where]
        at = np.searchsorted(held, chosen)
        at[at == len(held)] = 0
        found = held[at] == chosen
        out[found] += weight * _gain(often[where][at[found]].astype(np.int64), m[chosen[found]])
    return out


def _merged(best: tuple, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    """The k highest of both, ties by ascending id."""
    scores, ids = np.concatenate([best[0], scores]), np.concatenate([best[1], ids])
    keep = np.lexsort((ids, -scores))[:k]
    keep = keep[scores[keep] > 0]
    return scores[keep], ids[keep]


#: Stands for a null doc_id inside tasks: after all ids.
NO_ID = np.iinfo(np.int64).max


def search_block(index: DataFrame, block: dict, n_docs: int, n_words: int, k: int) -> DataFrame:
    """The best k of every task for each item of the block."""
    sent = index.sparkSession.sparkContext.broadcast(block)  # bounded by BLOCK_BYTES of text and one more item

    def run(batches):
        part = TaskContext.get().partitionId() % MERGE_PARTS
        empty = (np.empty(0, np.int64), np.empty(0, np.int64))
        best = [empty] * len(sent.value["items"])
        for batch in batches:
            for i in range(batch.num_rows):
                shard = {name: batch.column(name)[i] for name in batch.schema.names}
                shard = {name: (v.values if pa.types.is_list(v.type) else v.as_py()) for name, v in shard.items()}
                shard["doc_ids"] = shard["doc_ids"].fill_null(NO_ID).to_numpy(zero_copy_only=False)
                _rank_shard(shard, sent.value, n_docs, n_words, best, k)
        sizes = [len(s) for s, _ in best]
        ids = np.concatenate([d for _, d in best]) if best else empty[0]
        yield pa.record_batch({
            "item": pa.array(np.repeat(np.arange(len(best)), sizes).astype(np.int32)),
            "doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID),
            "score": pa.array(np.concatenate([s for s, _ in best]) if best else empty[0], pa.int64()),
            "part": pa.array(np.full(sum(sizes), part, np.int32))})

    return index.mapInArrow(run, FOUND_SCHEMA)


def search(index: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "item_id",
           text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each
    item. Every block of items meets every shard once."""
    spark = index.sparkSession
    queries = item_terms(items, id_col, text_col)
    id_type = queries.schema["item_id"].dataType
    n_docs, n_words = corpus_counts(index)
    best = Window.partitionBy("item", "part").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    rank = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = spark.createDataFrame([], "rank int, doc_id bigint, score bigint").withColumn(
        "item_id", F.lit(None).cast(id_type)).select("item_id", "rank", "doc_id", "score")
    blocks = [r.block for r in queries.select("block").distinct().orderBy("block").collect()] if n_docs else []
    for number in blocks:
        rows = queries.where(F.col("block") == number).collect()  # BLOCK_BYTES of text, on average
        terms = sorted({t.term for r in rows for t in r.terms})
        block = block_arrays(rows, document_frequencies(index, terms), n_docs)
        found = search_block(index, block, n_docs, n_words, k)
        top = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k)
        ranked = top.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], "item int, item_id " + id_type.simpleString())
        out = out.unionByName(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def search_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Index ``docs`` and rank them for every item."""
    return search(build_index(docs), items, k)


_WORDS = rf"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD_PATTERN}')"

#: The same ranking from plain counts, every document scored.
LEXICAL_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
lengths AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nw FROM lengths),
i AS (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY item_id, term),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
scored AS (
  SELECT q.item_id, l.r, l.doc_id, CAST(sum(q.times * g.w * ((1000000000 * tf.tf)
         // (1000 * tf.tf + 8 * (100 - 75 + (75 * l.n * nd) // nw)))) AS BIGINT) AS score
  FROM q JOIN tf ON tf.term = q.term JOIN weights g ON g.term = q.term JOIN lengths l ON l.r = tf.r, total
  GROUP BY q.item_id, l.r, l.doc_id),
ranked AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST, r) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
