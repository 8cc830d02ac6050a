"""Concatenate-and-cut packing.

Pass one encodes every document once and writes, per partition, the ids with
the count of ids before each document in its partition. The partition totals
(one row per partition) give each partition's global offset. Pass two adds
that offset and cuts each document where the global position crosses a
multiple of the window; no document ever moves between tasks.

Defined cases: a null text is an empty document (only the end id); repeated
rows and null ids are packed each as its own document; an empty table has no
pieces; a very long text spans many sequences. Only the last sequence can be
short: it is padded to the window unless its length is a power of two.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossbook.llm.common import checkpointed, join_small, text_slices
from crossbook.llm.tokens import encoder, id_dtype, with_end

WINDOW = 4096
ENCODED_SCHEMA = "part int, before bigint, doc_id bigint, doc_tokens bigint, ids binary"
PIECE_SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
                "sequence_id bigint, offset bigint, ids binary")


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Pass one, written once: ids of each document and of those before it."""
    dtype = id_dtype(tokenizer)

    def encode(batches):
        part, before = TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for piece in text_slices(batch, "text"):
                offsets, ids = encoder(tokenizer).encode(piece.column(1))
                own = with_end(offsets, ids, end_id, dtype)
                n = np.diff(offsets) + 1
                at = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.record_batch({
                    "part": pa.array(np.full(len(n), part, np.int32)), "before": pa.array(at),
                    "doc_id": piece.column(0), "doc_tokens": pa.array(n),
                    "ids": pa.array([pack.compress(x.tobytes()) for x in own], pa.binary())})

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                         F.col("text").cast("string").alias("text"))
    return checkpointed(narrow.mapInArrow(encode, ENCODED_SCHEMA))


def cut(encoded: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pass two: the pieces of all documents (their ids too if asked for)."""
    dtype = id_dtype(tokenizer)

    def pieces(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            col = {name: batch.column(name) for name in batch.schema.names}
            at = (col["base"].to_numpy(zero_copy_only=False) + col["before"].to_numpy(zero_copy_only=False))
            n = col["doc_tokens"].to_numpy(zero_copy_only=False)
            row, start, length, crc, sequence, offset, body = [], [], [], [], [], [], []
            for k in range(batch.num_rows):
                ids = np.frombuffer(unpack.decompress(col["ids"][k].as_py(),
                                                      max_output_size=int(n[k]) * dtype.itemsize), dtype)
                own = ids.astype("<u4").tobytes()
                done, g = 0, int(at[k])
                while done < len(ids):
                    take = min(len(ids) - done, window - g % window)
                    cut_bytes = own[4 * done:4 * (done + take)]
                    row.append(k)
                    start.append(done)
                    length.append(take)
                    crc.append(zlib.crc32(cut_bytes))
                    sequence.append(g // window)
                    offset.append(g % window)
                    body.append(cut_bytes if with_ids else None)
                    done += take
                    g += take
            took = pa.array(row, pa.int64())
            yield pa.record_batch({
                "doc_id": col["doc_id"].take(took), "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": col["doc_tokens"].take(took),
                "sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64()),
                "ids": pa.array(body, pa.binary())})

    totals = encoded.groupBy("part").agg(F.max(F.col("before") + F.col("doc_tokens")).alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).cast("bigint").alias("base"))
    placed = join_small(encoded, bases, encoded.rdd.getNumPartitions(), ["part"], "inner")
    cuts = placed.mapInArrow(pieces, PIECE_SCHEMA)
    return cuts if with_ids else cuts.drop("ids")


def padded_length(filled, window: int = WINDOW):
    """Length that a sequence of ``filled`` ids (a column) is stored with."""
    power = filled.bitwiseAND(filled - 1) == 0
    return F.when(power, filled).otherwise(F.lit(window).cast("bigint"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW,
                   with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place in the sequences:
    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_length (with padding)."""
    encoded = encode_documents(docs, tokenizer, end_id)
    total = encoded.agg(F.coalesce(F.sum("doc_tokens"), F.lit(0))).first()[0]
    last = (total - 1) // window
    filled = F.when(F.col("sequence_id") == last, F.lit(total - last * window).cast("bigint")).otherwise(
        F.lit(window).cast("bigint"))
    return cut(encoded, tokenizer, window, with_ids).withColumn(
        "sequence_length", padded_length(filled, window))


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences of pieces cut ``with_ids``: sequence_id, ids (32-bit,
    in order) and the boundary records (doc_id, start, offset, length). A
    sequence holds at most one window of ids, so a group is bounded."""
    record = F.struct("offset", "length", "doc_id", "start", "ids")
    return pieces.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(record)).alias("p"), F.first("sequence_length").alias("length")).select(
        "sequence_id", "length",
        F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x.ids)).alias("ids"),
        F.transform("p", lambda x: F.struct(x.doc_id.alias("doc_id"), x.start.alias("start"),
                                            x.offset.alias("offset"), x.length.alias("length"))).alias("boundaries"))
