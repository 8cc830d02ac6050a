"""Token-id files with one shared zstandard dictionary.

A dictionary is trained on the serialised id arrays of a bounded sample of
documents. Documents are then written in ascending id order into a sequence
of files, each document compressed alone, so that a short document can be
read without its neighbours. A file is

    magic (8) | frames ... | index | footer

where the index holds (doc id, frame offset, frame bytes, ids) of each
document and the footer the index offset, the document count, the width of an
id and the sha256 of the dictionary, which readers compare. Files and the
dictionary go to any folder that Arrow's file systems reach; a task writes to
a name of its own attempt and then moves it, so a retried task leaves one file.

Defined cases: a null text is an empty document (only the end id); a null
doc_id sorts first and reads back as null; repeated rows are written each,
ties of doc_id ordered by a hash of the text; an empty table gives no files.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossbook.llm.common import checkpointed, text_slices
from crossbook.llm.tokens import encoder, id_dtype, with_end
from crossbook.session import ensure_checkpoint_dir

MAGIC = b"TOKZST01"
FOOTER = "<QQI32s"  # index offset, documents, bytes of an id, dictionary hash
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "<u1"), ("at", "<u8"), ("size", "<u4"), ("n", "<u8")])

#: Dictionary training: documents of the sample, characters and pieces taken of each, bytes of the dictionary.
SAMPLE_DOCS = 512
SAMPLE_CHARS = 8192
SAMPLE_PIECES = 4
DICTIONARY_BYTES = 1 << 16
LEVEL = 3

FILE_SCHEMA = "part int, file string, n_docs bigint, n_tokens bigint, n_bytes bigint"


def _open(uri: str):
    return fs.FileSystem.from_uri(uri)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the folder in spark.checkpoint.dir."""
    root = ensure_checkpoint_dir(spark)
    root = root if ":/" in root else f"file://{root}"
    return f"{root}/{name}-{uuid.uuid4().hex}"


def sample_pieces(text="text"):
    """A whole text up to SAMPLE_CHARS characters; of a longer one a piece from
    each of SAMPLE_PIECES equal stretches, at a place chosen by a hash of the text."""
    size = SAMPLE_CHARS // SAMPLE_PIECES
    stretch = F.floor(F.length(text) / SAMPLE_PIECES)
    places = [(F.lit(1) + i * stretch + F.pmod(F.xxhash64(text, F.lit(i)), stretch - size + 1)).cast("int")
              for i in range(SAMPLE_PIECES)]
    return (F.when(F.length(text) <= SAMPLE_CHARS, F.array(text))
            .otherwise(F.array(*[F.substring(text, at, F.lit(size)) for at in places])))


def train_dictionary(docs: DataFrame, tokenizer: str, sample_docs: int = SAMPLE_DOCS) -> bytes:
    """A dictionary trained on the ids of the ``sample_docs`` documents with
    the smallest hash of their id, SAMPLE_CHARS characters of each, from all
    parts of long ones. Too few or too short samples give an empty dictionary (plain compression)."""
    hashed = F.xxhash64("doc_id")
    # the hashes first (no texts), then only the texts up to the last of them
    smallest = docs.select(hashed.alias("h")).orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    if smallest is None:
        return b""
    sample = (docs.where(hashed <= smallest).where("length(text) > 0")
              .select(hashed.alias("h"), sample_pieces().alias("t"))
              .orderBy("h", "t").limit(sample_docs).collect())
    dtype = id_dtype(tokenizer)
    offsets, ids = encoder(tokenizer).encode(pa.array([t for r in sample for t in r.t], pa.string()))
    arrays = [ids[a:b].astype(dtype).tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
    size = min(DICTIONARY_BYTES, sum(map(len, arrays)) // 8)
    if len(arrays) < 16 or size < 1024:
        return b""
    return zstandard.train_dictionary(size, arrays).as_bytes()


def _compressor(dictionary: bytes):
    return zstandard.ZstdCompressor(
        level=LEVEL, write_content_size=True, write_checksum=False,
        dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _decompressor(dictionary: bytes):
    return zstandard.ZstdDecompressor(
        dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write the files and return one row per file, in file order ("part")."""
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                         F.col("text").cast("string").alias("text"))
    dictionary = train_dictionary(narrow, tokenizer)
    where, path = _open(folder)
    where.create_dir(path, recursive=True)
    with where.open_output_stream(f"{path}/dictionary") as out:
        out.write(dictionary)
    sent = spark.sparkContext.broadcast(dictionary)  # at most DICTIONARY_BYTES
    dtype = id_dtype(tokenizer)

    def write(batches):
        context = TaskContext.get()
        target, base = _open(folder)
        part = context.partitionId()
        final = f"part-{part:06d}.tok"
        name = f"{base}/_{context.taskAttemptId()}-{final}"
        pack, tokens = _compressor(sent.value), 0
        entries, at, out = [], len(MAGIC), None
        for batch in batches:
            for piece in text_slices(batch, "text"):
                offsets, ids = encoder(tokenizer).encode(piece.column(1))
                frames = []
                for doc_id, own in zip(piece.column(0).to_pylist(), with_end(offsets, ids, end_id, dtype)):
                    frame = pack.compress(own.tobytes())
                    frames.append(frame)
                    entries.append((doc_id or 0, doc_id is None, at, len(frame), len(own)))
                    at += len(frame)
                    tokens += len(own)
                if out is None:
                    out = target.open_output_stream(name)
                    out.write(MAGIC)
                out.write(b"".join(frames))
        if out is None:
            return
        out.write(np.array(entries, ENTRY).tobytes())
        out.write(struct.pack(FOOTER, at, len(entries), dtype.itemsize, hashlib.sha256(sent.value).digest()))
        size = out.tell()
        out.close()
        target.move(name, f"{base}/{final}")
        yield pa.record_batch({"part": pa.array([part], pa.int32()), "file": [final],
                               "n_docs": [len(entries)], "n_tokens": [tokens], "n_bytes": [size]})

    ordered = (narrow.withColumn("_tie", F.xxhash64("text"))
               .repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
               .select("doc_id", "text"))
    return checkpointed(ordered.mapInArrow(write, FILE_SCHEMA))


class TokenFile:
    """One file: the index at once, any document's ids on demand."""

    def __init__(self, folder: str, name: str, dictionary: bytes):
        where, path = _open(folder)
        self.source = where.open_input_file(f"{path}/{name}")
        size = self.source.size()
        self.source.seek(size - struct.calcsize(FOOTER))
        self.index_at, count, width, digest = struct.unpack(
            FOOTER, self.source.read(struct.calcsize(FOOTER)))
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name}: written with another dictionary")
        self.source.seek(self.index_at)
        self.entries = np.frombuffer(self.source.read(count * ENTRY.itemsize), ENTRY)
        self.dtype = np.dtype(f"<u{width}")
        self.unpack = _decompressor(dictionary)

    def document(self, row: int) -> np.ndarray:
        """The ids of one document: a single seek and a single frame."""
        entry = self.entries[row]
        self.source.seek(int(entry["at"]))
        return self._ids(self.source.read(int(entry["size"])), int(entry["n"]))

    def _ids(self, frame: bytes, n: int) -> np.ndarray:
        return np.frombuffer(self.unpack.decompress(frame, max_output_size=n * self.dtype.itemsize),
                             self.dtype)

    def documents(self, chunk: int = 4 << 20):
        """(row, ids) of all documents, read in runs of about ``chunk`` bytes."""
        ends = self.entries["at"] + self.entries["size"]
        row = 0
        while row < len(self.entries):
            start = int(self.entries["at"][row])
            stop = max(row + 1, int(np.searchsorted(ends, start + chunk, "right")))
            self.source.seek(start)
            block = memoryview(self.source.read(int(ends[stop - 1]) - start))
            for k in range(row, stop):
                at = int(self.entries["at"][k]) - start
                yield k, self._ids(block[at:at + int(self.entries["size"][k])], int(self.entries["n"][k]))
            row = stop


def read_dictionary(folder: str) -> bytes:
    where, path = _open(folder)
    with where.open_input_file(f"{path}/dictionary") as source:
        return source.read()


def read_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Read files back, one file to a task: (part, row, doc_id, before,
    n_tokens, ids_crc32), "before" being the ids of the file's earlier
    documents, the digest that of the ids as little-endian 32-bit numbers."""

    def read(batches):
        dictionary = read_dictionary(folder)
        for batch in batches:
            for part, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                source = TokenFile(folder, name, dictionary)
                crc = np.empty(len(source.entries), np.int64)
                n = np.empty(len(source.entries), np.int64)
                for k, ids in source.documents():
                    crc[k], n[k] = zlib.crc32(ids.astype("<u4").tobytes()), len(ids)
                yield pa.record_batch({
                    "part": pa.array(np.full(len(n), part, np.int32)),
                    "row": pa.array(np.arange(len(n), dtype=np.int64)),
                    "doc_id": pa.array(source.entries["doc_id"].astype(np.int64),
                                       mask=source.entries["null"].astype(bool)),
                    "before": pa.array(np.cumsum(n) - n), "n_tokens": pa.array(n),
                    "ids_crc32": pa.array(crc)})

    return files.select("part", "file").repartition("part").mapInArrow(
        read, "part int, row bigint, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write all documents and describe them from the files: doc_id, start
    (ids of all documents before it), n_tokens, ids_crc32, file, row."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-files")
    files = write_files(docs, folder, tokenizer, end_id)
    # one row for each file: the running total over files is a small table
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    return read_files(spark, folder, files).join(starts, "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32",
        "file", "row")
