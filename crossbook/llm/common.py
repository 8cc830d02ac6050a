"""Arrow text helpers shared by the operators.

Texts are handled as Arrow string arrays inside tasks; words are split and
dictionary-encoded by Arrow, so Python only ever looks at distinct words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossbook.session import ensure_checkpoint_dir

SLICE_BYTES = 4 << 20


def byte_table(keep: str | None = None, lower: bool = True) -> bytes:
    """256-byte translation table. ASCII bytes that ``keep`` does not list
    become a space (``None``: all stay); bytes of non-ASCII letters stay;
    ``lower`` folds A-Z first."""
    table = bytearray(range(256))
    if lower:
        for b in range(ord("A"), ord("Z") + 1):
            table[b] = b + 32
    if keep is not None:
        allowed = set(keep.encode("ascii"))
        for b in range(128):
            if table[b] not in allowed:
                table[b] = 32
    return bytes(table)


ALNUM = "0123456789abcdefghijklmnopqrstuvwxyz"
#: A-Z lower-cased; words are runs of digits, a-z and non-ASCII characters.
WORD_TABLE = byte_table(ALNUM)
#: A-Z lower-cased, everything else as it is.
LOWER_TABLE = byte_table()


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; a null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if len(texts) == 0:
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    _, offset_buffer, data = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int32)[texts.offset:texts.offset + len(texts) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[lo:hi] if data is not None else np.empty(0, np.uint8)
    return offsets.astype(np.int64) - lo, raw


def translate(texts: pa.Array, table: bytes) -> pa.Array:
    """Every byte of every text through ``table`` (which leaves UTF-8 valid)."""
    offsets, raw = raw_bytes(texts)
    data = raw.tobytes().translate(table)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32).tobytes()),
                                       pa.py_buffer(data))


def split_words(texts: pa.Array, table: bytes | None = None):
    """Words between ASCII white space: (offsets of each text's words, code of
    each word, the distinct words as an Arrow array)."""
    texts = translate(texts, table) if table else pc.fill_null(texts.cast(pa.string()), "")
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    encoded = lists.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = encoded.dictionary
    blank = pc.index(words, "").as_py()
    if blank >= 0:  # white space at an end of a text leaves an empty word
        kept = codes != blank
        offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
        codes = codes[kept]
    return offsets, codes, words


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Runs of rows with at most ``limit`` bytes of text each (one row at least)."""
    if batch.num_rows == 0:
        return
    index = batch.schema.get_field_index(column)
    size = pc.fill_null(pc.binary_length(batch.column(index)), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(size.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = int(upto[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def gather_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every run, one run after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def sums_between(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i+1]] for every i (0 where empty)."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder in spark.checkpoint.dir and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def plain(model) -> dict | None:
    """A model's fields as a dict, the form in which it is broadcast: executors
    need no copy of this package to read it."""
    return None if model is None else dict(vars(model))


def rebuilt(cls, fields: dict | None):
    """The model again, inside a task."""
    if fields is None:
        return None
    model = object.__new__(cls)
    model.__dict__.update(fields)
    return model


#: A table is sent whole to every task only up to this many rows.
SMALL_ROWS = 100_000


def join_small(big: DataFrame, small: DataFrame, rows: int, on: list[str], how: str = "left"):
    """Join that sends ``small`` to every task when its known row count is
    small, and shuffles both sides otherwise."""
    return big.join(F.broadcast(small) if rows <= SMALL_ROWS else small, on, how)


def whole_rows(docs: DataFrame, *more) -> DataFrame:
    """All columns of ``docs`` as one struct ``row`` beside the columns
    ``more``, so that names of either never meet."""
    return docs.select(F.struct("*").alias("row"), *more)


def row_columns(columns: list[str], **changed):
    """The columns of ``row`` again, some replaced by other expressions."""
    return [changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in columns]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
