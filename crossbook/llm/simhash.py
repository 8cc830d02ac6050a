"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments.
The Manhattan distance of two count vectors never exceeds the number of
differing bits, so it bounds it from below. Distance 4 in all means distance
2 or less in one half of the segments, and two vectors at distance 2 or less
share a grid cell at distance 1 or less from each: every distinct fingerprint
is listed in its own cell of either half and in the cells one step away. A
cell is cut by the bit patterns that have its counts: a fingerprint stands at
its own pattern and at those one bit away, and two that differ in 2 bits or
fewer of the half meet at a pattern between them. So a row is met by the few
that share 31 bits of a half with it, a common cell lies in several tasks, and
fingerprints at one pattern are compared, the lower bound first, then the bits.

At a pattern that very many fingerprints share, the other half differs in 4
bits or fewer, so one of its quarters in 2 or fewer: there they meet once more
at patterns one bit away from either quarter. Only links that join two parts of
a large group come out (at most one fewer than its fingerprints), so a group of
near copies never becomes its square of pairs; connected components over the
links are those over all pairs.

Defined cases: a null or wordless text has fingerprint zero and links like any
other; repeated rows have one fingerprint; a null doc_id joins its group but is
its label only if all ids of the group are null; an empty table has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossbook.llm.common import (LOWER_TABLE, checkpointed, raw_bytes, row_columns, text_slices,
                                  whole_rows)
from crossbook.llm.components import connected_components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Groups of up to so many fingerprints are compared together, larger ones alone,
#: and those beyond WIDE_CELL by the quarters of their other half.
SMALL_CELL = 64
WIDE_CELL = 2_048
#: Rows of quarters held at a time.
QUARTER_ROWS = 2_000_000

_PAIRS = np.uint64(0x5555555555555555)
_LOW = np.uint64(0xFFFFFFFF)


def text_fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Fingerprint of one word sequence."""
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = np.array([digest(joined[a:b], SEED) for a, b in
                       zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())],
                      "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at:at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp) of every document: fp as a signed 64-bit number,
    text_key a hash of the text that tells rows with one doc_id apart."""

    def run(batches):
        for batch in batches:
            for piece in text_slices(batch, "text"):
                offsets, raw = raw_bytes(piece.column(1))
                data = raw.tobytes().translate(LOWER_TABLE)
                found = [text_fingerprint(data[a:b].split(), shingle)
                         for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.record_batch({"doc_id": piece.column(0), "text_key": piece.column(2),
                                       "fp": pa.array(np.array(found, np.uint64).view(np.int64))})

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                         F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    return narrow.mapInArrow(run, "doc_id bigint, text_key bigint, fp bigint")


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, each in its two bits."""
    return (fp & _PAIRS) + ((fp >> np.uint64(1)) & _PAIRS)


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Manhattan distance of two segment count vectors (counts 0 to 2)."""
    differ = x ^ y
    one, two = differ & _PAIRS, (differ >> np.uint64(1)) & _PAIRS
    return np.bitwise_count(one) + 2 * np.bitwise_count(two & ~one)


def near(x: np.ndarray, y: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs differ in at most ``max_bits`` bits: the lower bound first,
    then the bits of what passes it."""
    passed = manhattan(segment_counts(x), segment_counts(y)) <= max_bits
    passed[passed] = np.bitwise_count((x ^ y)[passed]) <= max_bits
    return passed


def cells_of(fp: np.ndarray):
    """(cell, pattern, fingerprint) rows: either half's own cell and those one
    step away, at each bit pattern of the cell that is one bit away."""
    cells, patterns, owners = [], [], []
    for half in (0, 1):
        own = (fp >> np.uint64(32 * half)) & _LOW
        tag = np.uint64(half << 32)
        for step in [np.uint64(0)] + [np.uint64(1 << bit) for bit in range(32)]:
            patterns.append(own ^ step)
            cells.append(segment_counts(own ^ step) | tag)
            owners.append(fp)
    return np.concatenate(cells), np.concatenate(patterns), np.concatenate(owners)


def _links_in_small_cells(cell, fp, max_bits):
    """All links between rows of the same cell, by growing distance in the order."""
    left, right = [], []
    idx = np.arange(len(cell) - 1)
    shift = 1
    while len(idx):
        idx = idx[idx + shift < len(cell)]
        idx = idx[cell[idx] == cell[idx + shift]]
        linked = idx[near(fp[idx], fp[idx + shift], max_bits)]
        left.append(fp[linked])
        right.append(fp[linked + shift])
        shift += 1
    return left, right


def _links_in_large_cell(fp, max_bits):
    """Links that join all fingerprints of a cell that belong together: one
    for each union of two parts, by comparing each row with all later ones."""
    label = np.arange(len(fp))
    left, right = [], []
    for i in range(len(fp) - 1):
        linked = i + 1 + np.flatnonzero(near(fp[i + 1:], fp[i], max_bits))
        other, first = np.unique(label[linked], return_index=True)
        new = other != label[i]
        if new.any():
            left.append(np.full(int(new.sum()), fp[i]))
            right.append(fp[linked[first[new]]])
            label[np.isin(label, other[new])] = label[i]
    return left, right


def _links_in_wide_cell(fp, half, max_bits):
    """Links among fingerprints at one pattern of a half: each meets those that
    are near it in a quarter of the other half, a share of the quarters at a time."""
    other = (fp >> np.uint64(32 * (1 - half))) & _LOW
    parts = np.uint64(1 + 17 * len(fp) // QUARTER_ROWS)
    left, right = [], []
    for quarter in (0, 16):
        own = (other >> np.uint64(quarter)) & np.uint64(0xFFFF)
        for part in range(int(parts)):
            at, owners = [], []
            for step in [0] + [1 << bit for bit in range(16)]:
                place = own ^ np.uint64(step)
                took = np.flatnonzero(place % parts == part)
                at.append(place[took])
                owners.append(took)
            at, owners = np.concatenate(at), np.concatenate(owners)
            order = np.argsort(at, kind="stable")
            a, b = group_links(at[order], fp[owners[order]], max_bits)
            left.append(a)
            right.append(b)
    return left, right


def group_links(group: np.ndarray, fp: np.ndarray, max_bits: int, halves: np.ndarray | None = None):
    """Links among rows sorted by group; with ``halves`` given (the half that a
    row's group agrees in), wide groups are taken by the quarters of the other."""
    empty = np.empty(0, np.uint64)
    if not len(group):
        return empty, empty
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, len(group)))
    large = np.repeat(sizes > SMALL_CELL, sizes)
    left, right = _links_in_small_cells(group[~large], fp[~large], max_bits)
    for at, n in zip(starts[sizes > SMALL_CELL], sizes[sizes > SMALL_CELL]):
        if halves is not None and n > WIDE_CELL:
            a, b = _links_in_wide_cell(fp[at:at + n], int(halves[at]), max_bits)
        else:
            a, b = _links_in_large_cell(fp[at:at + n], max_bits)
        left += a
        right += b
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def grid_rows(distinct: DataFrame) -> DataFrame:
    """(cell, pattern, fp): the rows of cells_of for all fingerprints."""

    def spread(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 10_000):
                fp = batch.column(0).slice(start, 10_000).to_numpy(zero_copy_only=False).view(np.uint64)
                yield pa.record_batch({n: pa.array(c.view(np.int64))
                                       for n, c in zip(("cell", "pattern", "fp"), cells_of(fp))})

    return distinct.select("fp").mapInArrow(spread, "cell bigint, pattern bigint, fp bigint")


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that span the
    same components as all pairs at ``max_bits`` or fewer differing bits."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the grid of half vectors holds for at most 4 differing bits")

    def verify(batches):
        # a pattern may go on in the next batch: its rows wait for the rest
        held = np.empty((3, 0), np.int64)

        def linked(part):
            half = part[0] >> 32
            a, b = group_links(part[1] | half << 32, part[2].view(np.uint64), max_bits, half)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            return pa.record_batch({"a": pa.array(pairs[0].view(np.int64)), "b": pa.array(pairs[1].view(np.int64))})

        for batch in batches:
            part = np.concatenate([held, [c.to_numpy(zero_copy_only=False) for c in batch.columns]], axis=1)
            if not part.shape[1]:
                continue
            last = int((part[:2] == part[:2, -1:]).all(axis=0).argmax())
            if last:
                yield linked(part[:, :last])
            held = part[:, last:]
        if held.shape[1]:
            yield linked(held)

    return (grid_rows(distinct).repartition("cell", "pattern").sortWithinPartitions("cell", "pattern")
            .mapInArrow(verify, "a bigint, b bigint").distinct())


def group_documents(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, text_key, fp, component_id, kept_key) of every document.
    component_id is the smallest doc_id that links lead to, its own included;
    kept_key is the text_key of the row that stands for the group."""
    printed = checkpointed(fingerprints(docs, shingle))
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    first = printed.groupBy("fp").agg(F.min(rank).alias("first"))
    member = connected_components(links(first, max_bits))
    labelled = first.join(member.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    label = labelled.groupBy("component").agg(F.min("first").alias("label"))
    by_fp = labelled.join(label, "component").select(
        "fp", F.col("label.doc_id").alias("component_id"), F.col("label.text_key").alias("kept_key"))
    return printed.join(by_fp, "fp").select("doc_id", "text_key", "fp", "component_id", "kept_key")


def hex_digits(fp: str = "fp"):
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each group: the row with the smallest
    doc_id (null last, ties by text_key). Rows that share both stay once."""
    grouped = checkpointed(group_documents(docs, shingle, max_bits))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("kept_key"))
    gone = grouped.where(~stays).select("doc_id", "text_key").distinct()
    repeated = grouped.where(stays).groupBy("doc_id", "text_key").count().where("count > 1").drop("count")
    keyed = whole_rows(docs, F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.xxhash64(F.col("text").cast("string")).alias("text_key"))

    def having(rows, keys, how):
        same = rows["doc_id"].eqNullSafe(keys["doc_id"]) & (rows["text_key"] == keys["text_key"])
        return rows.join(keys, same, how)

    kept = having(keyed, gone, "left_anti")
    columns = row_columns(docs.columns)
    if not repeated.take(1):
        return kept.select(*columns)
    # only the rows that repeat are aggregated: the first in order of their columns
    once = having(kept, repeated, "left_semi").groupBy("doc_id", "text_key").agg(F.min("row").alias("row"))
    return having(kept, repeated, "left_anti").select(*columns).unionByName(once.select(*columns))
