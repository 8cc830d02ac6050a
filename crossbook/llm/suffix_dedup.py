"""Repeated passages by sparse suffix arrays.

Only suffixes at minimiser positions are kept: of every run of WINDOWS
consecutive GRAM-word grams the one with the smallest hash. Two texts that
share MIN_WORDS = WINDOWS + GRAM - 1 words in a row share such a position with
the same gram, so suffixes whose gram stands in one text only are dropped.

Suffixes that stand in two texts with the same REACH words before and after
the gram are told by a hash of that context, aggregated before anything is
sorted: they are repeated over all of it. What is left is read again with its
words, one row for each suffix and one for each repeated context beside them,
and sorted twice: by the gram and the words after it, and by the gram and the
words before it, read backwards. Each row is compared word by word with its
neighbours and the match extended right and left; a match of MIN_WORDS words
or more with another text is a repeated run.

Sorting also bounds what neighbours cannot show: no row of the same gram
agrees with a row further to the right than its neighbours in the first order,
or further to the left than those in the second. Where those bounds leave a
longer run open (the best match is split between several rows), the few
MIN_WORDS-word windows in question are compared with those of all rows of the
gram. So every passage of MIN_WORDS or more words that two different texts
share is found whole, and nothing shorter. Both sorts are dealt by ranges, so
one very common gram lies in several tasks; rows at the ends of a range, whose
neighbour is elsewhere, count as open.

Texts that are equal byte for byte are one text here (their documents repeat
from end to end), so a large group of copies is processed once.

Words are lower-cased runs of digits, a-z and non-ASCII characters. Defined
cases: null and short texts have no passages; a document that stands twice
with one doc_id and one text is one document; a null doc_id is reported as
null; passages that repeat only within one text are not reported; an empty
table has no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossbook.llm.common import WORD_TABLE, checkpointed, split_words, text_slices
from crossbook.llm.token_files import shared_folder

MIN_WORDS = 50
GRAM = 25
WINDOWS = MIN_WORDS - GRAM + 1
#: Words on either side of a gram that a window around it can hold.
REACH = MIN_WORDS - GRAM

#: What is known of a window row after its own partition was compared.
OPEN, SETTLED, WITNESS = 0, 1, 2

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BASE_2 = 0xC2B2AE3D27D4EB4F

SUFFIX_SCHEMA = ("doc_id bigint, text_key bigint, n_words int, "
                 "grams array<bigint>, contexts array<bigint>, places array<int>")
STATE_NAMES = ["state", "gram", "context", "text_key", "pos"]
STATE_SCHEMA = "state int, gram bigint, context bigint, text_key bigint, pos int"
SHARED_SCHEMA = "state int, text_key bigint, pos int, gram bigint, a bigint, b bigint"
#: Rows of one context or gram that wait for the rest before they are told.
HELD_ROWS = 200_000
#: A suffix with the words around its gram, nearest first, eight bytes each
#: (zeros beyond the text); it stands in texts a and b (the same, if only one).
#: reach_left, reach_right: how far any row of the gram may agree with it;
#: first, last: the outermost words before the gram at which a repeated window starts.
WIDE_SCHEMA = ("gram bigint, a bigint, b bigint, pos int, before binary, after binary, "
               "reach_left int, reach_right int, first int, last int")


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, 64-bit hash of every word)."""
    offsets, codes, words = split_words(texts, WORD_TABLE)
    digest = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
    return offsets, digest[codes] if len(codes) else np.empty(0, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = int(_BASE)) -> np.ndarray:
    """Hash of the words from each start to its end (polynomial, mixed)."""
    if not len(starts):
        return np.empty(0, np.uint64)
    inverse = np.uint64(pow(base, -1, 1 << 64))
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashes) - 1, inverse)]))
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashes) - 1, np.uint64(base))]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * down)])
    return _mixed((sums[ends] - sums[starts]) * up[ends - 1])


def gram_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of ``length`` words from every position."""
    starts = np.arange(max(0, len(hashes) - length + 1))
    return run_hashes(hashes, starts, starts + length)


def context_hashes(hashes: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Hash of each gram with up to REACH words on either side; a text's ends count."""
    starts = np.maximum(anchors - REACH, 0)
    ends = np.minimum(anchors + GRAM + REACH, len(hashes))
    ends_seen = (anchors - starts) * (REACH + 1) + ends - anchors
    return _mixed(run_hashes(hashes, starts, ends, _BASE_2) + ends_seen.astype(np.uint64))


def window_anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor position of every MIN_WORDS-word window, gram hashes): the
    leftmost smallest gram in the window."""
    grams = gram_hashes(hashes, GRAM)
    if len(grams) < WINDOWS:
        return np.empty(0, np.int64), grams
    view = np.lib.stride_tricks.sliding_window_view(grams, WINDOWS)
    return np.arange(len(view)) + view.argmin(axis=1), grams


def sparse_suffixes(docs: DataFrame) -> DataFrame:
    """One row per document with its sampled suffixes, written once."""

    def run(batches):
        for batch in batches:
            for piece in text_slices(batch, "text"):
                offsets, hashes = word_hashes(piece.column(2))
                at, grams, contexts, positions = [0], [], [], []
                for a, b in zip(offsets[:-1], offsets[1:]):
                    anchors, own = window_anchors(hashes[a:b])
                    anchors = np.unique(anchors)
                    grams.append(own[anchors])
                    contexts.append(context_hashes(hashes[a:b], anchors))
                    positions.append(anchors)
                    at.append(at[-1] + len(anchors))
                at = pa.array(np.array(at, np.int32))
                yield pa.record_batch({
                    "doc_id": piece.column(0), "text_key": piece.column(1),
                    "n_words": pa.array(np.diff(offsets).astype(np.int32)),
                    "grams": pa.ListArray.from_arrays(at, pa.array(np.concatenate(grams).view(np.int64))),
                    "contexts": pa.ListArray.from_arrays(at, pa.array(np.concatenate(contexts).view(np.int64))),
                    "places": pa.ListArray.from_arrays(at, pa.array(np.concatenate(positions).astype(np.int32)))})

    return checkpointed(_keyed(docs).mapInArrow(run, SUFFIX_SCHEMA))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"),
                       text.alias("text"))


def _runs(*key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, size) of each run of equal keys."""
    cut = np.zeros(max(0, len(key[0]) - 1), bool)
    for k in key:
        cut |= k[1:] != k[:-1]
    first = np.flatnonzero(np.concatenate([[True], cut]))
    return first, np.diff(np.append(first, len(key[0])))


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to the shared folder, compressed, and read from there."""
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def _several(first: np.ndarray, size: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which runs hold two texts or more; rows of a run are sorted by text."""
    return text[first] != text[first + size - 1]


def settled_contexts(rows: DataFrame) -> DataFrame:
    """(state, gram, context, text_key, pos): suffixes sorted by gram and
    context and neighbours compared within each partition, before any shuffle.
    Rows whose whole context stands in two texts there are SETTLED, and of each
    such run two WITNESS rows go on, of two texts, so that a very common
    context meets again as two rows per partition. Other rows stay OPEN; of
    the same row out of copies of a text one is left."""

    def run(batches):
        held = np.empty((4, 0), np.int64)

        def told(part):
            gram, context, text, pos = part
            first, size = _runs(gram, context)
            both = _several(first, size, text)
            state = np.where(np.repeat(both, size), SETTLED, OPEN)
            marks = np.concatenate([first[both], (first + size - 1)[both]])
            out = np.concatenate([part, part[:, marks]], axis=1)
            return pa.record_batch(
                [pa.array(np.append(state, np.full(len(marks), WITNESS)).astype(np.int32)),
                 *map(pa.array, out[:3]), pa.array(out[3].astype(np.int32))], STATE_NAMES)

        for batch in batches:
            part = np.concatenate([held, [c.to_numpy().astype(np.int64) for c in batch.columns]], axis=1)
            part = part[:, np.concatenate([[True], (part[:, 1:] != part[:, :-1]).any(axis=0)])[:part.shape[1]]]
            if not part.shape[1]:
                continue
            last = int(_runs(part[0], part[1])[0][-1])
            # a run that goes on waits; of a long one, what is here is told by itself
            last = part.shape[1] if part.shape[1] - last > HELD_ROWS else last
            if last:
                yield told(part[:, :last])
            held = part[:, last:]
        if held.shape[1]:
            yield told(held)

    return rows.sortWithinPartitions("gram", "context", "text_key", "pos").mapInArrow(run, STATE_SCHEMA)


def shared_suffixes(suffixes: DataFrame) -> DataFrame:
    """(state, text_key, pos, gram, a, b) of the suffixes whose gram stands in
    another text too. SETTLED: the whole context stands in another text; OPEN:
    not seen to; WITNESS: one for each settled context, which stands in the
    texts a and b. Sorted by gram and context over ranges, so a common gram
    lies in several tasks; at the ends of a range a gram counts as shared."""
    rows = suffixes.select("text_key", F.explode(F.arrays_zip("grams", "contexts", "places")).alias("s")).select(
        F.col("s.grams").alias("gram"), F.col("s.contexts").alias("context"), "text_key",
        F.col("s.places").alias("pos"))

    def run(batches):
        held = np.empty((5, 0), np.int64)

        def told(part, opening, closing):
            state, gram, context, text, pos = part
            first, size = _runs(gram, context)
            group = np.repeat(np.arange(len(first)), size)
            both = _several(first, size, text)
            # a gram is shared if it holds two texts, or may go on in another range
            head, many = _runs(gram, gram)
            shared = np.minimum.reduceat(text, head) != np.maximum.reduceat(text, head)
            shared[0] |= opening
            shared[-1] |= closing
            kept = np.repeat(shared, many) & (state != WITNESS)
            now = np.where(both[group], SETTLED, OPEN)[kept]
            rep = first[both]
            return pa.record_batch([
                pa.array(np.append(now, np.full(len(rep), WITNESS)).astype(np.int32)),
                pa.array(np.append(text[kept], text[rep])), pa.array(np.append(pos[kept], pos[rep]).astype(np.int32)),
                pa.array(np.append(gram[kept], gram[rep])), pa.array(np.append(text[kept], text[rep])),
                pa.array(np.append(text[kept], text[(first + size - 1)[both]]))],
                ["state", "text_key", "pos", "gram", "a", "b"])

        opening = True
        for batch in batches:
            columns = [c.to_numpy().astype(np.int64) for c in batch.columns]
            settled = columns[0] == SETTLED
            if settled.any():
                text, none = pa.array(columns[3][settled]), pa.nulls(int(settled.sum()), pa.int64())
                yield pa.record_batch([
                    pa.array(np.full(len(text), SETTLED, np.int32)), text,
                    pa.array(columns[4][settled].astype(np.int32)), none, none, none],
                    ["state", "text_key", "pos", "gram", "a", "b"])
            part = np.concatenate([held, [c[~settled] for c in columns]], axis=1)
            if not part.shape[1]:
                continue
            last = int(_runs(part[1], part[1])[0][-1])
            if part.shape[1] - last > HELD_ROWS:
                # a common gram: its whole contexts are told, and it is known to be shared
                last = int(_runs(part[1], part[2])[0][-1])
                if last and part[1][last - 1] == part[1][last]:
                    yield told(part[:, :last], opening, True)
                    held, opening = part[:, last:], True
                    continue
                last = 0
            if last:
                yield told(part[:, :last], opening, False)
                opening = False
            held = part[:, last:]
        if held.shape[1]:
            yield told(held, opening, True)

    # settled rows are spread by their text and place
    spread = F.col("state") == SETTLED
    rows = settled_contexts(rows).select(
        "state", F.when(spread, F.xxhash64("text_key", "pos")).otherwise(F.col("gram")).alias("gram"),
        F.when(spread, F.lit(0)).otherwise(F.col("context")).alias("context"), "text_key", "pos")
    return rows.repartitionByRange("gram", "context").sortWithinPartitions("gram", "context", "text_key", "pos"
                                                                           ).mapInArrow(run, SHARED_SCHEMA)


def _bytes(words: np.ndarray) -> pa.Array:
    """Rows of word hashes as binary values that sort like the words in turn."""
    data = words.astype(">u8").tobytes()
    offsets = np.arange(len(words) + 1, dtype=np.int32) * (8 * words.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def _words(column: pa.Array) -> np.ndarray:
    """The rows of word hashes again."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, REACH)


def wide_suffixes(docs: DataFrame, wanted: DataFrame, first: DataFrame) -> DataFrame:
    """The wanted suffixes (text_key, pos, gram, a, b) with the words around
    them, out of the first document (text_key, _first) of each text."""
    here = np.arange(REACH)

    def run(batches):
        for batch in batches:
            for piece in text_slices(batch, "text"):
                offsets, hashes = word_hashes(piece.column(0))
                for row, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:])):
                    own = np.concatenate([np.zeros(REACH, np.uint64), np.maximum(hashes[lo:hi], 1),
                                          np.zeros(REACH, np.uint64)])
                    marks = pa.RecordBatch.from_struct_array(piece.column(1)[row].values)
                    for at in range(0, marks.num_rows, 4096):
                        some = marks.slice(at, 4096)
                        pos = some.column("pos").to_numpy().astype(np.int64)[:, None] + REACH
                        none = pa.array(np.zeros(len(pos), np.int32))
                        nothing = pa.nulls(len(pos), pa.int32())
                        yield pa.record_batch({
                            "gram": some.column("gram"), "a": some.column("a"), "b": some.column("b"),
                            "pos": some.column("pos"), "before": _bytes(own[pos - 1 - here]),
                            "after": _bytes(own[pos + GRAM + here]),
                            "reach_left": none, "reach_right": none, "first": nothing, "last": nothing})

    marks = wanted.groupBy(F.col("text_key").alias("_key")).agg(
        F.collect_set(F.struct("gram", "a", "b", "pos")).alias("marks"))
    marks = marks.join(first, F.col("_key") == F.col("text_key")).drop("text_key")
    # dealt by text and document, so that the copies of one text do not meet in one task
    one = (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_first"))
    return _keyed(docs).join(marks, one).select("text", "marks").mapInArrow(run, WIDE_SCHEMA)


def agreement(x: np.ndarray) -> np.ndarray:
    """How many words each row shares with the next one, from the gram on."""
    same = (x[1:] == x[:-1]) & (x[1:] != 0)
    return np.logical_and.accumulate(same, axis=1).sum(axis=1)


def words_held(column: pa.Array) -> int:
    """How many words of a single row are there, before its text ends."""
    return int(np.count_nonzero(_words(column)))


def compared(wide: DataFrame, side: str) -> DataFrame:
    """``wide`` sorted by gram and the words on one side ("after" or "before"),
    each row compared with both neighbours: reach_right or reach_left, and the
    windows (first, last) that a neighbour in another text shows to repeat."""
    reach = "reach_right" if side == "after" else "reach_left"

    def run(batches):
        held, opening = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            column = {n: whole.column(n) for n in whole.schema.names}
            gram, a, b = (column[n].to_numpy() for n in ("gram", "a", "b"))
            left, right = (agreement(_words(column[n])) for n in ("before", "after"))
            kin = gram[1:] == gram[:-1]
            left, right = left * kin, right * kin
            reached = column[reach].to_numpy().copy()
            longest = right if side == "after" else left
            reached[:-1] = np.maximum(reached[:-1], longest)
            reached[1:] = np.maximum(reached[1:], longest)
            if opening:  # what stands before the first row is not seen here
                reached[0], opening = words_held(column[side].slice(0, 1)), False
            # (MIN_WORDS-word windows start from ``low`` to ``left`` words before the gram)
            low = REACH - right
            other = kin & (low <= left) & ((a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (a[1:] != b[1:]))
            least = column["first"].fill_null(REACH + 1).to_numpy().copy()
            most = column["last"].fill_null(-1).to_numpy().copy()
            for part in (slice(None, -1), slice(1, None)):
                least[part] = np.where(other, np.minimum(least[part], low), least[part])
                most[part] = np.where(other, np.maximum(most[part], left), most[part])
            column[reach] = pa.array(reached.astype(np.int32))
            column["first"] = pa.array(least.astype(np.int32), mask=most < 0)
            column["last"] = pa.array(most.astype(np.int32), mask=most < 0)
            done = pa.record_batch(column)
            held = done.slice(len(done) - 1)
            yield done.slice(0, len(done) - 1)
        if held is not None:
            at = held.schema.get_field_index(reach)
            yield held.set_column(at, reach, pa.array([words_held(held.column(side))], pa.int32()))

    other_side = "before" if side == "after" else "after"
    return (wide.repartitionByRange("gram", side, other_side).sortWithinPartitions("gram", side, other_side)
            .mapInArrow(run, WIDE_SCHEMA))


def open_windows(rows: DataFrame) -> DataFrame:
    """(win, text_key, pos): the windows around grams with an open row, one
    that may repeat further out than its neighbours show. Windows farther out
    than the words that any row of the gram shares are left out. Contexts that
    are known to repeat are there to be met only (pos is -1)."""

    def run(batches):
        power = np.cumprod(np.full(REACH, _BASE))
        power_2 = np.cumprod(np.full(REACH, np.uint64(_BASE_2)))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                column = {n: some.column(n) for n in some.schema.names}
                upto = [np.pad(np.cumsum(_words(column[n]) * p, axis=1), ((0, 0), (1, 0)))
                        for n, p in (("before", power), ("after", power_2))]
                gram, pos = column["gram"].to_numpy().view(np.uint64), column["pos"].to_numpy()
                for i in range(REACH + 1):
                    took = np.flatnonzero((column["low"].to_numpy() <= i) & (column["high"].to_numpy() >= i))
                    win = _mixed(_mixed(upto[0][took, i] + np.uint64(i)) * _BASE
                                 + _mixed(upto[1][took, REACH - i]) + gram[took])
                    a, b = (column[n].to_numpy()[took] for n in ("a", "b"))
                    several = a != b
                    yield pa.record_batch({
                        "win": pa.array(np.append(win, win[several]).view(np.int64)),
                        "text_key": pa.array(np.append(a, b[several])),
                        "pos": pa.array(np.append(np.where(several, -1, pos[took] - i),
                                                  np.full(several.sum(), -1)).astype(np.int32))})

    low = (F.lit(REACH) - F.col("reach_right")).alias("low")
    ranged = rows.select("*", low, F.col("reach_left").alias("high")).where("low <= high")
    unsure = (F.col("a") == F.col("b")) & (F.col("first").isNull() | (F.col("low") < F.col("first"))
                                           | (F.col("high") > F.col("last")))
    grams = ranged.where(unsure).select("gram").distinct()
    return (ranged.join(grams, "gram").select("gram", "a", "b", "pos", "before", "after", "low", "high")
            .mapInArrow(run, "win bigint, text_key bigint, pos int"))


def settled_windows(windows: DataFrame) -> DataFrame:
    """(state, win, text_key, pos): neighbours compared within each partition,
    before any shuffle. A run of two texts or more is SETTLED there, and one
    WITNESS row of it goes on for all its rows, so that what meets later of a
    very common window is a row per partition. Other rows stay OPEN."""

    def run(batches):
        held = None  # (window, text, whether its run was seen to hold two texts)
        for batch in batches:
            win, key, pos = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(win):
                continue
            first, size = _runs(win)
            several = key[first] != key[first + size - 1]
            if held is not None and win[0] == held[0]:
                known = held[2]
                several[0] = several[0] or known or key[0] != held[1]
            else:
                known = False
            state = np.where(np.repeat(several, size), SETTLED, OPEN).astype(np.int32)
            marks = first[several] if not known else first[several][1:]
            yield pa.record_batch({
                "state": pa.array(np.append(state, np.full(len(marks), WITNESS, np.int32))),
                "win": pa.array(np.append(win, win[marks])),
                "text_key": pa.array(np.append(key, key[marks])), "pos": pa.array(np.append(pos, pos[marks]))})
            held = (win[-1], key[-1], bool(several[-1]))

    return windows.sortWithinPartitions("win", "text_key").mapInArrow(
        run, "state int, win bigint, text_key bigint, pos int")


def repeated_windows(windows: DataFrame) -> DataFrame:
    """(text_key, pos) of the windows that stand in two texts or more. Settled
    rows pass; the others are sorted, then each run of equal windows compared
    from neighbour to neighbour. Of a run that goes on, only rows of a single
    text ever wait."""

    def run(batches):
        wait = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
        known = None  # the run that is known to stand in several texts
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            settled = columns[0] == SETTLED
            if settled.any():
                yield pa.record_batch({"text_key": pa.array(columns[2][settled]),
                                       "pos": pa.array(columns[3][settled])})
            state, win, key, pos = (np.concatenate([w, c[~settled]]) for w, c in zip(wait, columns))
            if not len(win):
                continue
            first, size = _runs(win)
            # sorted by text_key within a run: its first and last tell whether there are two
            several = (key[first] != key[first + size - 1]) | np.logical_or.reduceat(state == WITNESS, first)
            if known is not None and win[0] == known:
                several[0] = True
            taken = np.repeat(several, size) & (state == OPEN)
            known = win[-1] if several[-1] else None
            tail = len(win) if several[-1] else int(first[-1])
            wait = [state[tail:], win[tail:], key[tail:], pos[tail:]]
            taken = taken[:tail]
            yield pa.record_batch({"text_key": pa.array(key[:tail][taken]), "pos": pa.array(pos[:tail][taken])})

    place = F.when(F.col("state") == SETTLED, F.col("text_key")).otherwise(F.col("win"))
    rows = settled_windows(windows).withColumn("place", place)
    return (rows.repartition("place").sortWithinPartitions("win", "text_key")
            .select("state", "win", "text_key", "pos").mapInArrow(run, "text_key bigint, pos int"))


def joined_spans(runs: DataFrame) -> DataFrame:
    """(text_key, start, length): runs of a text (text_key, start, stop) that
    overlap or touch as one span."""

    def run(batches):
        held = None  # (text_key, start, stop) of the span that may go on
        for batch in batches:
            key, start, stop = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            if not len(key):
                continue
            if held is not None:
                key, start, stop = (np.concatenate([[h], c]) for h, c in zip(held, (key, start, stop)))
            # the farthest stop so far within each text
            text = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) << 40
            stop = np.maximum.accumulate(stop + text) - text
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (start[1:] > stop[:-1])]))
            key, start, stop = key[first], start[first], stop[np.append(first[1:], len(stop)) - 1]
            held = (key[-1], start[-1], stop[-1])
            yield pa.record_batch({"text_key": pa.array(key[:-1]), "start": pa.array(start[:-1]),
                                   "length": pa.array(stop[:-1] - start[:-1])})
        if held is not None:
            yield pa.record_batch({"text_key": pa.array([held[0]], pa.int64()),
                                   "start": pa.array([held[1]], pa.int64()),
                                   "length": pa.array([held[2] - held[1]], pa.int64())})

    def joined(rows):
        return rows.sortWithinPartitions("text_key", "start").mapInArrow(
            run, "text_key bigint, start bigint, length bigint")

    # joined before the shuffle too
    near = joined(runs).select("text_key", "start", (F.col("start") + F.col("length")).alias("stop"))
    return joined(near.repartition("text_key"))


def repeated_runs(docs: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(text_key, start, stop): runs of MIN_WORDS words or more that another
    text holds too; together they cover every such run. Settled ones may end
    behind the end of the text."""
    spark, pos = docs.sparkSession, F.col("pos")
    folder = shared_folder(spark, "suffixes")
    shared = written(shared_suffixes(suffixes), f"{folder}/shared")
    settled = shared.where(F.col("state") == SETTLED).select(
        "text_key", F.greatest(pos - REACH, F.lit(0)).cast("bigint").alias("start"),
        (pos + MIN_WORDS).cast("bigint").alias("stop"))
    # beside the open suffixes, one row of each settled context of their grams
    lone = shared.where(F.col("state") == OPEN)
    seen = shared.where(F.col("state") == WITNESS).join(lone.select("gram").distinct(), "gram", "left_semi")
    wide = written(wide_suffixes(docs, lone.unionByName(seen), suffixes.groupBy("text_key").agg(
        F.min("doc_id").alias("_first"))), f"{folder}/wide")
    rows = written(compared(compared(wide, "after"), "before"), f"{folder}/compared")
    # between the outermost repeated windows all hold the gram, so they overlap
    extended = rows.where((F.col("a") == F.col("b")) & F.col("first").isNotNull()).select(
        F.col("a").alias("text_key"), (pos - F.col("last")).cast("bigint").alias("start"),
        (pos - F.col("first") + MIN_WORDS).cast("bigint").alias("stop"))
    further = repeated_windows(open_windows(rows)).where("pos >= 0").select(
        "text_key", pos.cast("bigint").alias("start"), (pos + MIN_WORDS).cast("bigint").alias("stop"))
    return settled.unionByName(extended).unionByName(further)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, n_words, whole): the word spans of each
    document that repeat in another document; ``whole`` marks documents whose
    entire text stands under another doc_id."""
    suffixes = sparse_suffixes(docs)
    spans = joined_spans(repeated_runs(docs, suffixes))
    members = suffixes.select("doc_id", "text_key", "n_words").distinct()
    long_enough = members.where(F.col("n_words") >= MIN_WORDS)
    copied = long_enough.groupBy("text_key").agg(F.count(F.lit(1)).alias("n"), F.first("n_words").alias("w"))
    copied = copied.where("n > 1").select("text_key", F.lit(0).cast("bigint").alias("start"),
                                          F.col("w").cast("bigint").alias("length"), F.lit(True).alias("whole"))
    parts = spans.join(copied.select("text_key"), "text_key", "left_anti").withColumn("whole", F.lit(False))
    inside = F.least("length", F.col("n_words") - F.col("start")).alias("length")
    return long_enough.join(copied.unionByName(parts), "text_key").select(
        "doc_id", "start", inside, F.col("n_words").cast("bigint").alias("n_words"), "whole")
