"""Topics as segment files with partitions and offsets: a Spark data source.

    <path>/segments/<uuid>.parquet     records (key, value, timestamp) of one
                                       partition of one topic, in order
    <path>/manifests/<n>.json          publication n: its segments with their
                                       topic, partition, first offset and rows,
                                       and the next offset of every partition

Reading goes through the manifests alone. A publication (SNK-1..4) is visible
once its manifest is: tasks write segments and report them in their commit
messages, the driver gives out offsets and moves one manifest into place, so a
batch's trades and prices appear together, and segments of killed tasks never.
A publication names its transaction; one that is already there is not repeated.

A batch read (SRC-1, SRC-4) takes starting and ending offsets per partition and
plans one task per segment in range; others are never opened. A stream read
(SRC-3, STR-9) takes a record bound per trigger and resumes from where the last
planned micro-batch ended, which it keeps under ``progress`` (for example in
the stream's checkpoint folder).

``path`` is any folder that Arrow's file systems and all executors reach. One
writer at a time publishes to a path.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader,
                                    InputPartition, WriterCommitMessage)

FORMAT = "topic_segments"
SCHEMA = "topic string, partition int, offset long, timestamp long, key string, value string"
FILE_SCHEMA = pa.schema([("key", pa.string()), ("value", pa.string()), ("timestamp", pa.int64())])
#: Records of a segment file; a longer run of one partition becomes several.
SEGMENT_RECORDS = 500_000
BATCH_RECORDS = 8_192


class TopicFolder:
    """The manifests below one path."""

    def __init__(self, path: str):
        self.fs, self.root = fs.FileSystem.from_uri(path)

    def numbers(self) -> list[int]:
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/manifests", allow_not_found=True))
        return sorted(int(i.base_name.removesuffix(".json")) for i in found if i.base_name.endswith(".json"))

    def manifest(self, n: int) -> dict:
        with self.fs.open_input_stream(f"{self.root}/manifests/{n}.json") as f:
            return json.loads(f.read())

    def ends(self) -> dict[str, int]:
        """Next offset of every partition ("topic/partition")."""
        numbers = self.numbers()
        return self.manifest(numbers[-1])["ends"] if numbers else {}

    def segments(self):
        """All published segments: (place, first offset, rows, file)."""
        for n in self.numbers():
            yield from map(tuple, self.manifest(n)["segments"])

    def published(self, txn: str) -> bool:
        return any(self.manifest(n)["txn"] == txn for n in reversed(self.numbers()))

    def write(self, name: str, content: dict) -> None:
        """A JSON file that appears whole or not at all."""
        target = f"{self.root}/{name}"
        folder = target.rsplit("/", 1)[0]
        self.fs.create_dir(folder, recursive=True)
        own = f"{folder}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(own) as f:
            f.write(json.dumps(content).encode())
        self.fs.move(own, target)

    def publish(self, files: list[tuple[str, str, int]], txn: str) -> None:
        """Make segment files (place, file, rows) visible, in this order."""
        if self.published(txn):
            self.forget([f for _, f, _ in files])
            return
        numbers = self.numbers()
        ends, segments = dict(self.ends()), []
        for place, file, rows in files:
            first = ends.get(place, 0)
            segments.append((place, first, rows, file))
            ends[place] = first + rows
        n = numbers[-1] + 1 if numbers else 0
        self.write(f"manifests/{n}.json", {"txn": txn, "segments": segments, "ends": ends})

    def forget(self, files: list[str]) -> None:
        for f in files:
            if self.fs.get_file_info(f"{self.root}/segments/{f}").type != fs.FileType.NotFound:
                self.fs.delete_file(f"{self.root}/segments/{f}")


@dataclass
class Segment(InputPartition):
    """Rows ``skip`` to ``skip + rows`` of one segment file."""

    path: str
    place: str
    file: str
    first: int
    skip: int
    rows: int


def plan(path: str, start: dict[str, int], end: dict[str, int]) -> list[Segment]:
    """Segments that hold offsets from ``start`` up to (not with) ``end``."""
    found = []
    for place, first, rows, file in TopicFolder(path).segments():
        low, high = max(first, start.get(place, 0)), min(first + rows, end.get(place, 0))
        if low < high:
            found.append(Segment(path, place, file, first, low - first, high - low))
    return found


def read_segment(part: Segment | None):
    if part is None:  # a read without partitions
        return
    folder = TopicFolder(part.path)
    topic, _, partition = part.place.rpartition("/")
    with folder.fs.open_input_file(f"{folder.root}/segments/{part.file}") as f:
        at, stop = 0, part.skip + part.rows
        for batch in pq.ParquetFile(f).iter_batches(BATCH_RECORDS):
            low, high = max(part.skip - at, 0), min(stop - at, batch.num_rows)
            if low < high:
                piece = batch.slice(low, high - low)
                n = piece.num_rows
                offsets = range(part.first + at + low, part.first + at + high)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([topic] * n), pa.array([int(partition)] * n, pa.int32()), pa.array(offsets, pa.int64()),
                     piece.column("timestamp"), piece.column("key"), piece.column("value")],
                    names=["topic", "partition", "offset", "timestamp", "key", "value"])
            at += batch.num_rows
            if at >= stop:
                return


def _offsets(text: str | None) -> dict[str, int] | None:
    """{"topic": {"0": 5}} as {"topic/0": 5}."""
    if not text:
        return None
    return {f"{topic}/{p}": int(at) for topic, places in json.loads(text).items() for p, at in places.items()}


class _Options:
    """Path, topics and offsets of a read. Starting offsets that are not given
    are 0; with ending offsets only the partitions they name are bounded."""

    def __init__(self, options):
        self.path = options["path"]
        self.topics = [t for t in options.get("topics", "").split(",") if t]
        self.start = _offsets(options.get("startingOffsets")) or {}
        self.end = _offsets(options.get("endingOffsets")) or {}
        self.bound = int(options.get("maxRecordsPerTrigger", 0))
        self.progress = options.get("progress")

    def ends(self) -> dict[str, int]:
        ends = TopicFolder(self.path).ends()
        return {p: min(n, self.end.get(p, n)) for p, n in ends.items()
                if not self.topics or p.rpartition("/")[0] in self.topics}


class SegmentReader(DataSourceReader):
    def __init__(self, options):
        self.options = _Options(options)

    def partitions(self):
        return plan(self.options.path, self.options.start, self.options.ends())

    def read(self, partition):
        return read_segment(partition)


class SegmentStreamReader(DataSourceStreamReader):
    """``maxRecordsPerTrigger`` bounds the records of a micro-batch over all
    partitions, shared out evenly. Where the last planned micro-batch ended is
    kept in ``progress``: Spark has that batch in its offset log by then, so a
    restart repeats it or goes on behind it."""

    def __init__(self, options):
        self.options = _Options(options)
        if self.options.bound and not self.options.progress:
            raise ValueError("maxRecordsPerTrigger needs a progress folder")
        self.at: dict[str, int] | None = None

    def initialOffset(self):
        return dict(self.options.start)

    def _position(self) -> dict[str, int]:
        if self.at is None:
            self.at = dict(self.options.start)
            if self.options.progress:
                store, root = fs.FileSystem.from_uri(self.options.progress)
                if store.get_file_info(f"{root}/position.json").type != fs.FileType.NotFound:
                    with store.open_input_stream(f"{root}/position.json") as f:
                        self.at = json.loads(f.read())
        return self.at

    def latestOffset(self):
        ends = self.options.ends()
        if not self.options.bound:
            return ends
        at = self._position()
        left = {p: n - at.get(p, 0) for p, n in sorted(ends.items()) if n > at.get(p, 0)}
        out, room = {p: min(at.get(p, 0), n) for p, n in ends.items()}, self.options.bound
        for i, (place, waiting) in enumerate(sorted(left.items(), key=lambda x: (x[1], x[0]))):
            taken = min(waiting, -(-room // (len(left) - i)))
            out[place] += taken
            room -= taken
        return out

    def partitions(self, start, end):
        if self.options.bound and end != self.at:
            self.at = dict(end)
            TopicFolder(self.options.progress).write("position.json", self.at)
        return plan(self.options.path, start, end)

    def read(self, partition):
        return read_segment(partition)


@dataclass
class SegmentsWritten(WriterCommitMessage):
    files: list


class SegmentWriter(DataSourceArrowWriter):
    """Rows (topic, partition, key, value, timestamp) into segment files."""

    def __init__(self, options):
        self.path = options["path"]
        self.txn = options.get("txn") or uuid.uuid4().hex

    def write(self, iterator):
        folder = TopicFolder(self.path)
        folder.fs.create_dir(f"{folder.root}/segments", recursive=True)
        files, place, writer, rows = [], None, None, 0

        def close():
            if writer is not None:
                writer.close()
                files.append((place, name, rows))

        for batch in iterator:
            places = [f"{t}/{p}" for t, p in zip(batch.column("topic").to_pylist(), batch.column("partition").to_pylist())]
            start = 0
            while start < len(places):
                stop = start + 1
                while stop < len(places) and places[stop] == places[start]:
                    stop += 1
                if places[start] != place or rows >= SEGMENT_RECORDS:
                    close()
                    place, name, rows = places[start], f"{uuid.uuid4().hex}.parquet", 0
                    writer = pq.ParquetWriter(folder.fs.open_output_stream(f"{folder.root}/segments/{name}"), FILE_SCHEMA)
                piece = batch.slice(start, stop - start)
                writer.write_batch(pa.RecordBatch.from_arrays(
                    [piece.column(f.name).cast(f.type) for f in FILE_SCHEMA], schema=FILE_SCHEMA))
                rows += stop - start
                start = stop
        close()
        return SegmentsWritten(files)

    def commit(self, messages):
        files = [tuple(f) for m in messages if m is not None for f in m.files]
        TopicFolder(self.path).publish(files, self.txn)

    def abort(self, messages):
        TopicFolder(self.path).forget([f for m in messages if m is not None for _, f, _ in m.files])


class TopicSegments(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return SegmentReader(self.options)

    def streamReader(self, schema):
        return SegmentStreamReader(self.options)

    def writer(self, schema, overwrite):
        return SegmentWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    from crossbook.plans.match import ship_package
    ship_package()
    spark.dataSource.register(TopicSegments)


def publish(rows: DataFrame, path: str, partitions: int | dict[str, int] = 1, txn: str | None = None,
            order: tuple[str, ...] = ()) -> None:
    """Append messages (topic, key, value[, timestamp]) to their topics as one
    publication. A key's messages go to one of the topic's ``partitions`` (one
    number, or one per topic) by its hash, in the order of the columns
    ``order``; a null key goes to partition 0. A column ``partition`` of the
    rows decides instead. Tasks write ranges of a partition in this order, so
    their memory does not follow the partition's size."""
    register(rows.sparkSession)
    if isinstance(partitions, dict):
        count = F.coalesce(*[F.when(F.col("topic") == t, F.lit(n)) for t, n in partitions.items()], F.lit(1))
    else:
        count = F.lit(partitions)
    place = F.when(F.col("key").isNull(), F.lit(0)).otherwise(F.pmod(F.crc32(F.col("key").cast("binary")), count)).cast("int")
    timestamp = F.col("timestamp").cast("long") if "timestamp" in rows.columns else F.lit(None).cast("long")
    out = rows if "partition" in rows.columns else rows.withColumn("partition", place)
    out = out.withColumn("partition", F.col("partition").cast("int")).withColumn("timestamp", timestamp)
    # commit messages come by task, so ranges in order are segments in order; the
    # hash splits a partition whose messages have no order of their own
    spread = F.xxhash64("key", "value")
    out = out.repartitionByRange("topic", "partition", *order, spread).sortWithinPartitions("topic", "partition", *order)
    writer = out.select("topic", "partition", F.lit(0).cast("long").alias("offset"), "timestamp",
                        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    writer = writer.write.format(FORMAT).mode("append").option("path", path)
    (writer.option("txn", txn) if txn else writer).save()


def read_topics(spark: SparkSession, path: str, topics: list[str] | None = None, starting: dict | None = None,
                ending: dict | None = None) -> DataFrame:
    """The records of topics, from and up to offsets per topic and partition
    ({"topic": {partition: offset}}; the end is not included)."""
    register(spark)
    return _options(spark.read, path, topics, starting, ending).load()


def stream_topics(spark: SparkSession, path: str, topics: list[str] | None = None, starting: dict | None = None,
                  max_records: int | None = None, progress: str | None = None) -> DataFrame:
    """The records of topics as a stream; see SegmentStreamReader."""
    register(spark)
    reader = _options(spark.readStream, path, topics, starting, None)
    if max_records:
        reader = reader.option("maxRecordsPerTrigger", str(max_records)).option("progress", progress)
    return reader.load()


def _options(reader, path, topics, starting, ending):
    reader = reader.format(FORMAT).option("path", path)
    if topics:
        reader = reader.option("topics", ",".join(topics))
    for name, offsets in (("startingOffsets", starting), ("endingOffsets", ending)):
        if offsets:
            reader = reader.option(name, json.dumps(offsets))
    return reader
