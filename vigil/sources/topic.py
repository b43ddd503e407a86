"""A topic of JSON messages as a folder of segments, read by offset.

A segment file is named by partition and by the offset of its first message
(``<partition>-<20 digits>.jsonl``), one message a line, so that a reader knows
from the listing alone which offsets a file holds: its own up to the next
file's of that partition.  The Python Data Source ``segments`` makes each
segment one input partition of the plan, for batch and for streaming reads:

- batch: options ``path``, ``startingOffset`` and ``limit`` (messages in
  arrival order: partition, then offset).  Segments beyond the limit are never
  opened.
- stream: the offset of a micro-batch is the next message of every partition;
  a batch takes what is there, one task a segment.

Rows are (partition, offset, value).  ``append`` writes new segments; segments
are never changed, and the last one of a partition is complete when it has its
name (files are renamed into place).
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from vigil.plans.ordered_scan import sequence_within

SCHEMA = "partition int, offset long, value string"


def segment_name(partition: int, first: int) -> str:
    return f"{partition}-{first:020d}.jsonl"


def _files(path: str):
    """The file system and its base folder (any store that Arrow reads)."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def segments(path: str) -> list[tuple[int, int, str]]:
    """(partition, first offset, file) in arrival order."""
    fs, base = _files(path)
    found = []
    for info in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        if info.is_file and info.base_name.endswith(".jsonl"):
            partition, first = info.base_name[:-len(".jsonl")].split("-")
            found.append((int(partition), int(first), info.path))
    return sorted(found)


def read_segment(path: str, file: str, first: int, start: int, stop: int | None) -> Iterator[tuple[int, str]]:
    """(offset, value) of a segment's messages from ``start`` up to ``stop``,
    line by line: never a whole file in memory."""
    fs, _ = _files(path)
    with fs.open_input_stream(file) as raw:
        for offset, line in enumerate(io.TextIOWrapper(raw, "utf-8", errors="replace", newline="\n"), first):
            if stop is not None and offset >= stop:
                return
            if offset >= start:
                yield offset, line.rstrip("\n")


def count_messages(path: str, file: str) -> int:
    """Lines of a segment."""
    fs, _ = _files(path)
    lines, last = 0, b"\n"
    with fs.open_input_stream(file) as raw:
        while chunk := raw.read(1 << 20):
            lines += chunk.count(b"\n")
            last = chunk[-1:]
    return lines + (last != b"\n")


class Segment(InputPartition):
    """One segment, or a range of its offsets."""

    def __init__(self, partition: int, first: int, file: str, start: int, stop: int | None):
        super().__init__((partition, first))
        self.partition, self.first, self.file, self.start, self.stop = partition, first, file, start, stop


def _rows(path: str, s: Segment) -> Iterator[tuple]:
    for offset, value in read_segment(path, s.file, s.first, s.start, s.stop):
        yield s.partition, offset, value


class SegmentReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.start = int(options.get("startingOffset", 0))
        self.limit = int(options["limit"]) if "limit" in options else None

    def partitions(self) -> list[Segment]:
        """Segments that hold the wanted messages.  The size of all but a
        partition's last segment is known from the names."""
        found = segments(self.path)
        out, left = [], self.limit
        for i, (partition, first, file) in enumerate(found):
            after = found[i + 1][1] if i + 1 < len(found) and found[i + 1][0] == partition else None
            if after is not None and after <= self.start:
                continue
            start = max(first, self.start)
            if left is None:
                out.append(Segment(partition, first, file, start, after))
                continue
            if left <= 0:
                break
            if after is None and i + 1 < len(found):  # another partition follows: the count matters
                after = first + count_messages(self.path, file)
            stop = start + left if after is None else min(after, start + left)
            out.append(Segment(partition, first, file, start, stop))
            left -= max(0, stop - start)
        return out or [Segment(0, 0, "", 0, 0)]

    def read(self, partition: Segment) -> Iterator[tuple]:
        return _rows(self.path, partition) if partition.file else iter(())


class SegmentStream(DataSourceStreamReader):
    """Offsets are ``{partition: next offset}``; a batch ends at the ends of
    segments, so each planned range lies in one file."""

    def __init__(self, options):
        self.path = options["path"]
        self.earliest = options.get("startingOffsets", "earliest") == "earliest"
        self.ends: dict[str, int] = {}

    def _end(self, file: str, first: int, after: int | None) -> int:
        if after is not None:
            return after
        if file not in self.ends:  # segments never change: counted once
            self.ends[file] = first + count_messages(self.path, file)
        return self.ends[file]

    def _spans(self) -> list[tuple[int, int, int, str]]:
        found = segments(self.path)
        return [(p, first, self._end(file, first, found[i + 1][1] if i + 1 < len(found) and found[i + 1][0] == p else None), file)
                for i, (p, first, file) in enumerate(found)]

    def initialOffset(self) -> dict:
        return {} if self.earliest else self.latestOffset()

    def latestOffset(self) -> dict:
        out: dict[str, int] = {}
        for p, _, end, _ in self._spans():
            out[str(p)] = max(end, out.get(str(p), 0))
        return out

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        out = []
        for p, first, stop, file in self._spans():
            lo, hi = max(first, start.get(str(p), 0)), min(stop, end.get(str(p), 0))
            if lo < hi:
                out.append(Segment(p, first, file, lo, hi))
        return out or [Segment(0, 0, "", 0, 0)]

    def read(self, partition: Segment) -> Iterator[tuple]:
        return _rows(self.path, partition) if partition.file else iter(())

    def commit(self, end: dict) -> None:
        pass


class SegmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SegmentReader:
        return SegmentReader(self.options)

    def streamReader(self, schema) -> SegmentStream:
        return SegmentStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SegmentSource)


def append(messages: DataFrame, path: str, per_segment: int = 10_000, partitions: int = 1) -> int:
    """Append (value, and an order column ``seq`` if there is one) to the topic:
    messages are dealt to ``partitions`` by hash and cut into segments of
    ``per_segment``.  Returns the number of new segments."""
    spark = messages.sparkSession
    next_offset = {p: 0 for p in range(partitions)}
    for p, first, file in segments(path):
        next_offset[p] = first + count_messages(path, file)
    order = [c for c in ("seq",) if c in messages.columns]
    dealt = messages.withColumn("_p", F.pmod(F.xxhash64("value"), F.lit(partitions)).cast("int") if partitions > 1 else F.lit(0))
    base = F.element_at(F.array(*[F.lit(next_offset[p]).cast("long") for p in range(partitions)]), F.col("_p") + 1)
    # chunks of a range sort give gapless offsets: their sizes are summed up first
    placed = sequence_within(dealt.withColumn("_base", base), "_p", order or ["value"])
    sizes = placed.groupBy("_p", "_chunk").agg(F.count("*").alias("n"), F.min("_gid").alias("low")).collect()  # one row a chunk
    before: dict[tuple, int] = {}
    for p in range(partitions):
        total = 0
        for r in sorted((r for r in sizes if r._p == p), key=lambda r: r._chunk):
            before[p, r._chunk] = total - r.low
            total += r.n
    shift = spark.createDataFrame([(p, c, b) for (p, c), b in before.items()], "_sp int, _sc int, _shift long")
    numbered = placed.join(F.broadcast(shift), (F.col("_p") == F.col("_sp")) & (F.col("_chunk") == F.col("_sc"))) \
        .select(F.col("_p").alias("p"), (F.col("_gid") + F.col("_shift")).alias("at"), "value", "_base")
    cut = numbered.withColumn("segment", F.floor(F.col("at") / per_segment))

    def write(batches):
        fs, folder = _files(path)
        fs.create_dir(folder, recursive=True)
        now, out, temp, name = None, None, None, None
        done = 0
        for rb in batches:  # sorted by partition and offset
            for p, at, value, b, s in zip(*(rb.column(c).to_pylist() for c in ("p", "at", "value", "_base", "segment"))):
                if (p, s) != now:
                    if out:
                        out.close()
                        fs.move(temp, name)
                        done += 1
                    now = (p, s)
                    name = f"{folder}/{segment_name(p, b + at)}"
                    temp = f"{folder}/.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temp)
                out.write((value or "").replace("\n", " ").encode() + b"\n")
        if out:
            out.close()
            fs.move(temp, name)
            done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int32())], ["n"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return cut.repartition(n, "p", "segment").sortWithinPartitions("p", "at").mapInArrow(write, "n int") \
        .agg(F.sum("n")).first()[0] or 0

