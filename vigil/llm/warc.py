"""WARC archives with a two-level capture index.

Writing: each task writes its rows as gzip members to WARC files of its own
in the shared folder (an attempt that fails leaves a file nobody refers to).
Rows with equal payloads of at least ``REVISIT_BYTES`` bytes become revisits of
the one with the largest page_id.

Index: captures are range-partitioned and sorted by URL key (host labels
reversed), and each task writes one index shard: compressed blocks of
``BLOCK`` captures and a sparse directory with the first key and the place of
each block.  The first and last keys of the shards, one row a shard, are the
top level.

Lookup: a key goes to the shards that can hold it, is binary-searched in the
shard's block directory and then in the block; the records are read by byte
ranges.  Files are opened with Arrow's file systems, so the shared folder may
be a local mount, HDFS or an object store that Arrow knows.

Defined cases: a null html is an empty payload; a null url has an empty key.
Rows without a page_id are revisits if an equal payload has one, else
responses.  Repeated rows are records of their own, all responses if they
hold the largest page_id.  Urls keep their text, with control characters and
blanks percent-encoded in the WARC header.  No rows: no files.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import partitions, shared_path, steps, written
from vigil.session import delete_on_exit

REVISIT_BYTES = 1000
BLOCK = 1024                # captures in a compressed block
FILE_BYTES = 1 << 30        # a WARC file is closed beyond this size
RANGE_BYTES = 4 << 20       # neighbouring records are read together up to this size
SLICE_BYTES = 64 << 20      # part of a file that one reading task gets
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def url_key(url: str) -> Column:
    """Host labels reversed, then ``)`` and the rest of the url."""
    at = F.expr(f"instr(`{url}`, '://')")
    rest = F.when(at > 0, F.expr(f"substr(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    tail = F.when(at > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)).otherwise(F.coalesce(F.col(url), F.lit("")))
    return F.concat(F.array_join(F.reverse(F.split(F.coalesce(host, F.lit("")), r"\.")), ","), F.lit(")"), F.coalesce(tail, F.lit("")))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member: WARC header, HTTP header and, for a response, payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 3, mtime=0)


def parse(member: bytes) -> dict:
    """Fields of a record; the payload's digest is computed, not believed."""
    data = gzip.decompress(member)
    end = data.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in data[:end].decode().split("\r\n")[1:])
    body = data[end + 4:end + 4 + int(head["Content-Length"])]
    at = body.index(b"\r\n\r\n") + 4
    size = int(re.search(rb"\r\nContent-Length: (\d+)", body[:at])[1])
    stated = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = head["WARC-Type"] == "revisit"
    payload = None if revisit else body[at:]
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != stated):
        raise ValueError(f"damaged record {head['WARC-Record-ID']}")

    def page(name: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", head.get(name, ""))
        return int(found[1]) if found else None

    return {"page_id": page("WARC-Record-ID"), "url": head.get("WARC-Target-URI"), "payload_bytes": size,
            "payload_digest": stated, "record_type": head["WARC-Type"], "refers_to": page("WARC-Refers-To"),
            "payload": payload}


def write_records(pages: DataFrame, path: str, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Write WARC files below ``path``; (key, page_id, file, offset, length)
    of every record."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    keyed = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"),
        url_key(url_col).alias("key"), F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("size"),
        F.xxhash64(html).alias("x"))
    same = written(keyed.filter(F.col("size") >= REVISIT_BYTES).groupBy("sha", "size", "x")
                   .agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1").drop("n"), "same")
    rows = keyed.join(same, ["sha", "size", "x"], "left").select("page_id", "url", "html", "key", "response")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(path)
        fs.create_dir(base, recursive=True)
        ctx, number, out, name, at = TaskContext.get(), 0, None, "", 0
        try:
            for rb in steps(batches, "html", 4 << 20):
                rows = []
                for page, url, text, key, response in zip(*(rb.column(c).to_pylist() for c in (
                        "page_id", "url", "html", "key", "response"))):
                    if out is None or at >= FILE_BYTES:
                        if out:
                            out.close()
                        name, at = f"part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{number}.warc.gz", 0
                        out, number = fs.open_output_stream(f"{base}/{name}", compression=None), number + 1
                    member = record(page, url, text.encode(), response, response is not None and response != page)
                    out.write(member)
                    rows.append((key, page, name, at, len(member)))
                    at += len(member)
                if out:
                    out.flush()
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                    ["key", "page_id", "file", "offset", "length"])
        finally:
            if out:
                out.close()

    return written(rows.mapInArrow(run, "key string, page_id long, file string, offset long, length long"), "captures")


def write_index(captures: DataFrame, path: str) -> DataFrame:
    """Write index shards below ``path``; (shard, first, last) of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(path)
        fs.create_dir(base, recursive=True)
        ctx = TaskContext.get()
        name = f"index-{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        directory, held, at, last, out = [], [], 0, None, None

        def flush(lines: list[list]) -> int:
            block = zlib.compress("\n".join(map(json.dumps, lines)).encode(), 6)
            out.write(block)
            directory.append([lines[0][0], at, len(block)])
            return len(block)

        for rb in batches:
            for line in zip(*(rb.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length"))):
                out = out or fs.open_output_stream(f"{base}/{name}.blocks", compression=None)
                held.append(list(line))
                if len(held) == BLOCK:
                    last = held[-1][0]
                    at += flush(held)
                    held = []
        if held:
            last = held[-1][0]
            at += flush(held)
        if out:
            out.close()
            with fs.open_output_stream(f"{base}/{name}.directory", compression=None) as f:
                f.write(json.dumps(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, directory[0][0], last)], ["shard", "first", "last"])

    order = ["key", "page_id", "file", "offset"]
    return written(captures.repartitionByRange(partitions(captures.sparkSession), *order).sortWithinPartitions(*order)
                   .mapInArrow(run, "shard string, first string, last string"), "shards")


class Shard:
    """Index shard: the block directory in memory, one block at a time."""

    def __init__(self, path: str, name: str):
        self.fs, base = file_system(path)
        with self.fs.open_input_file(f"{base}/{name}.directory") as f:
            self.directory = json.loads(f.read())
        self.firsts = [d[0] for d in self.directory]
        self.file = self.fs.open_input_file(f"{base}/{name}.blocks")
        self.at, self.lines, self.keys = -1, [], []

    def block(self, i: int) -> None:
        if i != self.at:
            _, offset, length = self.directory[i]
            text = zlib.decompress(self.file.read_at(length, offset)).decode()
            self.lines = [json.loads(x) for x in text.split("\n")]
            self.at, self.keys = i, [x[0] for x in self.lines]

    def find(self, key: str) -> Iterator[list]:
        """Captures of a key: it may begin in the block before the first one
        whose first key isn't smaller, and go on in those behind."""
        i = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.firsts) and self.firsts[i] <= key:
            self.block(i)
            yield from self.lines[bisect.bisect_left(self.keys, key):bisect.bisect_right(self.keys, key)]
            i += 1


def lookup(keys: DataFrame, shards: DataFrame, path: str) -> DataFrame:
    """Captures (key, page_id, file, offset, length) of the distinct ``key``s."""
    spark = keys.sparkSession
    bounds = sorted((r["first"], r["last"], r.shard) for r in shards.collect())  # one row for each shard
    bc = spark.sparkContext.broadcast(bounds)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts = [b[0] for b in bc.value], [b[1] for b in bc.value]
        for rb in batches:
            out_key, out_shard = [], []
            for key in rb.column("key").to_pylist():
                for i in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                    out_key.append(key)
                    out_shard.append(bc.value[i][2])
            yield pa.RecordBatch.from_arrays([pa.array(out_key, pa.string()), pa.array(out_shard, pa.string())], ["key", "shard"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard = None, None
        for rb in batches:
            rows = []
            for key, of in zip(rb.column("key").to_pylist(), rb.column("shard").to_pylist()):
                if of != name:
                    name, shard = of, Shard(path, of)
                rows += shard.find(key)
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                ["key", "page_id", "file", "offset", "length"])

    routed = keys.select("key").distinct().mapInArrow(route, "key string, shard string")
    return routed.repartition(partitions(spark), "shard").sortWithinPartitions("shard", "key") \
        .mapInArrow(search, "key string, page_id long, file string, offset long, length long")


def read_records(captures: DataFrame, path: str, with_payload: bool = False) -> DataFrame:
    """Records at the captures' byte ranges; neighbours are read together."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    arrow = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
             ("record_type", pa.string()), ("refers_to", pa.int64())]
    if with_payload:
        schema, arrow = f"{schema}, payload binary", [*arrow, ("payload", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(path)
        name, source = None, None

        def emit(ranges: list[tuple[int, int]]) -> pa.RecordBatch:
            start = ranges[0][0]
            data = source.read_at(ranges[-1][0] + ranges[-1][1] - start, start)
            found = [parse(data[o - start:o - start + n]) for o, n in ranges]
            return pa.RecordBatch.from_pylist([{c: r[c] for c, _ in arrow} for r in found], pa.schema(arrow))

        for rb in batches:
            ranges: list[tuple[int, int]] = []
            for file, offset, length in zip(*(rb.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if ranges and (file != name or offset != sum(ranges[-1]) or offset + length - ranges[0][0] > RANGE_BYTES):
                    yield emit(ranges)
                    ranges = []
                if file != name:
                    name, source = file, fs.open_input_file(f"{base}/{file}")
                ranges.append((offset, length))
            if ranges:
                yield emit(ranges)

    piece = F.expr(f"offset div {SLICE_BYTES}")
    return captures.select("file", "offset", "length", piece.alias("piece")) \
        .repartition(partitions(captures.sparkSession), "file", "piece").sortWithinPartitions("file", "offset") \
        .mapInArrow(run, schema)


def archive(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> tuple[str, DataFrame]:
    """Write records and index; the folder and the shard table.  Without a
    ``path`` the archive is scratch and goes when the driver ends."""
    scratch, spark = path is None, pages.sparkSession
    path = path or shared_path(spark, "warc")
    shards = write_index(write_records(pages, f"{path}/data", id_col, url_col, html_col), f"{path}/index")
    if scratch:
        delete_on_exit(spark, path)
    return path, shards


def fetch(spark: SparkSession, urls: DataFrame, path: str, shards: DataFrame, url_col: str = "url",
          with_payload: bool = False) -> DataFrame:
    """All records of the given urls, through the index."""
    captures = written(lookup(urls.select(url_key(url_col).alias("key")), shards, f"{path}/index"), "located")
    return read_records(captures, f"{path}/data", with_payload)
