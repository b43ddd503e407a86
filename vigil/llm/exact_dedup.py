"""Exact dedup with an extendible-hash index on shared files.

Texts are equal when identical after each run of ASCII white space is one
space.  The scan writes index records to the shared folder: row, hash, SHA-256
and the text; a step that holds a text several times compares the bytes and
writes the text once, with the count and the first row (so a group that holds
much of the input is small before anything is shuffled).

The directory maps the top bits of a hash to a bucket.  It starts with one
bucket and doubles as long as a bucket is overfull and bits are left (at most
MAX_DEPTH, which bounds what the driver reads and the tasks get).  A bucket
that bits can't split gets overflow pages.  Owner tasks hold whole pages,
sorted by hash: texts of one hash form a chain, whose entries are compared by
bytes.  Classes of buckets with several pages are chained once more by hash.
The classes then join the rows by (hash, SHA-256); a chain in which two
different texts share both would stop the job instead of joining wrongly.

Defined cases: null counts as the empty text.  Of equal texts the row with
the smallest id stays; rows without an id come last; of repeated rows exactly
one stays.  ``keep_id`` is null where all rows of a group lack an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import partitions, steps, written

PAGE_BYTES = 32 << 20
MAX_DEPTH = 20
LAST_ID = (1 << 63) - 1


def records(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, id, h, sha of every row; text, n, first (id, row) for the first
    of equal texts in a step."""
    norm = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                       norm.alias("text")) \
        .select("row", "id", "text", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("sha"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in steps(batches, "text"):
            chains: dict[int, list[int]] = {}
            texts, hashes = rb.column("text").to_pylist(), rb.column("h").to_pylist()
            ids = [LAST_ID if x is None else x for x in rb.column("id").to_pylist()]
            rows = rb.column("row").to_pylist()
            n = np.zeros(len(texts), np.int64)
            first: list[tuple[int, int]] = [(0, 0)] * len(texts)
            for i, (h, t) in enumerate(zip(hashes, texts)):
                chain = chains.setdefault(h, [])
                rep = next((j for j in chain if texts[j] == t), i)
                if rep == i:
                    chain.append(i)
                    first[i] = (ids[i], rows[i])
                else:
                    texts[i] = None
                n[rep] += 1
                first[rep] = min(first[rep], (ids[i], rows[i]))
            yield pa.RecordBatch.from_arrays(
                [rb.column("row"), rb.column("id"), rb.column("h"), rb.column("sha"), pa.array(texts, pa.string()),
                 pa.array(n), pa.array([x[0] for x in first], pa.int64()), pa.array([x[1] for x in first], pa.int64())],
                ["row", "id", "h", "sha", "text", "n", "first_id", "first_row"])

    return base.mapInArrow(run, "row long, id long, h long, sha string, text string, n long, first_id long, first_row long")


class Directory:
    """Extendible-hash directory: ``bucket[top bits]`` and pages of a bucket."""

    def __init__(self, cells: dict[int, int], depth: int, page_bytes: int):
        self.depth = 0                       # global depth: bits the directory looks at
        self.bucket = np.zeros(1, np.int64)  # bucket of each entry
        local, load = [0], [sum(cells.values())]
        weight = np.zeros(1 << depth, np.int64)
        for cell, size in cells.items():
            weight[cell] = size
        span = [(0, 1 << depth)]             # finest cells below a bucket
        todo = [0]
        while todo:
            b = todo.pop()
            if load[b] <= page_bytes or local[b] == depth:
                continue
            if local[b] == self.depth:       # the directory doubles
                self.bucket = np.repeat(self.bucket, 2)
                self.depth += 1
            lo, hi = span[b]
            mid, new = (lo + hi) // 2, len(local)
            local[b] += 1
            local.append(local[b])
            span[b] = (lo, mid)
            span.append((mid, hi))
            load[b], right = int(weight[lo:mid].sum()), int(weight[mid:hi].sum())
            load.append(right)
            shift = depth - self.depth
            self.bucket[mid >> shift:max(hi >> shift, (mid >> shift) + 1)] = new
            todo += [b, new]
        self.pages = np.maximum(1, -(-np.array(load, np.int64) // page_bytes))

    def find(self, h: np.ndarray) -> np.ndarray:
        if not self.depth:
            return np.zeros(len(h), np.int64)
        return self.bucket[(h.view(np.uint64) >> np.uint64(64 - self.depth)).astype(np.int64)]


def directory(recs: DataFrame, page_bytes: int) -> Directory:
    """Loads of the finest cells (at most 2 ** MAX_DEPTH) decide the splits."""
    reps = recs.filter("text IS NOT NULL")
    size = F.octet_length("text") + F.lit(64)
    total = reps.agg(F.sum(size)).first()[0] or 0
    depth = max(1, min(MAX_DEPTH, (4 * total // page_bytes + 1).bit_length() + 2))
    cells = reps.groupBy(F.shiftrightunsigned("h", 64 - depth).alias("cell")).agg(F.sum(size).alias("s"))
    return Directory({r.cell: r.s for r in cells.collect()}, depth, page_bytes)


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes of rows sorted by (bucket, page, h): equal bytes of one hash."""
    names = ["h", "sha", "text", "n", "first_id", "first_row", "pages"]
    key, entries = None, []

    def done() -> list[list]:
        shas = [e[1] for e in entries]
        if len(set(shas)) < len(shas):
            raise ValueError("different texts share their hash and SHA-256")
        return [[e[0], e[1], e[2] if e[6] > 1 else None, *e[3:]] for e in entries]

    def batch(rows: list[list]) -> pa.RecordBatch:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        cols = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    for rb in steps(batches, "text"):
        out: list[list] = []
        for bucket, page, *row in zip(*(rb.column(c).to_pylist() for c in ("bucket", "page", *names))):
            if (bucket, page, row[0]) != key:
                out += done()
                key, entries = (bucket, page, row[0]), []
            same = next((e for e in entries if e[2] == row[2]), None)
            if same is None:
                entries.append(list(row))
            else:
                same[3] += row[3]
                same[4], same[5] = min((same[4], same[5]), (row[4], row[5]))
        yield batch(out)
    if entries:
        yield batch(done())


def classes(recs: DataFrame, page_bytes: int) -> DataFrame:
    """(h, sha, n, first_id, first_row) of each class of equal texts."""
    spark = recs.sparkSession
    bc = spark.sparkContext.broadcast(directory(recs, page_bytes))  # at most 2 ** MAX_DEPTH entries
    fields = "h long, sha string, text string, n long, first_id long, first_row long, pages long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            bucket = bc.value.find(rb.column("h").to_numpy(zero_copy_only=False))
            pages = bc.value.pages[bucket]
            page = rb.column("row").to_numpy(zero_copy_only=False) * 0x9E3779B1 % (1 << 31) % pages
            rest = [rb.column(c) for c in ("h", "sha", "text", "n", "first_id", "first_row")]
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(page), *rest, pa.array(pages)], [
                "bucket", "page", "h", "sha", "text", "n", "first_id", "first_row", "pages"])

    reps = recs.filter("text IS NOT NULL").mapInArrow(place, f"bucket long, page long, {fields}")
    owned = written(reps.repartition(partitions(spark), "bucket", "page").sortWithinPartitions("bucket", "page", "h")
                    .mapInArrow(chain, fields), "index")
    # pages of one bucket can hold the same text: chain their entries again
    again = owned.filter("pages > 1").select(F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("page"),
                                             "h", "sha", "text", "n", "first_id", "first_row", F.lit(1).cast("long").alias("pages")) \
        .repartition(partitions(spark), "h").sortWithinPartitions("h").mapInArrow(chain, fields)
    return owned.filter("pages = 1").unionByName(again).drop("text", "pages")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", page_bytes: int = PAGE_BYTES) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row."""
    recs = written(records(docs, id_col, text_col), "records")
    found = classes(recs, page_bytes)
    return recs.select("row", "id", "h", "sha").join(found, ["h", "sha"]).select(
        F.col("id").alias(id_col), F.nullif("first_id", F.lit(LAST_ID)).alias("keep_id"),
        F.col("n").alias("group_size"), (F.col("row") == F.col("first_row")).alias("kept"), F.col("sha").alias("text_sha256"))
