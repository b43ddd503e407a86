"""Contiguous shards of nearly equal bytes.

Rows are range-partitioned and sorted by (group, id), so equal texts lie
together.  A task adds the running sums of its partition; the totals of the
partitions, one row each, give every partition its offset, and so every row
its global byte and row position.  The line of bytes is cut at equal targets.
A cut inside a group of at most ``SNAP`` of a shard moves to the group's
nearer end; larger groups are cut where the target falls, so that one group
of copies can't unbalance the shards.

Defined cases: a null text has no bytes and counts as an equal of the empty
text.  Rows without an id come first in their group.  Repeated rows are
separate rows with slots of their own.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import partitions, wider, written

SNAP = 0.01


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the partition, the bytes and the rows before each row."""
    part, size, rows = TaskContext.get().partitionId(), 0, 0
    for rb in batches:
        n = rb.column("_size").to_numpy(zero_copy_only=False)
        before = size + np.cumsum(n) - n
        yield pa.RecordBatch.from_arrays(
            [*rb.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(before, pa.int64()),
             pa.array(np.arange(rows, rows + len(n), dtype=np.int64))],
            [*rb.schema.names, "_part", "_before", "_row"])
        size, rows = size + int(n.sum()), rows + len(n)


def positions(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """Rows in their global order: _group, _size, _crc, _start, _at (row)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("_id"), *[F.col(c).alias(f"keep_{c}") for c in keep],
        F.xxhash64(text).alias("_group"), (F.octet_length(text) + F.lit(1)).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"))
    ordered = base.repartitionByRange(partitions(docs.sparkSession), "_group", "_id", "_crc") \
        .sortWithinPartitions("_group", "_id", "_crc")
    placed = written(ordered.mapInArrow(_running, wider(base, "_part int, _before long, _row long")), "placed")
    # one row for each partition: the window's single task is bounded by their number
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(F.sum("_size").alias("s"), F.count("*").alias("n")) \
        .select("_part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_s"),
                F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"))
    return placed.join(F.broadcast(totals), "_part") \
        .withColumns({"_start": F.col("_before") + F.col("_s"), "_at": F.col("_row") + F.col("_n")}) \
        .drop("_part", "_before", "_row", "_s", "_n")


def cuts(rows: DataFrame, shards: int) -> list[int]:
    """Start bytes of shards 1 to shards - 1 (as many numbers on the driver)."""
    total = rows.agg(F.sum("_size")).first()[0] or 0
    if not total:
        return []
    want = [total * k // shards for k in range(1, shards)]
    # the rows that hold a target, one for each, and the extent of their groups
    holds = F.expr(f"(_start + _size) * {shards} div {total} > _start * {shards} div {total}")
    groups = [r[0] for r in rows.filter(holds).select("_group").distinct().collect()]
    extents = rows.filter(F.col("_group").isin(groups)).groupBy("_group") \
        .agg(F.min("_start").alias("a"), F.max(F.col("_start") + F.col("_size")).alias("b")).collect()
    out = []
    for c in want:
        edges = [(r.a, r.b) for r in extents if r.a < c < r.b and r.b - r.a <= SNAP * total / shards]
        out.append(min(edges[0], key=lambda e: (abs(e - c), e)) if edges else c)
    return out


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row, and
    the columns in ``keep``."""
    keep = keep or []
    rows = positions(docs, id_col, text_col, keep)
    at = np.array(cuts(rows, shards), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            s = np.searchsorted(at, rb.column("_start").to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(s.astype(np.int32))], [*rb.schema.names, "_shard"])

    cut = rows.mapInArrow(run, wider(rows, "_shard int"))
    firsts = cut.groupBy("_shard").agg(F.min("_at").alias("_first"))
    return cut.join(F.broadcast(firsts), "_shard").select(  # one row for each shard
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), (F.col("_at") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), *[F.col(f"keep_{c}").alias(c) for c in keep])


def write_shards(docs: DataFrame, shards: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows of ``docs`` as Parquet, one folder for each shard."""
    rest = [c for c in docs.columns if c != id_col]
    clash = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    shard(docs, shards, id_col, text_col, [c for c in rest if c not in clash]).write.partitionBy("shard").parquet(path)
