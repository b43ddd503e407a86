"""Skew-proof running computations per key ("prefix scans").

A window ``partitionBy(key).orderBy(...)`` sends every row of a key to one
task; a key holding a third of all rows would then run in one task.  Instead:

1. ``sequence_within`` range-partitions on ``(key, *order)``.  The sort key is
   unique, so Spark's sampled range bounds cut even a hot key into balanced
   chunks.  ``monotonically_increasing_id`` after the local sort gives a
   global position ``_gid`` that is monotone in ``(key, *order)``; its upper
   bits are the chunk (partition) index.  The result is written once to the
   shared folder, so positions are stable, lineage is cut, and each of the
   passes below reads only its columns.
2. Per ``(key, chunk)`` summaries are small (one row per key per chunk) and
   are turned into carries from earlier chunks with a window over the summary
   table, whose partitions hold at most ``#chunks`` rows per key.
3. Row-level values are in-chunk windows (partitioned by ``(key, chunk)``,
   bounded by the chunk size) plus the carry joined on ``(key, chunk)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.session import write_once

GID = "_gid"
CHUNK = "_chunk"
UNB = Window.unboundedPreceding
CHUNK_ROWS = 1 << 16  # rows of a chunk, about: the chunks grow in number, not in size


def _chunks(rows: DataFrame) -> int:
    """Chunks for the rows of a written frame (counted from the files' footers)."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // CHUNK_ROWS))


def by_chunk(seq: DataFrame, key: str, carries: DataFrame, counted: dict[str, str] | None = None) -> DataFrame:
    """Rows of a sequenced frame joined to the carries of their (key, chunk).
    The number of partitions is given on both sides, so that it grows with the
    rows and small partitions aren't merged into large tasks.  The carries (at
    most one a row of the chunk) are the hashed side, so rows aren't sorted for
    the join.  With ``counted`` (prefix to column) rows get ``_<prefix>_c``,
    the count of their value so far in the chunk; these sorts come before the
    rows have the columns of the carries."""
    n = _chunks(seq)
    rows = seq.repartition(n, key, CHUNK)
    for p, c in (counted or {}).items():
        rows = with_value_counts(rows, c, p, key)
    return rows.join(carries.repartition(n, key, CHUNK).hint("shuffle_hash"), [key, CHUNK])


def sequence_within(df: DataFrame, key: str, order: list[str], num_chunks: int | None = None,
                    checkpoint: bool = True) -> DataFrame:
    """Tag rows with ``_gid`` (global position, monotone in key+order) and ``_chunk``."""
    if num_chunks is None:
        # counted, sampled for the bounds and then sorted; a task that deals the
        # rows out holds those it reads, which are few files of a chunk's rows
        df = write_once(df, "unordered", CHUNK_ROWS)
    n = num_chunks or _chunks(df)
    out = (df.repartitionByRange(n, key, *order)
             .sortWithinPartitions(key, *order)
             .withColumn(GID, F.monotonically_increasing_id()))
    out = out.withColumn(CHUNK, F.shiftright(F.col(GID), 33).cast("int"))
    return write_once(out, "sequenced") if checkpoint else out


def chunk_prefix(seq: DataFrame, key: str, sums: dict[str, str]) -> DataFrame:
    """Per (key, chunk): totals of earlier chunks (``<name>_before``) and the
    running total at the end of the chunk (``<name>_end``).  ``sums`` maps an
    output name to a column to add up; ``'*'`` counts rows."""
    aggs = [(F.count(F.lit(1)) if c == "*" else F.sum(c)).alias(name) for name, c in sums.items()]
    per = seq.groupBy(key, CHUNK).agg(*aggs)
    w = Window.partitionBy(key).orderBy(CHUNK).rowsBetween(UNB, -1)
    cols = [key, CHUNK]
    for name in sums:
        before = F.coalesce(F.sum(name).over(w), F.lit(0)).cast("long")
        cols += [before.alias(f"{name}_before"), (before + F.col(name)).alias(f"{name}_end")]
    return per.select(*cols)


def running_mode_carry(seq: DataFrame, key: str, attrs: dict[str, str], known: DataFrame | None = None) -> DataFrame:
    """Carries for running modes of several attributes per key, ties to the
    first-seen value, in one pipeline (attributes are stacked as rows).

    ``attrs`` maps a prefix to a string column.  For each (key, chunk) and
    prefix: ``<prefix>_carry`` maps every value present in the chunk to
    (count in earlier chunks, first-seen position) and ``<prefix>_prev`` is
    the best (count, -first_seen, value) over all earlier chunks.  A map holds
    at most the distinct values of the attribute in one chunk of one key
    (bounded by the attribute's domain, e.g. countries or device kinds).

    ``known`` (key, attr, value, count, first) are counts from before the rows
    of ``seq``; ``first`` orders the values by their first appearance.
    """
    stacked = seq.select(key, CHUNK, GID, F.explode(F.array(*[
        F.struct(F.lit(p).alias("a"), F.col(c).alias("v")) for p, c in attrs.items()])).alias("_av")) \
        .select(key, CHUNK, GID, F.col("_av.a").alias("_a"), F.col("_av.v").alias("_v"))
    per = stacked.groupBy(key, CHUNK, "_a", "_v").agg(F.count(F.lit(1)).alias("_nv"), F.min(GID).alias("_first"))
    if known is not None:  # as a chunk before all others, whose values were seen before
        per = per.unionByName(known.select(key, F.lit(-1).alias(CHUNK), F.col("attr").alias("_a"), F.col("value").alias("_v"),
                                           F.col("count").alias("_nv"), (F.col("first") - F.lit(1 << 62)).alias("_first")))
    wv = Window.partitionBy(key, "_a", "_v")
    per = (per.withColumn("_cum", F.sum("_nv").over(wv.orderBy(CHUNK).rowsBetween(UNB, 0)))
              .withColumn("_fs", F.min("_first").over(wv)))
    best = F.struct(F.col("_cum").alias("c"), (-F.col("_fs")).alias("nfs"), F.col("_v").alias("v"))
    entry = F.struct(F.col("_v"), F.struct((F.col("_cum") - F.col("_nv")).alias("before"),
                                          F.col("_fs").alias("fs")))
    chunks = per.groupBy(key, CHUNK, "_a").agg(F.max(best).alias("_cmax"),
                                               F.map_from_entries(F.collect_list(entry)).alias("_carry"))
    wprev = Window.partitionBy(key, "_a").orderBy(CHUNK).rowsBetween(UNB, -1)
    chunks = chunks.withColumn("_prev", F.max("_cmax").over(wprev))
    outs = []
    for p in attrs:
        sel = F.col("_a") == p
        outs += [F.first(F.when(sel, F.col("_carry")), ignorenulls=True).alias(f"{p}_carry"),
                 F.first(F.when(sel, F.col("_prev")), ignorenulls=True).alias(f"{p}_prev")]
    return chunks.groupBy(key, CHUNK).agg(*outs)


def with_carries(seq: DataFrame, carries: DataFrame, key: str, attrs: dict[str, str]) -> DataFrame:
    """Rows with the carries of their (key, chunk); of a carry map a row keeps
    only its own value's entry: its count so far for the key (``_<prefix>_c``)
    and first position (``_<prefix>_fs``)."""
    rows = by_chunk(seq, key, carries, attrs)
    own = {p: F.col(f"{p}_carry")[F.col(c)] for p, c in attrs.items()}
    rows = rows.withColumns({f"_{p}_c": own[p]["before"] + F.col(f"_{p}_c") for p in attrs}
                            | {f"_{p}_fs": own[p]["fs"] for p in attrs})
    return rows.drop(*[f"{p}_carry" for p in attrs])


def with_value_counts(df: DataFrame, attr: str, prefix: str, key: str) -> DataFrame:
    """Occurrences of the row's value so far in its (key, chunk)."""
    return df.withColumn(f"_{prefix}_c", F.row_number().over(Window.partitionBy(key, CHUNK, attr).orderBy(GID)))


def running_mode(run: Window, attr: str, prefix: str) -> Column:
    """Running mode: the carry from earlier chunks combined with an in-chunk
    running max of (count so far, -first_seen, value); ``run`` is the
    (key, chunk) window ordered by position, unbounded preceding to current."""
    cand = F.struct(F.col(f"_{prefix}_c").alias("c"), (-F.col(f"_{prefix}_fs")).alias("nfs"), F.col(attr).alias("v"))
    return F.greatest(F.col(f"{prefix}_prev"), F.max(cand).over(run))["v"]


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """1-based position of each row in a total order, without a single-partition
    window: range-sort, tag partitions, and add the row counts of earlier
    partitions.  The offsets table has one row per partition (a bound fixed by
    the partition count), so it is broadcast."""
    tagged = write_once(df.orderBy(*order).withColumn(GID, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(F.col(GID), 33)
    counts = tagged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_cnt"), F.min(GID).alias("_g0"))
    offsets = counts.select("_p", "_g0", (F.sum("_cnt").over(Window.orderBy("_p").rowsBetween(UNB, -1)))
                            .alias("_off"))
    out = tagged.join(F.broadcast(offsets), part == F.col("_p"))
    rank = F.coalesce(F.col("_off"), F.lit(0)) + (F.col(GID) - F.col("_g0")) + 1
    return out.withColumn(name, rank.cast("long")).drop(GID, "_p", "_g0", "_off")


def sample_by_outcome(df: DataFrame, every: dict[str, int], order: list, outcome: str = "outcome") -> DataFrame:
    """Of all rows in arrival order, those whose number is a multiple of
    their outcome's step (1: all rows of it; outcomes not named: none)."""
    ranked = global_rank(df, order, "total")
    keep = F.lit(False)
    for name, step in every.items():
        keep = keep | ((F.col(outcome) == name) & (F.col("total") % step == 0))
    return ranked.filter(keep)


def periodic_totals(df: DataFrame, flags: dict[str, Column], order: list, every: int = 50) -> DataFrame:
    """Running totals of all rows in arrival order, at every ``every``-th
    one: ``total`` and a running count for each flag."""
    base = df.select(*order, F.lit(0).alias("_all"), *[c.cast("long").alias(f"_f_{k}") for k, c in flags.items()])
    seq = sequence_within(base, "_all", order)
    pre = chunk_prefix(seq, "_all", {"total": "*", **{k: f"_f_{k}" for k in flags}})
    w = Window.partitionBy("_all", CHUNK).orderBy(GID)
    run = w.rowsBetween(UNB, 0)
    out = by_chunk(seq, "_all", pre).select(
        *order, (F.col("total_before") + F.row_number().over(w)).alias("total"),
        *[(F.col(f"{k}_before") + F.sum(f"_f_{k}").over(run)).alias(k) for k in flags])
    return out.filter(F.col("total") % every == 0)
