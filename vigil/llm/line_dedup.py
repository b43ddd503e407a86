"""Line dedup by pairwise alignment.

A line's key is a 128-bit hash of its text (outer blanks dropped) and of its
occurrence number inside its document, so that every key is unique in a
document.  A pair of documents is aligned as patience diff does: all shared
unique lines, in the order of the later document, and of these the longest
sequence that also rises in the earlier one.  Neighbouring aligned lines form
a block; blocks of at least ``min_words`` words are deleted from the later
document.

With ``all_pairs`` the texts are those of an alignment of every document with
every earlier one.  Only pairs that share a run of ``min_words`` words can lose
lines, and every line of such a run lies in one of its shortest parts of that
many words (``windows``).  So a document is aligned with the earliest holder of
each of its windows; where a window isn't deleted by then, since it crosses a
longer passage, its other earlier holders follow, twice as many each round,
until it is deleted or has no earlier holder left.  No window's frequency is
limited.  ``partners`` names the earlier documents of the pairs aligned.
Without ``all_pairs`` each line is aligned with its earliest holder only, and
passages whose lines have different earliest holders can stay.

Earliest holders come from a pre-aggregated minimum; the joins on keys are
left to skew-join splitting; a task aligns one document's rows at a time.
The earliest holder of a block never loses it.

Defined cases: documents are in the order of their ids, rows without an id
last, ties by a hash of the row.  Equal rows are one document and get equal
results.  A null text stays null; a text whose lines all go becomes ``""``.
Blank lines are never deleted and don't break a block.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import partitions, steps, written

MIN_WORDS = 10
LAST_ID = (1 << 63) - 1


def windows(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """(first, last) of the runs of lines that hold ``min_words`` words and would
    not without their last line (forward) or without their first (backward).
    Every line of a longer run lies in such a run inside it."""
    out, first, total = set(), 0, 0
    for last, n in enumerate(words):  # the latest start of a run that ends here
        total += n
        while first < last and total - words[first] >= min_words:
            total -= words[first]
            first += 1
        if total >= min_words:
            out.add((first, last))
    last, total = -1, 0
    for first, n in enumerate(words):  # the earliest end of a run that starts here
        while total < min_words and last + 1 < len(words):
            last += 1
            total += words[last]
        if total < min_words:
            break
        out.add((first, last))
        total -= n
    return sorted(out)


def lines_of(keyed: DataFrame, min_words: int | None) -> DataFrame:
    """(did, dkey, pos, seq, h1, h2, words, wins) of every line that isn't
    blank: pos counts all lines, seq only these; wins are the (hash, last) of
    the ``windows`` that begin with the line, none without ``min_words``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for rb in steps(batches, "_text"):
            owner, pos, seq, words, keys = [], [], [], [], []
            offs, whash, wlast = [0], [], []
            for d, text in enumerate(rb.column("_text").to_pylist()):
                seen: dict[bytes, int] = {}
                n, start = 0, len(keys)
                for p, line in enumerate(text.encode().split(b"\n") if text else ()):
                    line = line.strip()
                    if not line:
                        continue
                    key = digest(line)
                    again = seen.get(key, 0)
                    seen[key] = again + 1
                    keys.append(digest(key + again.to_bytes(8, "little")) if again else key)
                    owner.append(d)
                    pos.append(p)
                    seq.append(n)
                    words.append(len(line.split()))
                    n += 1
                own = keys[start:]
                at = 0
                for first, last in windows(words[start:], min_words) if min_words is not None else ():
                    offs.extend([len(whash)] * (first - at))
                    at = first
                    whash.append(own[first][:8] if first == last else digest(b"".join(own[first:last + 1]))[:8])
                    wlast.append(last)
                offs.extend([len(whash)] * (n - at))
            h = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            at = pa.array(owner, pa.int64())
            wins = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(np.frombuffer(b"".join(whash), np.int64)), pa.array(wlast, pa.int32())], ["w", "last"]))
            yield pa.RecordBatch.from_arrays(
                [rb.column("_did").take(at), rb.column("_dkey").take(at), pa.array(pos, pa.int32()),
                 pa.array(seq, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(words, pa.int32()), wins],
                ["did", "dkey", "pos", "seq", "h1", "h2", "words", "wins"])

    return keyed.mapInArrow(run, "did long, dkey long, pos int, seq int, h1 long, h2 long, words int, "
                                 "wins array<struct<w:long,last:int>>")


def rising(values: list[int]) -> list[int]:
    """Indexes of a longest strictly rising subsequence (patience piles)."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def common_blocks(pairs: list[tuple[int, int, int, int]], min_words: int) -> set[int]:
    """Lines (pos) to delete from the later document of one aligned pair.

    ``pairs``: (seq in the later, seq in the earlier, pos in the later, words).
    """
    pairs = sorted(set(pairs))
    kept = [pairs[i] for i in rising([p[1] for p in pairs])]
    gone: set[int] = set()
    block: list[tuple[int, int, int, int]] = []
    for p in [*kept, None]:
        if block and (p is None or p[0] != block[-1][0] + 1 or p[1] != block[-1][1] + 1):
            if sum(x[3] for x in block) >= min_words:
                gone.update(x[2] for x in block)
            block = []
        if p:
            block.append(p)
    return gone


def aligned(matches: DataFrame, min_words: int) -> DataFrame:
    """One row for each later document that loses lines: these lines (pos, seq,
    words) and the partners."""
    schema = "did long, dkey long, gone array<struct<pos:int,seq:int,words:int>>, partners array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(doc: tuple, rows: list[tuple]) -> dict | None:
            gone: set[int] = set()
            partners, lines = set(), {r[4]: (r[2], r[5]) for r in rows}
            start = 0
            for i in range(1, len(rows) + 1):  # rows are sorted by the earlier document
                if i == len(rows) or rows[i][:2] != rows[start][:2]:
                    lost = common_blocks([(r[2], r[3], r[4], r[5]) for r in rows[start:i]], min_words)
                    if lost:
                        gone |= lost
                        partners.add(rows[start][0])
                    start = i
            if not gone:
                return None
            return {"did": doc[0], "dkey": doc[1], "partners": sorted(partners),
                    "gone": [{"pos": p, "seq": lines[p][0], "words": lines[p][1]} for p in sorted(gone)]}

        arrow = pa.schema([("did", pa.int64()), ("dkey", pa.int64()),
                           ("gone", pa.list_(pa.struct([("pos", pa.int32()), ("seq", pa.int32()), ("words", pa.int32())]))),
                           ("partners", pa.list_(pa.int64()))])
        doc, rows = None, []
        for rb in batches:  # sorted by document
            out = []
            for did, dkey, *row in zip(*(rb.column(c).to_pylist() for c in (
                    "did", "dkey", "a_did", "a_dkey", "seq", "a_seq", "pos", "words"))):
                if (did, dkey) != doc:
                    out.append(result(doc, rows) if rows else None)
                    doc, rows = (did, dkey), []
                rows.append(tuple(row))
            yield pa.RecordBatch.from_pylist([x for x in out if x], arrow)
        if rows and (x := result(doc, rows)):
            yield pa.RecordBatch.from_pylist([x], arrow)

    cols = ["did", "dkey", "a_did", "a_dkey", "seq", "a_seq", "pos", "words"]
    return matches.select(*cols).repartition(partitions(matches.sparkSession), "did", "dkey") \
        .sortWithinPartitions("did", "dkey", "a_did", "a_dkey").mapInArrow(run, schema)


def by_holders_of_lines(lines: DataFrame, min_words: int) -> DataFrame:
    """Lines lost when a document is aligned, on each line, with the earliest
    holder of that line only."""
    # written, so that the join below has plain shuffles on both sides, which
    # Spark can split where a line is held by a large part of the documents
    first = lines.groupBy("h1", "h2").agg(F.min(F.struct("did", "dkey", "seq")).alias("a"), F.count("*").alias("n")) \
        .filter("n > 1").select("h1", "h2", F.col("a.did").alias("a_did"), F.col("a.dkey").alias("a_dkey"),
                                F.col("a.seq").alias("a_seq"))
    first = written(first, "holders")
    matches = lines.join(first, ["h1", "h2"]).filter("did <> a_did OR dkey <> a_dkey")
    return written(aligned(matches, min_words), "aligned")


def aligned_pairs(lines: DataFrame, pairs: DataFrame, min_words: int) -> DataFrame:
    """``aligned`` on all lines that the two documents of each pair share."""
    later = pairs.join(lines.drop("wins"), ["did", "dkey"])
    earlier = lines.select(F.col("did").alias("a_did"), F.col("dkey").alias("a_dkey"), "h1", "h2", "seq") \
        .join(pairs.select("a_did", "a_dkey").distinct(), ["a_did", "a_dkey"], "left_semi") \
        .groupBy("a_did", "a_dkey", "h1", "h2").agg(F.min("seq").alias("a_seq"))  # repeated rows are one document
    return aligned(later.join(written(earlier, "earlier"), ["a_did", "a_dkey", "h1", "h2"]), min_words)


def by_all_pairs(lines: DataFrame, min_words: int) -> DataFrame:
    """Lines lost when a document is aligned with every earlier document."""
    wins = lines.select("did", "dkey", "seq", F.explode("wins").alias("x")) \
        .select("did", "dkey", "seq", F.col("x.last").alias("last"), F.col("x.w").alias("w"))
    first = wins.groupBy("w").agg(F.min(F.struct("did", "dkey")).alias("a"), F.count("*").alias("n")) \
        .filter("n > 1").select("w", F.col("a.did").alias("a_did"), F.col("a.dkey").alias("a_dkey"))
    hits = written(wins.join(written(first, "holders"), "w").filter("did <> a_did OR dkey <> a_dkey"), "hits")
    pairs = written(hits.select("did", "dkey", "a_did", "a_dkey").distinct(), "pairs")
    lost = written(aligned_pairs(lines, pairs, min_words), "aligned")
    left, tried, ranked = hits.drop("a_did", "a_dkey"), 1, None
    while True:
        at = lost.select("did", "dkey", F.col("gone.seq").alias("_gone"))
        left = left.join(at, ["did", "dkey"], "left").filter(
            "_gone IS NULL OR size(array_except(sequence(seq, last), _gone)) > 0").drop("_gone")
        if ranked is None:
            left = written(left.distinct(), "left")
            holders = wins.join(left.select("w").distinct(), "w", "left_semi").select("w", "did", "dkey").distinct()
            ranked = written(holders.withColumn("rank", F.row_number().over(
                Window.partitionBy("w").orderBy("did", "dkey")) - 1), "ranked")
            left = left.join(ranked, ["w", "did", "dkey"])
        left = written(left.filter(F.col("rank") > tried), "left")
        if left.isEmpty():
            return lost
        more = ranked.filter((F.col("rank") >= tried) & (F.col("rank") < 2 * tried)).select(
            "w", F.col("did").alias("a_did"), F.col("dkey").alias("a_dkey"), F.col("rank").alias("a_rank"))
        pairs = written(left.join(more, "w").filter("a_rank < rank").select("did", "dkey", "a_did", "a_dkey").distinct(), "pairs")
        lost = written(lost.unionByName(aligned_pairs(lines, pairs, min_words)).groupBy("did", "dkey").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("partners")))).alias("partners")), "aligned")
        tried *= 2


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_words: int = MIN_WORDS, all_pairs: bool = False) -> DataFrame:
    """``docs`` with the text cleaned and n_lines, n_removed, words_removed,
    partners (ids of the earlier documents) added; columns of these names are
    replaced.  ``all_pairs`` aligns every pair of documents that can lose
    lines; without it a line is aligned with its earliest holder only."""
    added = ["n_lines", "n_removed", "words_removed", "partners"]
    base = docs.drop(*added)
    did = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    dkey = F.xxhash64(F.lit(11), id_col, text_col)
    lines = written(lines_of(base.select(did.alias("_did"), dkey.alias("_dkey"), F.col(text_col).alias("_text")),
                             min_words if all_pairs else None), "lines")
    lost = by_all_pairs(lines, min_words) if all_pairs else by_holders_of_lines(lines, min_words)
    cuts = F.col("gone.pos")
    lost = lost.select("did", "dkey", "partners", F.size("gone").alias("n_removed"),
                       F.aggregate("gone", F.lit(0), lambda n, x: n + x["words"]).alias("words_removed"),
                       F.concat(F.array(F.lit(-1)), cuts).alias("after"), F.concat(cuts, F.array(F.lit(1 << 30))).alias("until"))
    lost = lost.select(*[F.col(c).alias(f"_lost_{c}") for c in lost.columns])
    keyed = base.withColumns({"_row_did": did, "_row_dkey": dkey})
    joined = keyed.join(lost, (F.col("_row_did") == F.col("_lost_did")) & (F.col("_row_dkey") == F.col("_lost_dkey")), "left")
    split = F.split(F.col(text_col), "\n", -1)
    runs = F.zip_with("_lost_after", "_lost_until", lambda a, b: F.slice(split, a + 2, b - a - 1))
    clean = F.array_join(F.flatten(runs), "\n")
    lines_n = F.when(F.length(text_col) > 0, F.size(split)).otherwise(0).cast("long")
    out = joined.select(
        *[c for c in base.columns if c != text_col],
        F.when(F.col("_lost_after").isNull(), F.col(text_col)).otherwise(clean).alias(text_col),
        lines_n.alias("n_lines"), F.coalesce("_lost_n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("_lost_words_removed", F.lit(0)).cast("long").alias("words_removed"),
        F.coalesce("_lost_partners", F.array().cast("array<long>")).alias("partners"))
    return out.select(*base.columns, *added)
