"""Benchmark decontamination with suffix arrays over the training documents.

Words: ASCII letters lower-cased, then runs of characters outside the ASCII
non-alphanumerics.  A test item's windows are its runs of ``window`` words
(an item of fewer words, but not none, is one window).  Every task takes its
documents in shards of bounded size and sorts the suffixes of a shard (word
codes, prefix doubling).  Every distinct window is then binary-searched in the
shard's suffix array: the two bounds of its range give all places where it
occurs.  Each such place is searched in the sorted test suffixes in turn: the
neighbours of its insertion point are the suffixes that share most words with
it, so they give the place's longest verbatim match, and the longest of a
document's places is the document's, with its location and item.

Suffixes that cannot match are left out of the array: a word that no test
item holds ends a run, and a run shorter than the shortest window holds no
occurrence.  Nothing is shuffled.  Test items go to the tasks in blocks of
about BLOCK_BYTES (one pass over the documents for each block); with more
than one block the hits are merged by text, so any benchmark size works.

Defined cases: null and empty texts have no words; a null text in the
benchmark is no item text; a null item_id counts as an item written ``null``.
Repeated rows give repeated results; items repeated with one id count once.
An empty benchmark contaminates nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import steps, written

BLOCK_BYTES = 8 << 20
SHARD_BYTES = 8 << 20

# lower case for A-Z, a blank for every ASCII character that is no letter or digit
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                   for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_TABLE).split() if text else []


class TestSet:
    """Test suffixes of a block of items: codes, windows and owners."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.vocab: dict[bytes, int] = {}
        code = self.vocab.setdefault
        distinct: dict[tuple, set[int]] = {}
        first: dict[tuple, int] = {}
        self.ids = sorted({i for i, _ in items})
        number = {i: n for n, i in enumerate(self.ids)}
        flat, owner = [], []  # codes of all items, a zero behind each
        for item, text in items:
            seq = [code(w, len(self.vocab) + 1) for w in words_of(text)]
            w = min(window, len(seq))
            for p in range(len(seq) - w + 1 if seq else 0):
                key = (w, *seq[p:p + w])
                distinct.setdefault(key, set()).add(number[item])
                first.setdefault(key, len(flat) + p)
            flat += [*seq, 0]
            owner += [number[item]] * (len(seq) + 1)
        self.window = np.array([k[0] for k in distinct], np.int64)
        self.owners = [np.array(sorted(v), np.int64) for v in distinct.values()]
        self.shortest = int(self.window.min()) if len(distinct) else 0
        # one place of each distinct window
        self.at = np.array([first[k] for k in distinct], np.int64)
        self.codes, self.owner = np.array(flat, np.int64), np.array(owner, np.int64)
        ends = np.flatnonzero(self.codes == 0)
        places = np.flatnonzero(self.codes)
        self.suffixes = suffix_array(self.codes, places, ends[np.searchsorted(ends, places)] if len(places) else places)


def suffix_array(codes: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Positions ``at`` (all of the runs, which end at ``stop``) sorted by suffix."""
    if not len(at):
        return at
    rank = np.zeros(len(codes) + 1, np.int64)
    rank[at] = codes[at]
    k = 1
    while True:
        second = np.where(at + k < stop, rank[np.minimum(at + k, len(codes))], 0)
        key = rank[at] * (len(codes) + int(rank.max()) + 2) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.append(0, np.cumsum(sorted_key[1:] != sorted_key[:-1])) + 1
        rank[at[order]] = new
        if new[-1] == len(at) or k > len(codes):
            return at[order]
        if not (second > 0).any():  # all have ended: equal suffixes are ties
            return at[order]
        k *= 2


def compare(codes: np.ndarray, place: np.ndarray, test: np.ndarray, start: np.ndarray,
            limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign of training suffix minus test suffix within ``limit`` words, and
    the number of words they share."""
    sign, shared = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    live, k = np.arange(len(place)), 0
    while len(live):
        live = live[limit[live] > k]
        a, b = codes[place[live] + k], test[start[live] + k]
        same = (a == b) & (a > 0)
        sign[live[~same]] = np.sign(a[~same] - b[~same])
        live = live[same]
        shared[live] += 1
        k += 1
    return sign, shared


def bound(codes: np.ndarray, sa: np.ndarray, test: np.ndarray, start: np.ndarray, limit: np.ndarray,
          upper: bool) -> np.ndarray:
    """Binary search of all test suffixes at once, on ``limit`` words each."""
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(sa), np.int64)
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return lo
        mid = (lo[live] + hi[live]) // 2
        sign, _ = compare(codes, sa[mid], test, start[live], limit[live])
        right = sign <= 0 if upper else sign < 0
        lo[live[right]] = mid[right] + 1
        hi[live[~right]] = mid[~right]


def search_shard(texts: list[str | None], test: TestSet) -> dict:
    """Hits of a shard's documents.

    n_words, hit (per word), the pairs (document, item) and the longest match
    of each document with a hit (document, word, length, item).
    """
    get, seqs, n_words = test.vocab.get, [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = words_of(t)
        n_words[i] = len(words)
        seqs += [get(w, 0) for w in words]
        seqs.append(0)  # a text's end ends a run
    seqs.append(0)
    codes = np.array(seqs, np.int64)
    offset = np.cumsum(n_words + 1) - n_words - 1
    hit = np.zeros(len(codes), np.int64)
    pairs = np.empty((0, 2), np.int64)
    longest = np.empty((0, 4), np.int64)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], codes > 0, [0]])))
    starts, stops = edges[::2], edges[1::2]
    long_enough = (stops - starts) >= max(1, test.shortest)
    starts, stops = starts[long_enough], stops[long_enough]
    n = stops - starts
    if len(test.window) and len(starts):
        at = np.arange(int(n.sum())) + np.repeat(starts - (np.cumsum(n) - n), n)
        sa = suffix_array(codes, at, np.repeat(stops, n))
        lo = bound(codes, sa, test.codes, test.at, test.window, False)
        hi = bound(codes, sa, test.codes, test.at, test.window, True)
        found = np.flatnonzero(hi > lo)
        found_pairs, found_places = [], []
        for t in found:
            places = sa[lo[t]:hi[t]]
            w = test.window[t]
            np.add.at(hit, places, 1)
            np.add.at(hit, places + w, -1)
            found_places.append(places)
            doc = np.unique(np.searchsorted(offset, places, side="right") - 1)
            own = test.owners[t]
            found_pairs.append(np.stack([np.repeat(doc, len(own)), np.tile(own, len(doc))], 1))
        if len(found):
            pairs = np.unique(np.concatenate(found_pairs), axis=0)
            spots = np.unique(np.concatenate(found_places))
            whole = np.full(len(spots), np.iinfo(np.int64).max)
            spot = bound(test.codes, test.suffixes, codes, spots, whole, False)
            best, item = np.zeros(len(spots), np.int64), np.zeros(len(spots), np.int64)
            for side in (spot - 1, spot):
                ok = np.flatnonzero((side >= 0) & (side < len(test.suffixes)))
                suffix = test.suffixes[side[ok]]
                _, shared = compare(test.codes, suffix, codes, spots[ok], whole[ok])
                better = shared > best[ok]
                best[ok[better]], item[ok[better]] = shared[better], test.owner[suffix[better]]
            doc = np.searchsorted(offset, spots, side="right") - 1
            order = np.lexsort((spots, -best, doc))  # the longest of a document, the first of these
            order = order[np.flatnonzero(np.append(True, doc[order][1:] != doc[order][:-1]))]
            longest = np.stack([doc, spots - offset[doc], best, item], 1)[order]
    covered = np.cumsum(hit) > 0
    return {"n_words": n_words, "offset": offset, "covered": covered, "pairs": pairs, "longest": longest}


def test_blocks(spark: SparkSession, benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list]:
    """Items in hashed blocks of about BLOCK_BYTES; one block is in memory."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"),
                             F.col(text_col).alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1
    block = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    for b in range(n):
        yield [(r.i, r.t) for r in items.filter(block == b).distinct().collect()]  # bounded by the block


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id",
         text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_words, n_hit, n_items, items (ids, sorted as
    strings), items_sha256, contaminated, longest (the longest run of words
    that also stands in an item: first word, length, an item; null without a
    hit)."""
    spark = docs.sparkSession
    key = docs.schema[id_col].dataType.simpleString()
    match = "array<struct<word:int,length:int,item:string>>"

    def scan(block: list, source: DataFrame) -> DataFrame:
        bc = spark.sparkContext.broadcast(block)  # bounded by BLOCK_BYTES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            test = None
            for rb in steps(batches, "_text", SHARD_BYTES):
                test = test or TestSet(bc.value, window)
                found = search_shard(rb.column("_text").to_pylist(), test)
                n = rb.num_rows
                items: list[list[str]] = [[] for _ in range(n)]
                for d, i in found["pairs"].tolist():
                    items[d].append(test.ids[i])
                best: list[list[dict]] = [[] for _ in range(n)]
                for d, w, length, i in found["longest"].tolist():
                    best[d].append({"word": w, "length": length, "item": test.ids[i]})
                spans: list[list[int]] = [[] for _ in range(n)]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], found["covered"], [False]])))
                owner = np.searchsorted(found["offset"], edge[::2], side="right") - 1
                for d, a, b in zip(owner.tolist(), edge[::2].tolist(), edge[1::2].tolist()):
                    spans[d] += [a - int(found["offset"][d]), b - int(found["offset"][d])]
                yield pa.RecordBatch.from_arrays(
                    [rb.column("_id"), rb.column("_key"), pa.array(found["n_words"], pa.int64()),
                     pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())),
                     pa.array(best, pa.list_(pa.struct([("word", pa.int32()), ("length", pa.int32()),
                                                        ("item", pa.string())])))],
                    ["_id", "_key", "n_words", "spans", "items", "longest"])

        return source.mapInArrow(run, f"_id {key}, _key string, n_words long, spans array<int>, "
                                      f"items array<string>, longest {match}")

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    blocks = test_blocks(spark, benchmark, item_col, item_text)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        found = scan(first, source.withColumn("_key", F.lit(None).cast("string")))
    else:  # hits follow from the text alone: merge the blocks' hits by text
        source = source.withColumn("_key", F.sha2("_text", 256))
        parts = [written(scan(block, source).filter("size(spans) > 0 OR size(items) > 0")
                         .dropDuplicates(["_key"]).drop("_id", "n_words"), "hits")
                 for block in chain([first, second], blocks)]
        merged = parts[0]
        for p in parts[1:]:
            merged = merged.unionByName(p)
        merged = merged.groupBy("_key").agg(F.flatten(F.collect_list("spans")).alias("spans"),
                                            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
                                            F.flatten(F.collect_list("longest")).alias("longest"))
        base = scan([], source).select("_id", "_key", "n_words")
        none = F.array().cast
        found = base.join(merged, "_key", "left").select(
            "_id", "_key", "n_words", F.coalesce("spans", none("array<int>")).alias("spans"),
            F.coalesce("items", none("array<string>")).alias("items"),
            F.coalesce("longest", none(match)).alias("longest"))
    # spans are (from, to) pairs; the union's size is summed in order
    covered = F.expr("""aggregate(
        array_sort(transform(sequence(0, size(spans) div 2 - 1), i -> struct(spans[2 * i] AS a, spans[2 * i + 1] AS b))),
        struct(0L AS n, 0 AS upto),
        (s, x) -> struct(s.n + greatest(0, x.b - greatest(x.a, s.upto)) AS n, greatest(s.upto, x.b) AS upto),
        s -> s.n)""")
    items = F.array_sort("items")
    # one match a block of items: the longest, the first of these
    longest = F.expr("""transform(slice(array_sort(transform(longest, x -> struct(-x.length AS l, x.word AS word, x.item AS item))), 1, 1),
        x -> named_struct('word', x.word, 'length', -x.l, 'item', x.item))[0]""")
    longest = F.when(F.size("longest") > 0, longest)
    return found.select(
        F.col("_id").alias(id_col), "n_words", F.when(F.size("spans") > 0, covered).otherwise(F.lit(0)).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), items.alias("items"), longest.alias("longest"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows of ``docs`` without any hit.  A pass for each block of test items
    drops the rows it hits; nothing is shuffled or joined."""
    out = docs
    for block in test_blocks(docs.sparkSession, benchmark, item_col, item_text):
        bc = docs.sparkSession.sparkContext.broadcast(block)  # bounded by BLOCK_BYTES

        def run(batches: Iterator[pa.RecordBatch], bc=bc) -> Iterator[pa.RecordBatch]:
            test = None
            for rb in steps(batches, text_col, SHARD_BYTES):
                test = test or TestSet(bc.value, window)
                found = search_shard(rb.column(text_col).to_pylist(), test)
                hit = np.zeros(rb.num_rows, bool)
                hit[np.searchsorted(found["offset"], np.flatnonzero(found["covered"]), side="right") - 1] = True
                yield rb.filter(pa.array(~hit))

        out = out.mapInArrow(run, docs.schema)
    return out
