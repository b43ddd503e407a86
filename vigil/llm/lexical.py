"""Ranked lexical search with geometric blocks in every posting list.

1. One pass over the documents counts words and keeps, of each document, the
   terms of the queries with their occurrences (the forward table, written
   once).  Statistics (documents, words, documents with a term) are sums over
   all documents.
2. A task reads the forward table in steps of CELLS impacts.  Documents of a
   step are grouped by similarity (nearest of a few pivots, by the share of
   common terms); the posting list of a term is cut along these groups into
   blocks.  A block's summary holds, for each term that some query has
   together with the block's term, the greatest impact of its documents.
3. A query walks its terms by falling weight.  A document is looked at in the
   list of its first query term only, so the bound of a block sums over that
   term and those behind it: weight * summary.  The block is skipped only if
   that bound is below the score of the query's last place so far; documents
   of the others are scored exactly, in integers.
4. A task hands on at most ``k`` rows a query; places are taken among these,
   first within salted parts and then over all.

Queries are a stated set: they go to the tasks in blocks of at most
QUERY_TERMS terms, one pass over the forward table each.

Defined cases: null and empty texts and texts without terms are no documents
(they count in no statistic and are never found).  A query without text or
without known terms has no rows; queries of one id are joined into one.  Each
row is a document, also if its id repeats; equal scores go by ascending id,
null ids last.  Empty tables give empty results; further columns aren't read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import partitions, steps, written

CELLS = 1 << 24        # impacts (documents x query terms) of one step
BLOCK = 64             # documents of one block at most
QUERY_TERMS = 1 << 15  # terms of the queries handled at one time
LAST = (1 << 63) - 1   # sorts null ids last

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def terms(text: str | None) -> list[str]:
    return _TERM.findall(text.translate(_LOWER)) if text else []


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def forward(docs: DataFrame, vocabulary: dict[str, int], id_col: str, text_col: str) -> DataFrame:
    """(_id, n, ids, tfs) of every document that holds any term; ids are those
    of the vocabulary, ascending."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for rb in steps(batches, "_text"):
            n, ids, tfs = [], [], []
            for text in rb.column("_text").to_pylist():
                words = terms(text)
                n.append(len(words))
                found = sorted((known[t], c) for t, c in Counter(words).items() if t in known)
                ids.append([i for i, _ in found])
                tfs.append([c for _, c in found])
            out = pa.RecordBatch.from_arrays(
                [rb.column("_id"), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                 pa.array(tfs, pa.list_(pa.int64()))], ["_id", "n", "ids", "tfs"])
            yield out.filter(pa.compute.greater(out.column("n"), 0))

    key = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")) \
        .mapInArrow(run, f"_id {key}, n long, ids array<int>, tfs array<long>")


class Queries:
    """A block of queries as term ids by falling weight, and for every term
    the terms that occur with it."""

    def __init__(self, ids: list[int], of: list[list[int]], weights: dict[int, int]):
        self.ids, self.weights = ids, weights
        self.of = [sorted(set(t), key=lambda x: (-weights[x], x)) for t in of]
        mates: dict[int, set[int]] = {}
        for q in self.of:
            for i, t in enumerate(q):
                mates.setdefault(t, set()).update(q[i:])
        self.used = np.array(sorted(mates), np.int64)
        column = {t: i for i, t in enumerate(self.used.tolist())}
        self.mates = {column[t]: np.array(sorted(column[x] for x in m)) for t, m in mates.items()}
        self.columns = [np.array([column[x] for x in q], np.int64) for q in self.of]
        self.w = [np.array([weights[x] for x in q], np.int64) for q in self.of]


class Index:
    """Blocked posting lists of one step of documents, in dense columns of the
    query terms: ``impact[doc, column]``."""

    def __init__(self, impact: np.ndarray, queries: Queries):
        groups = cluster(impact)
        order = np.argsort(groups, kind="stable")
        self.impact, self.order = impact[order], order  # rows now lie by group
        group = groups[order]
        self.lists, self.heads, self.summaries = {}, {}, {}
        rows, columns = np.nonzero(self.impact.T)  # by term, then by group
        cuts = np.searchsorted(rows, np.arange(impact.shape[1] + 1))
        for c, mates in queries.mates.items():
            docs = columns[cuts[c]:cuts[c + 1]]
            if not len(docs):
                continue
            # a block ends with its group; neighbouring small groups share one
            fresh = np.append(True, group[docs[1:]] != group[docs[:-1]])
            at = np.arange(len(docs))
            start = np.maximum.accumulate(np.where(fresh, at, 0))
            heads = np.flatnonzero(fresh | ((at - start) % BLOCK == 0))
            heads = merge_small(heads, len(docs))
            self.lists[c], self.heads[c] = docs, heads
            self.summaries[c] = np.maximum.reduceat(self.impact[np.ix_(docs, mates)], heads, axis=0)

    def search(self, columns: np.ndarray, w: np.ndarray, mates: dict[int, np.ndarray], k: int,
               floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of documents of at least the k-th score, ``floor``
        or above (a superset of the k best)."""
        seen = np.zeros(len(self.impact), bool)
        rows, scores, best = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.empty(0, np.int64)
        for i, c in enumerate(columns.tolist()):
            if c not in self.lists:
                continue
            at = np.searchsorted(mates[c], columns[i:])
            bound = self.summaries[c][:, at].astype(np.int64) @ w[i:]
            open_ = bound >= max(floor, 1)
            if not open_.any():
                continue
            docs = self.lists[c]
            size = np.diff(np.append(self.heads[c], len(docs)))
            docs = docs[np.repeat(open_, size)]
            docs = docs[~seen[docs]]
            seen[docs] = True
            score = self.impact[np.ix_(docs, columns[i:])].astype(np.int64) @ w[i:]
            # a document of an earlier list was scored or bounded there
            good = score >= max(floor, 1)
            if i:
                good &= ~self.impact[np.ix_(docs, columns[:i])].any(axis=1)
            docs, score = docs[good], score[good]
            rows.append(docs)
            scores.append(score)
            best = np.concatenate([best, score])
            if len(best) > k:
                best = np.partition(best, len(best) - k)[-k:]
            if len(best) >= k:
                floor = max(floor, int(best.min()))
        row, score = np.concatenate(rows), np.concatenate(scores)
        return self.order[row[score >= floor]], score[score >= floor]


def cluster(impact: np.ndarray) -> np.ndarray:
    """Group of each row: the pivot row with the greatest cosine of held terms."""
    pivots = (impact[::4 * BLOCK] > 0).astype(np.float32)
    pivots /= np.sqrt(np.maximum(pivots.sum(axis=1, keepdims=True), 1))
    return np.concatenate([np.argmax((impact[i:i + 512] > 0).astype(np.float32) @ pivots.T, axis=1)
                           for i in range(0, len(impact), 512)])


def merge_small(heads: np.ndarray, n: int) -> np.ndarray:
    """Drop block heads until blocks hold at least an eighth of BLOCK."""
    keep, last = [0], 0
    for h in heads[1:].tolist():
        if h - last >= BLOCK // 8:
            keep.append(h)
            last = h
    return np.array(keep)


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """The part of a score that depends on the document only, in integers."""
    m = 50 + (50 * n * docs) // words
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def search(documents: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text",
           query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query id, rank, document id, score) of the ``k`` best documents with a
    score above 0 of every query."""
    spark = documents.sparkSession
    schema = f"{query_id} {queries.schema[query_id].dataType.simpleString()}, rank int, " \
             f"{id_col} {documents.schema[id_col].dataType.simpleString()}, score long"
    out = spark.createDataFrame([], schema)
    asked: dict = {}
    by_id = queries.groupBy(F.col(query_id).alias("q")).agg(F.collect_list(query_text).alias("texts"))
    for r in by_id.toLocalIterator():
        if sum(map(len, asked.values())) > QUERY_TERMS:
            out = out.unionByName(_search_block(documents, asked, k, id_col, text_col, query_id, schema))
            asked = {}
        asked[r.q] = set().union(*map(terms, r.texts))
    return out.unionByName(_search_block(documents, asked, k, id_col, text_col, query_id, schema))


def _search_block(documents: DataFrame, asked: dict, k: int, id_col: str, text_col: str, query_id: str,
                  schema: str) -> DataFrame:
    spark = documents.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*asked.values())))}
    if not vocabulary:
        return spark.createDataFrame([], schema)
    table = written(forward(documents, vocabulary, id_col, text_col), "forward")
    total = table.agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
    if not total.docs:
        return spark.createDataFrame([], schema)
    # at most one row for each term of the block
    df = {r.t: r.c for r in table.select(F.explode("ids").alias("t")).groupBy("t").agg(F.count("*").alias("c")).collect()}
    weights = {i: weight(total.docs, df[i]) for i in vocabulary.values() if i in df}
    names = list(asked)
    of = [[vocabulary[t] for t in asked[q] if vocabulary[t] in weights and weights[vocabulary[t]] > 0] for q in names]
    shared = spark.sparkContext.broadcast((of, weights, total.docs, total.words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, weights, docs, words = shared.value
        queries = Queries(list(range(len(of))), of, weights)
        slot = np.full(len(vocabulary), -1, np.int64)
        slot[queries.used] = np.arange(len(queries.used))
        heaps: list[list[tuple]] = [[] for _ in queries.ids]
        for rb in _of_rows(batches, max(64, CELLS // max(1, len(queries.used)))):
            ids = rb.column("_id").to_pylist()
            lists = rb.column("ids")
            count = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(rb.num_rows), count)
            term, tf = slot[lists.flatten().to_numpy()], rb.column("tfs").flatten().to_numpy()
            n = rb.column("n").to_numpy()[row]
            ok = term >= 0
            impact = np.zeros((rb.num_rows, len(queries.used)), np.int32)
            impact[row[ok], term[ok]] = impacts(tf[ok], n[ok], docs, words)
            index = Index(impact, queries)
            for q, heap in enumerate(heaps):
                floor = heap[0][0] if len(heap) == k else 0
                for i, s in zip(*index.search(queries.columns[q], queries.w[q], queries.mates, k, floor)):
                    # the least entry leaves: lowest score, then greatest id
                    entry = (int(s), -(LAST if ids[i] is None else ids[i]))
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
        flat = [(q, s, -i) for q, heap in enumerate(heaps) for s, i in heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([q for q, _, _ in flat], pa.int32()), pa.array([s for _, s, _ in flat], pa.int64()),
             pa.array([None if i == LAST else i for _, _, i in flat], pa.int64())], ["q", "score", "_id"])

    found = table.mapInArrow(run, "q int, score long, _id long")
    order = [F.desc("score"), F.asc_nulls_last("_id")]
    salted = Window.partitionBy("q", "salt").orderBy(*order)
    places = found.withColumn("salt", F.pmod(F.xxhash64("_id", "score"), F.lit(partitions(spark)))) \
        .withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= k)
    ranked = places.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))) \
        .filter(F.col("rank") <= k)
    named = spark.createDataFrame([(i, q) for i, q in enumerate(names)], f"_q int, {schema.split(',')[0]}")
    return ranked.join(F.broadcast(named), F.col("q") == F.col("_q")) \
        .select(query_id, "rank", F.col("_id").alias(id_col), "score")


def _of_rows(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of exactly ``rows`` rows, but for the last."""
    held: list[pa.RecordBatch] = []
    size = 0
    for rb in batches:
        held.append(rb)
        size += rb.num_rows
        while size >= rows:
            t = pa.Table.from_batches(held)
            yield t.slice(0, rows).combine_chunks().to_batches()[0]
            held, size = t.slice(rows).to_batches(), size - rows
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def duckdb_sql(k: int) -> str:
    """The same rows by scoring every document that shares a term."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = rf"regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, unnest({found}) AS t FROM documents),
p AS MATERIALIZED (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL),
size AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM size),
q AS (SELECT DISTINCT item_id, unnest({found}) AS t FROM benchmark),
w AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, total GROUP BY t),
s AS (SELECT item_id, doc_id,
        sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score
      FROM q JOIN p USING (t) JOIN w USING (t) JOIN size USING (doc_id), total GROUP BY ALL HAVING score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {k}"""
