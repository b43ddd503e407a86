"""Prefix trie of conversations by ternary search trees over range shards.

1. Turns (role, text) are dictionary-encoded: distinct pairs in sorted order
   get ascending ids, so that ids sort like the turns.
2. Each conversation becomes the list of its turn ids; equal lists become one
   row with the number of their conversations and the smallest of them.
3. Lists are range-partitioned and sorted.  A task cuts its rows into runs of
   at most RUN turns.  A run's lists go into a ternary search tree, the middle
   list first, then the middles of both halves, so that every level of the
   tree is balanced; an iterative traversal gives each trie node its members,
   leaves and savings.
4. Only prefixes of a run's first and last list can occur in other runs.  Their
   partial sums are added by key (128-bit digest of the prefix); what
   neighbouring runs both counted for their common prefix is taken off, once
   for each pair of neighbours.

The digest of the ids of conversations that end at a node is taken from a
sorted stream: tasks format pieces of the ids, and one pass over the pieces of
a node hashes them, holding one piece at a time.

Defined cases: null role and text are empty; turns go by turn (null first),
equal ones by role and text.  Rows without a conversation id belong to no
conversation and count nowhere.  Repeated rows are turns of their own.  An
empty table has no root and gives an empty result; further columns aren't read.
A conversation's turn ids (16 bytes a turn) are one row of one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import partitions, written

RUN = 1 << 17     # turns in the lists of one tree
PIECE = 1 << 16   # bytes of formatted ids hashed at a time
EMPTY = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"

NODE = "key binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, " \
       "n_leaves long, saved_tokens long, ends_sha256 string, inner boolean"
ENDS = "run long, first array<long>, last array<long>, last_words array<long>"
NODE_NAMES = [c.split()[0] for c in NODE.split(", ")]
SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]


def encode(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, id, words) of rows (conv_id, turn, role, text)."""
    dictionary = written(
        turns.select("role", "text").distinct().sort("role", "text")
        .select(F.col("role").alias("_role"), F.col("text").alias("_text"), F.monotonically_increasing_id().alias("id"),
                F.size(F.regexp_extract_all("text", F.lit(WORD), 0)).cast("long").alias("words")), "turns")
    return turns.join(dictionary, (F.col("role") == F.col("_role")) & (F.col("text") == F.col("_text"))) \
        .select("conv_id", "turn", "id", "words")


def lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): ids and words of each conversation in order."""
    rows = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return encode(rows).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "words"))).alias("t")) \
        .select("conv_id", F.expr("transform(t, x -> struct(x.id AS id, x.words AS words))").alias("turns"))


def rebuild(seqs: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Conversations whose first turns are those of the one their id, rounded
    to a multiple of ``every``, names; crc32(id) % ``heads`` of them."""
    own = seqs.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")) \
        .withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    base = seqs.filter(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("_base"), F.slice("turns", 1, heads).alias("_head"))
    none = F.expr("slice(turns, 1, 0)")
    return own.join(base, F.col("base") == F.col("_base"), "left").select("conv_id", F.concat(
        F.expr("slice(coalesce(_head, slice(turns, 1, 0)), 1, h)"),
        F.when(F.size("turns") > F.col("h"), F.expr("slice(turns, h + 1, size(turns))")).otherwise(none)).alias("turns"))


class TernaryTree:
    """Ternary search tree over lists of ids in flat columns.

    Cell i holds one id; ``low`` and ``high`` lead to smaller and greater ids
    at the same depth, ``equal`` to the next depth.
    """

    def __init__(self):
        self.id, self.low, self.equal, self.high, self.depth, self.parent, self.words = [], [], [], [], [], [], []
        self.top = -1

    def _cell(self, value: int, depth: int, parent: int, words: int) -> int:
        for column, x in ((self.id, value), (self.low, -1), (self.equal, -1), (self.high, -1),
                          (self.depth, depth), (self.parent, parent), (self.words, words)):
            column.append(x)
        return len(self.id) - 1

    def insert(self, ids: list[int], words: list[int]) -> int:
        """Cell of the last id of a list (-1: the root)."""
        above, place = -1, self.top  # cell of the last id found, cell looked at
        side, hang = None, -1        # link to the cell looked at: column and cell
        for depth, value in enumerate(ids, 1):
            while place >= 0 and self.id[place] != value:
                side, hang = (self.low, place) if value < self.id[place] else (self.high, place)
                place = side[place]
            if place < 0:
                place = self._cell(value, depth, above, words[depth - 1])
                if side is None:
                    self.top = place
                else:
                    side[hang] = place
            above, side, hang = place, self.equal, place
            place = self.equal[place]
        return above

    def preorder(self) -> list[int]:
        """Cells by list order, a prefix before its continuations."""
        out, stack = [], [(self.top, False)] if self.top >= 0 else []
        while stack:
            cell, ready = stack.pop()
            if ready:
                out.append(cell)
                continue
            for nxt, flag in ((self.high[cell], False), (self.equal[cell], False), (cell, True), (self.low[cell], False)):
                if nxt >= 0:
                    stack.append((nxt, flag))
        return out


def balanced(n: int) -> Iterator[int]:
    """Positions of a sorted range, the middle before both halves."""
    spans = [(0, n)]
    while spans:
        lo, hi = spans.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            spans += [(mid + 1, hi), (lo, mid)]


def digest(ids: list[int]) -> list[bytes]:
    """Keys of all prefixes of a list, the empty one first."""
    out = [hashlib.md5(b"root").digest()]
    for x in ids:
        out.append(hashlib.md5(out[-1] + x.to_bytes(8, "little", signed=True)).digest())
    return out


def run_nodes(ids: list[list[int]], words: list[list[int]], count: list[int], least: list[int],
              ends: list[str]) -> pa.RecordBatch:
    """NODE rows for the lists of one run (sorted, distinct)."""
    tree = TernaryTree()
    at = [0] * len(ids)
    for i in balanced(len(ids)):
        at[i] = tree.insert(ids[i], words[i])
    order = np.array(tree.preorder(), np.int64)
    n = len(order)
    rank = np.zeros(n + 1, np.int64)  # cell -1 is the root, of rank 0
    rank[order] = np.arange(1, n + 1)
    parent, depth, tokens = (np.zeros(n + 1, np.int64) for _ in range(3))
    parent[1:] = rank[np.array(tree.parent, np.int64)[order]]
    depth[1:] = np.array(tree.depth, np.int64)[order]
    tokens[1:] = np.array(tree.words, np.int64)[order]
    convs, low = np.zeros(n + 1, np.int64), np.full(n + 1, np.iinfo(np.int64).max)
    of_end = [None] * (n + 1)
    for i, cell in enumerate(at):
        r = int(rank[cell])
        convs[r], low[r], of_end[r] = count[i], least[i], ends[i]
    children, leaves = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    saved = np.zeros(n + 1, np.int64)
    for r in range(n, -1, -1):  # continuations before their prefix
        leaves[r] += children[r] == 0
        saved[r] += (convs[r] - 1) * tokens[r]
        if r:
            p = parent[r]
            convs[p] += convs[r]
            low[p] = min(low[p], low[r])
            children[p] += 1
            leaves[p] += leaves[r]
            saved[p] += saved[r]
    keys: dict[int, bytes] = {}
    for i in {0, len(ids) - 1}:
        cells, place = [], at[i]
        while place >= 0:
            cells.append(place)
            place = tree.parent[place]
        for r, k in zip([0, *(int(rank[c]) for c in reversed(cells))], digest(ids[i])):
            keys[r] = k
    edge = [r in keys for r in range(n + 1)]
    top = [r == 0 or edge[p] for r, p in enumerate(parent.tolist())]
    columns = [
        pa.array([keys.get(r) for r in range(n + 1)], pa.binary()),
        pa.array([keys[p] if r and edge[p] else None for r, p in enumerate(parent.tolist())], pa.binary()),
        pa.array(depth), pa.array(low), pa.array(low[parent], mask=np.array(top)), pa.array(convs), pa.array(children),
        pa.array(leaves), pa.array(saved), pa.array(of_end, pa.string()), pa.array([not e for e in edge])]
    return pa.RecordBatch.from_arrays(columns, NODE_NAMES)


def _runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[dict[str, list]]:
    """Rows of a sorted partition in runs of about ``limit`` turns."""
    held: dict[str, list] = {}
    load = 0
    for rb in batches:
        for row in zip(*(rb.column(c).to_pylist() for c in ("ids", "words", "n", "low", "ends"))):
            for name, value in zip(("ids", "words", "count", "least", "ends"), row):
                held.setdefault(name, []).append(value)
            load += len(row[0]) + 1
            if load >= limit:
                yield held
                held, load = {}, 0
    if held:
        yield held


def end_digests(rows: DataFrame) -> DataFrame:
    """(k1, k2, ends): SHA-256 of the ascending conv_ids of each key."""
    spark = rows.sparkSession

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rb in batches:
            k1, k2, conv = (rb.column(c).to_numpy() for c in ("k1", "k2", "conv_id"))
            heads = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))) if len(k1) else []
            for lo, hi in zip(heads, [*heads[1:], len(k1)]):
                for a in range(lo, hi, PIECE // 20):
                    part = conv[a:min(hi, a + PIECE // 20)]
                    out.append((k1[lo], k2[lo], part[0], ",".join(map(str, part.tolist())).encode()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(
                (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["k1", "k2", "first", "part"])
            out = []

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for rb in batches:
            done = []
            for a, b, part in zip(*(rb.column(c).to_pylist() for c in ("k1", "k2", "part"))):
                if (a, b) != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = (a, b), hashlib.sha256(part)
                else:
                    state.update(b"," + part)
            yield _ends(done)
        if now is not None:
            yield _ends([(*now, state.hexdigest())])

    def _ends(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(
            (pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "ends"])

    order = ["k1", "k2", "conv_id"]
    cut = rows.select(*order).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order) \
        .mapInArrow(pieces, "k1 long, k2 long, first long, part binary")
    return cut.repartition(partitions(spark), "k1", "k2").sortWithinPartitions("k1", "k2", "first") \
        .mapInArrow(hashed, "k1 long, k2 long, ends string")


def partial_nodes(distinct: DataFrame, limit: int) -> DataFrame:
    """NODE rows of all runs of ``distinct`` (ids, words, n, low, ends), and a
    row of ENDS for each run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, held in enumerate(_runs(batches, limit)):
            nodes = run_nodes(**held)
            rest = [pa.nulls(nodes.num_rows, f.type) for f in ends_type]
            yield pa.RecordBatch.from_arrays([*nodes.columns, *rest], names)
            one = [[(part << 33) + number], held["ids"][:1], held["ids"][-1:], held["words"][-1:]]
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(1, c.type) for c in nodes.columns), *(pa.array(v, f.type) for v, f in zip(one, ends_type))], names)

    ids = pa.list_(pa.int64())
    ends_type = pa.schema([("run", pa.int64()), ("first", ids), ("last", ids), ("last_words", ids)])
    names = [*NODE_NAMES, *ends_type.names]
    return distinct.repartitionByRange(partitions(distinct.sparkSession), "ids").sortWithinPartitions("ids") \
        .mapInArrow(run, f"{NODE}, {ENDS}")


def overlap(last: list[int], words: list[int], first: list[int]) -> pa.RecordBatch:
    """What to add to the sums of two neighbouring runs for the prefixes that
    the last list of one and the first list of the next share."""
    same = 0
    while same < min(len(last), len(first)) and last[same] == first[same]:
        same += 1
    # both runs left one member out of each node's savings
    saved = np.cumsum(np.array(words[:same], np.int64)[::-1])[::-1]
    saved = [*saved[:1].tolist(), *saved.tolist()] if same else [0]
    keys = digest(last[:same])
    # a last list that goes on in the next run is no leaf
    leaf = -int(same == len(last))
    n = same + 1
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()), pa.array([None, *keys[:-1]], pa.binary()), pa.array(range(n), pa.int64()),
         pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([0] * n, pa.int64()),
         pa.array([-1] * same + [0], pa.int64()), pa.array([leaf] * n, pa.int64()), pa.array(saved, pa.int64()),
         pa.nulls(n, pa.string()), pa.array([False] * n)], NODE_NAMES)


def corrections(ends: DataFrame) -> DataFrame:
    """NODE rows to be added for all neighbouring runs of ``ends``."""
    spark = ends.sparkSession
    ends = ends.withColumn("part", F.shiftright("run", 33))
    # one number for each partition of the range shuffle: makes run numbers gapless
    counts = sorted((r.part, r.n) for r in ends.groupBy("part").agg(F.count("*").alias("n")).collect())
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, before)], "_part long, offset long")
    runs = ends.join(F.broadcast(offsets), F.col("part") == F.col("_part")) \
        .withColumn("no", F.col("offset") + F.col("run").bitwiseAND(F.lit((1 << 33) - 1)))
    pairs = runs.select((F.col("no") + 1).alias("next"), "last", "last_words") \
        .join(runs.select("no", F.col("first").alias("then")), F.col("next") == F.col("no"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for last, words, first in zip(*(c.to_pylist() for c in rb.columns)):
                yield overlap(last, words, first)

    return pairs.select("last", "last_words", "then").mapInArrow(run, NODE)


def trie(conversations: DataFrame, every: int = 20, heads: int = 4, run: int = RUN) -> DataFrame:
    """One row per trie node of the rebuilt conversations: conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    ids = F.expr("transform(turns, x -> x.id)")
    rows = written(rebuild(lists(conversations), every, heads).select(
        "conv_id", ids.alias("ids"), F.expr("transform(turns, x -> x.words)").alias("words"),
        F.xxhash64(ids).alias("k1"), F.xxhash64(F.lit(7), ids).alias("k2")), "lists")
    ends = end_digests(rows).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "ends")
    distinct = rows.groupBy("k1", "k2").agg(
        F.first("ids").alias("ids"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("low")) \
        .join(ends, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))) \
        .select("ids", "words", "n", "low", "ends")
    partial = written(partial_nodes(distinct, run), "trie")
    nodes = partial.filter("run IS NULL")
    edges = nodes.filter("NOT inner").select(*NODE_NAMES) \
        .unionByName(corrections(partial.filter("run IS NOT NULL").select("run", "first", "last", "last_words")))
    merged = written(edges.groupBy("key").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in SUMS], F.max("ends_sha256").alias("ends_sha256")), "edges")
    above = merged.select(F.col("key").alias("_key"), F.col("conv_id").alias("_above"))
    result = ["conv_id", "depth", "parent_conv_id", *SUMS, F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")]
    inner = nodes.filter("inner")
    below = inner.filter("parent IS NOT NULL").drop("parent_conv_id") \
        .unionByName(merged.withColumns({"inner": F.lit(False)}), allowMissingColumns=True) \
        .join(above, F.col("parent") == F.col("_key"), "left").withColumn("parent_conv_id", F.col("_above"))
    return inner.filter("parent IS NULL").select(*result).unionByName(below.select(*result))


def duckdb_sql(every: int = 20, heads: int = 4) -> str:
    """The same rows by grouping every prefix of every conversation."""
    crc = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: i::UBIGINT)),
      lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT)"""
    return rf"""
WITH c AS MATERIALIZED (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
own AS (SELECT conv_id, s, ({crc} % {heads})::BIGINT AS h FROM c),
rebuilt AS MATERIALIZED (
  SELECT own.conv_id, list_concat(coalesce(b.s, [])[1:h], own.s[h + 1:]) AS s
  FROM own LEFT JOIN c b ON b.conv_id = own.conv_id - own.conv_id % {every}),
prefixes AS (SELECT conv_id, s, len(s) AS size, unnest(range(0, len(s) + 1)) AS depth FROM rebuilt),
nodes AS MATERIALIZED (
  SELECT s[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    any_value(CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(s[depth].t, '[^ 	-
]+')) END) AS words,
    sha256(coalesce(string_agg(CASE WHEN size = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM prefixes GROUP BY 1, 2),
kids AS MATERIALIZED (SELECT p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
whole AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON nodes.p = kids.p),
below AS (SELECT p[1:a] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM whole) GROUP BY 1)
SELECT whole.conv_id, whole.depth, up.conv_id AS parent_conv_id, whole.n_convs, n_children, n_leaves, saved_tokens, whole.ends_sha256
FROM whole JOIN below ON whole.p = below.p LEFT JOIN nodes up ON whole.depth > 0 AND up.p = whole.p[1:whole.depth - 1]"""
