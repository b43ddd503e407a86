"""SimHash near-duplicates with BK-trees.

Fingerprints come from word shingles hashed with XXH64.  Equal fingerprints
are one node.  Two fingerprints within ``radius`` bits agree on at least
``blocks - radius`` of any ``blocks`` bit blocks, so every link lies inside a
bucket of fingerprints that agree on some combination of blocks.  A bucket's
fingerprints form BK-trees (children keyed by the Hamming distance to their
parent); a query follows only the edges whose key is within the radius of its
own distance to the node.  The number of blocks follows the number of
fingerprints so that buckets stay small at any size; every choice is exact.

Broadcasting every tree to every task would make each query visit trees of
the whole corpus, and the broadcast would grow with it.  So a tree goes only
to the tasks that hold queries of its bucket: a bucket of up to TREE rows is
one tree and one task; a larger one is cut into trees of about TREE rows,
each copied to the tasks that hold the bucket's query blocks.

A task returns a spanning forest of the links it found (never all pairs of a
group); components run on Spark.

Defined cases: null and empty texts and texts without words have fingerprint
zero and link like any other.  Repeated rows share fingerprint and component.
A null doc_id gets a component like any row; the component id is the smallest
non-null doc_id.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import partitions, steps, written
from vigil.llm.components import components

TREE = 1 << 15      # fingerprints of one tree
BUCKET = 2048       # fingerprints in a bucket, on average, at most: fewer mean more copies, more mean more visits
FRONTIER = 1 << 20  # (query, node) visits held at a time


def fingerprints_of(texts: list[str | None], shingle: int = 4) -> np.ndarray:
    """64-bit SimHash of each text, as unsigned integers."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = t.encode().lower().split() if t else ()  # bytes: ASCII letters and blanks only
        if not words:
            continue
        flat = b" ".join(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lens + 1) - lens - 1
        k = max(1, len(words) - shingle + 1)
        ends = (starts + lens)[min(shingle, len(words)) - 1:]
        hashes += [digest(flat[a:b], 42) for a, b in zip(starts[:k].tolist(), ends.tolist())]
        counts[i] = k
    out = np.zeros(len(texts), np.uint64)
    h = np.array(hashes, np.uint64)
    ends = np.cumsum(counts)
    with_words = np.flatnonzero(counts)
    if len(with_words):
        at = ends[with_words] - counts[with_words]
        for bit in range(64):
            ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), at)
            out[with_words] |= (ones * 2 > counts[with_words]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, _of) of every row; fp holds the unsigned bits, _of is a
    hash of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in steps(batches, "_text", 2 << 20):
            fp = fingerprints_of(rb.column("_text").to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([rb.column("_id"), pa.array(fp.view(np.int64)), rb.column("_of")],
                                             [id_col, "fp", "_of"])

    key = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_of")) \
        .mapInArrow(run, f"{id_col} {key}, fp long, _of long")


class Forest:
    """BK-trees of many groups at once, in flat arrays.

    Node i has value ``fp[i]``; its children are ``kid[lo[i]:hi[i]]`` sorted
    by edge key, found by binary search in ``edge`` = node * 128 + key.
    """

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        n = len(fp)
        self.fp = fp
        parent, key = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        rest = np.argsort(group, kind="stable")
        inside = group[rest]  # tree that a row still has to enter, then (node, key) it must go below
        self.roots: dict | None = None
        level = 0
        while len(rest):
            first = np.append(True, inside[1:] != inside[:-1])
            heads = rest[first]
            if level == 0:
                self.root_group, self.root = group[heads], heads
            sizes = np.diff(np.append(np.flatnonzero(first), len(rest)))
            head = np.repeat(heads, sizes)[~first]
            rest = rest[~first]
            d = np.bitwise_count(fp[rest] ^ fp[head]).astype(np.int64)
            parent_of, key_of = head, d
            inside = head * 128 + d
            order = np.argsort(inside, kind="stable")
            rest, inside = rest[order], inside[order]
            head_next = np.append(True, inside[1:] != inside[:-1]) if len(rest) else np.empty(0, bool)
            kids = rest[head_next]
            parent[kids], key[kids] = parent_of[order][head_next], key_of[order][head_next]
            level += 1
        kid = np.flatnonzero(parent >= 0)
        edge = parent[kid] * 128 + key[kid]
        order = np.argsort(edge)
        self.kid, self.edge = kid[order], edge[order]

    def search(self, query: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query index, node) within the radius, in bounded pieces."""
        at = np.searchsorted(self.root_group, group)
        at[at == len(self.root_group)] = 0
        ok = np.flatnonzero(self.root_group[at] == group) if len(self.root_group) else np.empty(0, np.int64)
        stack = [(ok[i:i + FRONTIER // 8], self.root[at[ok[i:i + FRONTIER // 8]]])
                 for i in range(0, len(ok), FRONTIER // 8)]
        while stack:
            q, node = stack.pop()
            d = np.bitwise_count(query[q] ^ self.fp[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            lo = np.searchsorted(self.edge, node * 128 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.edge, node * 128 + np.minimum(d + radius, 127), side="right")
            n = hi - lo
            some = np.flatnonzero(n)
            q, lo, n = q[some], lo[some], n[some]
            ends = np.cumsum(n)
            start = 0
            while start < len(q):  # split so that no piece exceeds the frontier
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + FRONTIER, side="right")))
                c = n[start:stop]
                at = np.arange(int(c.sum())) + np.repeat(lo[start:stop] - (np.cumsum(c) - c), c)
                stack.append((np.repeat(q[start:stop], c), self.kid[at]))
                start = stop


def spanning(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Lower the labels of nodes joined by a-b until all ends agree."""
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        if (la == lb).all():
            return label
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def links_in_unit(fp: np.ndarray, unit: np.ndarray, is_tree: np.ndarray, is_query: np.ndarray,
                  radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, smallest value of its part) of all units of a step."""
    values = fp.view(np.uint64)
    tree = np.flatnonzero(is_tree)
    forest = Forest(values[tree], unit[tree])
    ask = np.flatnonzero(is_query)
    label = np.arange(len(fp))
    for q, node in forest.search(values[ask], unit[ask], radius):
        a, b = ask[q], tree[node]
        differ = fp[a] != fp[b]
        label = spanning(a[differ], b[differ], label)
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return fp[linked], fp[label[linked]]


def block_plan(n: int, radius: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Bit blocks (low bit, width) and the combinations to agree on."""
    b = radius + 1
    while 64 * (b - radius) // b < 63 and n >> (64 * (b - radius) // b) > BUCKET:
        b += 1
    cuts = [64 * i // b for i in range(b + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])], list(combinations(range(b), b - radius))


def near_links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) that connect all fingerprints within the radius.

    ``nodes`` has one row for each distinct fp.
    """
    spark = nodes.sparkSession
    blocks, combos = block_plan(nodes.count(), radius)

    def part(lo: int, width: int):
        return F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << width) - 1))

    keys = F.array(*[F.xxhash64(F.lit(i), *[part(*blocks[x]) for x in c]) for i, c in enumerate(combos)])
    # distinct fingerprints only, so a bucket is large only where many
    # different texts are close; its size decides how many trees it needs
    bucketed = nodes.select("fp", F.explode(keys).alias("bucket"))
    sizes = written(bucketed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    rows = bucketed.join(sizes, "bucket").select(
        "fp", "bucket", F.ceil(F.col("n") / TREE).cast("int").alias("cuts"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("cuts")).cast("int")
    units = rows.withColumn("own", own).select(
        "fp", F.explode(F.expr("""
            flatten(transform(sequence(0, cuts - 1), i -> array(
              struct(xxhash64(bucket, own, i) AS unit, true AS tree, i = own AS ask),
              struct(xxhash64(bucket, i, own) AS unit, false AS tree, i <> own AS ask))))""")).alias("u")) \
        .select("fp", "u.unit", "u.tree", "u.ask").filter("tree OR ask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows_held = 0

        def flush(t: pa.Table):
            a, b = links_in_unit(*(t.column(c).to_numpy() for c in ("fp", "unit", "tree", "ask")), radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for rb in batches:  # sorted by unit: handle whole units, many at a time
            held.append(rb)
            rows_held += rb.num_rows
            if rows_held >= 1 << 17:
                t = pa.Table.from_batches(held)
                unit = t.column("unit").to_numpy()
                cut = int(np.searchsorted(unit, unit[-1]))
                if cut:
                    yield flush(t.slice(0, cut))
                    held, rows_held = t.slice(cut).to_batches(), t.num_rows - cut
        if rows_held:
            yield flush(pa.Table.from_batches(held))

    return units.repartition(partitions(spark), "unit").sortWithinPartitions("unit") \
        .mapInArrow(run, "a long, b long")


def labelled(docs: DataFrame, shingle: int, radius: int, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, _of, component_id) of every row of ``docs``."""
    fps = written(fingerprints(docs, shingle, id_col, text_col), "simhash")
    nodes = fps.groupBy("fp").agg(F.min(id_col).alias("low"))
    comp = components(near_links(nodes.select("fp"), radius))
    # aggregates are written before they are joined: both sides are then plain
    # shuffles, which Spark can split where one component holds a large part
    of_node = written(nodes.join(comp, nodes.fp == comp.node, "left")
                      .select("fp", "low", F.coalesce("root", "fp").alias("root")), "nodes")
    roots = written(of_node.groupBy("root").agg(F.min("low").alias("component_id")), "roots")
    of_fp = written(of_node.join(roots, "root").select(F.col("fp").alias("_fp"), "component_id"), "of-fp")
    return fps.join(of_fp, fps.fp == of_fp["_fp"]).drop("_fp")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint hex, component_id) of every row of ``docs``."""
    return labelled(docs, shingle, radius, id_col, text_col) \
        .select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay: of each component the smallest id.

    Rows repeated with one id are one document and stay together.  Rows
    without an id stay only if no row of their component has one.
    """
    gone = labelled(docs, shingle, radius, id_col, text_col) \
        .filter(F.col("component_id").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("component_id"))) \
        .select(F.col(id_col).alias("_gone"), F.col("_of").alias("_gone_of")).distinct()
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("_gone")) & F.xxhash64(text_col).eqNullSafe(F.col("_gone_of")),
                     "left_anti")
