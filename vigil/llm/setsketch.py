"""Near-duplicates by SetSketch registers.

A document's set is its distinct word shingles (64-bit XXH64 each).  Every
element runs a Poisson process of rate REGISTERS * RATE whose points fall on
registers at random, so each register sees the least of independent
exponentials, one an element; an element stops at the first point above all
minima of its document.  A register holds the minimum's exponent to BASE,
truncated to two bytes: sketches of parts merge by the elementwise greatest
value, and two registers are equal with nearly the Jaccard similarity J.

1. Equal sets (128-bit digest of the sorted hashes) become one node.
2. BANDS bands of ROWS registers are hashed.  A pair at J = 0.85 meets in none
   of them with probability (1 - 0.85^6)^42 = 2e-9.
3. Nodes that meet are compared register by register: the counts of greater,
   less and equal ones and the two known set sizes give the likelihood of J;
   pairs whose maximum lies more than MARGIN (over five standard deviations)
   below the threshold go.  A task returns a spanning forest, never all pairs.
4. Inside the components of that candidate graph links are confirmed on the
   full sets, again as spanning forests, and the final components follow.

A bucket or component above UNIT is cut into blocks, and every pair of blocks
is a unit of work of its own, so no group has to fit into one task.

Defined cases: null and empty texts and texts without words have no shingles,
are linked with nothing and are their own component.  Fewer words than a
shingle are one shingle.  Repeated rows share their component.  A null id gets
a component like any row; the component id is the smallest non-null id, and
such a row is kept only if no row of its component has an id.  Empty tables
give empty results; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import partitions, steps, written
from vigil.llm.components import components

REGISTERS, BASE, RATE, TOP = 256, 1.001, 20.0, 65535
BANDS, ROWS = 42, 6
MARGIN = 0.12
UNIT = 4096          # nodes of one block of a bucket
SET_UNIT = 1 << 22   # shingles of one block of a component
PIECE = 1 << 18      # points drawn at a time
SMALL = 24           # units of up to this size are compared at one go


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    words = text.encode().lower().split() if text else ()  # bytes: ASCII letters and blanks only
    if not words:
        return np.empty(0, np.uint64)
    digest, flat = xxhash.xxh64_intdigest, b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lens + 1) - lens - 1
    k = max(1, len(words) - shingle + 1)
    ends = (starts + lens)[min(shingle, len(words)) - 1:]
    return np.unique(np.array([digest(flat[a:b], 42) for a, b in zip(starts[:k].tolist(), ends.tolist())], np.uint64))


def _mix(z: np.ndarray) -> np.ndarray:
    """Finaliser of the public-domain splitmix64 generator."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Least point of every register: one row of REGISTERS for each set."""
    out = np.full((len(sets), REGISTERS), np.inf)
    flat = out.reshape(-1)
    step = np.uint64(0x9E3779B97F4A7C15)
    sizes = np.array([len(s) for s in sets], np.int64)
    # a set needs about REGISTERS * ln(REGISTERS) points in all to reach every register
    need = np.ceil(1.2 * REGISTERS * np.log(REGISTERS) / np.maximum(sizes, 1)).astype(np.int64)
    block = 1 << np.ceil(np.log2(np.maximum(need, 4))).astype(np.int64)
    for g in np.unique(block[sizes > 0]).tolist():
        rows = np.flatnonzero((block == g) & (sizes > 0))
        h, of = np.concatenate([sets[i] for i in rows]), np.repeat(rows, sizes[rows])
        x, drawn = np.zeros(len(h)), 0
        while len(h):
            again = []
            for a in range(0, len(h), max(1, PIECE // g)):
                b = a + max(1, PIECE // g)
                j = np.arange(drawn + 1, drawn + g + 1, dtype=np.uint64) * step
                z = _mix(h[a:b, None] + j[None, :])
                gap = -np.log1p(-((z >> np.uint64(11)).astype(np.float64) * 2.0 ** -53))
                at = x[a:b, None] + np.cumsum(gap, axis=1)
                cell = of[a:b, None] * REGISTERS + (z & np.uint64(REGISTERS - 1)).astype(np.int64)
                np.minimum.at(flat, cell.ravel(), at.ravel())
                x[a:b] = at[:, -1]
            again = x < out.max(axis=1)[of]
            h, of, x, drawn = h[again], of[again], x[again], drawn + g
    return out / (REGISTERS * RATE)


def registers(least: np.ndarray) -> np.ndarray:
    """Truncated exponents of the minima; an empty set has zeros."""
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least) / np.log(BASE))
    return np.clip(k, 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(greater: np.ndarray, less: np.ndarray, equal: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """Most likely J of sets of sizes nu, nv whose registers compare so often
    as greater, less and equal (the log-likelihood is concave: bisection)."""
    u, v = nu / (nu + nv), nv / (nu + nv)
    c, ln_b = (BASE - 1) / BASE, np.log(BASE)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(26):
        j = (low + high) / 2
        xu, xv = np.maximum(u - v * j, 1e-15), np.maximum(v - u * j, 1e-15)
        pu, pv = -np.log1p(-xu * c) / ln_b, -np.log1p(-xv * c) / ln_b
        du, dv = c / ((1 - xu * c) * ln_b), c / ((1 - xv * c) * ln_b)
        slope = equal * (v * du + u * dv) / np.maximum(1 - pu - pv, 1e-300) - greater * v * du / pu - less * u * dv / pv
        up = slope > 0
        low, high = np.where(up, j, low), np.where(up, high, j)
    return (low + high) / 2


def likely(ru: np.ndarray, rv: np.ndarray, nu: np.ndarray, nv: np.ndarray, least: float) -> np.ndarray:
    """Rows of registers whose sets may well have a J of ``least``."""
    ok = np.minimum(nu, nv) >= least * np.maximum(nu, nv)
    rows = np.flatnonzero(ok)
    equal = (ru[rows] == rv[rows] if len(ru) == len(rv) else ru == rv[rows]).sum(axis=1)
    near = equal >= REGISTERS * (least - MARGIN - 0.07)  # spares the likelihood of pairs far off
    rows, equal = rows[near], equal[near]
    left = ru[rows] if len(ru) == len(rv) else ru
    more = (left > rv[rows]).sum(axis=1)
    j = estimate(more, REGISTERS - more - equal, equal, np.broadcast_to(nu, len(rv))[rows].astype(float), nv[rows].astype(float))
    out = np.zeros(len(rv), bool)
    out[rows] = j >= least - MARGIN
    return out


def grow(tree: np.ndarray, ask: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Spanning forest over rows of one unit: each asking row meets those tree
    rows that aren't in its part yet.  ``near(row, rows)`` gives a mask."""
    label = np.arange(len(tree))
    for p in np.flatnonzero(ask).tolist():
        rest = np.flatnonzero(tree & (label != label[p]))
        if not len(rest):
            continue
        found = rest[near(p, rest)]
        parts, first = np.unique(label[found], return_index=True)
        for q in found[first].tolist():
            yield p, q
        label[np.isin(label, parts)] = label[p]


def _pairs(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All row pairs inside consecutive small units of the given sizes."""
    start = np.repeat(np.cumsum(size) - size, size)
    at = np.arange(int(size.sum()))
    behind = start + np.repeat(size, size) - at - 1  # rows after this one in its unit
    a = np.repeat(at, behind)
    return a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(behind) - behind, behind)


def meet(regs: np.ndarray, n: np.ndarray, unit: np.ndarray, tree: np.ndarray, ask: np.ndarray,
         least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that connect the likely pairs of each unit (sorted by unit)."""
    heads = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    size = np.diff(np.append(heads, len(unit)))
    one, other = [], []
    small = np.repeat(size <= SMALL, size)
    rows = np.flatnonzero(small)
    if len(rows):
        a, b = _pairs(size[size <= SMALL])
        a, b = rows[a], rows[b]
        ok = (tree[a] & ask[b]) | (ask[a] & tree[b])
        a, b = a[ok], b[ok]
        for i in range(0, len(a), 1 << 15):
            p, q = a[i:i + (1 << 15)], b[i:i + (1 << 15)]
            good = likely(regs[p], regs[q], n[p], n[q], least)
            one.append(p[good])
            other.append(q[good])
    for k in np.flatnonzero(size > SMALL).tolist():
        lo, hi = heads[k], heads[k] + size[k]
        r, m = regs[lo:hi], n[lo:hi]
        links = list(grow(tree[lo:hi], ask[lo:hi], lambda p, rest: likely(r[p][None], r[rest], m[p:p + 1], m[rest], least)))
        if links:
            one.append(lo + np.array([x for x, _ in links]))
            other.append(lo + np.array([x for _, x in links]))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *one]), np.concatenate([none, *other])


def confirm(sets: list[np.ndarray], tree: np.ndarray, ask: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Row pairs that connect the sets of one unit at ``percent`` or more."""
    n = np.array([len(s) for s in sets], np.int64)
    values, token = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(n) - n
    mark = np.zeros(len(values), bool)

    def near(p: int, rest: np.ndarray) -> np.ndarray:
        fit = 100 * np.minimum(n[rest], n[p]) >= percent * np.maximum(n[rest], n[p])
        rows, out = rest[fit], np.zeros(len(rest), bool)
        if not len(rows):
            return out
        own = token[starts[p]:starts[p] + n[p]]
        mark[own] = True
        size = n[rows]
        base = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(starts[rows] - base, size)
        both = np.add.reduceat(mark[token[at]].astype(np.int64), base)
        mark[own] = False
        out[fit] = 100 * both >= percent * (size + n[p] - both)
        return out

    return list(grow(tree, ask, near))


def sketches(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(_id, n, k1, k2, of, regs) of every row: set size, set digest, text
    hash and registers (null without words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in steps(batches, "_text", 2 << 20):
            sets = [shingle_set(t, shingle) for t in rb.column("_text").to_pylist()]
            regs = registers(minima(sets))
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [rb.column("_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0].copy()),
                 pa.array(keys[:, 1].copy()), rb.column("_of"),
                 pa.array([r.tobytes() if len(s) else None for r, s in zip(regs, sets)], pa.binary())],
                ["_id", "n", "k1", "k2", "of", "regs"])

    key = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_of")) \
        .mapInArrow(run, f"_id {key}, n long, k1 long, k2 long, of long, regs binary")


def _units(rows: DataFrame, group: str, key: str, keep: list[str]) -> DataFrame:
    """Rows of ``group`` dealt to units: of a group of ``cuts`` blocks a row
    goes to every unit of its own block and another one."""
    own = F.pmod(F.xxhash64(key, F.lit(13)), F.col("cuts")).cast("int")
    return rows.withColumn("own", own).select(*keep, F.explode(F.expr(f"""
        flatten(transform(sequence(0, cuts - 1), i -> filter(array(
          struct(xxhash64({group}, own, i) AS unit, true AS tree, i = own AS ask),
          struct(xxhash64({group}, i, own) AS unit, false AS tree, i <> own AS ask)), x -> x.tree OR x.ask)))""")).alias("u")) \
        .select(*keep, "u.unit", "u.tree", "u.ask")


def _by_unit(batches: Iterator[pa.RecordBatch], limit: int, weight: Callable[[pa.RecordBatch], int]) -> Iterator[pa.Table]:
    """Whole units of sorted rows, many at a time."""
    held: list[pa.RecordBatch] = []
    load = 0
    for rb in batches:
        held.append(rb)
        load += weight(rb)
        if load >= limit:
            t = pa.Table.from_batches(held)
            unit = t.column("unit").to_numpy()
            cut = int(np.searchsorted(unit, unit[-1]))
            if cut:
                yield t.slice(0, cut)
                held = t.slice(cut).to_batches()
                load = sum(map(weight, held))
    if held:
        yield pa.Table.from_batches(held)


def candidates(nodes: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that connect all likely pairs of ``nodes`` (node, n, regs)."""
    spark = nodes.sparkSession
    keys = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(regs, i * {2 * ROWS} + 1, {2 * ROWS})))")
    banded = nodes.select("node", F.explode(keys).alias("bucket"))
    sizes = written(banded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    rows = banded.join(sizes, "bucket").select(
        F.col("node").alias("_node"), "bucket", F.ceil(F.col("size") / UNIT).cast("int").alias("cuts"))
    units = _units(rows, "bucket", "_node", ["_node"])
    with_regs = units.join(nodes, units["_node"] == nodes["node"]).select("node", "n", "regs", "unit", "tree", "ask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_unit(batches, 1 << 15, lambda rb: rb.num_rows):
            node, n, unit, tree, ask = (t.column(c).to_numpy() for c in ("node", "n", "unit", "tree", "ask"))
            regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            a, b = meet(regs, n, unit, tree, ask, least)
            links = np.unique(np.stack([np.maximum(node[a], node[b]), np.minimum(node[a], node[b])], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy())], ["a", "b"])

    return with_regs.repartition(partitions(spark), "unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")


def confirmed(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect the sets (node, root, n, members) within each
    candidate component ``root``."""
    spark = sets.sparkSession
    load = written(sets.groupBy("root").agg(F.ceil(F.sum("n") / SET_UNIT).cast("int").alias("cuts")), "loads") \
        .withColumnRenamed("root", "_root")
    units = _units(sets.join(load, sets["root"] == load["_root"]), "root", "node", ["node", "members"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_unit(batches, 32 << 20, lambda rb: rb.nbytes):
            node, unit, tree, ask = (t.column(c).to_numpy() for c in ("node", "unit", "tree", "ask"))
            heads = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            members = t.column("members")
            one, other = [], []
            for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), len(unit)]):
                own = [np.frombuffer(x, np.uint64) for x in members.slice(lo, hi - lo).to_pylist()]
                for p, q in confirm(own, tree[lo:hi], ask[lo:hi], percent):
                    one.append(node[lo + p])
                    other.append(node[lo + q])
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(other, pa.int64())], ["a", "b"])

    return units.repartition(partitions(spark), "unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 85,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of ``docs``: links
    join sets with 100 * intersection >= percent * union."""
    key = docs.schema[id_col].dataType.simpleString()
    rows = written(sketches(docs, shingle, id_col, text_col), "sketches")
    nodes = written(rows.filter("n > 0").groupBy("k1", "k2").agg(
        F.min("_id").alias("low"), F.min(F.struct("of", "_id")).alias("at"), F.first("n").alias("n"), F.first("regs").alias("regs"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    likely_parts = written(components(candidates(nodes.select("node", "n", "regs"), percent / 100)), "likely")

    asked = nodes.join(likely_parts.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node")) \
        .select("node", "root", F.col("at.of").alias("of"), F.col("at._id").alias("_at"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = texts.join(asked, (F.xxhash64("_text") == F.col("of")) & F.col("_id").eqNullSafe(F.col("_at"))) \
        .select("node", "root", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in steps(batches, "_text", 2 << 20):
            sets = [shingle_set(t, shingle) for t in rb.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [rb.column("node"), rb.column("root"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "root", "n", "members"])

    # rows repeated with one id and text give one set
    sets = written(found.mapInArrow(run, "node long, root long, n long, members binary").groupBy("node").agg(
        F.first("root").alias("root"), F.first("n").alias("n"), F.first("members").alias("members")), "sets")
    parts = components(confirmed(sets, percent)).withColumnRenamed("node", "_node").withColumnRenamed("root", "_root")
    of_node = written(nodes.select("node", "k1", "k2", "low").join(parts, F.col("node") == F.col("_node"), "left")
                      .select("k1", "k2", "low", F.coalesce("_root", "node").alias("root")), "parts")
    lows = written(of_node.groupBy("root").agg(F.min("low").alias("component_id")), "lows").withColumnRenamed("root", "_root")
    of_key = written(of_node.join(lows, F.col("root") == F.col("_root"))
                     .select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "component_id"), "of-key")
    linked = rows.filter("n > 0").select("_id", "n", "k1", "k2") \
        .join(of_key, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))) \
        .select("_id", "n", "component_id")
    alone = rows.filter("n = 0").select("_id", "n", F.col("_id").cast(key).alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
        F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def duckdb_sql(shingle: int, percent: int, table: str = "documents") -> str:
    """The same rows by joining all shingles (for small tables of unique ids)."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS ws FROM {table}),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {shingle} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {shingle} + 2), lambda i: array_to_string(ws[i:i + {shingle - 1}], ' ')) END) AS s FROM w),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT x, y FROM shared JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * c >= {percent} * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
low AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(sizes.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN low ON w.doc_id = low.x LEFT JOIN sizes ON w.doc_id = sizes.doc_id"""
