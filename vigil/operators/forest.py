"""Random forest grown to pure leaves (M3).

Rows with equal features are one *cell* with its rows of both classes.  Each
tree draws every row a Poisson(1) number of times (a cell of c rows Poisson(c)
times), by a hash of cell and tree, so a rerun draws alike.

Growth starts level by level: while a node holds more than HANDOFF drawn cells,
one grouped aggregate adds up class weights and drawn cells per (tree, node,
feature, bin) of quantile bins, and the node is split at the best bin edge.  A node at or below
the bound is handed off: its cells are shuffled to one task, which grows the
rest of the subtree to purity with exact thresholds.  A node looks at a random
part of its features, and at the others only while none of these has a cut.

The trees are a table (Parquet) that grows with the data.  For scoring they are
broadcast in pieces of at most PIECE_NODES nodes and the pieces' parts of the
probability are added up, so no piece's size depends on the forest's.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.operators.boosting import BINS, quantile_edges
from vigil.schema import FEATURES
from vigil.session import delete_on_exit, ensure_checkpoint_dir, write_once

HANDOFF = 1 << 18       # drawn cells of a node that one task grows further
PIECE_NODES = 1 << 21   # nodes broadcast at a time
BATCH = 1 << 13         # cells a task draws for all trees at a time
ORDERS = 1 << 8         # nodes whose feature orders are found at a time

NODE_SCHEMA = "tree int, unit long, node int, left int, right int, feature int, threshold double, " \
              "w0 double, w1 double, gain double"


def _mix(z: np.ndarray) -> np.ndarray:
    """Finaliser of the public-domain splitmix64 generator."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _uniform(*parts) -> np.ndarray:
    """Uniform (0, 1) from integers."""
    z = np.uint64(0x9E3779B97F4A7C15)
    for p in parts:
        z = _mix((np.asarray(p).astype(np.uint64) ^ z) + np.uint64(0x9E3779B97F4A7C15))
    return ((z >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53


def poisson(mean: np.ndarray, u: np.ndarray, u2: np.ndarray) -> np.ndarray:
    """Poisson draws by inversion; means over 64 by the normal limit."""
    out = np.zeros(len(mean))
    small = mean <= 64
    at = np.flatnonzero(small)
    m, v = mean[at], u[at]
    chance = np.exp(-m)
    total, step = chance, 0
    while step < 300 and (left := v > total).any():
        step += 1
        at, m, v, chance, total = (a[left] for a in (at, m, v, chance, total))
        out[at] += 1
        chance = chance * m / step
        total = total + chance
    big = ~small
    z = np.sqrt(-2 * np.log(u[big])) * np.cos(2 * np.pi * u2[big])
    out[big] = np.maximum(0, np.rint(mean[big] + np.sqrt(mean[big]) * z))
    return out


def drawn(key: np.ndarray, counts: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Rows of both classes that a tree draws of each cell."""
    out = np.zeros((len(key), 2))
    for y in (0, 1):
        some = np.flatnonzero(counts[:, y])  # most cells have rows of one class only
        mean, u2 = counts[some, y], np.zeros(len(some))
        big = mean > 64  # only these need a second number
        u2[big] = _uniform(key[some[big]], np.int64(tree * 4 + y + 2), np.int64(seed))
        out[some, y] = poisson(mean, _uniform(key[some], np.int64(tree * 4 + y), np.int64(seed)), u2)
    return out


def gini_loss(w: np.ndarray) -> np.ndarray:
    """Weight times Gini impurity of class weights (..., 2)."""
    total = w.sum(axis=-1)
    return total - (w * w).sum(axis=-1) / np.where(total > 0, total, 1)


def feature_order(tree: int, node: int | np.ndarray, n: int, seed: int) -> np.ndarray:
    """Features in the order that a node looks at them; a row a node for many."""
    node = np.asarray(node, np.int64)[..., None]
    return np.argsort(_uniform(np.arange(n), np.int64(tree), node, np.int64(seed)), axis=-1, kind="stable")


def grow_pure(x: np.ndarray, w: np.ndarray, tree: int, unit: int, some: int, seed: int) -> list[tuple]:
    """Rows (node, left, right, feature, threshold, w0, w1, gain) of a subtree
    grown until every leaf is pure or its features are constant."""
    out: list[list] = []
    orders: list[list[int]] = []
    stack = [(np.arange(len(x)), -1, 0)]
    while stack:
        rows, parent, side = stack.pop()
        node = len(out)
        if parent >= 0:
            out[parent][1 + side] = node
        own = w[rows]
        total = own.sum(axis=0)
        out.append([node, -1, -1, -1, None, float(total[0]), float(total[1]), 0.0])
        if total.min() <= 0:
            continue
        best = None
        if node >= len(orders):  # for many nodes at once
            more = unit * 1_000_003 + np.arange(len(orders), node + ORDERS)
            orders += feature_order(tree, more, x.shape[1], seed).tolist()
        for looked, f in enumerate(orders[node]):
            if looked >= some and best:
                break
            order = np.argsort(x[rows, f], kind="stable")
            v = x[rows[order], f]
            cuts = np.flatnonzero(v[1:] > v[:-1])
            if not len(cuts):
                continue
            left = np.cumsum(own[order], axis=0)[cuts]
            loss = gini_loss(left) + gini_loss(total - left)
            i = int(loss.argmin())
            if best is None or loss[i] < best[0]:
                a, b = v[cuts[i]], v[cuts[i] + 1]
                middle = (a + b) / 2
                best = float(loss[i]), f, float(middle if middle < b else a), rows[order[:cuts[i] + 1]], rows[order[cuts[i] + 1:]]
        if best:
            out[node][3], out[node][4], out[node][7] = best[1], best[2], float(gini_loss(total)) - best[0]
            stack += [(best[4], node, 1), (best[3], node, 0)]
    return [tuple(r) for r in out]


class Top:
    """Top parts of the trees: nodes that were split on Spark.  Node ids of a
    tree are positions in its arrays; ``feature`` -1 marks an end."""

    def __init__(self, trees: int):
        self.feature = [[-1] for _ in range(trees)]
        self.threshold = [[0.0] for _ in range(trees)]
        self.left = [[-1] for _ in range(trees)]
        self.right = [[-1] for _ in range(trees)]
        self.stats: dict[tuple[int, int], tuple] = {}

    def split(self, tree: int, node: int, feature: int, threshold: float) -> tuple[int, int]:
        new = len(self.feature[tree])
        self.feature[tree][node], self.threshold[tree][node] = feature, threshold
        self.left[tree][node], self.right[tree][node] = new, new + 1
        for column, empty in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1)):
            column[tree] += [empty, empty]
        return new, new + 1

    def columns(self) -> tuple:
        """Plain lists for the tasks."""
        return self.feature, self.threshold, self.left, self.right


def top_ends(columns: tuple, tree: int, x: np.ndarray) -> np.ndarray:
    return descend(x, *(np.array(c[tree]) for c in columns))


def descend(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Node that each row ends at."""
    node = np.zeros(len(x), np.int64)
    going = np.arange(len(x))
    while len(going):
        at = node[going]
        going = going[feature[at] >= 0]
        at = node[going]
        node[going] = np.where(x[going, feature[at]] <= threshold[at], left[at], right[at])
    return node


def exact_cells(df: DataFrame, label: str, features: list[str] = FEATURES) -> DataFrame:
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]
    return df.select(*x, (F.col(label) == 1).alias("_y")).groupBy(*features).agg(
        F.count_if(~F.col("_y")).alias("n0"), F.count_if("_y").alias("n1")) \
        .withColumn("key", F.xxhash64(*features))


def fit(train: DataFrame, label: str, trees: int = 100, some: int = 2, seed: int = 42,
        features: list[str] = FEATURES) -> "Forest":
    """``trees`` pure trees; a node looks at ``some`` random features."""
    spark = train.sparkSession
    # cells are few bytes and much work: by a given number of partitions, else
    # they are merged by size and a few tasks draw for all trees
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = write_once(exact_cells(train, label, features).repartition(parts, "key"), "forest-cells")
    edges = quantile_edges(train, features)
    top = Top(trees)
    active = _large(table, top, {t: [0] for t in range(trees)}, features, seed)
    while active:
        sums = _histograms(table, top, active, edges, features, seed)
        grown: dict[int, list[int]] = {}
        for r in _best_splits(sums, features, some, seed).collect():  # one row a node that is split
            e = edges[r.feature]
            top.stats[r.tree, r.node] = (r.w0, r.w1, r.gain)
            for child, n in zip(top.split(r.tree, r.node, r.feature, e[r.cut]), (r.n_left, r.n_right)):
                if n > HANDOFF:
                    grown.setdefault(r.tree, []).append(child)
        active = grown
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    _subtrees(table, top, some, seed, features).unionByName(_top_rows(spark, top)).write.parquet(path)
    delete_on_exit(spark, path)
    return Forest(spark, path, trees, features)


def _cell_batches(batches: Iterator[pa.RecordBatch], features: list[str]):
    for big in batches:
        for lo in range(0, big.num_rows, BATCH):
            rb = big.slice(lo, BATCH)
            x = np.stack([rb.column(c).to_numpy() for c in features], axis=1)
            yield x, rb.column("key").to_numpy(), np.stack([rb.column(c).to_numpy() for c in ("n0", "n1")], axis=1).astype(float)


def _large(table: DataFrame, top: Top, nodes: dict[int, list[int]], features: list[str], seed: int) -> dict[int, list[int]]:
    """Nodes of ``nodes`` with more than HANDOFF drawn cells."""
    shared = table.sparkSession.sparkContext.broadcast((top.columns(), nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, of = shared.value
        for x, key, counts in _cell_batches(batches, features):
            out: list[tuple] = []
            for t, ids in of.items():
                held = drawn(key, counts, t, seed).sum(axis=1) > 0
                ends, n = np.unique(top_ends(parts, t, x[held]), return_counts=True)
                out += [(t, int(e), int(c)) for e, c in zip(ends, n) if e in set(ids)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], ["tree", "node", "n"])

    rows = table.mapInArrow(run, "tree long, node long, n long").groupBy("tree", "node").agg(F.sum("n").alias("n"))
    out: dict[int, list[int]] = {}
    for r in rows.filter(F.col("n") > HANDOFF).collect():
        out.setdefault(r.tree, []).append(r.node)
    return out


def _histograms(table: DataFrame, top: Top, nodes: dict[int, list[int]], edges: list[list[float]],
                features: list[str], seed: int) -> DataFrame:
    """(tree, node, feature, bin, w0, w1, n) of the given nodes, n drawn cells."""
    shared = table.sparkSession.sparkContext.broadcast((top.columns(), nodes, [np.array(e) for e in edges]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, of, cuts = shared.value
        for x, key, counts in _cell_batches(batches, features):
            bins = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(cuts)], axis=1)
            n_bins, n_features = max(map(len, cuts)) + 1, len(features)
            for t, ids in of.items():
                w, ends, slots = drawn(key, counts, t, seed), top_ends(parts, t, x), np.sort(np.array(ids))
                at = np.searchsorted(slots, ends)
                at[at == len(slots)] = 0
                here = np.flatnonzero((slots[at] == ends) & (w.sum(axis=1) > 0))
                cell = ((at[here, None] * n_features + np.arange(n_features)) * n_bins + bins[here]).ravel()
                used, cell = np.unique(cell, return_inverse=True)
                sums = [np.bincount(cell, np.repeat(w[here, y], n_features), len(used)) for y in (0, 1)]
                sums.append(np.bincount(cell, minlength=len(used)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), t)), pa.array(slots[used // (n_bins * n_features)]),
                     pa.array(used // n_bins % n_features), pa.array(used % n_bins), *map(pa.array, sums)],
                    ["tree", "node", "feature", "bin", "w0", "w1", "n"])

    return table.mapInArrow(run, "tree long, node long, feature long, bin long, w0 double, w1 double, n long") \
        .groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("w0", "w1", "n")])


def _best_splits(sums: DataFrame, features: list[str], some: int, seed: int) -> DataFrame:
    """The split of each node: least Gini loss among the features it looks at,
    with the drawn cells of both sides."""
    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
        h = np.zeros((len(features), int(pdf["bin"].max()) + 1, 2))
        h[pdf["feature"], pdf["bin"]] = pdf[["w0", "w1"]].to_numpy()
        cells = np.zeros(h.shape[:2], np.int64)
        cells[pdf["feature"], pdf["bin"]] = pdf["n"]
        total = h[0].sum(axis=0)
        best = None
        for looked, f in enumerate(feature_order(tree, node, len(features), seed).tolist()):
            if looked >= some and best:
                break
            left = np.cumsum(h[f], axis=0)[:-1]
            loss = gini_loss(left) + gini_loss(total - left)
            loss[(left.sum(axis=1) <= 0) | ((total - left).sum(axis=1) <= 0)] = np.inf
            if len(loss) and np.isfinite(loss).any() and (best is None or loss.min() < best[0]):
                best = float(loss.min()), f, int(loss.argmin())
        if best is None or total.min() <= 0:
            return pd.DataFrame(columns=names)
        _, f, cut = best
        n_left, n_right = cells[f, :cut + 1].sum(), cells[f, cut + 1:].sum()
        return pd.DataFrame([(tree, node, f, cut, total[0], total[1], float(gini_loss(total)) - best[0], n_left, n_right)], columns=names)

    schema = "tree int, node int, feature int, cut int, w0 double, w1 double, gain double, n_left long, n_right long"
    names = [c.split()[0] for c in schema.split(", ")]
    return sums.groupBy("tree", "node").applyInPandas(pick, schema)


def _subtrees(table: DataFrame, top: Top, some: int, seed: int, features: list[str]) -> DataFrame:
    """Nodes below the top parts: each end of a top part is a unit of its own."""
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast(top.columns())

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = shared.value
        for x, key, counts in _cell_batches(batches, features):
            for t in range(len(parts[0])):
                w = drawn(key, counts, t, seed)
                held = w.sum(axis=1) > 0
                unit = top_ends(parts, t, x[held])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(unit), t, np.int32)), pa.array(unit), pa.array(key[held]),
                     *(pa.array(x[held, i]) for i in range(len(features))), pa.array(w[held, 0]), pa.array(w[held, 1])],
                    ["tree", "unit", "key", *features, "w0", "w1"])

    routed = table.mapInArrow(route, "tree int, unit long, key long, " + ", ".join(f"{c} double" for c in features)
                              + ", w0 double, w1 double")
    parts = max(len(top.feature), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def finish(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        tree, unit = t.column("tree")[0].as_py(), t.column("unit")[0].as_py()
        x = np.stack([t.column(c).to_numpy() for c in features], axis=1)
        rows = grow_pure(x, np.stack([t.column(c).to_numpy() for c in ("w0", "w1")], axis=1), tree, unit, some, seed)
        columns = list(zip(*rows))
        types = [pa.int32()] * 4 + [pa.float64()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array([tree] * len(rows), pa.int32()), pa.array([unit] * len(rows), pa.int64()),
             *(pa.array(c, t) for c, t in zip(columns, types))], [c.split()[0] for c in NODE_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for rb in batches:  # sorted by tree and unit
            t, u = rb.column("tree").to_numpy(), rb.column("unit").to_numpy()
            heads = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (u[1:] != u[:-1]))) if len(t) else []
            for lo, hi in zip(heads, [*heads[1:], len(t)]):
                if now not in (None, (t[lo], u[lo])):
                    yield finish(held)
                    held = []
                now = t[lo], u[lo]
                held.append(rb.slice(lo, hi - lo))
        if held:
            yield finish(held)

    return routed.repartition(parts, "tree", "unit").sortWithinPartitions("tree", "unit", "key").mapInArrow(run, NODE_SCHEMA)


def _top_rows(spark: SparkSession, top: Top) -> DataFrame:
    """Split nodes of the top parts, as unit -1."""
    rows = [(t, -1, node, top.left[t][node], top.right[t][node], f, float(top.threshold[t][node]), *map(float, top.stats[t, node]))
            for t, features in enumerate(top.feature) for node, f in enumerate(features) if f >= 0]
    return spark.createDataFrame(rows, NODE_SCHEMA)


def stitch(nodes: pd.DataFrame) -> dict[int, tuple[np.ndarray, ...]]:
    """(feature, threshold, left, right, value, w0 + w1) of every tree of a
    node table; a unit that isn't ``whole`` is a leaf of value 0."""
    out = {}
    for tree, part in nodes.groupby("tree"):
        top = part[part["unit"] == -1].sort_values("node")
        units = {u: g.sort_values("node") for u, g in part[part["unit"] >= 0].groupby("unit")}
        size = max([0, *top["node"], *top["right"]]) + 1
        feature, threshold = np.full(size, -1), np.zeros(size)
        left, right, value, cover = np.full(size, -1), np.full(size, -1), np.zeros(size), np.zeros(size)
        at = top["node"].to_numpy(int)
        feature[at], threshold[at], left[at], right[at] = top["feature"], top["threshold"], top["left"], top["right"]
        cover[at] = top["w0"] + top["w1"]
        columns = [[feature], [threshold], [left], [right], [value], [cover]]
        for u, g in units.items():  # the unit's root takes the place of the end; the others go behind
            base = sum(map(len, columns[0])) - 1
            link = {c: np.where(g[c] > 0, g[c] + base, -1) for c in ("left", "right")}
            w = (g["w0"] + g["w1"]).to_numpy()
            new = (g["feature"].to_numpy(int), g["threshold"].astype(float).fillna(0).to_numpy(), link["left"], link["right"],
                   np.where(g["feature"] < 0, g["w1"] / w, 0.0), w)
            if "whole" in g and not g["whole"].iloc[0]:
                new = np.array([-1]), np.zeros(1), np.array([-1]), np.array([-1]), np.zeros(1), w[:1]
            for column, values in zip(columns, new):
                column[0][int(u)] = values[0]
                column.append(values[1:])
        out[int(tree)] = tuple(np.concatenate(c) for c in columns)
    return out


def leaf_values(trees):
    """Column function: sum over the (broadcast) trees of the leaf's value."""
    @F.pandas_udf("double")
    def part(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float) for c in columns], axis=1)
        return pd.Series(sum((value[descend(x, f, t, left, right)] for f, t, left, right, value, _ in trees.value.values()),
                             np.zeros(len(x))))
    return part


class Forest:
    """A forest whose nodes lie in a Parquet folder."""

    def __init__(self, spark: SparkSession, path: str, trees: int, features: list[str] = FEATURES):
        self.path, self.trees, self.features = path, trees, features

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(NODE_SCHEMA).parquet(self.path)

    def pieces(self, spark: SparkSession) -> Iterator[pd.DataFrame]:
        """Node tables of at most PIECE_NODES nodes (or one unit), each with the
        top parts of its trees."""
        nodes = self.table(spark)
        sizes = nodes.groupBy("tree", "unit").agg(F.count("*").alias("n"))
        held, load = [], 0
        for tree, n in sorted((r.tree, r.n) for r in sizes.groupBy("tree").agg(F.sum("n").alias("n")).collect()):
            if held and load + n > PIECE_NODES:
                yield nodes.filter(F.col("tree").isin(held)).toPandas()
                held, load = [], 0
            if n <= PIECE_NODES:
                held.append(tree)
                load += n
                continue
            # a tree above the bound goes unit by unit, cut along a running sum
            order = Window.orderBy("unit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            units = sizes.filter((F.col("tree") == tree) & (F.col("unit") >= 0)).withColumn(
                "piece", F.floor((F.sum("n").over(order) - 1) / PIECE_NODES)).select("unit", "piece")
            for p in range(units.agg(F.max("piece")).first()[0] + 1):
                ids = units.filter(F.col("piece") == p).select(F.col("unit").alias("_unit"))
                own = nodes.filter(F.col("tree") == tree).join(ids, F.col("unit") == F.col("_unit"), "left") \
                    .withColumn("whole", F.col("_unit").isNotNull()).drop("_unit")
                # of the other units only the first node, for its weight
                yield own.filter((F.col("unit") == -1) | (F.col("node") == 0) | F.col("whole")).toPandas()
        if held:
            yield nodes.filter(F.col("tree").isin(held)).toPandas()

    def probability(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with the mean over trees of the leaf's share of class 1."""
        spark = df.sparkSession
        columns = [F.col(c).cast("double") for c in self.features]
        total = F.lit(0.0)
        for nodes in self.pieces(spark):
            total = total + leaf_values(spark.sparkContext.broadcast(stitch(nodes)))(*columns)
        return df.withColumn(out, total / self.trees)

    def importance(self, spark: SparkSession) -> list[tuple[str, float]]:
        """Impurity decrease of each feature, a share of each tree's, averaged."""
        gains = self.table(spark).filter("feature >= 0").groupBy("tree", "feature").agg(F.sum("gain").alias("g"))
        share = gains.withColumn("s", F.col("g") / F.sum("g").over(Window.partitionBy("tree")))
        by = {r.feature: r.s for r in share.groupBy("feature").agg(F.sum("s").alias("s")).collect()}
        total = sum(by.values()) or 1.0
        return sorted(((c, by.get(i, 0.0) / total) for i, c in enumerate(self.features)), key=lambda x: -x[1])

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).write.mode("overwrite").parquet(f"{path}/forest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Forest":
        trees = spark.read.parquet(f"{path}/forest").agg(F.max("tree")).first()[0] + 1
        return cls(spark, f"{path}/forest", trees)
