"""Second-order gradient boosting on histograms (M4).

Values are cut into at most BINS bins per feature at quantiles, and rows with
equal bins are one *cell* with its number of positive and negative rows: the
boosting rounds work on cells, whose number is bounded by the bins and not by
the rows.  Each level of a tree is one pass that adds up gradients and
Hessians per (node, feature, bin); the split with the greatest regularised
gain wins, ties by the lower feature and cut.

Cells are held as numpy blocks of an RDD: a fit is hundreds of short passes
that depend on each other, and planning a DataFrame for each would take four
times as long as the pass.  Sums of a pass meet in a tree of partial sums.
While all cells are in one block, that block's task walks through the levels
of a tree itself; the sums are the same.  Margins are cached and checkpointed
to ``spark.checkpoint.dir`` every CHECKPOINT rounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.schema import FEATURES
from vigil.session import ensure_checkpoint_dir, write_once

BINS = 256
BLOCK_CELLS = 1 << 17  # cells of one block
CHECKPOINT = 25        # rounds between checkpoints of the margins
LEAST_GAIN = 1e-6

NODE_SCHEMA = "tree int, node int, feature int, threshold double, value double, gain double, cover double"


@dataclass
class Params:
    rounds: int = 200
    depth: int = 6
    step: float = 0.1
    positive_weight: float = 5.0
    l2: float = 1.0
    least_cover: float = 1.0
    base: float = 0.5  # probability before the first round


# ----------------------------------------------------------------- one tree
@dataclass
class Tree:
    """Nodes by heap number: the children of i are 2i and 2i + 1.  ``feature``
    is -1 at a leaf and -2 where there is no node."""
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    cover: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """Node that each row of bins ends at."""
        node = np.ones(len(bins), np.int64)
        rows = np.arange(len(bins))
        while True:
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                return node
            right = bins[rows, np.maximum(f, 0)] > self.cut[node]
            node = np.where(inner, 2 * node + right, node)


def grow(histogram: Callable[[Tree, int], np.ndarray], p: Params) -> Tree:
    """One tree, level by level.  ``histogram(tree, first)`` gives the sums
    (node, feature, bin, gradient and Hessian) of the nodes first .. 2 first - 1."""
    size = 2 << p.depth
    t = Tree(np.full(size, -2), np.zeros(size, np.int64), np.zeros(size), np.zeros(size), np.zeros(size))
    t.feature[1] = -1
    for level in range(p.depth):
        first = 1 << level
        if not (t.feature[first:2 * first] == -1).any():
            break
        h = histogram(t, first)
        left = np.cumsum(h, axis=2)
        total = left[:, :1, -1:, :]
        right = total - left
        gl, hl, gr, hr, g, c = (*np.moveaxis(left, 3, 0), *np.moveaxis(right, 3, 0), *np.moveaxis(total, 3, 0))
        gain = 0.5 * (gl * gl / (hl + p.l2) + gr * gr / (hr + p.l2) - g * g / (c + p.l2))
        gain[(hl < p.least_cover) | (hr < p.least_cover)] = -np.inf
        flat = gain.reshape(len(gain), -1)
        best = flat.argmax(axis=1)
        for i in np.flatnonzero(t.feature[first:2 * first] == -1):
            node = first + i
            if level == 0:
                t.cover[1], t.value[1] = total[0, 0, 0, 1], -total[0, 0, 0, 0] / (total[0, 0, 0, 1] + p.l2) * p.step
            if flat[i, best[i]] <= LEAST_GAIN:
                continue
            f, cut = divmod(int(best[i]), h.shape[2])
            t.feature[node], t.cut[node], t.gain[node] = f, cut, flat[i, best[i]]
            for child, sums in ((2 * node, left[i, f, cut]), (2 * node + 1, right[i, f, cut])):
                t.feature[child], t.cover[child] = -1, sums[1]
                t.value[child] = -sums[0] / (sums[1] + p.l2) * p.step
    return t


# ----------------------------------------------------------------- cells
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # bins, positives, negatives, margins


def gradients(block: Block, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums over a cell's rows of the logistic loss's derivatives."""
    _, pos, neg, margin = block
    p = 1 / (1 + np.exp(-margin))
    return pos * weight * (p - 1) + neg * p, (pos * weight + neg) * np.maximum(p * (1 - p), 1e-16)


def block_histogram(blocks: list[Block], tree: Tree, first: int, n_bins: int, weight: float) -> np.ndarray:
    features = blocks[0][0].shape[1]
    out = np.zeros((first * features * n_bins, 2))
    for block in blocks:
        bins = block[0]
        node = tree.leaves(bins) - first
        here = np.flatnonzero((node >= 0) & (node < first))
        g, h = (x[here] for x in gradients(block, weight))
        key = (node[here, None] * features + np.arange(features)) * n_bins + bins[here]
        for i, x in enumerate((g, h)):
            out[:, i] += np.bincount(key.ravel(), np.repeat(x, features), len(out))
    return out.reshape(first, features, n_bins, 2)


def quantile_edges(df: DataFrame, features: list[str] = FEATURES, bins: int = BINS) -> list[list[float]]:
    """Upper edges of the bins: distinct values at the ranks ceil(n i / bins)."""
    q = df.agg(*[F.percentile_approx(F.col(c).cast("double"), [i / bins for i in range(1, bins)], 100_000).alias(c)
                 for c in features]).first()
    return [sorted(set(q[c] or [])) for c in features]


def with_bins(df: DataFrame, edges: list[list[float]], features: list[str] = FEATURES) -> DataFrame:
    """``bin_<feature>``: the number of edges below the value."""
    # Bucketizer's buckets are [s_k, s_k+1): splits lie at the next double above an edge
    splits = [[-math.inf, *(float(np.nextafter(e, np.inf)) for e in es or [0.0]), math.inf] for es in edges]
    x = df.select("*", *[F.col(c).cast("double").alias(f"_x_{c}") for c in features])
    out = Bucketizer(splitsArray=splits, inputCols=[f"_x_{c}" for c in features],
                     outputCols=[f"bin_{c}" for c in features], handleInvalid="keep").transform(x)
    return out.drop(*[f"_x_{c}" for c in features]).withColumns(
        {f"bin_{c}": F.col(f"bin_{c}").cast("int") for c in features})


def cells(df: DataFrame, edges: list[list[float]], label: str, features: list[str] = FEATURES) -> DataFrame:
    """Distinct bins with their positive and negative rows."""
    return with_bins(df, edges, features).groupBy(*[f"bin_{c}" for c in features]).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def _blocks(table: DataFrame, parts: int, margin: float, features: list[str]):
    names = [f"bin_{c}" for c in features]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [rb for rb in batches if rb.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            bins = np.stack([t.column(c).to_numpy() for c in names], axis=1).astype(np.int16)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes()], pa.binary()) for x in
                 (bins, t.column("pos").to_numpy().astype(float), t.column("neg").to_numpy().astype(float))],
                ["bins", "pos", "neg"])

    def unpack(r) -> Block:
        pos = np.frombuffer(r.pos)
        return np.frombuffer(r.bins, np.int16).reshape(len(pos), -1), pos, np.frombuffer(r.neg), np.full(len(pos), margin)

    return table.repartition(parts, *names).sortWithinPartitions(*names) \
        .mapInArrow(pack, "bins binary, pos binary, neg binary").rdd.map(unpack)


# ----------------------------------------------------------------- training
def fit(train: DataFrame, label: str, p: Params, features: list[str] = FEATURES) -> "BoostedTrees":
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    edges = quantile_edges(train, features)
    table = write_once(cells(train, edges, label, features), "cells")
    parts = max(1, math.ceil(table.count() / BLOCK_CELLS))
    n_bins = max((len(e) for e in edges), default=0) + 2
    weight = p.positive_weight
    base = math.log(p.base / (1 - p.base))
    state = _blocks(table, parts, base, features).persist(StorageLevel.MEMORY_AND_DISK)

    def local(it: Iterator[Block]) -> Iterator[tuple]:
        blocks = list(it)
        if blocks:
            yield astuple(grow(lambda tree, first: block_histogram(blocks, tree, first, n_bins, weight), p))

    def shared(tree: Tree, first: int) -> np.ndarray:
        def part(it: Iterator[Block]) -> Iterator[np.ndarray]:
            blocks = list(it)
            if blocks:
                yield block_histogram(blocks, tree, first, n_bins, weight)
        return state.mapPartitions(part).treeReduce(np.add)

    trees: list[Tree] = []
    for r in range(p.rounds):
        if parts == 1:
            grown = state.mapPartitions(local).collect()
            if not grown:
                break
            tree = Tree(*grown[0])
        else:
            tree = grow(shared, p)
        trees.append(tree)
        if tree.feature[1] < 0 and tree.value[1] == 0:
            break

        def add(block: Block, tree: Tree = tree) -> Block:
            bins, pos, neg, margin = block
            return bins, pos, neg, margin + tree.value[tree.leaves(bins)]

        new = state.map(add).persist(StorageLevel.MEMORY_AND_DISK)
        if (r + 1) % CHECKPOINT == 0:
            new.checkpoint()
            new.count()
        old, state = state, new
        # the old margins stay until the next round has read them
        if r % 2:
            old.unpersist()
    state.unpersist()
    return BoostedTrees.of(trees, edges, base, features)


# ----------------------------------------------------------------- model
class BoostedTrees:
    """Nodes (tree, node, feature, threshold, value, gain, cover) and the base
    margin.  At most rounds * 2^(depth + 1) nodes, whatever the data."""

    def __init__(self, nodes: pd.DataFrame, base: float, features: list[str] = FEATURES):
        self.nodes, self.base, self.features = nodes, base, features

    @classmethod
    def of(cls, trees: list[Tree], edges: list[list[float]], base: float, features: list[str]) -> "BoostedTrees":
        rows = []
        for i, t in enumerate(trees):
            for node in np.flatnonzero(t.feature > -2).tolist():
                f = int(t.feature[node])
                e = edges[f] if f >= 0 else []
                threshold = None if f < 0 else e[t.cut[node]] if t.cut[node] < len(e) else math.inf
                rows.append((i, node, f, threshold, float(t.value[node]), float(t.gain[node]), float(t.cover[node])))
        names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
        return cls(pd.DataFrame(rows, columns=names), base, features)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature, threshold and value by (tree, node)."""
        n = self.nodes
        shape = (int(n["tree"].max()) + 1 if len(n) else 0, int(n["node"].max()) + 1 if len(n) else 2)
        feature, threshold, value = np.full(shape, -1), np.zeros(shape), np.zeros(shape)
        at = n["tree"].to_numpy(int), n["node"].to_numpy(int)
        feature[at], value[at] = n["feature"], n["value"]
        threshold[at] = n["threshold"].astype(float).fillna(0.0)
        return feature, threshold, value

    @staticmethod
    def margins(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for f, t, v in zip(feature, threshold, value):
            node = np.ones(len(x), np.int64)
            while True:
                at = f[node]
                inner = at >= 0
                if not inner.any():
                    break
                node = np.where(inner, 2 * node + ~(x[rows, np.maximum(at, 0)] <= t[node]), node)
            out += v[node]
        return out

    def probability(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with P(positive); trees are broadcast (bounded, see above)."""
        shared = df.sparkSession.sparkContext.broadcast((self.arrays(), self.base))

        @F.pandas_udf("double")
        def p(*columns: pd.Series) -> pd.Series:
            trees, base = shared.value
            x = np.stack([c.to_numpy(float) for c in columns], axis=1)
            return pd.Series(1 / (1 + np.exp(-(base + BoostedTrees.margins(x, *trees)))))

        return df.withColumn(out, p(*[F.col(c).cast("double") for c in self.features]))

    def importance(self) -> list[tuple[str, float]]:
        """Mean gain of each feature's splits as a share of all, largest first."""
        inner = self.nodes[self.nodes["feature"] >= 0]
        mean = inner.groupby("feature")["gain"].mean()
        total = float(mean.sum()) or 1.0
        return sorted(((c, float(mean.get(i, 0.0)) / total) for i, c in enumerate(self.features)), key=lambda x: -x[1])

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(
            [(-1, 0, -1, None, self.base, 0.0, 0.0), *self.nodes.astype(object).where(self.nodes.notna(), None)
             .itertuples(index=False, name=None)], NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/boosted")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "BoostedTrees":
        n = spark.read.parquet(f"{path}/boosted").toPandas()
        trees = n[n["tree"] >= 0].sort_values(["tree", "node"]).reset_index(drop=True)
        return cls(trees, float(n.loc[n["tree"] < 0, "value"].iloc[0]))


def first_tree_sql(source: str, p: Params, features: list[str] = FEATURES, bins: int = BINS, label: str = "is_threat") -> str:
    """DuckDB SQL (to go on behind a WITH clause) for the nodes of the first
    tree: the same bins, sums and gains, one block of CTEs for each level."""
    n = len(features)
    edges = ",\n".join(f"""e{i} AS (SELECT list(DISTINCT x ORDER BY x) AS e FROM (
  SELECT {c}::DOUBLE AS x, row_number() OVER (ORDER BY {c}) AS r, count(*) OVER () AS n FROM {source})
  WHERE r IN (SELECT ceil(n * i / {bins}.0::DOUBLE) FROM range(1, {bins}) t(i)))""" for i, c in enumerate(features))
    prob = p.base
    g = f"sum(CASE WHEN {label} = 1 THEN {p.positive_weight * (prob - 1)}::DOUBLE ELSE {prob}::DOUBLE END)"
    h = f"sum(CASE WHEN {label} = 1 THEN {p.positive_weight * prob * (1 - prob)}::DOUBLE ELSE {prob * (1 - prob)}::DOUBLE END)"
    cols = ", ".join(f"len(list_filter(e{i}.e, lambda v: v < {c}::DOUBLE)) AS b{i}" for i, c in enumerate(features))
    out = [edges, f"c0 AS MATERIALIZED (SELECT 1 AS node, b0, {', '.join(f'b{i}' for i in range(1, n))}, {g} AS g, {h} AS h "
           f"FROM (SELECT {label}, {cols} FROM {source}, {', '.join(f'e{i}' for i in range(n))}) GROUP BY ALL)"]
    l2 = f"{p.l2}::DOUBLE"
    for d in range(p.depth):
        feature_rows = " UNION ALL ".join(f"SELECT node, {i} AS f, b{i} AS b, g, h FROM c{d}" for i in range(n))
        out.append(f"""h{d} AS (SELECT node, f, b, sum(g) AS g, sum(h) AS h FROM ({feature_rows}) GROUP BY ALL),
l{d} AS (SELECT node, f, b, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER a AS g, sum(h) OVER a AS h FROM h{d}
  WINDOW w AS (PARTITION BY node, f ORDER BY b), a AS (PARTITION BY node, f)),
s{d} AS MATERIALIZED (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, b) AS r FROM (
    SELECT *, 0.5::DOUBLE * (gl * gl / (hl + {l2}) + (g - gl) * (g - gl) / (h - hl + {l2}) - g * g / (h + {l2})) AS gain
    FROM l{d} WHERE hl >= {p.least_cover} AND h - hl >= {p.least_cover})) WHERE r = 1 AND gain > {LEAST_GAIN}),
t{d} AS MATERIALIZED (SELECT node, sum(g) AS g, sum(h) AS h FROM c{d} GROUP BY node),
c{d + 1} AS MATERIALIZED (SELECT 2 * c.node + CASE WHEN CASE f {' '.join(f'WHEN {i} THEN c.b{i}' for i in range(n))} END <= s.b THEN 0 ELSE 1 END AS node,
  {', '.join(f'c.b{i}' for i in range(n))}, c.g, c.h FROM c{d} c JOIN s{d} s ON c.node = s.node)""")
    out.append(f"t{p.depth} AS (SELECT node, sum(g) AS g, sum(h) AS h FROM c{p.depth} GROUP BY node)")
    at = "CASE f " + " ".join(f"WHEN {i} THEN (SELECT e[s.b + 1] FROM e{i})" for i in range(n)) + " END"
    name = "CASE f " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(features)) + " END"
    rows = " UNION ALL ".join(
        f"SELECT t.node, {name} AS feature, {at} AS threshold, gain, t.g, t.h FROM t{d} t LEFT JOIN s{d} s ON t.node = s.node"
        if d < p.depth else f"SELECT node, NULL, NULL, NULL, g, h FROM t{d}" for d in range(p.depth + 1))
    return ", " + ",\n".join(out) + f"""
SELECT node::INT AS node, feature, threshold, round(gain, 6) AS gain, round(h, 6) AS cover,
  round(-g / (h + {l2}) * {p.step}::DOUBLE, 6) AS value FROM ({rows})"""
