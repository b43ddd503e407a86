"""Model explanations: exact tree SHAP for forests, LIME-style local weights.

Tree SHAP (path-dependent, as for tree ensembles without background data):
for a coalition S of features, a tree's value v(S) follows the row at splits
on features of S and takes both sides, by their share of rows, at the others;
the forest's value is the mean over trees, and phi_i is the Shapley
combination of v over coalitions.

Scale: v(S) of a tree depends on a row only through the cells that the tree's
thresholds cut the features of S into.  A task takes a batch of distinct
feature vectors, finds for every tree and coalition the distinct cells among
them, and walks all of these down the tree together, one level at a time; a
walk only visits nodes that the coalition can reach.  Vectors are sorted
before, so that a batch holds few cells, and vectors that no threshold of any
tree tells apart are explained once a batch.  No row meets a leaf that it can't
reach, nothing is shuffled per tree, and rows are joined to vectors once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.normal import truncated_normal, truncation
from vigil.functions.text import scaled_bar
from vigil.operators.forest import Forest, stitch
from vigil.schema import FEATURES
from vigil.session import write_once


# ----------------------------------------------------------------- forest structure
def _shapley_weights(m: int) -> np.ndarray:
    return np.array([math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)])


def _shapley_matrix(m: int) -> np.ndarray:
    """phi = values of all coalitions (by bit mask) @ this matrix."""
    w, out = _shapley_weights(m), np.zeros((1 << m, m))
    for s in range(1 << m):
        for i in range(m):
            if s >> i & 1:
                out[s, i] += w[s.bit_count() - 1]
            else:
                out[s, i] -= w[s.bit_count()]
    return out


BATCH = 1 << 15     # vectors a task explains at a time
FRONTIER = 1 << 19  # walks that are moved on at a time


def coalition_values(x: np.ndarray, tree: tuple) -> np.ndarray:
    """v(S) of one tree for every row of ``x`` and bit mask S: (rows, 2^M)."""
    feature, threshold, left, right, value, cover = tree
    n, m = x.shape
    cuts = [np.unique(threshold[feature == f]) for f in range(m)]
    bins = [np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)]
    used = [f for f in range(m) if len(cuts[f])]
    slot_of, rows, masks = {}, [], []
    size = 0
    for s in range(1 << m):
        if any(s >> f & 1 and f not in used for f in range(m)):
            continue  # a feature without a split changes nothing
        code = np.zeros(n, np.int64)
        for f in used:
            if s >> f & 1:
                code = code * (len(cuts[f]) + 1) + bins[f]
        _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
        slot_of[s] = size + inverse.ravel()
        rows.append(first)
        masks.append(np.full(len(first), s))
        size += len(first)
    total = np.zeros(size)
    share = np.divide(cover[left], cover, out=np.zeros(len(cover)), where=cover > 0)
    stack = [(np.arange(size), np.concatenate(rows), np.concatenate(masks), np.zeros(size, np.int64), np.ones(size))]
    while stack:
        slot, row, mask, node, weight = stack.pop()
        if len(slot) > FRONTIER:
            half = len(slot) // 2
            stack += [tuple(a[:half] for a in (slot, row, mask, node, weight)),
                      tuple(a[half:] for a in (slot, row, mask, node, weight))]
            continue
        f = feature[node]
        end = f < 0
        if end.any():
            total += np.bincount(slot[end], weight[end] * value[node[end]], size)
            slot, row, mask, node, weight, f = (a[~end] for a in (slot, row, mask, node, weight, f))
        if not len(slot):
            continue
        known = (mask >> f & 1).astype(bool)
        one = np.flatnonzero(known)
        both = np.flatnonzero(~known)
        to = np.where(x[row[one], f[one]] <= threshold[node[one]], left[node[one]], right[node[one]])
        part = share[node[both]]
        stack.append((np.concatenate([slot[one], slot[both], slot[both]]), np.concatenate([row[one], row[both], row[both]]),
                      np.concatenate([mask[one], mask[both], mask[both]]),
                      np.concatenate([to, left[node[both]], right[node[both]]]),
                      np.concatenate([weight[one], weight[both] * part, weight[both] * (1 - part)])))
    out = np.empty((n, 1 << m))
    have = sum(1 << f for f in used)
    for s in range(1 << m):
        out[:, s] = total[slot_of[s & have]]
    return out


def shap_values(x: np.ndarray, trees: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over ``trees`` of phi (n, M), of the base value and of the
    prediction (n)."""
    m = x.shape[1]
    combine = _shapley_matrix(m)
    first, alike = told_apart(x, trees)
    x = x[first]
    phi, base, p = np.zeros(x.shape), np.zeros(len(x)), np.zeros(len(x))
    for tree in trees:
        v = coalition_values(x, tree)
        phi += v @ combine
        base += v[:, 0]
        p += v[:, -1]
    return phi[alike], base[alike], p[alike]


def told_apart(x: np.ndarray, trees: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x``, one of each set that no threshold tells apart, and for
    every row the place of its own among them."""
    code = np.zeros(len(x), np.int64)
    for f in range(x.shape[1]):
        cuts = np.unique(np.concatenate([threshold[feature == f] for feature, threshold, *_ in trees]))
        _, bins = np.unique(np.searchsorted(cuts, x[:, f]), return_inverse=True)
        # numbered anew after each feature, so codes stay below the rows squared
        _, first, code = np.unique(code * (bins.max(initial=0) + 1) + bins, return_index=True, return_inverse=True)
    return first, code


def in_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of an iterator of record batches, ``size`` at a time."""
    held, n = [], 0
    for rb in batches:
        while rb.num_rows:
            part = rb.slice(0, size - n)
            rb = rb.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


# ----------------------------------------------------------------- distributed SHAP
def vectors(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Distinct feature vectors (DOUBLE) with their row counts."""
    return df.select(*[F.col(c).cast("double").alias(c) for c in features]).groupBy(*features).agg(
        F.count(F.lit(1)).alias("rows"))


def vector_shap(rows: DataFrame, model: Forest, features: list[str] = FEATURES) -> DataFrame:
    """``phi_<feature>``, ``base`` and ``p_forest`` of every distinct vector."""
    spark = rows.sparkSession
    sums = [f"phi_{c}" for c in features] + ["base", "p_forest"]
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in features] + [T.StructField("rows", T.LongType())]
                          + [T.StructField(c, T.DoubleType()) for c in sums])
    # few values first: vectors of a batch then differ in few features
    order = ["login_attempts", "hour_of_day", "foreign_ip", "unknown_device"]
    order = [c for c in order if c in features] + [c for c in features if c not in order]
    rows = write_once(rows, "vectors")
    # a task has about a batch, for a walk serves all its rows; work for every
    # core, and less uneven work, comes from tasks for some of the trees each
    parts = max(1, -(-rows.count() // (BATCH * 3 // 4)))
    groups = max(4, -(-2 * spark.sparkContext.defaultParallelism // parts))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def add_up(trees: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(trees)  # at most PIECE_NODES nodes
        count = model.trees

        def run(batches):
            for part in in_batches(batches, BATCH):
                x = np.stack([part.column(c).to_numpy() for c in features], axis=1)
                phi, base, p = shap_values(x, shared.value)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in [*features, "rows"]),
                     *(pa.array(phi[:, i] / count) for i in range(len(features))), pa.array(base / count), pa.array(p / count)],
                    schema.names)

        return placed.select(*features, "rows").mapInArrow(run, schema)

    # the values add up over trees: a forest of any size goes piece by piece
    pieces = []
    for trees in (list(stitch(nodes).values()) for nodes in model.pieces(spark)):
        n = min(groups, len(trees))
        pieces += [add_up(trees[i::n]) for i in range(n)]
    total = pieces[0]
    for piece in pieces[1:]:
        total = total.unionByName(piece)
    if len(pieces) == 1:
        return total
    return total.groupBy(*features, "rows").agg(*[F.sum(c).alias(c) for c in sums])


def tree_shap(df: DataFrame, model: Forest, features: list[str] = FEATURES) -> DataFrame:
    """Per-row SHAP values (``phi_<feature>``), base value and the
    forest's probability; ``sum(phi) + base == p_forest``."""
    return with_shap(df, vector_shap(vectors(df, features), model, features), features)


def with_shap(df: DataFrame, shap: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Rows of ``df`` with the values of their vectors."""
    keys = shap.drop("rows").withColumnsRenamed({c: f"_v_{c}" for c in features})
    same = [F.col(c).cast("double") == F.col(f"_v_{c}") for c in features]
    return df.join(keys, same).drop(*[f"_v_{c}" for c in features])


def shap_importance(df: DataFrame, model: Forest, features: list[str] = FEATURES) -> DataFrame:
    """Mean |phi| per feature over all rows, its share of the total, and a
    bar; computed from distinct vectors weighted by their row counts."""
    return importance_of(vector_shap(vectors(df, features), model, features), features)


def importance_of(shap: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """M20 from SHAP values per vector and the vectors' row counts, in one pass."""
    total_rows = F.sum("rows")
    agg = shap.agg(*[(F.sum(F.abs(F.col(f"phi_{c}")) * F.col("rows")) / total_rows).alias(c) for c in features])
    long = agg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance"))
                                          for c in features])).alias("e")).select("e.*")
    w = Window.partitionBy(F.lit(0))  # six rows
    out = long.withColumn("percentage", F.lit(100.0) * F.col("importance") / F.sum("importance").over(w))
    return out.withColumn("bar", F.repeat(F.lit("█"), F.col("percentage").cast("int"))) \
              .orderBy(F.col("importance").desc())


def top_k_reasons(contrib: DataFrame, key: str, k: int = 3, features: list[str] = FEATURES,
                  prefix: str = "phi_") -> DataFrame:
    """The ``k`` largest |contributions| per row with direction text."""
    # six numbers are sorted inside the row: no event is shuffled
    ordered = F.slice(F.array_sort(F.array(*[
        F.struct((-F.abs(F.col(f"{prefix}{c}"))).alias("o"), F.lit(c).alias("feature"),
                 F.col(f"{prefix}{c}").alias("contribution")) for c in features])), 1, k)
    return contrib.select(key, F.posexplode(ordered).alias("p", "e")).select(
        key, "e.feature", "e.contribution", (F.col("p") + 1).alias("rank"),
        F.when(F.col("e.contribution") > 0, "🔺 RISK").otherwise("🔻 SAFE").alias("direction"))


# ----------------------------------------------------------------- LIME
# Fixed values that must equal the reference's for identical results.
LIME_KERNEL_WIDTH_FACTOR = 0.75     # kernel width = 0.75 * sqrt(#features)
LIME_RIDGE_ALPHA = 1.0
LIME_QUANTILES = [0.25, 0.5, 0.75]


def _u(seed: int, *cols) -> "F.Column":
    """Uniform (0, 1) from a seeded 64-bit hash (repeatable, partition-independent)."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.pmod(h, F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)


def lime_bins(train: DataFrame, features: list[str] = FEATURES) -> dict:
    """Quartile edges per feature (duplicates removed) and per-bin statistics
    (frequency, mean, std, min, max) of the training data: 6 x <=4 rows."""
    # quantile sketch (bounded memory), not the exact percentile that gathers
    # every distinct value into one task
    q = train.agg(*[F.percentile_approx(F.col(c).cast("double"), LIME_QUANTILES, 10000).alias(c)
                    for c in features]).first()
    edges = {c: sorted(set(float(v) for v in q[c])) for c in features}

    def bin_of(c):
        e = edges[c]
        x = F.col(c).cast("double")
        expr = F.lit(len(e))
        for i in reversed(range(len(e))):
            expr = F.when(x <= e[i], F.lit(i)).otherwise(expr)
        return expr

    stacked = train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), bin_of(c).alias("bin"), F.col(c).cast("double").alias("x"))
        for c in features])).alias("e")).select("e.*")
    stats = stacked.groupBy("feature", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"),
        F.min("x").alias("lo"), F.max("x").alias("hi")).toPandas()
    return {"edges": edges, "stats": stats, "bin_of": bin_of}


def _bin_names(feature: str, edges: list[float]) -> list[str]:
    names = [f"{feature} <= {edges[0]:.2f}"]
    names += [f"{edges[i - 1]:.2f} < {feature} <= {edges[i]:.2f}" for i in range(1, len(edges))]
    names.append(f"{feature} > {edges[-1]:.2f}")
    return names


def _perturbations(spark, bins: dict, num_samples: int, seed: int, features: list[str]) -> DataFrame:
    """Samples 1.. of LIME: the bin by the training frequencies, the value
    normal (mean and deviation of the bin's rows) truncated to the bin's
    edges, drawn by a seeded hash."""
    st = bins["stats"]
    samples = spark.range(1, num_samples).withColumnRenamed("id", "s")
    for c in features:
        rows = st[st["feature"] == c].sort_values("bin")
        total = float(rows["n"].sum())
        ends = [float(rows["lo"].min()), *bins["edges"][c], float(rows["hi"].max())]
        cum, picks = 0.0, []
        for _, r in rows.iterrows():  # at most four bins a feature
            cum += r["n"] / total
            picks.append((cum, int(r["bin"]), r))
        u, v = (_u(seed + i, F.col("s"), F.lit(c)) for i in range(2))
        pick = F.lit(picks[-1][1])
        for cum_p, b, _ in reversed(picks[:-1]):
            pick = F.when(u <= cum_p, F.lit(b)).otherwise(pick)
        terms = {b: truncation(float(r["mean"]), float(r["std"]), ends[b], ends[b + 1]) for _, b, r in picks}
        of_bin = [F.element_at(F.array(*[F.lit(float(terms.get(b, (0.0,) * 6)[i])) for b in range(len(ends) - 1)]),
                               F.col(f"sb_{c}") + 1) for i in range(6)]
        val = truncated_normal(v, *of_bin)
        samples = samples.withColumn(f"sb_{c}", pick).withColumn(c, val)
    return samples


def cell_fits(patterns: np.ndarray, count: np.ndarray, ysum: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Ridge fits of bin cells: for each cell (row) the weights at prediction
    zero, their slope in the own prediction, and the same for the intercept.

    A perturbation counts for a cell only through which of its bins agree, so
    the perturbations are given by bin pattern (count and sum of scores); the
    instance itself is sample 0 (all bins agree, weight 1)."""
    m = patterns.shape[1]
    width2 = (LIME_KERNEL_WIDTH_FACTOR ** 2) * m
    out = np.empty((len(cells), 2 * m + 2))
    for lo in range(0, len(cells), 64):  # one stacked solve for many cells
        z = (patterns[None] == cells[lo:lo + 64, None]).astype(float)
        w = np.sqrt(np.exp(-(m - z.sum(2)) / width2))
        wn, wy = w * count, w * ysum
        sw = wn.sum(1) + 1
        zbar = (np.einsum("cp,cpf->cf", wn, z) + 1) / sw[:, None]
        a = np.einsum("cpf,cp,cpg->cfg", z, wn, z, optimize=True) + 1 \
            - sw[:, None, None] * zbar[:, :, None] * zbar[:, None, :] + LIME_RIDGE_ALPHA * np.eye(m)
        right = np.stack([np.einsum("cp,cpf->cf", wy, z) - zbar * wy.sum(1)[:, None], 1 - zbar], 2)
        solved = np.linalg.solve(a, right)
        icept = np.stack([wy.sum(1), np.ones(len(sw))], 1) / sw[:, None] - np.einsum("cf,cfk->ck", zbar, solved)
        out[lo:lo + 64] = np.concatenate([solved[:, :, 0], solved[:, :, 1], icept], 1)
    return out


def lime_explain(model: Forest, train: DataFrame, instances: DataFrame, key: str = "event_id",
                 num_samples: int = 5000, seed: int = 42, features: list[str] = FEATURES) -> DataFrame:
    """Local linear weights per instance and feature, for any number of rows.

    All instances share one seeded set of perturbations, scored by the model
    once.  The exponential kernel and the binary 'same bin as the instance'
    representation make the weighted sums depend on an instance only through
    its cell of bins (at most 4 ** 6) and, linearly, its own prediction
    (sample 0).  So the ridge fits are solved per cell, and a row's weights are
    column arithmetic: nothing grows as rows x perturbations."""
    from vigil.operators import ml as ML
    spark = instances.sparkSession
    bins = lime_bins(train, features)
    ib = [f"ib_{c}" for c in features]
    scored = ML.score(model, _perturbations(spark, bins, num_samples, seed, features), "_y")
    per = scored.groupBy(*[f"sb_{c}" for c in features]).agg(F.count("*").alias("n"), F.sum("_y").alias("y")).toPandas()
    table = spark.sparkContext.broadcast((  # at most 4 ** 6 patterns
        per[[f"sb_{c}" for c in features]].to_numpy(), per["n"].to_numpy(float), per["y"].to_numpy(float)))
    base = ML.score(model, instances.select(key, *features), "prediction").select(
        key, "prediction", *[bins["bin_of"](c).alias(f"ib_{c}") for c in features])
    names = [f"a_{c}" for c in features] + [f"g_{c}" for c in features] + ["a_icept", "g_icept"]

    def solve(it):
        for pdf in it:
            fits = cell_fits(*table.value, pdf[ib].to_numpy())
            yield pd.concat([pdf[ib].reset_index(drop=True), pd.DataFrame(fits, columns=names)], axis=1)

    fits = base.select(*ib).distinct().mapInPandas(
        solve, ", ".join([f"{c} int" for c in ib] + [f"{n} double" for n in names]))
    rows = base.join(F.broadcast(fits), ib)  # at most 4 ** 6 cells
    y0 = F.col("prediction")

    def condition(c: str) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in _bin_names(c, bins["edges"][c])]), F.col(f"ib_{c}") + 1)

    parts = F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(f"a_{c}") + F.col(f"g_{c}") * y0).alias("weight"),
                               condition(c).alias("condition")) for c in features])
    return rows.select(key, "prediction", (F.col("a_icept") + F.col("g_icept") * y0).alias("intercept"),
                       F.explode(parts).alias("e")).select(
        key, "e.feature", "e.weight", "intercept", "prediction", "e.condition",
        F.when(F.col("e.weight") > 0, "🔺 Increases threat").otherwise("🔻 Decreases threat").alias("direction"))


def lime_impact_summary(weights: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Mean |weight| per base feature (conditions matched to their feature)."""
    return (weights.groupBy("feature").agg(F.avg(F.abs("weight")).alias("avg_impact"),
                                          F.count(F.lit(1)).alias("explanations"))
                   .withColumn("bar", F.repeat(F.lit("█"), (F.col("avg_impact") * 200).cast("int")))
                   .orderBy(F.col("avg_impact").desc()))


# ----------------------------------------------------------------- text lines
def lime_lines(weights: DataFrame, key: str = "event_id") -> DataFrame:
    """Lines of an explanation, the strongest condition first: direction,
    condition, a bar of |weight| x 100 up to 40, signed weight."""
    order = Window.partitionBy(key).orderBy(F.abs("weight").desc(), "feature")  # six rows a key
    return weights.select(
        key, F.row_number().over(order).alias("pos"),
        F.format_string("  %s %-25s %s (%+.3f)", "direction", "condition", scaled_bar(F.abs("weight"), 100, 40), "weight").alias("line"))


def lime_key_factors(weights: DataFrame, key: str = "event_id", k: int = 3) -> DataFrame:
    """The ``k`` strongest conditions of an explanation as risk or safe."""
    order = Window.partitionBy(key).orderBy(F.abs("weight").desc(), "feature")
    kind = F.when(F.col("weight") > 0, "⚠️ Risk").otherwise("✅ Safe")
    return weights.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k).select(
        key, "pos", F.format_string("     %s: %s (%+.3f)", kind, F.col("condition"), F.col("weight")).alias("line"))


def shap_lines(values: DataFrame, key: str = "event_id", features: list[str] = FEATURES) -> DataFrame:
    """Lines of an event's contributions (columns ``phi_<feature>`` beside the
    features), the strongest first: direction, feature, value, signed
    contribution, a bar of |contribution| x 50 up to 50."""
    ordered = F.array_sort(F.array(*[
        F.struct((-F.abs(F.col(f"phi_{c}"))).alias("o"), F.lit(c).alias("f"), F.col(c).cast("double").alias("x"),
                 F.col(f"phi_{c}").alias("phi")) for c in features]))
    direction = F.when(F.col("e.phi") > 0, "🔺 RISK").otherwise("🔻 SAFE")
    return values.select(key, F.posexplode(ordered).alias("p", "e")).select(
        key, (F.col("p") + 1).alias("pos"),
        F.format_string("  %s %-20s = %8.1f | %+.3f %s", direction, F.col("e.f"), F.col("e.x"), F.col("e.phi"),
                        scaled_bar(F.abs("e.phi"), 50, 50)).alias("line"))
