"""Explanation invariants: exact SHAP (additivity, brute force over all
coalitions, forest probability equals Spark's), LIME shape and split."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from vigil.operators import explain as X
from vigil.operators import forest as FO
from vigil.operators import ml as ML
from vigil.operators.forest import stitch
from vigil.schema import FEATURES
from vigil.sources.fixture import security_logs


@pytest.fixture(scope="module")
def forest(spark):
    logs = ML.prepare_features(security_logs(spark, SF_SMALL))
    train, test = ML.split(logs)
    model = ML.train_forest(train, trees=10)
    return logs, train, test, model


def test_split_is_disjoint_and_complete(spark, forest):
    logs, train, test, _ = forest
    assert train.count() + test.count() == logs.count()
    assert train.join(test, "event_id").count() == 0


def test_shap_additive_and_equal_to_model(spark, forest):
    logs, _, _, model = forest
    sh = ML.score(model, X.tree_shap(logs, model), "p_model").toPandas()
    phi = sh[[f"phi_{c}" for c in FEATURES]].sum(axis=1) + sh["base"]
    assert np.abs(phi - sh["p_model"]).max() < 1e-9
    assert np.abs(sh["p_forest"] - sh["p_model"]).max() < 1e-9
    assert len(sh) == logs.count()


def plain_value(tree, x, known, node=0):
    """v(S) of one row by recursion."""
    feature, threshold, left, right, value, cover = tree
    f = feature[node]
    if f < 0:
        return value[node]
    if f in known:
        return plain_value(tree, x, known, left[node] if x[f] <= threshold[node] else right[node])
    return sum(cover[c] / cover[node] * plain_value(tree, x, known, c) for c in (left[node], right[node]))


@pytest.mark.parametrize("frontier", [1 << 19, 50])
def test_shap_matches_brute_force(spark, forest, monkeypatch, frontier):
    monkeypatch.setattr(X, "FRONTIER", frontier)
    logs, _, _, model = forest
    trees = [t for piece in model.pieces(spark) for t in stitch(piece).values()]
    x = logs.select(*FEATURES).orderBy(F.col("files_accessed").desc()).limit(40).toPandas().to_numpy(float)[::9]
    phi, base, p = X.shap_values(x, trees)
    m = len(FEATURES)
    for r in range(len(x)):
        v = {s: sum(plain_value(t, x[r], s) for t in trees)
             for k in range(m + 1) for s in itertools.combinations(range(m), k)}
        assert abs(base[r] - v[()]) < 1e-9 and abs(p[r] - v[tuple(range(m))]) < 1e-9
        for i in range(m):
            want = sum(math.factorial(len(s)) * math.factorial(m - len(s) - 1) / math.factorial(m)
                       * (v[tuple(sorted((*s, i)))] - v[s]) for s in v if i not in s)
            assert abs(want - phi[r, i]) < 1e-9


def test_lime_weights(spark, forest):
    logs, train, _, model = forest
    inst = logs.orderBy(F.xxhash64(F.lit(1), "event_id")).limit(3)
    w = X.lime_explain(model, train, inst, num_samples=500).toPandas()
    assert len(w) == 3 * len(FEATURES)
    assert w["condition"].notna().all()
    assert set(w["feature"]) == set(FEATURES)


def test_lime_cells_equal_a_plain_weighted_ridge():
    """Fits per cell, with the own prediction put in afterwards, equal the
    regression over explicit samples."""
    rng = np.random.default_rng(0)
    bins = rng.integers(0, 4, (300, 6))
    y = rng.random(300)
    pats, inv = np.unique(bins, axis=0, return_inverse=True)
    count, ysum = np.bincount(inv.ravel()).astype(float), np.bincount(inv.ravel(), weights=y)
    cells = rng.integers(0, 4, (5, 6))
    fits = X.cell_fits(pats, count, ysum, cells)
    for cell, fit in zip(cells, fits):
        own = rng.random()
        z = np.vstack([np.ones(6), (bins == cell)]).astype(float)
        t = np.append(own, y)
        w = np.sqrt(np.exp(-((1 - z) ** 2).sum(1) / (0.75 ** 2 * 6)))
        zc, tc = z - (w @ z) / w.sum(), t - (w @ t) / w.sum()
        beta = np.linalg.solve(zc.T @ (zc * w[:, None]) + np.eye(6), zc.T @ (w * tc))
        assert np.allclose(fit[:6] + fit[6:12] * own, beta)
        assert np.isclose(fit[12] + fit[13] * own, (w @ t - (w @ z) @ beta) / w.sum())


def test_shap_of_a_forest_in_pieces(spark, forest, monkeypatch):
    logs, _, _, model = forest
    some = logs.limit(20)
    whole = {r.event_id: r for r in X.tree_shap(some, model).collect()}
    monkeypatch.setattr(FO, "PIECE_NODES", 3 * model.table(spark).count() // model.trees)
    assert len(list(model.pieces(spark))) > 2
    parts = X.tree_shap(some, model).collect()
    assert len(parts) == len(whole) == 20
    for r in parts:
        w = whole[r.event_id]
        assert np.isclose(r.base, w.base) and np.isclose(r.p_forest, w.p_forest)
        assert all(np.isclose(r[f"phi_{c}"], w[f"phi_{c}"]) for c in FEATURES)


def test_normal_quantile(spark):
    from statistics import NormalDist

    from vigil.functions.normal import normal_quantile
    p = [1e-12, 1e-6, 0.01, 0.02425, 0.3, 0.5, 0.77, 0.97575, 0.999, 1 - 1e-9]
    got = [r.q for r in spark.createDataFrame([(x,) for x in p], "p double").select(normal_quantile(F.col("p")).alias("q")).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(x) for x in p], rtol=2e-9, atol=1e-9)


def test_perturbations_lie_inside_their_bins(spark, forest):
    """Truncated, not clipped: hardly any draw lies on an edge, and the values
    of a bin follow the truncated distribution."""
    logs, train, _, _ = forest
    bins = X.lime_bins(train)
    c = "files_accessed"
    s = X._perturbations(spark, bins, 20000, 7, FEATURES).select(f"sb_{c}", c).toPandas()
    st = bins["stats"][bins["stats"]["feature"] == c].sort_values("bin")
    ends = [st["lo"].min(), *bins["edges"][c], st["hi"].max()]
    rng = np.random.default_rng(3)
    for _, r in st.iterrows():
        x = s.loc[s[f"sb_{c}"] == r["bin"], c].to_numpy()
        lo, hi = ends[int(r["bin"])], ends[int(r["bin"]) + 1]
        assert x.min() >= lo and x.max() <= hi
        assert ((x == lo) | (x == hi)).mean() == 0
        z = rng.normal(r["mean"], r["std"], 400_000)
        z = z[(z > lo) & (z < hi)]
        assert np.allclose(np.quantile(x, [.1, .5, .9]), np.quantile(z, [.1, .5, .9]), atol=0.06 * (hi - lo))


def test_text_lines(spark):
    w = spark.createDataFrame([(1, "a", 0.25, "a > 1.00", "🔺 Increases threat"), (1, "b", -0.5, "b <= 2.00", "🔻 Decreases threat"),
                               (1, "c", 0.0004, "c", "🔺 Increases threat"), (1, "d", 0.01, "d", "🔺 Increases threat")],
                              "event_id int, feature string, weight double, condition string, direction string")
    lines = [r.line for r in X.lime_lines(w).orderBy("pos").collect()]
    assert lines[0] == f"  🔻 Decreases threat {'b <= 2.00':25s} {'█' * 40} (-0.500)"
    assert lines[1] == f"  🔺 Increases threat {'a > 1.00':25s} {'█' * 25} (+0.250)"
    assert lines[3] == f"  🔺 Increases threat {'c':25s}  (+0.000)"
    assert [r.line for r in X.lime_key_factors(w).orderBy("pos").collect()] == [
        "     ✅ Safe: b <= 2.00 (-0.500)", "     ⚠️ Risk: a > 1.00 (+0.250)", "     ⚠️ Risk: d (+0.010)"]
    row = spark.createDataFrame([(1, 3.0, 8000.0, 0.25, -1.5)], "event_id int, h double, f double, phi_h double, phi_f double")
    assert [r.line for r in X.shap_lines(row, features=["h", "f"]).orderBy("pos").collect()] == [
        f"  🔻 SAFE {'f':20s} = {8000.0:8.1f} | {-1.5:+.3f} {'█' * 50}", f"  🔺 RISK {'h':20s} = {3.0:8.1f} | {0.25:+.3f} {'█' * 12}"]


def test_vectors_that_no_threshold_tells_apart_are_walked_once(monkeypatch):
    rng = np.random.default_rng(5)
    # a root on feature 0 at 10, below it feature 1 at 3
    tree = (np.array([0, 1, -1, -1, -1]), np.array([10.0, 3.0, 0, 0, 0]), np.array([1, 3, -1, -1, -1]), np.array([2, 4, -1, -1, -1]),
            np.array([0, 0, 0.9, 0.1, 0.4]), np.array([10.0, 6, 4, 2, 4]))
    x = rng.integers(0, 1000, (500, 3)).astype(float)
    x[::3, 0] %= 12
    x[::2, 1] %= 5
    sizes = []
    walk = X.coalition_values
    monkeypatch.setattr(X, "coalition_values", lambda rows, t: sizes.append(len(rows)) or walk(rows, t))
    phi, base, p = X.shap_values(x, [tree, tree])
    assert sizes[0] <= 4  # two cells of either feature
    for i in rng.integers(0, 500, 20):
        one = X.shap_values(x[i:i + 1], [tree, tree])
        assert np.allclose(phi[i], one[0][0]) and np.isclose(base[i], one[1][0]) and np.isclose(p[i], one[2][0])
    assert np.allclose(phi.sum(1) + base, p)


def test_batches_are_filled_across_record_batches():
    import pyarrow as pa
    parts = [pa.RecordBatch.from_arrays([pa.array(range(a, b))], ["v"]) for a, b in ((0, 3), (3, 3), (3, 10), (10, 11))]
    got = [b.column("v").to_pylist() for b in X.in_batches(iter(parts), 4)]
    assert got == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10]]
