"""Forest of pure trees: hand-off, scoring, pieces and persistence."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from vigil.operators import explain as X
from vigil.operators import forest as FO
from vigil.operators import ml as ML
from vigil.schema import FEATURES
from vigil.sources.fixture import security_logs


@pytest.fixture(scope="module")
def logs(spark):
    """Events with a label that the features decide."""
    df = ML.prepare_features(security_logs(spark, SF_SMALL))
    return df.withColumn("is_threat", ((F.col("files_accessed") % 7 > 3) | (F.col("hour_of_day") == 3)).cast("int"))


def plain(tree, x, node=0):
    feature, threshold, left, right, value, _ = tree
    while feature[node] >= 0:
        node = left[node] if x[feature[node]] <= threshold[node] else right[node]
    return value[node]


@pytest.mark.parametrize("handoff", [1 << 18, 60])
def test_leaves_are_pure_and_scores_equal_a_plain_walk(spark, logs, monkeypatch, handoff):
    monkeypatch.setattr(FO, "HANDOFF", handoff)
    model = FO.fit(logs, "is_threat", trees=6)
    nodes = model.table(spark)
    assert (nodes.filter("unit = -1").count() > 0) == (handoff == 60)
    assert nodes.filter("feature < 0 AND w0 > 0 AND w1 > 0").count() == 0
    trees = FO.stitch(nodes.toPandas())
    assert sorted(trees) == list(range(6))
    got = ML.score(model, logs, "p").select(*FEATURES, "p").toPandas()
    x = got[FEATURES].to_numpy(float)
    want = [np.mean([plain(t, r) for t in trees.values()]) for r in x]
    assert np.allclose(got["p"], want, atol=1e-12)


def test_a_node_weighs_as_much_as_its_children(spark, logs, monkeypatch):
    monkeypatch.setattr(FO, "HANDOFF", 100)
    model = FO.fit(logs, "is_threat", trees=3)
    drawn = {t: sum(v[5][0] for v in [tree]) for t, tree in FO.stitch(model.table(spark).toPandas()).items()}
    for t, (feature, _, left, right, _, cover) in FO.stitch(model.table(spark).toPandas()).items():
        inner = feature >= 0
        assert np.allclose(cover[inner], cover[left[inner]] + cover[right[inner]])
        assert abs(drawn[t] - logs.count()) < 6 * logs.count() ** 0.5  # a bootstrap of all rows


def test_fits_repeat_under_another_partitioning(spark, logs):
    a, b = (FO.fit(d, "is_threat", trees=3) for d in (logs, logs.repartition(7, "hour_of_day")))
    rows = [sorted(map(str, m.table(spark).collect())) for m in (a, b)]
    assert rows[0] == rows[1]


def test_unlike_labels_of_equal_rows_share_a_leaf(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, 1.0, 1.0, y) for y in (0, 0, 0, 1)] * 50,
                               ", ".join(f"{c} double" for c in FEATURES) + ", is_threat int")
    model = FO.fit(df, "is_threat", trees=20)
    p = ML.score(model, df.limit(1), "p").first().p
    assert abs(p - 0.25) < 0.05 and model.table(spark).count() == 20


def test_trees_above_the_piece_go_unit_by_unit(spark, logs, monkeypatch):
    monkeypatch.setattr(FO, "HANDOFF", 60)
    model = FO.fit(logs, "is_threat", trees=3)
    some = logs.limit(30)
    whole = {r.event_id: r for r in ML.score(model, X.tree_shap(some, model), "p").collect()}
    monkeypatch.setattr(FO, "PIECE_NODES", model.table(spark).count() // 9)
    assert len(list(model.pieces(spark))) > 6
    for r in ML.score(model, X.tree_shap(some, model), "p").collect():
        w = whole[r.event_id]
        assert np.isclose(r.p, w.p) and np.isclose(r.base, w.base) and np.isclose(r.p_forest, w.p)
        assert all(np.isclose(r[f"phi_{c}"], w[f"phi_{c}"]) for c in FEATURES)


def test_saved_forest_scores_alike(spark, logs, tmp_path):
    model = FO.fit(logs, "is_threat", trees=4)
    ML.save_model(model, str(tmp_path / "m"))
    again = ML.load_first(spark, [str(tmp_path / "m")])
    assert ML.score(again, ML.score(model, logs, "a"), "b").filter("a <> b").count() == 0
    assert sum(v for _, v in ML.feature_importance(again)) == pytest.approx(1)


def test_poisson_draws():
    rng = np.random.default_rng(0)
    for mean in (0.0, 1.0, 7.0, 500.0):
        k = FO.poisson(np.full(40000, mean), rng.random(40000), rng.random(40000))
        assert abs(k.mean() - mean) < 0.02 * max(1, mean) and abs(k.var() - mean) < 0.05 * max(1, mean)


def test_cells_are_cut_among_tasks_however_few_bytes_they_are(spark, logs, monkeypatch):
    """Merged by size, one task drew the cells for all trees."""
    tables = []
    monkeypatch.setattr(FO, "_subtrees", lambda table, *rest, f=FO._subtrees: tables.append(table) or f(table, *rest))
    FO.fit(logs, "is_threat", trees=2)
    assert tables[0].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_sizes_of_children_come_with_the_split(spark, logs, monkeypatch):
    """Drawn cells of both sides are those that a count of the table gives; no
    level needs a pass of its own for them."""
    monkeypatch.setattr(FO, "HANDOFF", 60)
    passes, said, counted = [], [], []
    large, best = FO._large, FO._best_splits

    def counts(table, top, nodes, features, seed):
        passes.append(1)
        return large(table, top, nodes, features, seed)

    def splits(*args):
        found = best(*args)
        said.extend((r.tree, r.node, r.n_left + r.n_right) for r in found.collect())
        return found

    def sums(table, top, nodes, edges, features, seed, f=FO._histograms):
        out = f(table, top, nodes, edges, features, seed)
        held = out.filter("feature = 0").groupBy("tree", "node").agg(F.sum("n").alias("n"))
        counted.extend((r.tree, r.node, r.n) for r in held.collect())
        assert all(n > 60 for _, _, n in counted)  # only nodes above the bound are split on Spark
        return out

    for name, f in (("_large", counts), ("_best_splits", splits), ("_histograms", sums)):
        monkeypatch.setattr(FO, name, f)
    model = FO.fit(logs, "is_threat", trees=2)
    assert len(passes) == 1 and set(said) <= set(counted) and len(said) > 4
    # units hold at most the bound, all of what the tree draws
    assert model.table(spark).filter("unit >= 0").groupBy("tree", "unit").count().filter("count > 2 * 60").count() == 0


def test_feature_orders_of_many_nodes():
    many = FO.feature_order(3, np.arange(70), 6, 42)
    assert [r.tolist() for r in many] == [FO.feature_order(3, i, 6, 42).tolist() for i in range(70)]
