"""Second-order boosting: equal to a plain fold over rows, whatever the blocks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from vigil.operators import boosting as B
from vigil.operators import ml as ML
from vigil.schema import FEATURES
from vigil.sources.fixture import security_logs


def plain_fit(rows, labels, edges, p):
    """Margins of all rows after boosting by loops over rows, nodes and cuts."""
    bins = [[sum(e < x for e in es) for x, es in zip(r, edges)] for r in rows]
    margin = [math.log(p.base / (1 - p.base))] * len(rows)
    for _ in range(p.rounds):
        prob = [1 / (1 + math.exp(-m)) for m in margin]
        w = [p.positive_weight if y else 1.0 for y in labels]
        g = [a * (q - y) for a, q, y in zip(w, prob, labels)]
        h = [a * q * (1 - q) for a, q in zip(w, prob)]

        def leaf(part):
            return -sum(g[i] for i in part) / (sum(h[i] for i in part) + p.l2) * p.step

        def split(part, depth):
            best = (B.LEAST_GAIN, None)
            gs, hs = sum(g[i] for i in part), sum(h[i] for i in part)
            if depth < p.depth:
                for f in range(len(edges)):
                    for cut in sorted({bins[i][f] for i in part}):
                        gl = sum(g[i] for i in part if bins[i][f] <= cut)
                        hl = sum(h[i] for i in part if bins[i][f] <= cut)
                        if hl >= p.least_cover and hs - hl >= p.least_cover:
                            gain = 0.5 * (gl * gl / (hl + p.l2) + (gs - gl) ** 2 / (hs - hl + p.l2) - gs * gs / (hs + p.l2))
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, cut))
            if best[1] is None:
                for i in part:
                    margin[i] += leaf(part)
                return
            f, cut = best[1]
            split([i for i in part if bins[i][f] <= cut], depth + 1)
            split([i for i in part if bins[i][f] > cut], depth + 1)
        split(list(range(len(rows))), 0)
    return margin


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    rows = [(i, *[float(rng.choice([0, 1, 2, 5, 9, 14])) for _ in FEATURES]) for i in range(160)]
    rows = [(*r, int(r[2] + 2 * r[4] + rng.choice([0, 6]) > 16)) for r in rows]
    return rows, spark.createDataFrame(rows, "event_id long, " + ", ".join(f"{c} double" for c in FEATURES) + ", is_threat int")


PARAMS = B.Params(rounds=6, depth=3, step=0.3)


@pytest.mark.parametrize("block", [1 << 17, 40])
def test_probabilities_equal_a_plain_fold(spark, data, monkeypatch, block):
    rows, df = data
    monkeypatch.setattr(B, "BLOCK_CELLS", block)
    monkeypatch.setattr(B, "CHECKPOINT", 2)
    model = B.fit(df, "is_threat", PARAMS)
    margin = plain_fit([r[1:-1] for r in rows], [r[-1] for r in rows], B.quantile_edges(df), PARAMS)
    got = {r.event_id: r.p for r in model.probability(df, "p").collect()}
    assert all(abs(got[r[0]] - 1 / (1 + math.exp(-m))) < 1e-9 for r, m in zip(rows, margin))


def test_saved_model_scores_alike(spark, data, tmp_path):
    _, df = data
    model = B.fit(df, "is_threat", PARAMS)
    ML.save_model(model, str(tmp_path / "m"))
    again = ML.load_first(spark, [str(tmp_path / "none"), str(tmp_path / "m")])
    both = ML.score(again, ML.score(model, df, "a"), "b")
    assert both.filter("a <> b").count() == 0
    assert sum(v for _, v in ML.feature_importance(again)) == pytest.approx(1)


def test_cells_hold_every_row(spark):
    logs = ML.prepare_features(security_logs(spark, SF_SMALL))
    edges = B.quantile_edges(logs)
    c = B.cells(logs, edges, "is_threat").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    assert (c.p, c.n) == (logs.filter("is_threat = 1").count(), logs.filter("is_threat = 0").count())
    for name, es in zip(FEATURES, edges):
        for r in B.with_bins(logs, edges).select(name, f"bin_{name}").distinct().collect():
            assert r[1] == sum(e < r[0] for e in es)


def test_one_class_and_no_rows(spark, data):
    _, df = data
    same = B.fit(df.filter("is_threat = 0"), "is_threat", B.Params(rounds=3))
    p = same.probability(df, "p").agg(F.min("p"), F.max("p")).first()
    assert p[0] == p[1] < 0.5  # one leaf: nothing to split
    none = B.fit(df.limit(0), "is_threat", B.Params(rounds=3))
    assert none.probability(df, "p").filter("p <> 0.5").count() == 0


def test_weights_raise_the_recall(spark):
    logs = ML.prepare_features(security_logs(spark, SF_SMALL))
    light, heavy = (ML.train_boosted(logs, rounds=8, positive_weight=w) for w in (1.0, 5.0))
    found = [ML.score(m, logs, "p").filter("is_threat = 1").agg(F.avg("p")).first()[0] for m in (light, heavy)]
    assert found[1] > found[0]
    assert np.isfinite(found).all()
