"""The perceptron's training over cells against Spark's own over rows."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from vigil.operators import ml as ML
from vigil.operators import network as N
from vigil.schema import FEATURES

LAYERS = [6, 5, 4, 2]


@pytest.fixture(scope="module")
def logs(spark):
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 24, 300), rng.integers(0, 40, 300), rng.integers(1, 4, 300), rng.integers(0, 2, 300),
                  rng.integers(0, 2, 300), rng.integers(0, 20, 300)], axis=1).astype(float)
    y = ((x[:, 0] < 6) & (x[:, 4] == 1) | (x[:, 1] > 33)).astype(int)
    rows = [(*map(float, r), int(v)) for r, v in zip(x, y)] * 3
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in FEATURES) + ", is_threat int").cache()


def cross_entropy(model, logs) -> float:
    p = ML.score(model, logs, "p")
    own = F.when(F.col("is_threat") == 1, F.col("p")).otherwise(1 - F.col("p"))
    return p.agg(F.avg(-F.log(F.greatest(own, F.lit(1e-300))))).first()[0]


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    size = sum((n + 1) * m for n, m in zip(LAYERS, LAYERS[1:]))
    w, block = rng.normal(size=size), (rng.normal(size=(30, 6)), rng.integers(0, 4, (30, 2)).astype(float))
    got = N.loss_and_gradient(block, w, LAYERS)
    for i in range(0, size, 7):
        e = np.eye(size)[i] * 1e-6
        want = (N.loss_and_gradient(block, w + e, LAYERS)[0] - N.loss_and_gradient(block, w - e, LAYERS)[0]) / 2e-6
        assert got[i + 1] == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_a_cell_weighs_as_its_rows():
    rng = np.random.default_rng(2)
    size = sum((n + 1) * m for n, m in zip(LAYERS, LAYERS[1:]))
    w, x, n = rng.normal(size=size), rng.normal(size=(9, 6)), rng.integers(0, 4, (9, 2))
    rows = np.concatenate([np.repeat(x, n[:, y], axis=0) for y in (0, 1)])
    ones = np.repeat([[1.0, 0.0], [0.0, 1.0]], n.sum(axis=0), axis=0)
    assert np.allclose(N.loss_and_gradient((x, n.astype(float)), w, LAYERS), N.loss_and_gradient((rows, ones), w, LAYERS))


def test_passes_go_over_distinct_vectors_and_end_no_worse_than_spark(spark, logs, monkeypatch):
    sizes = []
    blocks = N._blocks
    monkeypatch.setattr(N, "_blocks", lambda table, *a: sizes.append(table.count()) or blocks(table, *a))
    model = ML.train_mlp(logs, layers=LAYERS)
    assert sizes == [logs.select(*FEATURES).distinct().count()] and sizes[0] * 3 <= logs.count()
    stages = [VectorAssembler(inputCols=FEATURES, outputCol="raw_features"),
              StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
              MultilayerPerceptronClassifier(featuresCol="features", labelCol="is_threat", layers=LAYERS, maxIter=100, seed=ML.SEED)]
    theirs = Pipeline(stages=stages).fit(logs.withColumn("is_threat", F.col("is_threat").cast("double")))
    assert cross_entropy(model, logs) <= cross_entropy(theirs, logs) + 0.02
    # the same start and the same order of weights
    start = ML.train_mlp(logs, layers=LAYERS, max_iter=0)
    spark_start = Pipeline(stages=[*stages[:2], stages[2].copy().setMaxIter(0)]).fit(logs.withColumn("is_threat", F.col("is_threat").cast("double")))
    assert np.allclose(start.stages[-1].weights.toArray(), spark_start.stages[-1].weights.toArray())


def test_scores_of_the_model_are_those_of_the_trained_weights(spark, logs):
    model = ML.train_mlp(logs, layers=LAYERS, max_iter=7)
    weights = model.stages[-1].weights.toArray()
    got = ML.score(model, logs, "p").select(*FEATURES, "is_threat", "p").toPandas()
    scaler = model.stages[1]
    x = (got[FEATURES].to_numpy(float) - scaler.mean.toArray()) / scaler.std.toArray()
    n = np.stack([1 - got["is_threat"], got["is_threat"]], axis=1).astype(float)
    own = np.where(got["is_threat"] == 1, got["p"], 1 - got["p"])
    assert N.loss_and_gradient((x, n), weights, LAYERS)[0] == pytest.approx(-np.log(own).sum())
