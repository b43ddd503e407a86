"""Registered explanation queries (rows-only: checked by invariants in tests,
e.g. sum(phi) + base == forest probability)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from vigil.operators import explain as X
from vigil.operators import ml as ML
from vigil.operators.forest import NODE_SCHEMA, Forest
from vigil.plans.q_ml import _train
from vigil.plans.registry import register, r6
from vigil.schema import FEATURES
from vigil.session import write_once
from vigil.sources.fixture import security_logs

_SHAP: dict = {}


def _logs(spark, sf):
    return ML.prepare_features(security_logs(spark, sf))


def _vector_shap(spark, sf):
    """SHAP per distinct feature vector of the whole table, written once."""
    k = spark.sparkContext.applicationId, sf
    if k not in _SHAP:
        _SHAP[k] = write_once(X.vector_shap(X.vectors(_logs(spark, sf)), _train(spark, sf, "forest")), "shap")
    return _SHAP[k]


@register("forest_shap_values")
def q_forest_shap_values(spark, sf):
    """Per-event SHAP of the forest's P(threat), with base value and probability."""
    return X.with_shap(_logs(spark, sf).select("event_id", *FEATURES), _vector_shap(spark, sf)).drop(*FEATURES)


@register("forest_shap_importance")
def q_forest_shap_importance(spark, sf):
    """Mean |phi| per feature over all events, share and bar."""
    return X.importance_of(_vector_shap(spark, sf))


@register("forest_shap_top_reasons")
def q_forest_shap_top_reasons(spark, sf):
    """The three largest contributions per event, with direction."""
    return X.top_k_reasons(q_forest_shap_values(spark, sf), "event_id", 3)


@register("lime_explanations")
def q_lime_explanations(spark, sf):
    """Local weights of every event (5,000 perturbations)."""
    logs = _logs(spark, sf)
    train, _ = ML.split(logs)
    return X.lime_explain(_train(spark, sf, "forest"), train, logs)


@register("lime_impact_summary")
def q_lime_impact_summary(spark, sf):
    """Average |weight| per feature over the explanations of all events."""
    return X.lime_impact_summary(q_lime_explanations(spark, sf))


@register("lime_text_lines")
def q_lime_text_lines(spark, sf):
    """The explanation of every event as text."""
    return X.lime_lines(q_lime_explanations(spark, sf))


@register("lime_key_factors")
def q_lime_key_factors(spark, sf):
    """The three strongest conditions of every event as text."""
    return X.lime_key_factors(q_lime_explanations(spark, sf))


# ------------------------------------------------------------------ a forest that SQL can enumerate
# (feature, threshold, at or below, above); a number is a leaf
GIVEN_TREES = [
    ("files_accessed", 1000.0, ("hour_of_day", 5.0, 0.25, 0.0625), ("login_attempts", 5.0, 0.625, 0.9375)),
    ("foreign_ip", 0.5, ("unknown_device", 0.5, 0.03125, 0.1875), ("data_uploaded_mb", 100.0, 0.375, 0.875)),
    ("hour_of_day", 5.0, ("files_accessed", 50.0, 0.125, 0.6875),
     ("login_attempts", 2.0, ("hour_of_day", 20.0, 0.015625, 0.09375), ("files_accessed", 500.0, 0.4375, 0.8125))),
]


def _paths(tree, at=()):
    """(path, subtree) of all nodes, parents first; a path is a tuple of
    (feature, threshold, at or below?)."""
    yield at, tree
    if isinstance(tree, tuple):
        for child, below in ((tree[2], True), (tree[3], False)):
            yield from _paths(child, (*at, (tree[0], tree[1], below)))


def given_forest(spark, logs) -> Forest:
    """The given trees with their nodes' row counts in ``logs``."""
    nodes = [(t, path, sub) for t, tree in enumerate(GIVEN_TREES) for path, sub in _paths(tree)]

    def reached(path):
        out = F.lit(True)
        for c, threshold, below in path:
            out = out & ((F.col(c) <= threshold) if below else (F.col(c) > threshold))
        return F.count_if(out)
    counts = logs.agg(*[reached(path).alias(f"n{i}") for i, (_, path, _) in enumerate(nodes)]).first()
    number = {(t, path): sum(u == t for u, _, _ in nodes[:i]) for i, (t, path, _) in enumerate(nodes)}
    rows = []
    for i, (t, path, sub) in enumerate(nodes):
        inner, n = isinstance(sub, tuple), float(counts[i])
        left, right = (number[t, (*path, (sub[0], sub[1], b))] if inner else -1 for b in (True, False))
        p = 0.0 if inner else sub
        rows.append((t, 0, number[t, path], left, right, FEATURES.index(sub[0]) if inner else -1, sub[1] if inner else None,
                     n * (1 - p), n * p, 0.0))
    table = write_once(spark.createDataFrame(rows, NODE_SCHEMA), "given-forest")
    return Forest(spark, table.inputFiles()[0].rsplit("/", 1)[0], len(GIVEN_TREES))


def given_shap_sql() -> str:
    """SHAP of the given trees over all 64 coalitions, as SQL columns."""
    names = {(t, path): f"n{t}_{i}" for t, tree in enumerate(GIVEN_TREES) for i, (path, _) in enumerate(_paths(tree))}

    def cond(path):
        return " AND ".join(f"{c} {'<=' if below else '>'} {threshold}" for c, threshold, below in path) or "true"

    def value(t, tree, path, known):
        if not isinstance(tree, tuple):
            return f"{tree}::DOUBLE"
        c, threshold, *children = tree
        low, high = (value(t, child, (*path, (c, threshold, b)), known) for child, b in zip(children, (True, False)))
        if c in known:
            return f"CASE WHEN {c} <= {threshold} THEN {low} ELSE {high} END"
        a, b = (names[t, (*path, (c, threshold, x))] for x in (True, False))
        return f"(({a} * {low} + {b} * {high}) / greatest(1, {names[t, path]}))"
    subsets = [tuple(c for i, c in enumerate(FEATURES) if s >> i & 1) for s in range(64)]
    v = ", ".join(f"({' + '.join(value(t, tree, (), known) for t, tree in enumerate(GIVEN_TREES))}) / {len(GIVEN_TREES)} AS v{s}"
                  for s, known in enumerate(subsets))
    weight = [math.factorial(k) * math.factorial(5 - k) / 720 for k in range(6)]
    phi = ", ".join("round(" + " + ".join(f"{weight[s.bit_count()]}::DOUBLE * (v{s | 1 << i} - v{s})" for s in range(64) if not s >> i & 1)
                    + f", 6) AS phi_{c}" for i, c in enumerate(FEATURES))
    covers = ", ".join(f"count(*) FILTER (WHERE {cond(path)})::DOUBLE AS {n}" for (_, path), n in names.items())
    return f""", covers AS (SELECT {covers} FROM security_logs),
vs AS (SELECT event_id, {v} FROM security_logs, covers)
SELECT event_id, {phi}, round(v0, 6) AS base, round(v63, 6) AS p_forest FROM vs"""


@register("given_forest_shap", given_shap_sql(), cte=True)
def q_given_forest_shap(spark, sf):
    """SHAP of a given forest for every event, value by value."""
    logs = _logs(spark, sf).select("event_id", *FEATURES)
    return X.tree_shap(logs, given_forest(spark, logs)).select("event_id", *[r6(f"phi_{c}") for c in FEATURES], r6("base"), r6("p_forest"))


@register("given_forest_importance", given_shap_sql().replace("SELECT event_id, round(", ", shap AS (SELECT event_id, round(") + f""")
, total AS (SELECT {', '.join(f'avg(abs(phi_{c})) AS {c}' for c in FEATURES)} FROM shap),
long AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c} AS importance FROM total" for c in FEATURES)})
SELECT feature, round(importance, 4) AS importance, round(100.0::DOUBLE * importance / sum(importance) OVER (), 2) AS percentage FROM long""", cte=True)
def q_given_forest_importance(spark, sf):
    """Mean |phi| of the given forest over all events."""
    logs = _logs(spark, sf)
    return X.shap_importance(logs, given_forest(spark, logs)).select(
        "feature", F.round("importance", 4).alias("importance"), F.round("percentage", 2).alias("percentage"))


def _case(tree) -> str:
    return f"{tree}::DOUBLE" if not isinstance(tree, tuple) else \
        f"CASE WHEN {tree[0]} <= {tree[1]} THEN {_case(tree[2])} ELSE {_case(tree[3])} END"


@register("given_forest_scores", f"SELECT event_id, round(({' + '.join(map(_case, GIVEN_TREES))}) / {len(GIVEN_TREES)}, 6) AS p "
          "FROM security_logs")
def q_given_forest_scores(spark, sf):
    """M7: the given forest's probability of every event."""
    logs = _logs(spark, sf)
    return ML.score(given_forest(spark, logs), logs, "p").select("event_id", r6("p"))


@register("forest_shap_lines")
def q_forest_shap_lines(spark, sf):
    """The contributions of every event as text."""
    values = X.with_shap(_logs(spark, sf).select("event_id", *FEATURES), _vector_shap(spark, sf))
    return X.shap_lines(values)
