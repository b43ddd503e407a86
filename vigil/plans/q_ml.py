"""Registered evaluation, forecast and model queries.

Evaluation queries score events with the detector's rule score as P(threat)
against the fixture label, so they are SQL-checkable; model queries train on
the fixture (hash split) and are checked by row counts and invariants.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import alerts as A
from vigil.operators import forecast as FC
from vigil.operators import hunting as H
from vigil.operators import metrics as M
from vigil.operators import ml as ML
from vigil.operators import ueba as U
from vigil.operators.boosting import NODE_SCHEMA, Params, first_tree_sql
from vigil.plans.registry import register, r6
from vigil.schema import FEATURES
from vigil.session import write_once
from vigil.sources.fixture import security_logs

PRED_SQL = """
, p AS (SELECT event_id, is_threat, threat_score AS score,
               CASE WHEN threat_score > 0.5 THEN 1 ELSE 0 END AS prediction FROM scored_logs),
cm AS (SELECT count(*) FILTER (WHERE is_threat = 0 AND prediction = 0) AS tn,
              count(*) FILTER (WHERE is_threat = 0 AND prediction = 1) AS fp,
              count(*) FILTER (WHERE is_threat = 1 AND prediction = 0) AS fn,
              count(*) FILTER (WHERE is_threat = 1 AND prediction = 1) AS tp FROM p)
"""


def _pred(spark, sf):
    s = A.detector_scores(security_logs(spark, sf))
    return M.with_prediction(s, "score", 0.5)


@register("confusion_matrix", PRED_SQL + "SELECT * FROM cm", cte=True)
def q_confusion_matrix(spark, sf):
    return M.confusion_matrix(_pred(spark, sf))


@register("key_metrics", PRED_SQL + """
, km AS (SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy,
                CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
                CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM cm)
SELECT tn, fp, fn, tp, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
       round(recall, 6) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * (precision * recall) / (precision + recall) ELSE 0.0 END, 6)
         AS f1
FROM km
""", cte=True)
def q_key_metrics(spark, sf):
    k = M.key_metrics(M.confusion_matrix(_pred(spark, sf)))
    return k.select("tn", "fp", "fn", "tp", r6("accuracy"), r6("precision"), r6("recall"), r6("f1"))


@register("classification_report", PRED_SQL + """
, v AS (SELECT *, CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0.0 END AS p0,
               CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS r0,
               CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p1,
               CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r1,
               tn + fp AS s0, tp + fn AS s1 FROM cm),
g AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0 END AS f0,
               CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS f1, s0 + s1 AS n FROM v)
SELECT '0' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, s0 AS support FROM g
UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), s1 FROM g
UNION ALL SELECT 'accuracy', NULL, NULL, round((tp + tn) / n, 6), n FROM g
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), n FROM g
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / n, 6), round((r0 * s0 + r1 * s1) / n, 6),
                 round((f0 * s0 + f1 * s1) / n, 6), n FROM g
""", cte=True)
def q_classification_report(spark, sf):
    r = M.classification_report(_pred(spark, sf))
    return r.select("class", r6("precision"), r6("recall"), r6("f1"), "support")


@register("auc_roc", """
, c AS (SELECT threat_score AS s, count(*) FILTER (WHERE is_threat = 1) AS pos,
               count(*) FILTER (WHERE is_threat = 0) AS neg FROM scored_logs GROUP BY threat_score),
cu AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
       FROM c)
SELECT round(sum(pos * (below + neg / CAST(2.0 AS DOUBLE))) / (sum(pos) * sum(neg)), 6) AS auc,
       CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives
FROM cu
""", cte=True)
def q_auc_roc(spark, sf):
    a = M.auc_roc(A.detector_scores(security_logs(spark, sf)), "is_threat", "score")
    return a.select(r6("auc"), "positives", "negatives")


@register("roc_curve", """
, c AS (SELECT threat_score AS s, count(*) FILTER (WHERE is_threat = 1) AS pos,
               count(*) FILTER (WHERE is_threat = 0) AS neg FROM scored_logs GROUP BY threat_score),
t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM c),
cu AS (SELECT s, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM c
       WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT round(s, 6) AS threshold, round(cn / greatest(1, N), 6) AS fpr, round(cp / greatest(1, P), 6) AS tpr
FROM cu, t
""", cte=True)
def q_roc_curve(spark, sf):
    r = M.roc_curve(A.detector_scores(security_logs(spark, sf)), "is_threat", "score")
    return r.select(r6("threshold"), r6("fpr"), r6("tpr"))


def hist_sql(value: str, source: str, group: str | None, bins: int = 30) -> str:
    g = group or "0"
    b = float(bins)
    return f"""
, hv AS (SELECT {g} AS g, CAST({value} AS DOUBLE) AS x FROM {source} WHERE {value} IS NOT NULL),
hb0 AS (SELECT g, min(x) AS lo0, max(x) AS hi0 FROM hv GROUP BY g),
hb AS (SELECT g, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
                 CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM hb0),
hi0 AS (SELECT hv.g, x, lo, hi, least(CAST(floor((x - lo) * (CAST({b} AS DOUBLE) / (hi - lo))) AS INT), {bins - 1}) AS i
        FROM hv JOIN hb ON hv.g = hb.g),
hi1 AS (SELECT g, x, lo, hi, CASE WHEN x < CAST(i AS DOUBLE) * ((hi - lo) / CAST({b} AS DOUBLE)) + lo
                                  THEN i - 1 ELSE i END AS i FROM hi0),
hi2 AS (SELECT g, CASE WHEN x >= (CASE WHEN i + 1 >= {bins} THEN hi
                                       ELSE CAST(i + 1 AS DOUBLE) * ((hi - lo) / CAST({b} AS DOUBLE)) + lo END)
                        AND i <> {bins - 1} THEN i + 1 ELSE i END AS i FROM hi1),
hc AS (SELECT g, i, count(*) AS n FROM hi2 GROUP BY g, i),
hs AS (SELECT hb.g, CAST(s.i AS INT) AS i, lo, hi FROM hb, range({bins}) s(i))
SELECT {'hs.g AS ' + group + ', ' if group else ''}hs.i AS bin,
       round(CAST(hs.i AS DOUBLE) * ((hi - lo) / CAST({b} AS DOUBLE)) + lo, 6) AS bin_lo,
       round(CASE WHEN hs.i + 1 >= {bins} THEN hi
                  ELSE CAST(hs.i + 1 AS DOUBLE) * ((hi - lo) / CAST({b} AS DOUBLE)) + lo END, 6) AS bin_hi,
       CAST(coalesce(hc.n, 0) AS BIGINT) AS n
FROM hs LEFT JOIN hc ON hs.g = hc.g AND hs.i = hc.i
"""


@register("score_histogram_by_class", hist_sql("threat_score", "scored_logs", "is_threat"), cte=True)
def q_score_histogram_by_class(spark, sf):
    return H.score_histogram(A.detector_scores(security_logs(spark, sf)), "score", 30, by="is_threat")


@register("standardised_features", """
, st AS (SELECT """ + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES) + """
         FROM security_logs)
SELECT event_id, """ + ", ".join(
    f"round(CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE 0.0 END, 6) AS {c}_z" for c in FEATURES) + """
FROM security_logs, st
""", cte=True)
def q_standardised_features(spark, sf):
    z = M.standardise(security_logs(spark, sf), FEATURES)
    return z.select("event_id", *[r6(f"{c}_z") for c in FEATURES])


@register("class_balance", """
SELECT count(*) AS total, CAST(sum(is_threat) AS BIGINT) AS threats,
       round(CAST(100.0 AS DOUBLE) * sum(is_threat) / greatest(1, count(*)), 6) AS threat_pct
FROM security_logs
""")
def q_class_balance(spark, sf):
    return M.class_balance(security_logs(spark, sf)).withColumn("threat_pct", F.round("threat_pct", 6))


@register("overlap_analysis", """
SELECT count(*) FILTER (WHERE is_threat = 1 AND files_accessed < 100) AS threats_low_files,
       count(*) FILTER (WHERE is_threat = 0 AND files_accessed > 200) AS normals_high_files,
       count(*) FILTER (WHERE is_threat = 1 AND foreign_ip = 0) AS threats_local_ip,
       count(*) FILTER (WHERE is_threat = 0 AND foreign_ip = 1) AS normals_foreign_ip,
       count(*) FILTER (WHERE is_threat = 0 AND hour_of_day IN (0, 1, 2, 3, 4, 5)) AS late_night_normals
FROM security_logs
""")
def q_overlap_analysis(spark, sf):
    return M.overlap_analysis(security_logs(spark, sf))


@register("label_pair_confusion", """
SELECT count(*) FILTER (WHERE toxic = 0 AND quality = 0) AS tn,
       count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS fp,
       count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS fn,
       count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS tp
FROM labels
""")
def q_label_pair_confusion(spark, sf):
    """M12 on the driver's second 0/1 pair (``labels``: quality as prediction, toxic as truth)."""
    return M.confusion_matrix(spark.read.parquet(f"{sf}/labels.parquet"), "toxic", "quality")


DAILY_SQL = """
, dc AS (SELECT CAST(timestamp AS DATE) AS date, count(*) AS threats FROM scored_logs
         WHERE threat_score > 0.7 GROUP BY 1),
db AS (SELECT min(date) AS d0, max(date) AS d1 FROM dc),
ds AS (SELECT CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS date FROM db),
daily AS (SELECT ds.date, CAST(coalesce(dc.threats, 0) AS BIGINT) AS threats FROM ds LEFT JOIN dc USING (date)),
last30 AS (SELECT date, threats, CAST(date_diff('day', (SELECT min(date) FROM daily
                       WHERE date > (SELECT max(date) FROM daily) - INTERVAL 30 DAY), date) + 1 AS INT) AS day
           FROM daily WHERE date > (SELECT max(date) FROM daily) - INTERVAL 30 DAY)
"""


def _daily(spark, sf):
    det = A.detector_alerts(A.detector_scores(security_logs(spark, sf)))
    return FC.daily_counts(det, "timestamp")


@register("daily_alert_counts", DAILY_SQL + "SELECT strftime(date, '%Y-%m-%d') AS date, threats FROM daily",
          cte=True)
def q_daily_alert_counts(spark, sf):
    return _daily(spark, sf).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@register("last_30_days", DAILY_SQL + "SELECT strftime(date, '%Y-%m-%d') AS date, threats, day FROM last30",
          cte=True)
def q_last_30_days(spark, sf):
    return FC.last_n_days(_daily(spark, sf), 30).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@register("forecast_7_days", DAILY_SQL + """
, fit AS (SELECT regr_slope(threats, day) AS slope, regr_intercept(threats, day) AS intercept, count(*) AS n
          FROM last30),
pr AS (SELECT CAST(r.i AS INT) AS step, intercept + slope * CAST(n + r.i AS DOUBLE) AS pred
       FROM fit, range(1, 8) r(i))
SELECT 'Day ' || CAST(step AS STRING) AS day, step, round(pred, 6) AS predicted,
       greatest(0, CAST(trunc(pred) AS INT)) AS threats,
       CASE WHEN greatest(0, CAST(trunc(pred) AS INT)) > 20 THEN '🔺 High'
            WHEN greatest(0, CAST(trunc(pred) AS INT)) < 12 THEN '🔻 Normal' ELSE '➡️ Moderate' END AS trend
FROM pr
""", cte=True)
def q_forecast_7_days(spark, sf):
    return FC.forecast(FC.last_n_days(_daily(spark, sf), 30), 7)


# ------------------------------------------------------------------ trained models (rows-only)
_MODELS: dict = {}


def _train(spark, sf, kind: str):
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _MODELS:
        logs = ML.prepare_features(security_logs(spark, sf))
        train, _ = ML.split(logs)
        fit = {"forest": ML.train_forest, "boosted": ML.train_boosted, "mlp": ML.train_mlp}[kind]
        _MODELS[key] = fit(train)
    return _MODELS[key]


def _holdout(spark, sf, kind: str):
    model = _train(spark, sf, kind)
    _, test = ML.split(ML.prepare_features(security_logs(spark, sf)))
    # metrics and AUC read the held-out scores: scored once
    scored = write_once(M.with_prediction(ML.score(model, test), "p_threat", 0.5)
                        .select("is_threat", "p_threat", "prediction"), "heldout")
    km = M.key_metrics(M.confusion_matrix(scored))
    auc = M.auc_roc(scored, "is_threat", "p_threat").select("auc")
    return km.select("*", auc.scalar().alias("auc"), F.lit(kind).alias("model"))


@register("forest_holdout_metrics")
def q_forest_holdout_metrics(spark, sf):
    return _holdout(spark, sf, "forest")


@register("boosted_holdout_metrics")
def q_boosted_holdout_metrics(spark, sf):
    return _holdout(spark, sf, "boosted")


@register("boosted_first_tree", first_tree_sql("security_logs", Params(rounds=1)), cte=True)
def q_boosted_first_tree(spark, sf):
    """M4: splits, gains, covers and leaf values of the first tree over all events."""
    model = ML.train_boosted(ML.prepare_features(security_logs(spark, sf)), rounds=1)
    names = F.array(*[F.lit(c) for c in FEATURES])
    nodes = spark.createDataFrame(model.nodes.astype(object).where(model.nodes.notna(), None), NODE_SCHEMA)
    return nodes.select("node", F.get(names, F.col("feature")).alias("feature"), "threshold",
                        F.when(F.col("feature") >= 0, F.round("gain", 6)).alias("gain"), r6("cover"), r6("value"))


@register("boosted_feature_importance")
def q_boosted_feature_importance(spark, sf):
    """M18 of the boosted model: mean gain of each feature's splits."""
    return spark.createDataFrame(ML.feature_importance(_train(spark, sf, "boosted")), "feature string, importance double")


@register("mlp_holdout_metrics")
def q_mlp_holdout_metrics(spark, sf):
    return _holdout(spark, sf, "mlp")


@register("forest_feature_importance")
def q_forest_feature_importance(spark, sf):
    imp = ML.feature_importance(_train(spark, sf, "forest"))
    return spark.createDataFrame(imp, "feature string, importance double") \
                .withColumn("bar", F.repeat(F.lit("█"), (F.col("importance") * 50).cast("int")))


@register("ensemble_alerts")
def q_ensemble_alerts(spark, sf):
    """M9 + P20 + O5: boosted and forest probabilities per event, ensemble
    alerts, unioned with detector and behavioural alerts (all three producers)."""
    logs = security_logs(spark, sf)
    both = ML.score(_train(spark, sf, "boosted"), logs, "xgb_prob")
    both = ML.score(_train(spark, sf, "forest"), both, "rf_prob")
    ens = A.ensemble_alerts(A.ensemble_scores(both))
    det = A.detector_alerts(A.detector_scores(logs))
    ueba = U.ueba_anomalies(U.ueba_scores(logs))
    return A.canonical_alerts(("detector", det), ("ueba", ueba), ("ensemble", ens))


@register("model_scored_detector")
def q_model_scored_detector(spark, sf):
    """M8: the detector with the forest probability as its score (rules only
    where the model gives none)."""
    logs = ML.score(_train(spark, sf, "forest"), security_logs(spark, sf), "p_threat")
    return A.detector_stats(A.detector_scores(logs, model_score=F.col("p_threat")))


@register("mean_ensemble_scores")
def q_mean_ensemble_scores(spark, sf):
    """Mean of the forest and boosted probabilities with API cut-offs."""
    logs = security_logs(spark, sf)
    both = ML.score(_train(spark, sf, "boosted"), logs, "xgb_prob")
    both = ML.score(_train(spark, sf, "forest"), both, "rf_prob")
    return A.mean_ensemble(both, ["xgb_prob", "rf_prob"]).groupBy("risk_level", "agreement").count()
