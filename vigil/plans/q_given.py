"""Registered queries over given model scores, long users and altered rows.

Two probabilities derived from the events stand in for the models, so that
everything behind a model has an exact SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators import alerts as A
from vigil.operators import hunting as H
from vigil.operators import ml as ML
from vigil.operators import ueba as U
from vigil.plans.ordered_scan import periodic_totals, sample_by_outcome
from vigil.plans.q_alerts import ALERTS_SQL, GIVEN_SQL, fixture_alerts, given_probabilities
from vigil.plans.registry import ORACLE, register, r6
from vigil.plans.sql_text import UEBA_SQL
from vigil.sources.fixture import ORACLE_PREFIX, security_logs
from vigil.streaming import streams as S

ORDER = ["timestamp", "event_id"]

ENS_SQL = GIVEN_SQL + """
, lvl AS (SELECT *, CASE WHEN final_score > 0.3::DOUBLE THEN 'HIGH' WHEN final_score > 0.1::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END
                 AS risk_level FROM ens)
"""


def _ens(spark, sf) -> DataFrame:
    return A.ensemble_scores(given_probabilities(security_logs(spark, sf)))


@register("ensemble_scores_given", ENS_SQL + """
SELECT event_id, round(final_score, 6) AS final_score, risk_level,
       CASE risk_level WHEN 'HIGH' THEN 'BLOCK' WHEN 'MEDIUM' THEN 'MONITOR' ELSE 'ALLOW' END AS action,
       CASE risk_level WHEN 'HIGH' THEN '🚨' WHEN 'MEDIUM' THEN '⚠️' ELSE '✅' END AS emoji,
       CASE WHEN abs(xgb_prob - rf_prob) < 0.2::DOUBLE THEN 'STRONG' ELSE 'WEAK' END AS model_agreement
FROM lvl
""", cte=True)
def q_ensemble_scores_given(spark, sf):
    """M9."""
    return _ens(spark, sf).select("event_id", r6("final_score"), "risk_level", "action", "emoji", "model_agreement")


P20_SQL = ENS_SQL + """
SELECT event_id, 'ENSEMBLE_THREAT' AS type, timestamp, round(final_score, 3) AS threat_score,
       round(xgb_prob, 3) AS xgb_score, round(rf_prob, 3) AS rf_score, files_accessed, hour_of_day
FROM lvl WHERE risk_level = 'HIGH'
"""


def _p20(al: DataFrame) -> DataFrame:
    return al.select("event_id", "type", "timestamp", "threat_score", "xgb_score", "rf_score",
                     F.col("features_analyzed.files_accessed").alias("files_accessed"),
                     F.col("features_analyzed.hour_of_day").alias("hour_of_day"))


@register("ensemble_alerts_given", P20_SQL, cte=True)
def q_ensemble_alerts_given(spark, sf):
    """P20."""
    return _p20(A.ensemble_alerts(_ens(spark, sf)))


@register("stream_ensemble_given", P20_SQL, cte=True)
def q_stream_ensemble_given(spark, sf):
    """The ensemble over micro-batches equals the batch rows."""
    out = S.scratch(spark, "ensemble")
    S.run_foreach_batch(S.stream_fixture_logs(spark, sf), f"{out}/data", f"{out}/ckpt",
                        transform=lambda b: A.ensemble_alerts(A.ensemble_scores(given_probabilities(b))))
    return _p20(spark.read.parquet(f"{out}/data"))


@register("ensemble_stats_given", ENS_SQL + """
SELECT count(*) AS total, count(*) FILTER (WHERE risk_level = 'HIGH') AS high,
       count(*) FILTER (WHERE risk_level = 'MEDIUM') AS medium, count(*) FILTER (WHERE risk_level = 'LOW') AS low,
       round(100::DOUBLE * count(*) FILTER (WHERE risk_level = 'HIGH') / greatest(1, count(*)), 6) AS high_pct,
       round(100::DOUBLE * count(*) FILTER (WHERE risk_level = 'MEDIUM') / greatest(1, count(*)), 6) AS medium_pct,
       round(100::DOUBLE * count(*) FILTER (WHERE risk_level = 'LOW') / greatest(1, count(*)), 6) AS low_pct
FROM lvl
""", cte=True)
def q_ensemble_stats_given(spark, sf):
    """A41."""
    return A.scorer_stats(_ens(spark, sf))


@register("ensemble_samples_given", ENS_SQL + """
, o AS (SELECT *, row_number() OVER (ORDER BY timestamp, event_id) AS total FROM lvl)
SELECT event_id, total, risk_level FROM o
WHERE risk_level = 'HIGH' OR (risk_level = 'MEDIUM' AND total % 5 = 0) OR (risk_level = 'LOW' AND total % 20 = 0)
""", cte=True)
def q_ensemble_samples_given(spark, sf):
    """W13, scorer form: every HIGH, every 5th MEDIUM, every 20th LOW."""
    return sample_by_outcome(_ens(spark, sf), {"HIGH": 1, "MEDIUM": 5, "LOW": 20}, ORDER, "risk_level") \
        .select("event_id", "total", "risk_level")


@register("periodic_scorer_totals", ENS_SQL + """
, o AS (SELECT event_id, row_number() OVER w AS total,
          CAST(count(*) FILTER (WHERE risk_level = 'HIGH') OVER w AS BIGINT) AS high,
          CAST(count(*) FILTER (WHERE risk_level = 'MEDIUM') OVER w AS BIGINT) AS medium,
          CAST(count(*) FILTER (WHERE risk_level = 'LOW') OVER w AS BIGINT) AS low
        FROM lvl WINDOW w AS (ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING))
SELECT * FROM o WHERE total % 50 = 0
""", cte=True)
def q_periodic_scorer_totals(spark, sf):
    """W11, scorer form."""
    flags = {k.lower(): F.col("risk_level") == k for k in ("HIGH", "MEDIUM", "LOW")}
    return periodic_totals(_ens(spark, sf), flags, ORDER).select("event_id", "total", "high", "medium", "low")


@register("periodic_detector_totals", """
, o AS (SELECT event_id, row_number() OVER w AS total,
               CAST(count(*) FILTER (WHERE threat_score > 0.7::DOUBLE) OVER w AS BIGINT) AS alerts
        FROM scored_logs WINDOW w AS (ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, total, alerts, round(100::DOUBLE * alerts / total, 6) AS alert_rate FROM o WHERE total % 50 = 0
""", cte=True)
def q_periodic_detector_totals(spark, sf):
    """W11, detector form."""
    out = periodic_totals(A.detector_scores(security_logs(spark, sf)), {"alerts": F.col("is_alert")}, ORDER)
    return out.select("event_id", "total", "alerts",
                      F.round(F.lit(100.0) * F.col("alerts") / F.col("total"), 6).alias("alert_rate"))


@register("mean_ensemble_given", GIVEN_SQL + """
, m AS (SELECT event_id, xgb_prob, rf_prob, (xgb_prob + rf_prob) / 2 AS mean FROM given)
SELECT event_id, round(mean, 6) AS threat_score,
       CASE WHEN mean > 0.7::DOUBLE THEN 'HIGH' WHEN mean > 0.4::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
       CASE WHEN printf('%.1f', xgb_prob) = printf('%.1f', rf_prob) THEN 'STRONG' ELSE 'WEAK' END AS agreement
FROM m
""", cte=True)
def q_mean_ensemble_given(spark, sf):
    """M10 with E18 (Python's rounding, ties included: many scores end in 5)."""
    return A.mean_ensemble(given_probabilities(security_logs(spark, sf)), ["xgb_prob", "rf_prob"]) \
        .select("event_id", r6("threat_score"), "risk_level", "agreement")


@register("score_batch_without_model", """
SELECT event_id, 0.5::DOUBLE AS threat_score, 'MEDIUM' AS risk_level, NULL::VARCHAR AS error
FROM security_logs WHERE event_id % 7 <> 3
UNION ALL SELECT event_id, NULL, NULL, 'could not convert string to float: ''n/a'''
FROM security_logs WHERE event_id % 7 = 3
""", cte=True)
def q_score_batch_without_model(spark, sf):
    """A bad value is that row's error, and the job goes on."""
    logs = security_logs(spark, sf).withColumn("files_accessed", F.when(F.col("event_id") % 7 == 3, "n/a").otherwise(
        F.col("files_accessed").cast("string")))
    return ML.score_batch([], logs).select("event_id", "threat_score", "risk_level", "error")


@register("validated_bad_rows", """
SELECT event_id, CASE WHEN event_id % 5 = 1 THEN 'Missing feature: files_accessed' ELSE 'Invalid value: many' END
         AS reject_reason
FROM security_logs WHERE event_id % 5 IN (1, 2)
""", cte=True)
def q_validated_bad_rows(spark, sf):
    """The rejected rows and their reasons."""
    k = F.col("event_id") % 5
    logs = security_logs(spark, sf).withColumn("files_accessed", F.when(k == 1, None).when(k == 2, "many").otherwise(
        F.col("files_accessed").cast("string")))
    return ML.validate_features(logs)[1].select("event_id", "reject_reason")


@register("detector_test_messages", """
SELECT count(*) AS total, count(*) FILTER (WHERE threat_score > 0.7::DOUBLE) AS alerts
FROM scored_logs WHERE event_id % 3 <> 0
""", cte=True)
def q_detector_test_messages(spark, sf):
    """Messages marked as tests are skipped; the hour comes from the
    time's text."""
    logs = security_logs(spark, sf).withColumn("test", F.when(F.col("event_id") % 3 == 0, True)) \
        .withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")).drop("hour_of_day")
    return A.detector_stats(A.detector_scores(logs)).select("total", "alerts")


@register("events_of_one_user", """
SELECT event_id, timestamp FROM security_logs WHERE user_id = 'u7'
""", cte=True)
def q_events_of_one_user(spark, sf):
    """P8."""
    return H.events_of_user(security_logs(spark, sf), "u7").select("event_id", "timestamp")


# ------------------------------------------------------------ long users
LONG_SQL = UEBA_SQL.replace("coalesce(user_id, 'unknown') AS user_id",
                            "concat('long', CAST(event_id % 3 AS STRING)) AS user_id") \
    .replace("ROWS BETWEEN 999 PRECEDING", "ROWS BETWEEN 99 PRECEDING")


@register("ueba_long_users")
def q_ueba_long_users(spark, sf):
    """W2 on users far longer than the window: the events of three users with a
    window of 100, in many chunks."""
    logs = security_logs(spark, sf).withColumn(
        "user_id", F.concat(F.lit("long"), (F.col("event_id") % 3).cast("string")))
    return U.ueba_scores(logs, window=100).select(
        "event_id", "user_id", F.col("n").cast("long").alias("n"), r6("avg_login_hour"), r6("avg_files"),
        r6("avg_upload"), r6("std_login_hour"), r6("std_files"), "usual_location", "usual_device", "anomaly_score")


ORACLE["ueba_long_users"] = ORACLE_PREFIX.rstrip() + LONG_SQL + """
SELECT event_id, user_id, CAST(n AS BIGINT) AS n, round(avg_login_hour, 6) AS avg_login_hour,
       round(avg_files, 6) AS avg_files, round(avg_upload, 6) AS avg_upload,
       round(std_login_hour, 6) AS std_login_hour, round(std_files, 6) AS std_files,
       usual_location, usual_device, anomaly_score
FROM s
"""


@register("report_statistics_rows", ALERTS_SQL + """
SELECT 'alert_type' AS dim, alert_type AS key, count(*) AS count FROM al GROUP BY alert_type
UNION ALL SELECT 'location', location, count(*) FROM al GROUP BY location
UNION ALL SELECT 'model', model, count(*) FROM al GROUP BY model
UNION ALL SELECT 'user_id', user_id, count(*) FROM al GROUP BY user_id
UNION ALL SELECT 'hour', CAST(hour(ts) AS STRING), count(*) FROM al WHERE ts IS NOT NULL GROUP BY 2
UNION ALL SELECT 'total', NULL, count(*) FROM al
""", cte=True)
def q_report_statistics_rows(spark, sf):
    """S17 as (dim, key, count) rows, per-user counts included."""
    return A.alert_rollups(fixture_alerts(spark, sf)).filter("dim = 'total' OR key IS NOT NULL") \
        .select("dim", "key", "count")
