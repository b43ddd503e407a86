"""Registered queries (hunting summaries and behavioural baselines).

Importing this module also imports the other query modules, so
``QUERIES``/``ORACLE`` hold the full catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators import hunting as H
from vigil.operators import ueba as U
from vigil.plans.ordered_scan import sample_by_outcome
from vigil.plans.registry import ORACLE, QUERIES, register, r6  # noqa: F401
from vigil.sources.fixture import ORACLE_PREFIX, scored_logs, security_logs

# ============================================================ hunting summaries
@register("user_activity_summary", """
SELECT user_id, count(*) AS total_actions, round(avg(files_accessed), 6) AS avg_files,
       max(files_accessed) AS max_files, min(files_accessed) AS min_files
FROM security_logs GROUP BY user_id ORDER BY total_actions DESC, user_id LIMIT 10
""")
def q_user_activity_summary(spark, sf):
    return H.user_activity_summary(security_logs(spark, sf)).withColumn("avg_files", F.round("avg_files", 6))


@register("suspicious_location_counts", """
SELECT user_id, location, count(*) AS access_count
FROM security_logs WHERE location <> 'Pakistan' GROUP BY user_id, location
""")
def q_suspicious_location_counts(spark, sf):
    return H.suspicious_location_counts(security_logs(spark, sf))


@register("high_score_activities", """
SELECT event_id, user_id, action, round(threat_score, 6) AS threat_score
FROM scored_logs WHERE threat_score > 0.5 ORDER BY threat_score DESC, event_id LIMIT 10
""")
def q_high_score_activities(spark, sf):
    return H.high_score_activities(scored_logs(spark, sf), t=0.5).withColumn(
        "threat_score", F.round("threat_score", 6))


@register("action_distribution", """
SELECT action, count(*) AS count FROM security_logs GROUP BY action
""")
def q_action_distribution(spark, sf):
    return H.action_distribution(security_logs(spark, sf))


@register("device_usage", """
SELECT device, count(*) AS usage_count, round(avg(files_accessed), 6) AS avg_files
FROM security_logs GROUP BY device
""")
def q_device_usage(spark, sf):
    return H.device_usage(security_logs(spark, sf)).withColumn("avg_files", F.round("avg_files", 6))


@register("night_activity_by_user", """
SELECT user_id, count(*) AS night_events FROM security_logs
WHERE hour_of_day BETWEEN 0 AND 5 GROUP BY user_id
""")
def q_night_activity_by_user(spark, sf):
    return H.night_activity_by_user(security_logs(spark, sf))


@register("top_foreign_locations", """
SELECT location, count(*) AS count FROM security_logs
WHERE location IS DISTINCT FROM 'Pakistan' AND location IS NOT NULL
GROUP BY location ORDER BY count DESC, location LIMIT 10
""")
def q_top_foreign_locations(spark, sf):
    return H.top_foreign_locations(security_logs(spark, sf))


@register("foreign_nullsafe_rows", """
SELECT event_id, user_id, location FROM security_logs WHERE location IS DISTINCT FROM 'Pakistan'
""")
def q_foreign_nullsafe_rows(spark, sf):
    return H.foreign_nullsafe(security_logs(spark, sf)).select("event_id", "user_id", "location")


@register("high_risk_country_rows", """
SELECT event_id, user_id, location FROM security_logs
WHERE location IN ('Russia', 'China', 'North Korea', 'Iran')
""")
def q_high_risk_country_rows(spark, sf):
    return H.high_risk_country(security_logs(spark, sf)).select("event_id", "user_id", "location")


_HIST_SQL = """
, v AS (SELECT CAST(threat_score AS DOUBLE) AS x FROM scored_logs WHERE threat_score IS NOT NULL),
b0 AS (SELECT min(x) AS lo0, max(x) AS hi0 FROM v),
b AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
             CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM b0),
i0 AS (SELECT x, lo, hi, least(CAST(floor((x - lo) * (CAST(30 AS DOUBLE) / (hi - lo))) AS INT), 29) AS i
       FROM v, b),
i1 AS (SELECT x, lo, hi, CASE WHEN x < CAST(i AS DOUBLE) * ((hi - lo) / CAST(30 AS DOUBLE)) + lo
                              THEN i - 1 ELSE i END AS i FROM i0),
i2 AS (SELECT CASE WHEN x >= (CASE WHEN i + 1 >= 30 THEN hi
                                   ELSE CAST(i + 1 AS DOUBLE) * ((hi - lo) / CAST(30 AS DOUBLE)) + lo END)
                        AND i <> 29 THEN i + 1 ELSE i END AS i FROM i1),
cnt AS (SELECT i, count(*) AS n FROM i2 GROUP BY i),
spine AS (SELECT CAST(s.i AS INT) AS i, lo, hi FROM range(30) s(i), b)
SELECT spine.i AS bin,
       round(CAST(spine.i AS DOUBLE) * ((hi - lo) / CAST(30 AS DOUBLE)) + lo, 6) AS bin_lo,
       round(CASE WHEN spine.i + 1 >= 30 THEN hi
                  ELSE CAST(spine.i + 1 AS DOUBLE) * ((hi - lo) / CAST(30 AS DOUBLE)) + lo END, 6) AS bin_hi,
       CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
FROM spine LEFT JOIN cnt ON spine.i = cnt.i
"""


@register("score_histogram")
def q_score_histogram(spark, sf):
    return H.score_histogram(scored_logs(spark, sf), "threat_score", 30)


ORACLE["score_histogram"] = ORACLE_PREFIX.rstrip() + _HIST_SQL


@register("user_deep_dive", """
SELECT event_id, timestamp, location, device, files_accessed, round(threat_score, 6) AS threat_score
FROM scored_logs WHERE user_id = 'u7' AND threat_score >= 0.5
ORDER BY threat_score DESC, event_id LIMIT 20
""")
def q_user_deep_dive(spark, sf):
    return H.user_deep_dive(scored_logs(spark, sf), "u7").withColumn("threat_score", F.round("threat_score", 6))


@register("recent_high_scores", """
SELECT event_id, user_id, timestamp, round(threat_score, 6) AS threat_score FROM scored_logs
WHERE threat_score >= 0.5
  AND timestamp >= (SELECT max(timestamp) FROM scored_logs WHERE threat_score >= 0.5) - INTERVAL 24 HOUR
ORDER BY threat_score DESC, event_id LIMIT 1000
""")
def q_recent_high_scores(spark, sf):
    return H.read_index_query(scored_logs(spark, sf), 0.5, 24, 1000).select(
        "event_id", "user_id", "timestamp", F.round("threat_score", 6).alias("threat_score"))


@register("recent_high_scores_all", """
SELECT event_id, user_id, timestamp, round(threat_score, 6) AS threat_score FROM scored_logs
WHERE threat_score >= 0.5
  AND timestamp >= (SELECT max(timestamp) FROM scored_logs WHERE threat_score >= 0.5) - INTERVAL 24 HOUR
""")
def q_recent_high_scores_all(spark, sf):
    """S21 without the caller's cap."""
    return H.read_index_query(scored_logs(spark, sf), 0.5, 24).select(
        "event_id", "user_id", "timestamp", F.round("threat_score", 6).alias("threat_score"))


@register("threat_rows", """
SELECT event_id, user_id, round(threat_score, 6) AS threat_score FROM scored_logs WHERE threat_score > 0.5
""")
def q_threat_rows(spark, sf):
    return H.threat_rows(scored_logs(spark, sf)).select(
        "event_id", "user_id", F.round("threat_score", 6).alias("threat_score"))


@register("first_rows_profile", """
SELECT * FROM security_logs ORDER BY event_id LIMIT 5
""")
def q_first_rows_profile(spark, sf):
    return H.profile(security_logs(spark, sf))[2]


# ============================================================ behavioural baseline
from vigil.plans.sql_text import UEBA_SQL as _UEBA_SQL  # noqa: E402



def _ueba_out(df: DataFrame) -> DataFrame:
    return df.select(
        "event_id", "user_id", F.col("n").cast("long").alias("n"),
        r6("avg_login_hour"), r6("avg_files"), r6("avg_upload"),
        "usual_location", "usual_device", "anomaly_score", "is_anomaly",
        F.array_join("reasons", " | ").alias("reasons"))


ORACLE["ueba_scores"] = ORACLE_PREFIX.rstrip() + _UEBA_SQL + """
SELECT event_id, user_id, CAST(n AS BIGINT) AS n, round(avg_login_hour, 6) AS avg_login_hour,
       round(avg_files, 6) AS avg_files, round(avg_upload, 6) AS avg_upload,
       usual_location, usual_device, anomaly_score, anomaly_score >= 40 AS is_anomaly, reasons
FROM s
"""


@register("ueba_scores")
def q_ueba_scores(spark, sf):
    return _ueba_out(U.ueba_scores(security_logs(spark, sf)))


ORACLE["ueba_anomalies"] = ORACLE_PREFIX.rstrip() + _UEBA_SQL + """
SELECT timestamp, 'UEBA_ANOMALY' AS alert_type, user_id, anomaly_score, reasons,
       CAST(n AS BIGINT) AS total_events, usual_location, event_id, CAST(printf('%.1f', avg_files) AS DOUBLE) AS baseline_avg_files,
       concat_ws('|', (SELECT any_value(action) FROM security_logs l WHERE l.event_id = s.event_id),
                 CAST(files AS STRING), coalesce(location, 'None'), coalesce(device, 'None'), CAST(hour AS STRING)) AS activity
FROM s WHERE anomaly_score >= 40
"""


@register("ueba_anomalies")
def q_ueba_anomalies(spark, sf):
    a = U.ueba_anomalies(U.ueba_scores(security_logs(spark, sf)))
    return a.select("timestamp", "alert_type", "user_id", "anomaly_score",
                    F.array_join("reasons", " | ").alias("reasons"),
                    F.col("baseline.total_events").cast("long").alias("total_events"),
                    F.col("baseline.usual_location").alias("usual_location"), "event_id",
                    F.col("baseline.avg_files").alias("baseline_avg_files"),
                    F.concat_ws("|", "activity.action", F.col("activity.files").cast("string"),
                                F.coalesce("activity.location", F.lit("None")),
                                F.coalesce("activity.device", F.lit("None")),
                                F.col("activity.hour").cast("string")).alias("activity"))


ORACLE["ueba_stats"] = ORACLE_PREFIX.rstrip() + _UEBA_SQL + """
SELECT count(*) AS total_events, count(*) FILTER (WHERE anomaly_score >= 40) AS anomalies,
       count(DISTINCT user_id) AS users_tracked,
       round(100.0 * count(*) FILTER (WHERE anomaly_score >= 40) / greatest(1, count(*)), 6) AS anomaly_rate
FROM s
"""


@register("ueba_stats")
def q_ueba_stats(spark, sf):
    return U.ueba_stats(U.ueba_scores(security_logs(spark, sf)))


ORACLE["user_baseline"] = ORACLE_PREFIX.rstrip() + _UEBA_SQL + """
, last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS rk FROM s)
SELECT user_id, round(avg_login_hour, 6) AS avg_login_hour, round(avg_files, 6) AS avg_files,
       round(avg_upload, 6) AS avg_upload, round(std_login_hour, 6) AS std_login_hour, round(std_files, 6) AS std_files,
       usual_location, usual_device, CAST(n AS BIGINT) AS total_events
FROM last WHERE rk = 1 AND n >= 10
"""


@register("user_baseline")
def q_user_baseline(spark, sf):
    b = U.user_baseline(U.ueba_scores(security_logs(spark, sf)))
    return b.select("user_id", r6("avg_login_hour"), r6("avg_files"), r6("avg_upload"), r6("std_login_hour"), r6("std_files"),
                    "usual_location", "usual_device", F.col("total_events").cast("long").alias("total_events"))


ORACLE["running_threat_count"] = ORACLE_PREFIX.rstrip() + _UEBA_SQL + """
SELECT event_id, user_id,
       CAST(sum(CASE WHEN anomaly_score >= 40 THEN 1 ELSE 0 END)
            OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
         AS threat_count
FROM s
"""


@register("running_threat_count")
def q_running_threat_count(spark, sf):
    return U.running_threat_count(U.ueba_scores(security_logs(spark, sf)))


ORACLE["sample_every_10th"] = ORACLE_PREFIX.rstrip() + _UEBA_SQL + """
, o AS (SELECT *, row_number() OVER (ORDER BY timestamp, event_id) AS total FROM s)
SELECT event_id, user_id, total, anomaly_score, NOT hb AS learning FROM o WHERE total % 10 = 0 AND anomaly_score < 40
"""


@register("sample_every_10th")
def q_sample_every_10th(spark, sf):
    """W13, behavioural form: every 10th event, if it is not an anomaly."""
    s = U.ueba_scores(security_logs(spark, sf)).withColumn("outcome", F.when(F.col("is_anomaly"), "ANOMALY").otherwise("NORMAL"))
    return sample_by_outcome(s, {"NORMAL": 10}, ["timestamp", "event_id"]).select(
        "event_id", "user_id", "total", "anomaly_score", (~F.col("has_baseline")).alias("learning"))


# other query modules register themselves on import
from vigil.plans import q_investigate  # noqa: E402,F401
from vigil.plans import q_alerts  # noqa: E402,F401
from vigil.plans import q_ml  # noqa: E402,F401
from vigil.plans import q_stream  # noqa: E402,F401
from vigil.plans import q_explain  # noqa: E402,F401
from vigil.plans import q_io  # noqa: E402,F401
from vigil.plans import q_given  # noqa: E402,F401
from vigil.plans import q_invariants  # noqa: E402,F401
from vigil.plans import q_resume  # noqa: E402,F401
from vigil.plans import q_checks  # noqa: E402,F401
