"""Registered source/sink queries and the remaining per-user operators.

Sink → source round trips write the fixture (derived from ``events``) into a
fresh folder under the shared checkpoint folder and read it back through the
typed readers, so readers, writers and decoders are checked against SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.text import iso_text
from vigil.operators import alerts as A
from vigil.operators import investigate as I
from vigil.operators import ml as ML
from vigil.operators import ueba as U
from vigil.plans.registry import ORACLE
from vigil.plans.sql_text import UEBA_SQL as _UEBA_SQL
from vigil.plans.q_investigate import USER_AGG_SQL
from vigil.plans.q_ml import _train
from vigil.plans.registry import register, r6
from vigil.schema import FEATURES, LABELLED_CLEAN
from vigil.sources import logs as L
from vigil.sources import topic
from vigil.sources import sinks as K
from vigil.sources.fixture import ORACLE_PREFIX, security_logs
from vigil.streaming import streams as S

RAW_COLS_SQL = """
SELECT event_id, timestamp, user_id, action, files_accessed, location, device, login_attempts,
       data_uploaded_mb, foreign_ip FROM security_logs
"""


def _message():
    return F.to_json(F.struct(
        "event_id", iso_text("timestamp").alias("timestamp"), "user_id", "action", "files_accessed", "location",
        "device", "login_attempts", "data_uploaded_mb", "foreign_ip"))


def _raw_json(spark, sf):
    """Fixture rows as raw JSON messages (ISO text timestamps), as a producer sends them."""
    logs = security_logs(spark, sf)
    out = S.scratch(spark, "raw-json")
    msgs = logs.select(_message().alias("value"))
    msgs.write.mode("overwrite").text(out)
    return out


def _typed_back(df):
    return df.select("event_id", "timestamp", "user_id", "action", "files_accessed", "location", "device",
                     "login_attempts", "data_uploaded_mb", "foreign_ip")


@register("logs_json_roundtrip", RAW_COLS_SQL)
def q_logs_json_roundtrip(spark, sf):
    """S1 (json) + S14 value encoding: JSON documents read back typed."""
    from vigil.schema import RAW_EVENT
    from pyspark.sql import types as T
    schema = T.StructType(RAW_EVENT.fields + [T.StructField("event_id", T.LongType())])
    return _typed_back(L.read_logs(spark, _raw_json(spark, sf), "json", schema))


@register("decode_json_roundtrip", RAW_COLS_SQL)
def q_decode_json_roundtrip(spark, sf):
    """Message values decoded with the typed schema (PERMISSIVE); none is corrupt."""
    from vigil.schema import RAW_EVENT
    from pyspark.sql import types as T
    schema = T.StructType(RAW_EVENT.fields + [T.StructField("event_id", T.LongType())])
    text = spark.read.text(_raw_json(spark, sf))
    good, _bad = L.split_corrupt(L.decode_json(text, "value", schema))
    return _typed_back(L.canonical_logs(good))


@register("topic_batch_all", RAW_COLS_SQL)
def q_topic_batch_all(spark, sf):
    """The whole topic from the earliest message (no cap)."""
    return _typed_back(_topic_with_ids(spark, sf, None))


def _topic(spark, sf, per_segment: int = 1000) -> str:
    """The raw JSON messages as a topic of segments, in event order."""
    path = S.scratch(spark, "topic")
    messages = security_logs(spark, sf).select(F.col("event_id").alias("seq"), _message().alias("value"))
    topic.append(messages, path, per_segment)
    return path


def _event_schema():
    from vigil.schema import RAW_EVENT
    from pyspark.sql import types as T
    return T.StructType(RAW_EVENT.fields + [T.StructField("event_id", T.LongType())])


def _topic_with_ids(spark, sf, n):
    return L.read_topic_batch(spark, _topic(spark, sf), n=n, fmt="segments", schema=_event_schema())


@register("topic_batch_500", RAW_COLS_SQL.replace("FROM security_logs", "FROM security_logs ORDER BY event_id LIMIT 500"))
def q_topic_batch_500(spark, sf):
    """At most 500 messages from the earliest offset (arrival order).  The
    producer writes the event table in its stored (event id) order, so the
    oracle is the first 500 events by id."""
    return _typed_back(_topic_with_ids(spark, sf, 500))


@register("capped_scan_5000", """
SELECT event_id, user_id, timestamp FROM security_logs ORDER BY timestamp, event_id LIMIT 5000
""")
def q_capped_scan_5000(spark, sf):
    """Match-all scan capped at 5,000 rows in (time, id) order."""
    return L.read_logs_capped(security_logs(spark, sf), 5000).select("event_id", "user_id", "timestamp")


@register("labelled_csv_balance", """
SELECT count(*) AS total, CAST(sum(is_threat) AS BIGINT) AS threats,
       round(CAST(100.0 AS DOUBLE) * sum(is_threat) / greatest(1, count(*)), 6) AS threat_pct
FROM security_logs
""")
def q_labelled_csv_balance(spark, sf):
    """S16 → S3/S4: the labelled set written as CSV, found by the first-existing
    rule among candidate paths, read typed, class balance (A38)."""
    from vigil.operators import metrics as M
    logs = security_logs(spark, sf)
    out = S.scratch(spark, "labelled-csv")
    cols = [f.name for f in LABELLED_CLEAN.fields]
    K.write_table_csv(logs.select(iso_text("timestamp").alias("timestamp"), "user_id",
                                  F.lit(None).cast("string").alias("ip_address"),
                                  *[c for c in cols if c not in ("timestamp", "user_id", "ip_address")]), out)
    df = L.read_first_existing(spark, [f"{out}-missing", out])
    return M.class_balance(df).withColumn("threat_pct", F.round("threat_pct", 6))


@register("first_non_empty_source", "SELECT 1 AS source, event_id FROM security_logs")
def q_first_non_empty_source(spark, sf):
    """The first source that builds and has rows wins (an empty one and a
    failing one are skipped)."""
    logs = security_logs(spark, sf)
    i, df = L.first_non_empty(lambda: logs.filter(F.lit(False)), lambda: logs,
                              lambda: spark.read.parquet(f"{sf}/missing.parquet"))
    return df.select(F.lit(i).alias("source"), "event_id")


@register("sql_view_user_summary", """
SELECT user_id, count(*) AS total_actions, max(files_accessed) AS max_files FROM security_logs GROUP BY user_id
""")
def q_sql_view_user_summary(spark, sf):
    """The log frame as a SQL view, queried with SQL text."""
    L.register_view(security_logs(spark, sf), "security_logs")
    return spark.sql("SELECT user_id, count(*) AS total_actions, max(files_accessed) AS max_files "
                     "FROM security_logs GROUP BY user_id")


@register("alert_log_lines", """
SELECT concat_ws(' | ', strftime(timestamp, '%Y-%m-%dT%H:%M:%S') ||
                 CASE WHEN strftime(timestamp, '%f') <> '000000' THEN '.' || strftime(timestamp, '%f') ELSE '' END,
                 user_id, CAST(round(threat_score, 3) AS STRING), '[]') AS value
FROM scored_logs WHERE threat_score > 0.7
""")
def q_alert_log_lines(spark, sf):
    """``time | user | score | channels`` per detector alert."""
    return A.alert_log_lines(A.detector_alerts(A.detector_scores(security_logs(spark, sf))))


@register("stream_alert_topic_counts", """
SELECT 'UNKNOWN' AS alert_type, count(*) AS n FROM scored_logs WHERE threat_score > 0.7
""")
def q_stream_alert_topic_counts(spark, sf):
    """S14 → S8: detector alerts written as JSON values, consumed as a stream."""
    out = S.scratch(spark, "alert-topic")
    K.sink_alerts(A.detector_alerts(A.detector_scores(security_logs(spark, sf))), f"{out}/topic", "first")
    stream = S.stream_alerts(spark, f"{out}/topic")
    parsed = stream.select(F.coalesce(F.get_json_object("value", "$.alert_type"), F.lit("UNKNOWN"))
                           .alias("alert_type"))
    S.run_to_parquet(parsed, f"{out}/data", f"{out}/ckpt")
    return spark.read.parquet(f"{out}/data").groupBy("alert_type").agg(F.count(F.lit(1)).alias("n"))


@register("stream_logs_json_rows", RAW_COLS_SQL)
def q_stream_logs_json_rows(spark, sf):
    """The topic as an unbounded source, typed on the way in."""
    src = S.stream_logs(spark, _topic(spark, sf), "segments", schema=_event_schema())
    out = S.scratch(spark, "stream-json")
    S.run_to_parquet(_typed_back(src), f"{out}/data", f"{out}/ckpt")
    return spark.read.parquet(f"{out}/data")


@register("stream_until_idle_rows", RAW_COLS_SQL)
def q_stream_until_idle_rows(spark, sf):
    """The topic read by a consumer that ends itself when nothing comes in."""
    src = S.stream_logs(spark, _topic(spark, sf), "segments", schema=_event_schema())
    out = S.scratch(spark, "stream-idle")
    S.run_until_idle(_typed_back(src), f"{out}/data", f"{out}/ckpt", seconds=2)
    return spark.read.parquet(f"{out}/data")


@register("model_save_load", "SELECT count(*) AS rows, 0.0::DOUBLE AS max_abs_diff FROM security_logs")
def q_model_save_load(spark, sf):
    """Persist the forest, reload the first existing of two paths, and
    score with both in one pass: the probabilities are equal."""
    model = _train(spark, sf, "forest")
    out = S.scratch(spark, "model")
    ML.save_model(model, out)
    loaded = ML.load_first(spark, [f"{out}-missing", out])
    both = ML.score(loaded, ML.score(model, security_logs(spark, sf), "p_saved"), "p_loaded")
    return both.agg(F.count(F.lit(1)).alias("rows"),
                    F.max(F.abs(F.col("p_saved") - F.col("p_loaded"))).alias("max_abs_diff"))


@register("validated_features", "SELECT event_id, " + ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURES) + " FROM security_logs")
def q_validated_features(spark, sf):
    """Rows whose six features are present and numeric (rejected rows carry a reason)."""
    valid, _rejected = ML.validate_features(security_logs(spark, sf).select("event_id", *FEATURES))
    return valid


@register("score_batch_forest")
def q_score_batch_forest(spark, sf):
    """Batch scoring with the first available model, API levels."""
    s = ML.score_batch([_train(spark, sf, "forest")], security_logs(spark, sf))
    return s.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))


@register("score_cases")
def q_score_cases(spark, sf):
    """The named cases scored by the forest trained on the fixture."""
    return ML.score_case_table(spark, _train(spark, sf, "forest"))


@register("ensemble_scorer_stats")
def q_ensemble_scorer_stats(spark, sf):
    """Ensemble levels over all events (total, count and % per level)."""
    logs = security_logs(spark, sf)
    both = ML.score(_train(spark, sf, "forest"), ML.score(_train(spark, sf, "boosted"), logs, "xgb_prob"),
                    "rf_prob")
    return A.scorer_stats(A.ensemble_scores(both))


@register("stream_ensemble_alerts")
def q_stream_ensemble_alerts(spark, sf):
    """The ensemble scorer as ``foreachBatch`` over the live stream."""
    models = (_train(spark, sf, "boosted"), _train(spark, sf, "forest"))
    out = S.scratch(spark, "stream-ensemble")
    S.run_foreach_batch(S.stream_fixture_logs(spark, sf), f"{out}/data", f"{out}/ckpt",
                        transform=lambda b: S.stream_scorer_batch(models, b))
    return spark.read.parquet(f"{out}/data").drop("batch_id")


ORACLE["events_with_baseline"] = ORACLE_PREFIX.rstrip() + _UEBA_SQL + """
, last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS rk FROM s),
bl AS (SELECT user_id, round(avg_files, 6) AS baseline_avg_files, usual_location AS baseline_location,
              CAST(n AS BIGINT) AS baseline_events FROM last WHERE rk = 1 AND n >= 10)
SELECT e.event_id, e.user_id, bl.baseline_avg_files, bl.baseline_location, bl.baseline_events
FROM security_logs e LEFT JOIN bl ON e.user_id = bl.user_id
"""


@register("events_with_baseline")
def q_events_with_baseline(spark, sf):
    """Every event with its user's final baseline snapshot (left join)."""
    logs = security_logs(spark, sf)
    b = U.user_baseline(U.ueba_scores(logs)).select(
        "user_id", F.round("avg_files", 6).alias("baseline_avg_files"),
        F.col("usual_location").alias("baseline_location"),
        F.col("total_events").cast("long").alias("baseline_events"))
    return A.attach_baseline(logs.select("event_id", "user_id"), b)


@register("attach_verdict", USER_AGG_SQL + """
SELECT user_id, events, total_score, risk_level, round(avg_files, 6) AS avg_files, max_files FROM lv
""", cte=True)
def q_attach_verdict(spark, sf):
    """User statistics joined with the user's verdict."""
    logs = security_logs(spark, sf)
    stats = I.user_statistics(logs)
    verdict = I.user_verdicts(logs).select("user_id", "total_score", "risk_level")
    return stats.join(verdict, "user_id").select("user_id", "events", "total_score", "risk_level",
                                                 r6("avg_files"), "max_files")


@register("user_profile", _UEBA_SQL + """
, ac AS (SELECT user_id, coalesce(action, 'unknown') AS action, count(*) AS c FROM security_logs GROUP BY 1, 2),
am AS (SELECT user_id, string_agg(action || '=' || CAST(c AS STRING), ',' ORDER BY action) AS actions
       FROM ac GROUP BY user_id),
pf AS (SELECT user_id, count(*) AS total_events, min(timestamp) AS first_seen, max(timestamp) AS last_seen
       FROM security_logs GROUP BY user_id),
tc AS (SELECT user_id, count(*) FILTER (WHERE anomaly_score >= 40) AS threat_count FROM s GROUP BY user_id)
SELECT pf.user_id, total_events, first_seen, last_seen, actions, threat_count
FROM pf JOIN am USING (user_id) JOIN tc USING (user_id)
""", cte=True)
def q_user_profile(spark, sf):
    """Per-user counters, first/last seen, action counts, anomalies."""
    logs = security_logs(spark, sf)
    p = U.user_profile(logs, U.ueba_scores(logs))
    acts = F.array_join(F.transform(F.map_entries("actions"),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return p.select("user_id", "total_events", "first_seen", "last_seen", acts.alias("actions"), "threat_count")


@register("periodic_stats_every_50", _UEBA_SQL + """
, rc AS (SELECT *, sum(CASE WHEN anomaly_score >= 40 THEN 1 ELSE 0 END)
                   OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tc
         FROM s)
SELECT user_id, event_id, CAST(n AS BIGINT) AS events, CAST(tc AS BIGINT) AS anomalies,
       round(CAST(100.0 AS DOUBLE) * tc / n, 6) AS anomaly_rate
FROM rc WHERE n % 50 = 0
""", cte=True)
def q_periodic_stats_every_50(spark, sf):
    """Running totals per user at every 50th event."""
    return U.periodic_stats(U.ueba_scores(security_logs(spark, sf)), 50)


@register("distinct_users", "SELECT DISTINCT user_id FROM security_logs")
def q_distinct_users(spark, sf):
    """O6."""
    from vigil.operators.hunting import distinct_users
    return distinct_users(security_logs(spark, sf))
