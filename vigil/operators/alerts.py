"""Alert producers, the canonical alert frame, and alert roll-ups.

Producers (batch twins of the live stages):
- detector: five additive rules (or a model probability) per event, alert > 0.7
- behavioural: UEBA anomalies (``vigil.operators.ueba``)
- ensemble: weighted mean of two model probabilities, alert when HIGH

The three shapes are unioned by name and normalised with coalesce chains
(user_id→user→'unknown', alert_type→type→'UNKNOWN', location→'Unknown',
threat_score→anomaly_score→0.5, model→detector→'Unknown').  Scores keep their
own scale (``raw_score``): the roll-up compares all of them with 0.8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.scoring import (API_CUTS, DETECTOR_DEFAULTS, ENSEMBLE_CUTS, ENSEMBLE_WEIGHTS,
                                     AGREEMENT_GAP, RULE_ALERT_OVER, detector_foreign_ip,
                                     detector_unknown_device, odd_hour, risk_action, risk_emoji,
                                     risk_level, rule_score, safe_pct)
from vigil.functions.text import iso_text, ljust, py_round, tmpl
from vigil.functions.times import ntz_micros
from vigil.session import write_once

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------
DETECTOR_REASON = "High threat score detected"
ENSEMBLE_TYPE = "ENSEMBLE_THREAT"
BLOCK_OVER = 0.8
SOURCE_RANK = {"detector": 0, "ueba": 1, "ensemble": 2}
OVERALL_LEVELS = [  # (alerts above, text), first match wins
    (100, "🔴 CRITICAL - Immediate action required"),
    (50, "🟠 HIGH - Escalate to security team"),
    (20, "🟡 MEDIUM - Monitor closely"),
    (None, "🟢 LOW - Routine monitoring"),
]
REPORT_RECOMMENDATIONS = [  # (condition, text) in report order
    ("total > 100", "🔴 CRITICAL: Activate incident response team"),
    ("total > 100", "🔴 Block all suspicious IP ranges immediately"),
    ("total > 50", "🟠 Review high-risk user accounts immediately"),
    ("total > 50", "🟠 Enable MFA for all flagged accounts"),
    ("high_risk_users > 5", "🟡 Schedule security awareness training"),
    (None, "📋 Escalate critical findings to SOC Manager"),
    (None, "📊 Schedule automated hourly monitoring"),
    (None, "🔐 Review and update firewall rules"),
    (None, "📁 Backup and secure sensitive data"),
    (None, "📈 Generate follow-up report in 24 hours"),
]
ALERT_BOX = [
    "╔══════════════════════════════════╗",
    "║         🚨 THREAT ALERT!        ║",
    "╠══════════════════════════════════╣",
    "║ User:  {} ║",
    "║ Score: {} ║",
    "║ Time:  {} ║",
    "╚══════════════════════════════════╝",
]
NOTIFICATION_SUBJECT = "🚨 THREAT ALERT - {} - Score: {}"


def _opt(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


# ----------------------------------------------------------------- detector
def drop_test_messages(df: DataFrame) -> DataFrame:
    """Rows with a truthy ``test`` flag are skipped (plan-time check)."""
    if "test" in df.columns:
        return df.filter(~F.coalesce(F.col("test").cast("boolean"), F.lit(False)))
    return df


def with_detector_features(df: DataFrame) -> DataFrame:
    """Defaults for missing fields, hour of the event, derived flags."""
    hour = (F.col("hour_of_day") if "hour_of_day" in df.columns
            else F.hour(F.try_to_timestamp(F.col("timestamp").cast("string"))))
    # unparsable time: the live stage takes the current hour
    hour = F.coalesce(hour, F.hour(F.current_timestamp()))
    return (df.withColumn("d_hour", hour.cast("int"))
              .withColumn("d_files", F.coalesce(_opt(df, "files_accessed", "int"),
                                                F.lit(DETECTOR_DEFAULTS["files_accessed"])))
              .withColumn("d_attempts", F.coalesce(_opt(df, "login_attempts", "int"),
                                                   F.lit(DETECTOR_DEFAULTS["login_attempts"])))
              .withColumn("d_location", F.coalesce(_opt(df, "location"), F.lit(DETECTOR_DEFAULTS["location"])))
              .withColumn("d_device", F.coalesce(_opt(df, "device"), F.lit(DETECTOR_DEFAULTS["device"])))
              .withColumn("d_data_mb", F.coalesce(_opt(df, "data_mb", "int"), F.lit(DETECTOR_DEFAULTS["data_mb"])))
              .withColumn("d_foreign_ip", detector_foreign_ip("d_location"))
              .withColumn("d_unknown_device", detector_unknown_device("d_device")))


def detector_scores(df: DataFrame, model_score: Column | None = None) -> DataFrame:
    """T1 (batch) / E2 / M8: per-event score — the model probability when one
    is given, else the five rules — and the alert decision (strict > 0.7)."""
    feats = with_detector_features(drop_test_messages(df))
    rules = rule_score("d_hour", "d_files", "d_attempts", "d_foreign_ip", "d_unknown_device")
    score = rules if model_score is None else F.coalesce(model_score, rules)
    return feats.withColumn("score", score).withColumn("is_alert", F.col("score") > RULE_ALERT_OVER)


def detector_alerts(scored: DataFrame) -> DataFrame:
    """Alert rows of the detector (score rounded to 3 as Python does)."""
    return scored.filter(F.col("is_alert")).select(
        "event_id", F.col("user_id"),
        py_round(F.col("score"), 3).cast("double").alias("threat_score"),
        F.lit("HIGH").alias("risk_level"),
        F.col("timestamp"),
        F.coalesce(_opt(scored, "action"), F.lit("unknown")).alias("action"),
        F.col("d_location").alias("location"),
        F.col("d_files").alias("files_accessed"),
        F.col("d_device").alias("device"),
        F.lit(DETECTOR_REASON).alias("reason"))


def detector_stats(scored: DataFrame) -> DataFrame:
    """Total, alerts and alert rate (%)."""
    return scored.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_alert").alias("alerts")) \
                 .withColumn("alert_rate", F.round(safe_pct("alerts", "total"), 6))


# ----------------------------------------------------------------- ensemble
def ensemble_scores(df: DataFrame, boosted: str = "xgb_prob", forest: str = "rf_prob",
                    cuts: tuple[float, float] = ENSEMBLE_CUTS) -> DataFrame:
    """M9: 0.6 * boosted + 0.4 * forest, level/action/emoji, agreement when the
    two probabilities differ by less than 0.2."""
    final = F.col(boosted) * ENSEMBLE_WEIGHTS["boosted"] + F.col(forest) * ENSEMBLE_WEIGHTS["forest"]
    hi, mid = cuts
    return (df.withColumn("final_score", final)
              .withColumn("risk_level", risk_level("final_score", hi, mid))
              .withColumn("action", risk_action("final_score", hi, mid))
              .withColumn("emoji", risk_emoji("final_score", hi, mid))
              .withColumn("model_agreement",
                          F.when(F.abs(F.col(boosted) - F.col(forest)) < AGREEMENT_GAP, "STRONG")
                          .otherwise("WEAK")))


def ensemble_alerts(scored: DataFrame, boosted: str = "xgb_prob", forest: str = "rf_prob",
                    features: list[str] | None = None) -> DataFrame:
    """P20: HIGH ensemble results as alerts (type ENSEMBLE_THREAT, no user)."""
    feats = features or [c for c in ["hour_of_day", "files_accessed", "login_attempts", "foreign_ip",
                                     "unknown_device", "data_uploaded_mb"] if c in scored.columns]
    return scored.filter(F.col("risk_level") == "HIGH").select(
        F.lit(ENSEMBLE_TYPE).alias("type"), "timestamp",
        py_round(F.col("final_score"), 3).cast("double").alias("threat_score"),
        py_round(F.col(boosted), 3).cast("double").alias("xgb_score"),
        py_round(F.col(forest), 3).cast("double").alias("rf_score"),
        "risk_level", "action", "emoji", "model_agreement",
        F.struct(*feats).alias("features_analyzed"),
        *(["event_id"] if "event_id" in scored.columns else []))


def mean_ensemble(df: DataFrame, score_cols: list[str], cuts: tuple[float, float] = API_CUTS) -> DataFrame:
    """Mean of the available model scores (NULL = model unavailable),
    API cut-offs, agreement when all scores round to the same tenth."""
    arr = F.filter(F.array(*[F.col(c).cast("double") for c in score_cols]), lambda x: x.isNotNull())
    n = F.size(arr)
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    hi, mid = cuts
    out = df.withColumn("models_used", n).withColumn(
        "threat_score", F.when(n > 0, total / n).otherwise(F.lit(0.0)))
    agree = F.size(F.array_distinct(F.transform(arr, lambda x: py_round(x, 1)))) <= 1
    return (out.withColumn("risk_level", risk_level("threat_score", hi, mid))
               .withColumn("action", risk_action("threat_score", hi, mid))
               .withColumn("emoji", risk_emoji("threat_score", hi, mid))
               .withColumn("agreement", F.when(agree, "STRONG").otherwise("WEAK")))


# ----------------------------------------------------------------- canonical
def canonical_alerts(*frames: tuple[str, DataFrame]) -> DataFrame:
    """O5 + P17: union alert frames of any producer shape and normalise.

    ``frames`` are ``(source, df)`` pairs.  ``seq`` orders arrivals (event
    time, then producer, then event id) and breaks 'first seen' ties."""
    parts = []
    for source, df in frames:
        parts.append(df.withColumn("source", F.lit(source))
                       .withColumn("_src_rank", F.lit(SOURCE_RANK.get(source, 9))))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)

    def opt(name: str, dtype: str = "string") -> Column:
        return _opt(u, name, dtype)

    ts = opt("timestamp", "timestamp_ntz").cast("timestamp_ntz")
    eid = F.coalesce(opt("event_id", "bigint"), F.lit(0))
    micros = ntz_micros(ts)  # wall-clock microseconds, independent of the session zone
    return u.select(
        ts.alias("ts"),
        F.coalesce(opt("user_id"), opt("user"), F.lit("unknown")).alias("user_id"),
        F.coalesce(opt("alert_type"), opt("type"), F.lit("UNKNOWN")).alias("alert_type"),
        F.coalesce(opt("location"), F.lit("Unknown")).alias("location"),
        F.coalesce(opt("threat_score", "double"), opt("anomaly_score", "double"), F.lit(0.5)).alias("raw_score"),
        F.coalesce(opt("model"), opt("detector"), F.lit("Unknown")).alias("model"),
        opt("risk_level").alias("risk_level"),
        opt("reasons", "array<string>").alias("reasons"),
        F.col("source"),
        (micros * 4 + F.col("_src_rank")).alias("seq"),
        eid.alias("event_id"),
    )


# ----------------------------------------------------------------- roll-ups
def alerts_total(al: DataFrame) -> DataFrame:
    """A9."""
    return al.agg(F.count(F.lit(1)).alias("total_alerts"))


def alerts_by(al: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """Count per key (user, type, location, model), most first;
    ties keep first-seen order."""
    out = al.groupBy(key).agg(F.count(F.lit(1)).alias("count"), F.min("seq").alias("first_seq"))
    out = out.orderBy(F.col("count").desc(), "first_seq")
    return out.withColumnRenamed(key, name) if name else out


def alerts_by_hour(al: DataFrame) -> DataFrame:
    """Count per hour of the alert time (unparsable times skipped),
    all 24 hours via a spine, night mark for hours < 6 or > 22."""
    counts = (al.filter(F.col("ts").isNotNull())
                .groupBy(F.hour("ts").cast("int").alias("hour")).agg(F.count(F.lit(1)).alias("n")))
    spine = al.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    out = spine.join(F.broadcast(counts), "hour", "left").select(
        "hour", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("count"),
        odd_hour(F.col("hour")).alias("night"))
    return out.orderBy("hour")


def top_alert_users(al: DataFrame, n: int = 5) -> DataFrame:
    """Most alerted users, first-seen tie-break, severity mark."""
    top = alerts_by(al, "user_id").limit(n)
    sev = F.when(F.col("count") > 10, "🔴").when(F.col("count") > 5, "🟠").otherwise("🟡")
    return top.withColumn("severity", sev)


def executive_summary(al: DataFrame, top_n: int = 5) -> DataFrame:
    """Totals, high-risk users = min(5, distinct users), blocked
    (score > 0.8) and the overall level, in one aggregate."""
    out = al.agg(F.count(F.lit(1)).alias("total_alerts"),
                 F.least(F.lit(top_n).cast("long"), F.count_distinct("user_id")).alias("high_risk_users"),
                 F.count_if(F.col("raw_score") > BLOCK_OVER).alias("threats_blocked"))
    t = F.col("total_alerts")
    level = F.lit(OVERALL_LEVELS[-1][1])
    for above, text in reversed(OVERALL_LEVELS[:-1]):
        level = F.when(t > above, F.lit(text)).otherwise(level)
    return out.withColumn("risk_level", level)


def report_recommendations(summary: DataFrame, limit: int = 8) -> DataFrame:
    """Conditional recommendation list (first ``limit``), one row each."""
    conds = {"total > 100": F.col("total_alerts") > 100, "total > 50": F.col("total_alerts") > 50,
             "high_risk_users > 5": F.col("high_risk_users") > 5}
    recs = F.array(*[F.lit(text) if cond is None else F.when(conds[cond], F.lit(text))
                     for cond, text in REPORT_RECOMMENDATIONS])
    recs = F.slice(F.filter(recs, lambda x: x.isNotNull()), 1, limit)
    return summary.select(F.posexplode(recs).alias("pos", "recommendation")) \
                  .withColumn("pos", (F.col("pos") + 1).cast("int"))


def alert_timeline(al: DataFrame) -> DataFrame:
    """One row per alert in arrival order."""
    return al.select(F.col("ts").alias("timestamp"), F.col("user_id").alias("user"),
                     F.col("raw_score").alias("score"), F.col("alert_type").alias("type"), "seq") \
             .orderBy("seq")


def last_n_alerts(al: DataFrame, n: int = 100) -> DataFrame:
    """The most recent ``n`` alerts (TakeOrderedAndProject)."""
    return al.orderBy(F.col("seq").desc()).limit(n)


def alert_message(alerts: DataFrame) -> DataFrame:
    """The notifier's box text for detector-shaped alerts."""
    ts_text = F.substring(iso_text("timestamp"), 1, 19)
    values = iter([F.col("user_id"), F.col("threat_score"), ts_text])
    lines = F.array(*[tmpl(row, ljust(next(values), 26)) if "{}" in row else F.lit(row) for row in ALERT_BOX])
    return alerts.select("event_id", F.array_join(lines, "\n").alias("message"))


def alert_notification(alerts: DataFrame) -> DataFrame:
    """Notification subject and fields (text only), 'N/A' for missing."""
    def na(c: str) -> Column:
        return F.coalesce(_opt(alerts, c).cast("string"), F.lit("N/A"))
    subject = tmpl(NOTIFICATION_SUBJECT, F.col("user_id"), F.col("threat_score"))
    fields = F.array(
        F.concat(F.lit("User ID: "), F.col("user_id")),
        F.concat(F.lit("Threat Score: "), F.col("threat_score").cast("string")),
        F.concat(F.lit("Risk Level: "), F.coalesce(_opt(alerts, "risk_level"), F.lit("HIGH"))),
        F.concat(F.lit("Location: "), na("location")),
        F.concat(F.lit("Device: "), na("device")),
        F.concat(F.lit("Files Accessed: "), na("files_accessed")),
        F.concat(F.lit("Time: "), F.coalesce(iso_text(_opt(alerts, "timestamp", "timestamp_ntz")), F.lit("N/A"))))
    return alerts.select("event_id", subject.alias("subject"), F.array_join(fields, "\n").alias("body"))


def alert_log_lines(alerts: DataFrame, channels: str = "[]") -> DataFrame:
    """S15 text: ``time | user | score | channels`` per alert."""
    return alerts.select(F.concat_ws(" | ", iso_text("timestamp"),
                                     F.col("user_id"), F.col("threat_score").cast("string"),
                                     F.lit(channels)).alias("value"))


# ----------------------------------------------------------------- dashboard numbers
def threat_distribution(scored: DataFrame, score: str = "score", cuts: tuple[float, float] = API_CUTS) -> DataFrame:
    """Threats (events with a non-zero score) split HIGH/MEDIUM/LOW by the
    API cut-offs, each as % of threats; safe events and their % of all events.
    Percentages are rounded half-even like Python's ``round``."""
    hi, mid = cuts
    s = F.col(score)
    out = scored.agg(
        F.count(F.lit(1)).alias("total_logs"),
        F.count_if(s > hi).alias("high_threats"),
        F.count_if((s > mid) & (s <= hi)).alias("medium_threats"),
        F.count_if((s > 0) & (s <= mid)).alias("low_threats"))
    out = out.withColumn("total_alerts", F.col("high_threats") + F.col("medium_threats") + F.col("low_threats"))
    tot = F.greatest(F.lit(1), F.col("total_alerts"))
    out = (out.withColumn("high_pct", F.bround(F.col("high_threats") / tot * 100, 0).cast("long"))
              .withColumn("med_pct", F.bround(F.col("medium_threats") / tot * 100, 0).cast("long"))
              .withColumn("low_pct", F.bround(F.col("low_threats") / tot * 100, 0).cast("long"))
              .withColumn("safe_events", F.col("total_logs") - F.col("high_threats") - F.col("medium_threats")))
    return out.withColumn("safe_percent", F.bround(F.col("safe_events") / F.greatest(F.lit(1), F.col("total_logs"))
                                                   * 100, 0).cast("long"))


def top_threat_users_scored(alerts: DataFrame, n: int = 4) -> DataFrame:
    """User, alert count, max score and a colour band, most alerted first."""
    out = alerts.groupBy("user_id").agg(F.count(F.lit(1)).alias("alerts"),
                                        F.max("threat_score").alias("max_score"))
    colour = (F.when(F.col("max_score") >= 0.9, "#ff4444").when(F.col("max_score") >= 0.8, "#ff8800")
              .otherwise("#ffaa00"))
    return out.withColumn("color", colour).orderBy(F.col("alerts").desc(), F.col("max_score").desc(),
                                                   "user_id").limit(n)


def request_stats(scored: DataFrame, score: str = "score", cuts: tuple[float, float] = API_CUTS) -> DataFrame:
    """Scored requests and how many were HIGH."""
    return scored.agg(F.count(F.lit(1)).alias("total_requests"),
                      F.count_if(F.col(score) > cuts[0]).alias("threats_detected"))


def scorer_stats(scored: DataFrame, level: str = "risk_level") -> DataFrame:
    """Scored total and count / percent per level (divisor max(1, n))."""
    n = F.count(F.lit(1))
    out = scored.agg(n.alias("total"), *[F.count_if(F.col(level) == lv).alias(lv.lower())
                                         for lv in ("HIGH", "MEDIUM", "LOW")])
    for lv in ("high", "medium", "low"):
        out = out.withColumn(f"{lv}_pct", F.round(safe_pct(lv, "total"), 6))
    return out


def attach_baseline(events: DataFrame, baseline: DataFrame) -> DataFrame:
    """Each event with its user's baseline snapshot (left equi-join; AQE
    broadcasts the baseline at run time when it is small).  The baseline is
    written first: both sides are then plain shuffles, and a user with a large
    part of all events is split among tasks."""
    return events.join(write_once(baseline, "baseline"), "user_id", "left")


ROLLUP_DIMS = ["alert_type", "location", "model", "user_id", "hour"]


def alert_rollups(al: DataFrame) -> DataFrame:
    """Every report counter in one pass over the alerts: GROUPING SETS over
    type, location, engine, user and hour, plus the grand total.  Rows:
    ``(dim, key, count, first_seq, blocked, max_ts)``; one row per distinct
    value of each dimension, so the result is small next to the alerts."""
    x = al.withColumn("hour", F.hour("ts").cast("int"))
    g = x.groupingSets([[d] for d in ROLLUP_DIMS] + [[]], *ROLLUP_DIMS).agg(
        F.count(F.lit(1)).alias("count"), F.min("seq").alias("first_seq"),
        F.count_if(F.col("raw_score") > BLOCK_OVER).alias("blocked"), F.max("ts").alias("max_ts"),
        *[F.grouping(d).alias(f"_g_{d}") for d in ROLLUP_DIMS])
    dim = F.lit("total")
    for d in reversed(ROLLUP_DIMS):
        dim = F.when(F.col(f"_g_{d}") == 0, F.lit(d)).otherwise(dim)
    key = F.coalesce(*[F.col(d).cast("string") for d in ROLLUP_DIMS])
    return g.select(dim.alias("dim"), key.alias("key"), "count", "first_seq", "blocked", "max_ts")


def rollup_dim(r: DataFrame, dim: str, name: str | None = None) -> DataFrame:
    """One dimension of ``alert_rollups`` as (value, count, first_seq)."""
    return r.filter(F.col("dim") == dim).select(F.col("key").alias(name or dim), "count", "first_seq")


def summary_from_rollups(r: DataFrame, top_n: int = 5) -> DataFrame:
    """A16-A19 from the roll-up table (same row as ``executive_summary``)."""
    users = r.filter(F.col("dim") == "user_id").select(F.count(F.lit(1))).scalar()
    total = r.filter(F.col("dim") == "total")

    def of(c: str) -> Column:  # without alerts the roll-up has no total row
        return F.coalesce(total.select(F.max(c)).scalar(), F.lit(0)).cast("long")

    out = r.sparkSession.range(1).select(
        of("count").alias("total_alerts"), F.least(F.lit(top_n).cast("long"), users).alias("high_risk_users"),
        of("blocked").alias("threats_blocked"))
    t = F.col("total_alerts")
    level = F.lit(OVERALL_LEVELS[-1][1])
    for above, text in reversed(OVERALL_LEVELS[:-1]):
        level = F.when(t > above, F.lit(text)).otherwise(level)
    return out.withColumn("risk_level", level)
