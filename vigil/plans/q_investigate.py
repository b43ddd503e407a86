"""Registered investigation queries (risk factors, verdicts, rankings, stats)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import investigate as I
from vigil.plans.registry import register, r6
from vigil.sources.fixture import security_logs


def _fmt0(x: str) -> str:
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS STRING)"


USER_AGG_SQL = f"""
, ua AS (
  SELECT user_id, count(*) AS events, min(event_id) AS first_seen,
    count(*) FILTER (WHERE hour_of_day BETWEEN 0 AND 5) AS night_count,
    count(*) FILTER (WHERE location IS DISTINCT FROM 'Pakistan') AS foreign_count,
    count(*) FILTER (WHERE location IN ('Russia', 'China', 'North Korea', 'Iran')) AS high_risk_count,
    count(DISTINCT location) AS unique_locations,
    avg(files_accessed) AS avg_files, max(files_accessed) AS max_files,
    count(*) FILTER (WHERE files_accessed > 1000) AS files_over_1000,
    stddev_samp(files_accessed) AS std_files,
    CAST(sum(unknown_device) AS BIGINT) AS unknown_count,
    count(*) FILTER (WHERE login_attempts > 5) AS attempts_over_5,
    avg(login_attempts) AS avg_logins,
    count(*) FILTER (WHERE data_uploaded_mb > 500) AS uploads_over_500,
    avg(data_uploaded_mb) AS avg_upload,
    CAST(sum(data_uploaded_mb) AS BIGINT) AS total_upload,
    CAST(sum(foreign_ip) AS BIGINT) AS foreign_ip_count
  FROM security_logs GROUP BY user_id),
pc AS (SELECT *,
    CAST(100.0 AS DOUBLE) * night_count / events AS night_pct,
    CAST(100.0 AS DOUBLE) * foreign_count / events AS foreign_pct,
    CAST(100.0 AS DOUBLE) * unknown_count / events AS unknown_pct,
    CAST(100.0 AS DOUBLE) * foreign_ip_count / events AS foreign_ip_pct
  FROM ua),
sc AS (SELECT *, CAST(least(100,
      (CASE WHEN night_pct > 30 THEN 25 ELSE 0 END)
    + (CASE WHEN foreign_pct > 20 THEN 20 + (CASE WHEN high_risk_count > 0 THEN 10 ELSE 0 END) ELSE 0 END)
    + (CASE WHEN max_files > 5000 THEN 30 WHEN max_files > 1000 THEN 15 ELSE 0 END)
    + (CASE WHEN unknown_pct > 30 THEN 15 ELSE 0 END)
    + (CASE WHEN attempts_over_5 > 0 THEN least(10, 2 * attempts_over_5) ELSE 0 END)
    + (CASE WHEN uploads_over_500 > 0 THEN 15 ELSE 0 END)
    + (CASE WHEN foreign_ip_pct > 20 THEN 20 ELSE 0 END)) AS INT) AS total_score
  FROM pc),
lv AS (SELECT *, CASE WHEN total_score >= 80 THEN 'CRITICAL' WHEN total_score >= 60 THEN 'HIGH'
                      WHEN total_score >= 40 THEN 'MEDIUM' WHEN total_score >= 20 THEN 'LOW'
                      ELSE 'CLEAN' END AS risk_level
  FROM sc)
"""


@register("user_risk_ranking", USER_AGG_SQL + """
SELECT CAST(row_number() OVER (ORDER BY total_score DESC, first_seen) AS BIGINT) AS rank,
       user_id, total_score AS score, risk_level AS level, events
FROM lv
""", cte=True)
def q_user_risk_ranking(spark, sf):
    return I.user_risk_ranking(security_logs(spark, sf))


FACTORS_SQL = f"""
, f AS (
  SELECT user_id, 1 AS ord, 'Night Activity' AS factor,
         concat({_fmt0('night_pct')}, '% activity at night (12-5AM)') AS detail, 25 AS score,
         'HIGH' AS severity FROM lv WHERE night_pct > 30
  UNION ALL
  SELECT user_id, 2, 'Foreign Location', concat({_fmt0('foreign_pct')}, '% foreign access'),
         20 + CASE WHEN high_risk_count > 0 THEN 10 ELSE 0 END,
         CASE WHEN high_risk_count > 0 THEN 'CRITICAL' ELSE 'HIGH' END FROM lv WHERE foreign_pct > 20
  UNION ALL
  SELECT user_id, 3, 'Excessive File Access',
         concat('Max ', CAST(max_files AS STRING), ' files, Avg ', {_fmt0('avg_files')}, ', ',
                CAST(files_over_1000 AS STRING), ' events >1000'), 30, 'CRITICAL'
  FROM lv WHERE max_files > 5000
  UNION ALL
  SELECT user_id, 3, 'High File Access',
         concat('Max ', CAST(max_files AS STRING), ' files, Avg ', {_fmt0('avg_files')}), 15, 'MEDIUM'
  FROM lv WHERE max_files > 1000 AND max_files <= 5000
  UNION ALL
  SELECT user_id, 4, 'Unknown Device', concat({_fmt0('unknown_pct')}, '% from unknown devices'), 15, 'HIGH'
  FROM lv WHERE unknown_pct > 30
  UNION ALL
  SELECT user_id, 5, 'Multiple Logins', concat(CAST(attempts_over_5 AS STRING), ' events with >5 login attempts'),
         least(10, 2 * attempts_over_5), 'MEDIUM' FROM lv WHERE attempts_over_5 > 0
  UNION ALL
  SELECT user_id, 6, 'High Data Upload',
         concat(CAST(uploads_over_500 AS STRING), ' events >500MB, Avg ', {_fmt0('avg_upload')}, 'MB'), 15,
         CASE WHEN avg_upload > 1000 THEN 'HIGH' ELSE 'MEDIUM' END FROM lv WHERE uploads_over_500 > 0
  UNION ALL
  SELECT user_id, 7, 'Foreign IP', concat({_fmt0('foreign_ip_pct')}, '% from foreign IPs'), 20, 'HIGH'
  FROM lv WHERE foreign_ip_pct > 20)
"""


@register("user_risk_factors", USER_AGG_SQL + FACTORS_SQL + """
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, ord) AS INT) AS pos,
       factor, detail, CAST(score AS INT) AS score, severity
FROM f
""", cte=True)
def q_user_risk_factors(spark, sf):
    v = I.user_verdicts(security_logs(spark, sf))
    x = v.select("user_id", F.posexplode("risk_factors").alias("p", "f"))
    return x.select("user_id", (F.col("p") + 1).cast("int").alias("pos"), F.col("f.factor").alias("factor"),
                    F.col("f.detail").alias("detail"), F.col("f.score").alias("score"),
                    F.col("f.severity").alias("severity"))


@register("foreign_location_map", """
SELECT user_id, location, count(*) AS n FROM security_logs
WHERE location IS NOT NULL AND location <> 'Pakistan' GROUP BY user_id, location
""")
def q_foreign_location_map(spark, sf):
    m = I.location_map(security_logs(spark, sf))
    return m.select("user_id", F.explode("locations").alias("location", "n"))


@register("user_statistics", """
, hc AS (SELECT user_id, hour_of_day, count(*) AS c,
                row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, hour_of_day) AS rk
         FROM security_logs GROUP BY user_id, hour_of_day),
lc AS (SELECT user_id, location, count(*) AS c,
              row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, location) AS rk
       FROM security_logs WHERE location IS NOT NULL GROUP BY user_id, location),
dc AS (SELECT user_id, device, count(*) AS c FROM security_logs WHERE device IS NOT NULL
       GROUP BY user_id, device),
dm AS (SELECT user_id, '{' || string_agg('''' || device || ''': ' || CAST(c AS STRING), ', '
                                         ORDER BY c DESC, device) || '}' AS devices
       FROM dc GROUP BY user_id),
ua AS (SELECT user_id, count(*) AS events,
              count(*) FILTER (WHERE hour_of_day BETWEEN 0 AND 5) AS night_count,
              count(DISTINCT location) AS unique_locations, avg(files_accessed) AS avg_files,
              max(files_accessed) AS max_files, stddev_samp(files_accessed) AS std_files,
              avg(login_attempts) AS avg_logins, CAST(sum(data_uploaded_mb) AS BIGINT) AS total_upload
       FROM security_logs GROUP BY user_id)
SELECT ua.user_id, events, hc.hour_of_day AS peak_hour, night_count, unique_locations,
       lc.location AS top_location, round(avg_files, 6) AS avg_files, max_files, round(std_files, 6) AS std_files,
       round(avg_logins, 6) AS avg_logins, total_upload, devices
FROM ua LEFT JOIN hc ON ua.user_id = hc.user_id AND hc.rk = 1
        LEFT JOIN lc ON ua.user_id = lc.user_id AND lc.rk = 1
        LEFT JOIN dm ON ua.user_id = dm.user_id
""", cte=True)
def q_user_statistics(spark, sf):
    from vigil.functions.text import py_dict_text
    s = I.user_statistics(security_logs(spark, sf))
    return s.select("user_id", "events", "peak_hour", "night_count", "unique_locations", "top_location",
                    r6("avg_files"), "max_files", r6("std_files"), r6("avg_logins"), "total_upload",
                    py_dict_text(F.col("devices")).alias("devices"))


@register("user_patterns_recommendations", USER_AGG_SQL + f"""
SELECT user_id,
  concat_ws(' | ',
    CASE WHEN night_pct > 30 THEN concat('🔴 Night owl: ', {_fmt0('night_pct')}, '% activity during 12AM-5AM')
         WHEN night_pct > 10 THEN concat('🟡 Occasional late work: ', {_fmt0('night_pct')}, '% night activity')
         ELSE '🟢 Normal working hours' END,
    CASE WHEN unique_locations > 3 THEN concat('🔴 High mobility: ', CAST(unique_locations AS STRING),
                                               ' different locations')
         WHEN unique_locations > 1 THEN concat('🟡 Travel pattern: ', CAST(unique_locations AS STRING), ' locations')
         ELSE '🟢 Single location' END,
    CASE WHEN std_files > 1000 THEN '🔴 Erratic file access (high variance)'
         ELSE '🟢 Consistent file access pattern' END,
    CASE WHEN unknown_pct > 20 THEN concat('🔴 ', {_fmt0('unknown_pct')}, '% unknown devices - possible security bypass')
         WHEN unknown_pct > 0 THEN concat('🟡 ', {_fmt0('unknown_pct')}, '% unknown devices')
         ELSE '🟢 All known devices' END) AS patterns,
  concat_ws(' | ',
    CASE WHEN total_score >= 80 THEN '🚨 IMMEDIATE: Disable account and initiate security investigation' END,
    CASE WHEN total_score >= 80 THEN '📞 Escalate to SOC Manager immediately' END,
    CASE WHEN total_score >= 60 THEN '🔐 Enable MFA immediately' END,
    CASE WHEN total_score >= 60 THEN '📋 Review all recent activity logs' END,
    CASE WHEN high_risk_count > 0 THEN concat('🌍 Block access from high-risk countries (',
                                              CAST(high_risk_count AS STRING), ' events)') END,
    CASE WHEN max_files > 5000 THEN '📁 Review data loss prevention (DLP) policies' END,
    CASE WHEN unknown_count > 0 THEN '💻 Enforce device compliance policy' END,
    CASE WHEN NOT (total_score >= 60 OR high_risk_count > 0 OR max_files > 5000 OR unknown_count > 0)
         THEN '✅ No immediate action required' END,
    '📊 Schedule next review in 24 hours') AS recommendations
FROM lv
""", cte=True)
def q_user_patterns_recommendations(spark, sf):
    logs = security_logs(spark, sf)
    stats = I.user_statistics(logs)
    verdicts = I.risk_factors(stats)
    out = I.behaviour_patterns(stats).join(I.user_recommendations(verdicts), "user_id")
    return out.select("user_id", F.array_join("patterns", " | ").alias("patterns"),
                      F.array_join("recommendations", " | ").alias("recommendations"))


@register("risk_level_members", USER_AGG_SQL + """
, rk AS (SELECT CAST(row_number() OVER (ORDER BY total_score DESC, first_seen) AS BIGINT) AS rank,
                user_id, risk_level AS level FROM lv)
SELECT level, count(*) OVER (PARTITION BY level) AS level_users, rank, user_id FROM rk
""", cte=True)
def q_risk_level_members(spark, sf):
    return I.risk_level_members(I.user_risk_ranking(security_logs(spark, sf)))


@register("risky_user_events", USER_AGG_SQL + """
SELECT s.event_id, s.user_id, s.timestamp FROM security_logs s
WHERE s.user_id IN (SELECT user_id FROM lv WHERE risk_level IN ('CRITICAL', 'HIGH'))
""", cte=True)
def q_risky_user_events(spark, sf):
    return I.risky_user_events(security_logs(spark, sf)).select("event_id", "user_id", "timestamp")


@register("investigation_report")
def q_investigation_report(spark, sf):
    """Full report text for every user, as of the newest event."""
    logs = security_logs(spark, sf)
    return I.investigation_report(logs, generated=logs.select(F.max("timestamp")).scalar())


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fill(fmt: str, *vals: str) -> str:
    parts = fmt.split("{}")
    out = [_q(parts[0])]
    for v, p in zip(vals, parts[1:]):
        out += [f"CAST({v} AS STRING)", _q(p)]
    return "concat(" + ", ".join(out) + ")"


def investigation_report_sql(source: str = "parquet") -> str:
    """Oracle for A36, with its own literal text: nothing here comes from the
    investigation operator."""
    rt = {"title": "🔍 USER INVESTIGATION REPORT", "generated": "🕐 Generated: {}", "user": "👤 User: {}",
          "source": "📁 Source: {}", "records": "📊 Records: {}", "verdict": "{} RISK VERDICT: {}",
          "score": "  Risk Score: {}/100", "action": "  Action: {}", "factors": "⚠️  RISK FACTORS FOUND:",
          "no_factors": "  ✅ No significant risk factors found", "stats": "📊 ACTIVITY STATISTICS",
          "patterns": "🧠 BEHAVIORAL PATTERNS", "recommendations": "💡 RECOMMENDATIONS",
          "complete": "✅ INVESTIGATION COMPLETE"}
    pt = {"night_high": "🔴 Night owl: {}% activity during 12AM-5AM",
          "night_some": "🟡 Occasional late work: {}% night activity", "night_none": "🟢 Normal working hours",
          "mobility_high": "🔴 High mobility: {} different locations", "mobility_some": "🟡 Travel pattern: {} locations",
          "mobility_none": "🟢 Single location", "files_erratic": "🔴 Erratic file access (high variance)",
          "files_steady": "🟢 Consistent file access pattern",
          "device_high": "🔴 {}% unknown devices - possible security bypass", "device_some": "🟡 {}% unknown devices",
          "device_none": "🟢 All known devices"}
    rc = {"disable": "🚨 IMMEDIATE: Disable account and initiate security investigation",
          "escalate": "📞 Escalate to SOC Manager immediately", "mfa": "🔐 Enable MFA immediately",
          "review": "📋 Review all recent activity logs",
          "countries": "🌍 Block access from high-risk countries ({} events)",
          "dlp": "📁 Review data loss prevention (DLP) policies", "devices": "💻 Enforce device compliance policy",
          "none": "✅ No immediate action required", "always": "📊 Schedule next review in 24 hours"}
    verdicts = {"CRITICAL": ("🔴", "IMMEDIATE BLOCK + Investigation"),
                "HIGH": ("🟠", "Block suspicious activity, enable MFA"),
                "MEDIUM": ("🟡", "Monitor closely, review access"), "LOW": ("🟢", "Continue routine monitoring"),
                "CLEAN": ("✅", "No action needed")}
    marks = {"CRITICAL": "🔴", "HIGH": "🟠", "MEDIUM": "🟡", "LOW": "🟢"}
    bar, thin = _q("=" * 70), _q("-" * 70)
    verdict_emoji = "CASE risk_level " + " ".join(
        f"WHEN {_q(k)} THEN {_q(v[0])}" for k, v in verdicts.items()) + " END"
    verdict_action = "CASE risk_level " + " ".join(
        f"WHEN {_q(k)} THEN {_q(v[1])}" for k, v in verdicts.items()) + " END"
    sev_emoji = "CASE severity " + " ".join(
        f"WHEN {_q(k)} THEN {_q(v)}" for k, v in marks.items()) \
        + f" ELSE {_q('⚪')} END"
    f0 = _fmt0
    header = ", ".join([bar, _q(rt["title"]), bar,
                        _fill(rt["generated"], "(SELECT strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') FROM security_logs)"),
                        _fill(rt["user"], "user_id"),
                        _q(rt["source"].format(source)), _fill(rt["records"], "events"), "''", bar,
                        _fill(rt["verdict"], verdict_emoji, "risk_level"), bar, _fill(rt["score"], "total_score"),
                        _fill(rt["action"], verdict_action), "''"])
    stats = ", ".join([
        _fill("  Total Events: {}", "events"), _fill("  Peak Hour: {}:00", "coalesce(CAST(peak AS STRING), 'N/A')"),
        _fill("  Night Activity: {} events ({}%)", "night_count", f0("night_pct")),
        _fill("  Locations: {} unique (Most: {})", "unique_locations", "coalesce(top_loc, 'N/A')"),
        _fill("  Avg Files: {}", f0("avg_files")), _fill("  Max Files: {}", "max_files"),
        _fill("  Devices Used: {}", "coalesce(devices, '{}')"),
        _fill("  Avg Logins: {}", "printf('%.1f', avg_logins)"), _fill("  Total Upload: {} MB", "total_upload")])
    pats = ", ".join([
        f"'  ' || CASE WHEN night_pct > 30 THEN {_fill(pt['night_high'], f0('night_pct'))} "
        f"WHEN night_pct > 10 THEN {_fill(pt['night_some'], f0('night_pct'))} ELSE {_q(pt['night_none'])} END",
        f"'  ' || CASE WHEN unique_locations > 3 THEN {_fill(pt['mobility_high'], 'unique_locations')} "
        f"WHEN unique_locations > 1 THEN {_fill(pt['mobility_some'], 'unique_locations')} "
        f"ELSE {_q(pt['mobility_none'])} END",
        f"'  ' || CASE WHEN std_files > 1000 THEN {_q(pt['files_erratic'])} ELSE {_q(pt['files_steady'])} END",
        f"'  ' || CASE WHEN unknown_pct > 20 THEN {_fill(pt['device_high'], f0('unknown_pct'))} "
        f"WHEN unknown_pct > 0 THEN {_fill(pt['device_some'], f0('unknown_pct'))} ELSE {_q(pt['device_none'])} END"])
    recs = ", ".join([
        f"CASE WHEN total_score >= 80 THEN {_q(rc['disable'])} END",
        f"CASE WHEN total_score >= 80 THEN {_q(rc['escalate'])} END",
        f"CASE WHEN total_score >= 60 THEN {_q(rc['mfa'])} END",
        f"CASE WHEN total_score >= 60 THEN {_q(rc['review'])} END",
        f"CASE WHEN high_risk_count > 0 THEN {_fill(rc['countries'], 'high_risk_count')} END",
        f"CASE WHEN max_files > 5000 THEN {_q(rc['dlp'])} END",
        f"CASE WHEN unknown_count > 0 THEN {_q(rc['devices'])} END"])
    return USER_AGG_SQL + FACTORS_SQL + f"""
, fr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, ord) AS pos FROM f),
lm AS (SELECT user_id, '{{' || string_agg('''' || location || ''': ' || CAST(n AS STRING), ', '
                                          ORDER BY n DESC, location) || '}}' AS locs
       FROM (SELECT user_id, location, count(*) AS n FROM security_logs
             WHERE location IS NOT NULL AND location <> 'Pakistan' GROUP BY 1, 2) GROUP BY user_id),
fl AS (SELECT fr.user_id, pos, list_concat(
         [concat('  ', CAST(pos AS STRING), '. [', rpad(severity, 8, ' '), '] ', {sev_emoji}, ' ', factor),
          '     ' || detail, '     Risk Contribution: +' || CAST(score AS STRING)],
         CASE WHEN ord = 2 THEN ['     Locations: ' || coalesce(lm.locs, '{{}}')] ELSE [] END,
         ['']) AS lines
       FROM fr LEFT JOIN lm ON fr.user_id = lm.user_id),
fb AS (SELECT user_id, flatten(list(lines ORDER BY pos)) AS lines FROM fl GROUP BY user_id),
hcm AS (SELECT user_id, hour_of_day AS peak FROM (SELECT user_id, hour_of_day,
          row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, hour_of_day) AS rk
          FROM security_logs GROUP BY 1, 2) WHERE rk = 1),
lcm AS (SELECT user_id, location AS top_loc FROM (SELECT user_id, location,
          row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, location) AS rk
          FROM security_logs WHERE location IS NOT NULL GROUP BY 1, 2) WHERE rk = 1),
dm AS (SELECT user_id, '{{' || string_agg('''' || device || ''': ' || CAST(c AS STRING), ', '
                                          ORDER BY c DESC, device) || '}}' AS devices
       FROM (SELECT user_id, device, count(*) AS c FROM security_logs WHERE device IS NOT NULL GROUP BY 1, 2)
       GROUP BY user_id),
rp AS (SELECT lv.*, peak, top_loc, devices, fb.lines AS factor_lines,
              list_filter([{recs}], lambda x: x IS NOT NULL) AS rec0
       FROM lv LEFT JOIN hcm ON lv.user_id = hcm.user_id LEFT JOIN lcm ON lv.user_id = lcm.user_id
               LEFT JOIN dm ON lv.user_id = dm.user_id LEFT JOIN fb ON lv.user_id = fb.user_id),
rr AS (SELECT *, list_concat(CASE WHEN len(rec0) = 0 THEN [{_q(rc['none'])}] ELSE rec0 END,
                             [{_q(rc['always'])}]) AS recs FROM rp),
doc AS (SELECT user_id, list_concat(
          [{header}],
          CASE WHEN factor_lines IS NULL OR len(factor_lines) = 0
               THEN [{_q(rt['no_factors'])}, '']
               ELSE list_concat([{thin}, {_q(rt['factors'])}, {thin}], factor_lines) END,
          [{thin}, {_q(rt['stats'])}, {thin}, {stats}, ''],
          [{thin}, {_q(rt['patterns'])}, {thin}, {pats}, ''],
          [{thin}, {_q(rt['recommendations'])}, {thin}],
          list_transform(recs, lambda x, i: concat('  ', CAST(i AS STRING), '. ', x)),
          ['', {bar}, {_q(rt['complete'])}, {bar}]) AS lines
        FROM rr)
SELECT user_id, CAST(generate_subscripts(lines, 1) - 1 AS INT) AS line_no, unnest(lines) AS line FROM doc
"""


from vigil.plans.registry import ORACLE as _ORACLE  # noqa: E402
from vigil.sources.fixture import ORACLE_PREFIX as _PREFIX  # noqa: E402

_ORACLE["investigation_report"] = _PREFIX.rstrip() + investigation_report_sql("parquet")
