"""Registered alert queries: producers, canonical union, roll-ups, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators import alerts as A
from vigil.operators import report as R
from vigil.operators import ueba as U
from vigil.plans.sql_text import UEBA_SQL as _UEBA_SQL
from vigil.plans.registry import ORACLE, register
from vigil.sources.fixture import ORACLE_PREFIX, security_logs
from vigil.session import write_once


def given_probabilities(logs: DataFrame) -> DataFrame:
    """Two stand-in model probabilities derived from the events, so that
    everything behind the models can be checked with SQL."""
    scored = A.detector_scores(logs)
    return scored.withColumns({
        "xgb_prob": F.col("score") * 0.4 + F.pmod(F.col("event_id") * 37, F.lit(100)) * 0.005,
        "rf_prob": F.col("score") * 0.2 + F.pmod(F.col("event_id") * 53, F.lit(50)) * 0.015})


GIVEN_SQL = """
, given AS (SELECT *, threat_score * 0.4::DOUBLE + (event_id * 37 % 100) * 0.005::DOUBLE AS xgb_prob,
                   threat_score * 0.2::DOUBLE + (event_id * 53 % 50) * 0.015::DOUBLE AS rf_prob FROM scored_logs),
ens AS (SELECT *, xgb_prob * 0.6::DOUBLE + rf_prob * 0.4::DOUBLE AS final_score FROM given)
"""


def fixture_alerts(spark, sf, materialize: bool = False):
    """Canonical alerts of all three producers over the fixture.
    ``materialize`` writes them once when one frame
    feeds many outputs (the report)."""
    logs = security_logs(spark, sf)
    det = A.detector_alerts(A.detector_scores(logs))
    ueba = U.ueba_anomalies(U.ueba_scores(logs))
    ens = A.ensemble_alerts(A.ensemble_scores(given_probabilities(logs)))
    al = A.canonical_alerts(("detector", det), ("ueba", ueba), ("ensemble", ens))
    if materialize:
        al = write_once(al, "alerts")
    return al


ALERTS_SQL = GIVEN_SQL + _UEBA_SQL + """
, det AS (SELECT timestamp AS ts, user_id, 'UNKNOWN' AS alert_type, coalesce(location, 'Pakistan') AS location,
                 round(threat_score, 3) AS raw_score, 'Unknown' AS model, 'detector' AS source,
                 epoch_us(timestamp) * 4 + 0 AS seq, event_id
          FROM scored_logs WHERE threat_score > 0.7),
ue AS (SELECT timestamp AS ts, user_id, 'UEBA_ANOMALY' AS alert_type, 'Unknown' AS location,
              CAST(anomaly_score AS DOUBLE) AS raw_score, 'Unknown' AS model, 'ueba' AS source,
              epoch_us(timestamp) * 4 + 1 AS seq, event_id
       FROM s WHERE anomaly_score >= 40),
en AS (SELECT timestamp AS ts, 'unknown' AS user_id, 'ENSEMBLE_THREAT' AS alert_type, 'Unknown' AS location,
              round(final_score, 3) AS raw_score, 'Unknown' AS model, 'ensemble' AS source,
              epoch_us(timestamp) * 4 + 2 AS seq, event_id
       FROM ens WHERE final_score > 0.3::DOUBLE),
al AS (SELECT * FROM det UNION ALL SELECT * FROM ue UNION ALL SELECT * FROM en)
"""

DET_SQL = """
, det AS (SELECT event_id, user_id, round(threat_score, 3) AS threat_score, 'HIGH' AS risk_level, timestamp,
                 coalesce(action, 'unknown') AS action, coalesce(location, 'Pakistan') AS location,
                 coalesce(files_accessed, 0) AS files_accessed, coalesce(device, 'laptop') AS device,
                 'High threat score detected' AS reason
          FROM scored_logs WHERE threat_score > 0.7)
"""


def _det(spark, sf):
    return A.detector_alerts(A.detector_scores(security_logs(spark, sf)))


@register("detector_alerts", DET_SQL + "SELECT * FROM det", cte=True)
def q_detector_alerts(spark, sf):
    return _det(spark, sf)


@register("detector_stats", """
SELECT count(*) AS total, count(*) FILTER (WHERE threat_score > 0.7) AS alerts,
       round(CAST(100.0 AS DOUBLE) * count(*) FILTER (WHERE threat_score > 0.7) / greatest(1, count(*)), 6)
         AS alert_rate
FROM scored_logs
""")
def q_detector_stats(spark, sf):
    return A.detector_stats(A.detector_scores(security_logs(spark, sf)))


@register("alerts_canonical", ALERTS_SQL + """
SELECT ts, user_id, alert_type, location, raw_score, model, source, seq, event_id FROM al
""", cte=True)
def q_alerts_canonical(spark, sf):
    return fixture_alerts(spark, sf).select("ts", "user_id", "alert_type", "location", "raw_score", "model",
                                            "source", "seq", "event_id")


@register("executive_summary", ALERTS_SQL + """
SELECT count(*) AS total_alerts, least(5, count(DISTINCT user_id)) AS high_risk_users,
       count(*) FILTER (WHERE raw_score > 0.8) AS threats_blocked,
       CASE WHEN count(*) > 100 THEN '🔴 CRITICAL - Immediate action required'
            WHEN count(*) > 50 THEN '🟠 HIGH - Escalate to security team'
            WHEN count(*) > 20 THEN '🟡 MEDIUM - Monitor closely'
            ELSE '🟢 LOW - Routine monitoring' END AS risk_level
FROM al
""", cte=True)
def q_executive_summary(spark, sf):
    return A.executive_summary(fixture_alerts(spark, sf))


def _by(key: str, name: str):
    sql = ALERTS_SQL + f"SELECT {key}, count(*) AS count, min(seq) AS first_seq FROM al GROUP BY {key}"

    @register(name, sql, cte=True)
    def q(spark, sf):
        return A.alerts_by(fixture_alerts(spark, sf), key)
    return q


_by("user_id", "alerts_by_user")
_by("alert_type", "alerts_by_type")
_by("location", "alerts_by_location")
_by("model", "alerts_by_model")


@register("alerts_by_hour", ALERTS_SQL + """
, c AS (SELECT CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM al WHERE ts IS NOT NULL GROUP BY 1)
SELECT CAST(h.i AS INT) AS hour, CAST(coalesce(c.n, 0) AS BIGINT) AS count, (h.i < 6 OR h.i > 22) AS night
FROM range(24) h(i) LEFT JOIN c ON CAST(h.i AS INT) = c.hour
""", cte=True)
def q_alerts_by_hour(spark, sf):
    return A.alerts_by_hour(fixture_alerts(spark, sf))


@register("top_alert_users", ALERTS_SQL + """
SELECT user_id, count(*) AS count, min(seq) AS first_seq,
       CASE WHEN count(*) > 10 THEN '🔴' WHEN count(*) > 5 THEN '🟠' ELSE '🟡' END AS severity
FROM al GROUP BY user_id ORDER BY count DESC, first_seq LIMIT 5
""", cte=True)
def q_top_alert_users(spark, sf):
    return A.top_alert_users(fixture_alerts(spark, sf), 5)


@register("report_recommendations", ALERTS_SQL + """
, sm AS (SELECT count(*) AS t, least(5, count(DISTINCT user_id)) AS h FROM al),
rr AS (SELECT 1 AS k, '🔴 CRITICAL: Activate incident response team' AS rec FROM sm WHERE t > 100
      UNION ALL SELECT 2, '🔴 Block all suspicious IP ranges immediately' FROM sm WHERE t > 100
      UNION ALL SELECT 3, '🟠 Review high-risk user accounts immediately' FROM sm WHERE t > 50
      UNION ALL SELECT 4, '🟠 Enable MFA for all flagged accounts' FROM sm WHERE t > 50
      UNION ALL SELECT 5, '🟡 Schedule security awareness training' FROM sm WHERE h > 5
      UNION ALL SELECT 6, '📋 Escalate critical findings to SOC Manager'
      UNION ALL SELECT 7, '📊 Schedule automated hourly monitoring'
      UNION ALL SELECT 8, '🔐 Review and update firewall rules'
      UNION ALL SELECT 9, '📁 Backup and secure sensitive data'
      UNION ALL SELECT 10, '📈 Generate follow-up report in 24 hours'),
o AS (SELECT CAST(row_number() OVER (ORDER BY k) AS INT) AS pos, rec AS recommendation FROM rr)
SELECT * FROM o WHERE pos <= 8
""", cte=True)
def q_report_recommendations(spark, sf):
    return A.report_recommendations(A.executive_summary(fixture_alerts(spark, sf)))


@register("alert_timeline", ALERTS_SQL + """
SELECT ts AS timestamp, user_id AS user, raw_score AS score, alert_type AS type, seq FROM al
""", cte=True)
def q_alert_timeline(spark, sf):
    return A.alert_timeline(fixture_alerts(spark, sf))


@register("last_100_alerts", ALERTS_SQL + """
SELECT ts, user_id, alert_type, raw_score, seq FROM al ORDER BY seq DESC LIMIT 100
""", cte=True)
def q_last_100_alerts(spark, sf):
    return A.last_n_alerts(fixture_alerts(spark, sf), 100).select("ts", "user_id", "alert_type", "raw_score", "seq")


def _lj(x: str, w: int) -> str:
    return f"CASE WHEN length({x}) >= {w} THEN {x} ELSE rpad({x}, {w}, ' ') END"


@register("alert_messages", DET_SQL + f"""
SELECT event_id, concat_ws(chr(10),
  '╔══════════════════════════════════╗', '║         🚨 THREAT ALERT!        ║',
  '╠══════════════════════════════════╣',
  concat('║ User:  ', {_lj('user_id', 26)}, ' ║'),
  concat('║ Score: ', {_lj('CAST(threat_score AS STRING)', 26)}, ' ║'),
  concat('║ Time:  ', {_lj("strftime(timestamp, '%Y-%m-%dT%H:%M:%S')", 26)}, ' ║'),
  '╚══════════════════════════════════╝') AS message
FROM det
""", cte=True)
def q_alert_messages(spark, sf):
    return A.alert_message(_det(spark, sf))


@register("alert_notifications", DET_SQL + """
SELECT event_id, concat('🚨 THREAT ALERT - ', user_id, ' - Score: ', CAST(threat_score AS STRING)) AS subject,
       concat_ws(chr(10), concat('User ID: ', user_id), concat('Threat Score: ', CAST(threat_score AS STRING)),
                 concat('Risk Level: ', risk_level), concat('Location: ', location),
                 concat('Device: ', device), concat('Files Accessed: ', CAST(files_accessed AS STRING)),
                 concat('Time: ', strftime(timestamp, '%Y-%m-%dT%H:%M:%S'),
                        CASE WHEN strftime(timestamp, '%f') <> '000000' THEN '.' || strftime(timestamp, '%f')
                             ELSE '' END)) AS body
FROM det
""", cte=True)
def q_alert_notifications(spark, sf):
    return A.alert_notification(_det(spark, sf))


@register("threat_distribution", """
, c AS (SELECT count(*) AS total_logs,
               count(*) FILTER (WHERE threat_score > 0.7) AS high_threats,
               count(*) FILTER (WHERE threat_score > 0.4 AND threat_score <= 0.7) AS medium_threats,
               count(*) FILTER (WHERE threat_score > 0 AND threat_score <= 0.4) AS low_threats
        FROM scored_logs),
d AS (SELECT *, high_threats + medium_threats + low_threats AS total_alerts FROM c)
SELECT total_logs, high_threats, medium_threats, low_threats, total_alerts,
       CAST(round_even(high_threats / greatest(1, total_alerts) * 100, 0) AS BIGINT) AS high_pct,
       CAST(round_even(medium_threats / greatest(1, total_alerts) * 100, 0) AS BIGINT) AS med_pct,
       CAST(round_even(low_threats / greatest(1, total_alerts) * 100, 0) AS BIGINT) AS low_pct,
       total_logs - high_threats - medium_threats AS safe_events,
       CAST(round_even((total_logs - high_threats - medium_threats) / greatest(1, total_logs) * 100, 0) AS BIGINT)
         AS safe_percent
FROM d
""", cte=True)
def q_threat_distribution(spark, sf):
    return A.threat_distribution(A.detector_scores(security_logs(spark, sf)))


@register("top_threat_users_scored", DET_SQL + """
SELECT user_id, count(*) AS alerts, max(threat_score) AS max_score,
       CASE WHEN max(threat_score) >= 0.9 THEN '#ff4444' WHEN max(threat_score) >= 0.8 THEN '#ff8800'
            ELSE '#ffaa00' END AS color
FROM det GROUP BY user_id ORDER BY alerts DESC, max_score DESC, user_id LIMIT 4
""", cte=True)
def q_top_threat_users_scored(spark, sf):
    return A.top_threat_users_scored(_det(spark, sf), 4)


@register("request_stats", """
SELECT count(*) AS total_requests, count(*) FILTER (WHERE threat_score > 0.7) AS threats_detected FROM scored_logs
""")
def q_request_stats(spark, sf):
    return A.request_stats(A.detector_scores(security_logs(spark, sf)))


@register("threat_report")
def q_threat_report(spark, sf):  # oracle: threat_report_sql() (registered below)
    """The full daily report text (rows-only check)."""
    return R.threat_report(fixture_alerts(spark, sf, materialize=True), "daily")


@register("report_statistics")
def q_report_statistics(spark, sf):
    """S17 content (rows-only: nested maps)."""
    return R.report_statistics(fixture_alerts(spark, sf, materialize=True))


def _sq(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _tmpl_sql(fmt: str, *vals: str) -> str:
    parts = fmt.split("{}")
    out = [_sq(parts[0])]
    for v, p in zip(vals, parts[1:]):
        out += [f"CAST({v} AS STRING)", _sq(p)]
    return "concat(" + ", ".join(out) + ")"


def _rj(x: str, w: int) -> str:
    x = f"CAST({x} AS STRING)"
    return f"(CASE WHEN length({x}) >= {w} THEN {x} ELSE lpad({x}, {w}, ' ') END)"


def threat_report_sql(report_type: str = "daily") -> str:
    """Oracle for A37, with its own literal text: nothing here comes from the
    report operator."""
    W = 68
    titles = {
        "summary": "│                      EXECUTIVE SUMMARY                           │",
        "breakdown": "│                     THREAT BREAKDOWN                             │",
        "top": "│                       TOP THREATS                                 │",
        "hourly": "│                    HOURLY DISTRIBUTION                            │",
        "engines": "│                    DETECTION ENGINES                             │",
        "actions": "│                    RECOMMENDED ACTIONS                            │",
    }
    top_line, bot_line = "╔" + "═" * W + "╗", "╚" + "═" * W + "╝"
    box_end = "└" + "─" * W + "┘"

    def box(key):
        return ["┌" + "─" * W + "┐", titles[key], "├" + "─" * W + "┤"]

    def lit_rows(section, texts, start=0):
        return [f"SELECT {section} AS section, {start + i} AS pos, "
                f"{t if t.startswith('concat(') else _sq(t)} AS line FROM gt"
                for i, t in enumerate(texts)]

    h = ["║               CYBERSECURITY THREAT REPORT                       ║",
         "║                  {} ANALYSIS                            ║",
         "║  Generated: {}                       ║",
         "║  Report Type: {} Threat Report                       ║",
         "║  Classification: CONFIDENTIAL                                     ║"]
    sr = ["│  Total Alerts (24h):     {}                         │",
          "│  High Risk Users:        {}                         │",
          "│  Threats Blocked:        {}                         │",
          "│  Overall Risk Level:     {} │"]
    recs = [("t > 100", "🔴 CRITICAL: Activate incident response team"),
            ("t > 100", "🔴 Block all suspicious IP ranges immediately"),
            ("t > 50", "🟠 Review high-risk user accounts immediately"),
            ("t > 50", "🟠 Enable MFA for all flagged accounts"),
            ("h > 5", "🟡 Schedule security awareness training"),
            ("TRUE", "📋 Escalate critical findings to SOC Manager"),
            ("TRUE", "📊 Schedule automated hourly monitoring"),
            ("TRUE", "🔐 Review and update firewall rules"),
            ("TRUE", "📁 Backup and secure sensitive data"),
            ("TRUE", "📈 Generate follow-up report in 24 hours")]
    rec_rows = " UNION ALL ".join(f"SELECT {i} AS k, {_sq(text)} AS rec FROM sm WHERE {cond}"
                                  for i, (cond, text) in enumerate(recs))
    levels = ("CASE WHEN t > 100 THEN '🔴 CRITICAL - Immediate action required' "
              "WHEN t > 50 THEN '🟠 HIGH - Escalate to security team' "
              "WHEN t > 20 THEN '🟡 MEDIUM - Monitor closely' ELSE '🟢 LOW - Routine monitoring' END")
    parts = []
    parts += lit_rows(1, [top_line, h[0], h[1].format(report_type.upper()), "╠" + "═" * W + "╣",
                          _tmpl_sql(h[2], "gen"), h[3].format(report_type.capitalize()), h[4], bot_line, ""])
    parts += lit_rows(2, box("summary"))
    parts += [f"SELECT 2, 3, {_tmpl_sql(sr[0], _rj('t', 6))} FROM sm",
              f"SELECT 2, 4, {_tmpl_sql(sr[1], _rj('h', 6))} FROM sm",
              f"SELECT 2, 5, {_tmpl_sql(sr[2], _rj('b', 6))} FROM sm",
              f"SELECT 2, 6, {_tmpl_sql(sr[3], _lj(levels, 30))} FROM sm"]
    parts += lit_rows(2, [box_end, ""], start=7)
    parts += lit_rows(3, box("breakdown") + ["│  📊 By Alert Type:                                                 │"], start=-10)
    parts += [f"SELECT 3, rk + 1, {_tmpl_sql('│    {} {} {} │', _lj('alert_type', 30), _rj('c', 4), 'bar')} "
              f"FROM ty WHERE rk <= 5"]
    parts += lit_rows(4, ["│" + " " * W + "│", "│  🌍 By Location:                                                   │"], start=-10)
    parts += [f"SELECT 4, rk, {_tmpl_sql('│    {} {}                │', _lj('location', 30), _rj('c', 4))} FROM lo WHERE rk <= 3"]
    parts += lit_rows(5, [box_end, ""])
    parts += lit_rows(6, box("top"), start=-10)
    parts += [f"SELECT 6, rk, {_tmpl_sql('│  {}. {} {} {} alerts          │', _rj('rk', 2), 'sev', _lj('user_id', 25), _rj('c', 4))} "
              f"FROM tu WHERE rk <= 5"]
    parts += lit_rows(7, [box_end, ""])
    parts += lit_rows(8, box("hourly"), start=-10)
    parts += [f"SELECT 8, hour, {_tmpl_sql('│  {}:00 {} {}{} │', 'lpad(CAST(hour AS STRING), 2, ' + _sq('0') + ')', _lj('bar', 40), _rj('c', 4), 'night')} FROM hr"]
    parts += lit_rows(9, [box_end, ""])
    parts += lit_rows(10, box("engines"), start=-10)
    parts += [f"SELECT 10, rk, {_tmpl_sql('│  🤖 {} {} detections     │', _lj('model', 30), _rj('c', 4))} FROM mo"]
    parts += lit_rows(11, [box_end, ""])
    parts += lit_rows(12, box("actions"), start=-10)
    parts += [f"SELECT 12, pos, {_tmpl_sql('│  {}. {} │', 'pos', _lj('rec', 60))} FROM rc WHERE pos <= 8"]
    parts += lit_rows(13, [box_end, ""])
    parts += lit_rows(14, [top_line, "║          Report generated by AI Cybersecurity Platform         ║", _tmpl_sql("║               © {} - All Rights Reserved                   ║", "yr"), bot_line])
    body = "\nUNION ALL ".join(parts)
    return ALERTS_SQL + f"""
, gt AS (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS gen, CAST(year(max(ts)) AS STRING) AS yr FROM al),
sm AS (SELECT count(*) AS t, least(5, count(DISTINCT user_id)) AS h,
              count(*) FILTER (WHERE raw_score > 0.8) AS b FROM al),
tyc AS (SELECT alert_type, count(*) AS c, min(seq) AS fs FROM al GROUP BY alert_type),
ty AS (SELECT *, row_number() OVER (ORDER BY c DESC, fs) AS rk,
              repeat('█', CAST(least(30, floor(c * 30 / greatest(1, max(c) OVER ()))) AS INT)) AS bar FROM tyc),
lo AS (SELECT *, row_number() OVER (ORDER BY c DESC, fs) AS rk FROM
         (SELECT location, count(*) AS c, min(seq) AS fs FROM al WHERE location <> 'Pakistan' GROUP BY location)),
tu AS (SELECT *, row_number() OVER (ORDER BY c DESC, fs) AS rk,
              CASE WHEN c > 10 THEN '🔴' WHEN c > 5 THEN '🟠' ELSE '🟡' END AS sev FROM
         (SELECT user_id, count(*) AS c, min(seq) AS fs FROM al GROUP BY user_id)),
hc AS (SELECT CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM al WHERE ts IS NOT NULL GROUP BY 1),
hs AS (SELECT CAST(s.i AS INT) AS hour, CAST(coalesce(hc.n, 0) AS BIGINT) AS c
       FROM range(24) s(i) LEFT JOIN hc ON CAST(s.i AS INT) = hc.hour),
hr AS (SELECT hour, c,
              repeat('█', CAST(CASE WHEN max(c) OVER () > 0 THEN floor(c * 40 / max(c) OVER ()) ELSE 0 END AS INT))
                AS bar,
              CASE WHEN hour < 6 OR hour > 22 THEN ' 🌙' ELSE '' END AS night FROM hs),
mo AS (SELECT model, c, row_number() OVER (ORDER BY fs) AS rk FROM
         (SELECT model, count(*) AS c, min(seq) AS fs FROM al GROUP BY model)),
rr0 AS ({rec_rows.replace("FROM sm", "FROM (SELECT t, h FROM sm) sm")}),
rc AS (SELECT CAST(row_number() OVER (ORDER BY k) AS INT) AS pos, rec FROM rr0),
lines AS ({body})
SELECT CAST(section AS INT) AS section, CAST(pos AS INT) AS pos, line FROM lines
"""


ORACLE["threat_report"] = ORACLE_PREFIX.rstrip() + threat_report_sql("daily")
