"""The ``security_logs`` fixture view over the driver's ``events`` table.

The driver's tables hold no security logs, so a deterministic mapping turns
each event into an activity row.  Integer arithmetic on
``k = regexp_extract(props, '([0-9]+)', 1)`` keeps Spark and DuckDB equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.scoring import detector_score

# SQL text of the view; runs unchanged in Spark SQL and DuckDB (oracle side).
FIXTURE_SQL = """
SELECT
  event_id,
  ts AS timestamp,
  concat('u', CAST(user_id AS STRING)) AS user_id,
  CASE event_type WHEN 'view' THEN 'file_access' WHEN 'click' THEN 'download'
       WHEN 'purchase' THEN 'upload' WHEN 'signup' THEN 'login' ELSE 'logout' END AS action,
  CAST(CASE WHEN k >= 95 THEN floor(value * 100) + 1000 ELSE floor(value) END AS INT) AS files_accessed,
  CASE WHEN k < 60 THEN 'Pakistan' WHEN k < 70 THEN 'UAE' WHEN k < 80 THEN 'UK'
       WHEN k < 85 THEN NULL WHEN k < 90 THEN 'China' WHEN k < 95 THEN 'Iran'
       ELSE 'Russia' END AS location,
  CASE WHEN k % 10 = 9 THEN 'unknown' WHEN k % 10 = 8 THEN 'server'
       WHEN k % 3 = 0 THEN 'mobile' ELSE 'laptop' END AS device,
  CAST(hour(ts) AS INT) AS hour_of_day,
  CASE WHEN k >= 95 THEN 5 + k % 7 ELSE 1 + k % 3 END AS login_attempts,
  CASE WHEN k >= 85 THEN 1 ELSE 0 END AS foreign_ip,
  CASE WHEN k % 10 >= 8 THEN 1 ELSE 0 END AS unknown_device,
  CAST(CASE WHEN k >= 95 THEN floor(value * 10) ELSE floor(value / 2) END AS INT) AS data_uploaded_mb,
  event_id % 4 <> 3 AS success,
  CASE WHEN k >= 95 OR (k % 20 = 9 AND hour(ts) <= 5) THEN 1 ELSE 0 END AS is_threat
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) ev
"""

# Five-rule score over the view, as used by the hunting queries.
SCORE_SQL = """
  ( CAST(0.0 AS DOUBLE)
  + CASE WHEN coalesce(location, 'Pakistan') IN ('Pakistan', 'UAE') THEN CAST(0.0 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END
  + CASE WHEN device IN ('unknown', 'server', 'tor-node') THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END
  + CASE WHEN files_accessed > 1000 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END
  + CASE WHEN login_attempts > 5 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END
  + CASE WHEN hour_of_day < 6 OR hour_of_day > 22 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END )
"""

# CTE prefix for oracle SQL: ``security_logs`` and ``scored_logs``.
ORACLE_PREFIX = (
    "WITH security_logs AS (" + FIXTURE_SQL + "),\n"
    "scored_logs AS (SELECT *, " + SCORE_SQL + " AS threat_score FROM security_logs)\n"
)

_EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(*_EVENT_COLS)


def security_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed activity rows derived from ``events`` (DataFrame-API twin of FIXTURE_SQL)."""
    ev = read_events(spark, sf_dir)
    return from_events(ev)


def from_events(ev: DataFrame) -> DataFrame:
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("int")
    ev = ev.withColumn("k", k)
    k = F.col("k")
    hot = k >= 95
    action = (F.when(F.col("event_type") == "view", "file_access")
              .when(F.col("event_type") == "click", "download")
              .when(F.col("event_type") == "purchase", "upload")
              .when(F.col("event_type") == "signup", "login")
              .otherwise("logout"))
    files = F.when(hot, F.floor(F.col("value") * 100) + 1000).otherwise(F.floor("value")).cast("int")
    location = (F.when(k < 60, "Pakistan").when(k < 70, "UAE").when(k < 80, "UK")
                .when(k < 85, F.lit(None).cast("string")).when(k < 90, "China")
                .when(k < 95, "Iran").otherwise("Russia"))
    device = (F.when(k % 10 == 9, "unknown").when(k % 10 == 8, "server")
              .when(k % 3 == 0, "mobile").otherwise("laptop"))
    hour = F.hour("ts").cast("int")
    return ev.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        action.alias("action"),
        files.alias("files_accessed"),
        location.alias("location"),
        device.alias("device"),
        hour.alias("hour_of_day"),
        F.when(hot, 5 + k % 7).otherwise(1 + k % 3).alias("login_attempts"),
        F.when(k >= 85, 1).otherwise(0).alias("foreign_ip"),
        F.when(k % 10 >= 8, 1).otherwise(0).alias("unknown_device"),
        F.when(hot, F.floor(F.col("value") * 10)).otherwise(F.floor(F.col("value") / 2))
         .cast("int").alias("data_uploaded_mb"),
        (F.col("event_id") % 4 != 3).alias("success"),
        F.when(hot | ((k % 20 == 9) & (hour <= 5)), 1).otherwise(0).alias("is_threat"),
    )


def scored_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture rows plus the five-rule ``threat_score`` (DOUBLE)."""
    return with_threat_score(security_logs(spark, sf_dir))


def with_threat_score(df: DataFrame) -> DataFrame:
    return df.withColumn("threat_score", detector_score())
