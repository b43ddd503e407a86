"""Registered queries for readers, writers and helpers that other queries
don't pass through: what is written is read back."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vigil.functions.scoring import is_ipv4
from vigil.functions.text import capitalised, report_file_name, slug
from vigil.operators import hunting as H
from vigil.operators import ml as ML
from vigil.operators import report as R
from vigil.plans.q_alerts import fixture_alerts
from vigil.plans.registry import ORACLE, register
from vigil.schema import FEATURES
from vigil.sources import logs as L
from vigil.sources import sinks as K
from vigil.sources.fixture import security_logs
from vigil.streaming import streams as S


@register("labelled_csv_rows", f"SELECT {', '.join(FEATURES)}, is_threat FROM security_logs")
def q_labelled_csv_rows(spark, sf):
    """The labelled set written as CSV and read with its schema."""
    path = S.scratch(spark, "labelled")
    K.write_table_csv(security_logs(spark, sf).select(*FEATURES, "is_threat"), path)
    return L.read_labelled_csv(spark, path)


@register("rows_to_frame", "SELECT r_regionkey, r_name FROM region")
def q_rows_to_frame(spark, sf):
    """Rows held by the caller (here a table of five) as a frame."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/region.parquet").select("r_regionkey", "r_name").collect()]
    key, name = (t for _, t in spark.read.parquet(f"{sf}/region.parquet").select("r_regionkey", "r_name").dtypes)
    return L.from_rows(spark, rows, f"r_regionkey {key}, r_name {name}")


@register("report_text_lines")
def q_report_text_lines(spark, sf):
    """The daily report written as text and read back."""
    path = S.scratch(spark, "report-text")
    K.write_report_text(R.threat_report(fixture_alerts(spark, sf, materialize=True), "daily"), path)
    return spark.read.text(path)


ORACLE["report_text_lines"] = f"SELECT line AS value FROM ({ORACLE['threat_report']})"


@register("report_file_names", """
SELECT user_id, 'investigation_' || user_id || '_' || strftime(max(timestamp), '%Y%m%d_%H%M%S') || '.txt' AS user_file,
       'threat_report_daily_' || strftime(max(timestamp), '%Y%m%d_%H%M%S') || '.txt' AS report_file
FROM security_logs GROUP BY user_id
""")
def q_report_file_names(spark, sf):
    """E5: file names of each user's reports, as of the user's last event."""
    last = security_logs(spark, sf).groupBy("user_id").agg(F.max("timestamp").alias("t"))
    return last.select("user_id", report_file_name("user", "t", user="user_id").alias("user_file"),
                       report_file_name("threat", "t", "daily").alias("report_file"))


IPS = r"[0-9]+(\.[0-9]+){3}"


@register("ipv4_in_documents", rf"""
, t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{IPS}')) AS ip FROM documents)
SELECT doc_id, ip, len(string_split(ip, '.')) = 4 AND list_bool_and(list_transform(string_split(ip, '.'),
  lambda p: len(p) <= 3 AND try_cast(p AS INT) <= 255 AND (p = '0' OR NOT starts_with(p, '0')))) AS valid FROM t
""", cte=True)
def q_ipv4_in_documents(spark, sf):
    """Dotted quads in texts, and which of them are addresses."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(IPS), 0)).alias("ip"))
    return found.select("doc_id", "ip", is_ipv4("ip").alias("valid"))


@register("analyses_by_column", """
SELECT 'location' AS analysis, true AS present, count(*) AS n FROM security_logs WHERE location <> 'Pakistan'
UNION ALL SELECT 'ip_address', false, 0
""")
def q_analyses_by_column(spark, sf):
    """An analysis runs where its column exists, and not where it doesn't."""
    logs = security_logs(spark, sf)
    ran = {c: H.when_column(logs, c, lambda d, c=c: d.filter(F.col(c) != "Pakistan")) for c in ("location", "ip_address")}
    out = None
    for name, df in ran.items():
        n = F.lit(0).cast("long") if df is None else F.count(F.lit(1))
        row = (logs.limit(0).groupBy().agg(F.count("*")) if df is None else df).groupBy().agg(n.alias("n")) \
            .select(F.lit(name).alias("analysis"), F.lit(df is not None).alias("present"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@register("first_of_each_class", """
SELECT event_id, files_accessed, hour_of_day, is_threat FROM (
  SELECT *, row_number() OVER (PARTITION BY is_threat ORDER BY event_id) AS r FROM security_logs) WHERE r = 1
""")
def q_first_of_each_class(spark, sf):
    """O3: one sample of each class."""
    return H.one_per_class(security_logs(spark, sf).select("event_id", "files_accessed", "hour_of_day", "is_threat"), "is_threat") \
        .select("event_id", "files_accessed", "hour_of_day", "is_threat")


@register("assembled_features", "SELECT event_id, " + ", ".join(f"{c}::DOUBLE AS f{i}" for i, c in enumerate(FEATURES))
          + " FROM security_logs")
def q_assembled_features(spark, sf):
    """M1: the feature vector, taken apart again."""
    v = ML.assemble_features(security_logs(spark, sf)).select("event_id", vector_to_array("features").alias("v"))
    return v.select("event_id", *[F.col("v")[i].alias(f"f{i}") for i in range(len(FEATURES))])


@register("split_sizes", "SELECT count(*) AS events, CAST(0 AS BIGINT) AS in_both, true AS near_80 FROM security_logs")
def q_split_sizes(spark, sf):
    """M2: the split is complete, disjoint and near 80 to 20."""
    train, test = ML.split(security_logs(spark, sf).select("event_id"))
    both = train.withColumn("a", F.lit(1)).unionByName(test.withColumn("a", F.lit(0))).groupBy("event_id").agg(
        F.count("*").alias("n"), F.sum("a").alias("a"))
    return both.agg(F.count("*").alias("events"), F.count_if(F.col("n") > 1).alias("in_both"),
                    (F.abs(F.sum("a") / F.count("*") - 0.8) < 0.03).alias("near_80"))


@register("text_forms", r"""
SELECT DISTINCT action, upper(action[1]) || lower(action[2:]) AS capital, upper(replace(action, '_', ' ')) AS title,
  left(regexp_replace(replace(lower(coalesce(location, 'none') || ' (' || device || ', ' || action || ')'), ' ', '_'), '[(),]', '', 'g'), 40) AS name
FROM security_logs
""")
def q_text_forms(spark, sf):
    """Capitalised, upper case, replaced and cut texts."""
    name = F.concat(F.coalesce("location", F.lit("none")), F.lit(" ("), "device", F.lit(", "), "action", F.lit(")"))
    return security_logs(spark, sf).select("action", capitalised("action").alias("capital"),
                                           F.upper(F.replace("action", F.lit("_"), F.lit(" "))).alias("title"),
                                           slug(name).alias("name")).distinct()
