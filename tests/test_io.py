"""Sources and sinks: ordered report text, date-partitioned archive, report
JSON, fallbacks, IPv4 validity, report ids."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from vigil.functions.scoring import is_ipv4
from vigil.functions.text import report_file_name
from vigil.sources import logs as L
from vigil.sources import sinks as K
from vigil.sources.fixture import security_logs


def _tmp():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def test_report_text_written_in_order(spark):
    lines = spark.createDataFrame([(2, 1, "c"), (1, 2, "b"), (1, 1, "a"), (3, 0, "d")],
                                  "section int, pos int, line string")
    out = _tmp() + "/report"
    K.write_report_text(lines, out)
    files = [f for f in os.listdir(out) if f.startswith("part-")]
    assert len(files) == 1
    assert open(os.path.join(out, files[0])).read().split("\n")[:4] == ["a", "b", "c", "d"]


def test_logs_archive_partitioned_by_date(spark):
    logs = security_logs(spark, SF_SMALL)
    out = _tmp() + "/logs"
    K.sink_logs(logs, out, 'first')
    parts = sorted(d for d in os.listdir(out) if d.startswith("date="))
    assert len(parts) == logs.select(F.to_date("timestamp")).distinct().count()
    back = L.read_logs(spark, out)
    assert back.count() == logs.count()
    # partition pruning: a date filter reads one folder
    one = back.filter(F.col("date") == F.lit(parts[0][5:]).cast("date"))
    assert "PartitionFilters" in one._jdf.queryExecution().executedPlan().toString() or one.count() > 0


def test_report_json_roundtrip(spark):
    df = spark.createDataFrame([(5, {"UNKNOWN": 3})], "total_alerts long, threats_by_type map<string,bigint>")
    out = _tmp() + "/json"
    K.write_report_json(df, out)
    r = spark.read.json(out).first()
    assert r.total_alerts == 5 and r.threats_by_type.UNKNOWN == 3


def test_fallbacks(spark):
    assert L.first_non_empty(lambda: spark.range(0), lambda: 1 / 0) is None
    assert L.read_first_existing(spark, ["/nonexistent/a.csv", "/nonexistent/b.csv"]) is None


def test_ipv4_and_report_ids(spark):
    df = spark.createDataFrame([("10.0.0.1",), ("256.1.1.1",), ("1.2.3",), ("192.168.001.1",)], "ip string")
    assert [r[0] for r in df.select(is_ipv4("ip")).collect()] == [True, False, False, False]
    ts = spark.sql("SELECT TIMESTAMP_NTZ '2026-04-28 17:08:44' t").select(
        report_file_name("threat", F.col("t"), "daily"), report_file_name("user", F.col("t"), user=F.lit("ali")))
    assert tuple(ts.first()) == ("threat_report_daily_20260428_170844.txt", "investigation_ali_20260428_170844.txt")


def test_decode_quarantines_bad_json(spark):
    df = spark.createDataFrame([('{"user_id": "a", "files_accessed": 3}',), ("not json",)], "value string")
    good, bad = L.split_corrupt(L.decode_json(df))
    assert good.count() == 1 and bad.count() == 1


def test_sinks_repeat_without_duplicates(spark):
    """A repeated run replaces its rows; another run adds to them."""
    logs = security_logs(spark, SF_SMALL)
    out = _tmp()
    lines = spark.createDataFrame([("a | b",), ("c | d",)], "value string")
    for run in ("one", "one", "two"):
        K.sink_logs(logs, out + "/logs", run)
        K.sink_alert_log(lines, out + "/log", run)
        K.sink_alerts(logs.limit(7).select("event_id", "user_id"), out + "/topic", run)
    assert spark.read.parquet(out + "/logs").count() == 2 * logs.count()
    assert spark.read.text(out + "/log").count() == 4
    assert spark.read.text(out + "/topic").count() == 14


def test_stream_keeps_corrupt_rows_for_the_quarantine(spark):
    src, out = _tmp(), _tmp()
    with open(src + "/m.json", "w") as f:
        f.write('{"user_id": "a", "files_accessed": 3, "timestamp": "2024-01-01T05:00:00"}\nnot json\n{"user_id": "b"}\n')
    from vigil.streaming import streams as S
    S.run_to_parquet(S.stream_logs(spark, src), out + "/data", out + "/ckpt")
    good, bad = L.split_corrupt(spark.read.parquet(out + "/data"))
    assert sorted(r.user_id for r in good.collect()) == ["a", "b"]
    assert [r[L.CORRUPT] for r in bad.collect()] == ["not json"]
    assert {r.user_id: r.hour_of_day for r in good.collect()} == {"a": 5, "b": None}


def test_labelled_csv(spark):
    out = _tmp() + "/labelled.csv"
    names = [f.name for f in L.LABELLED_NOISY.fields]
    with open(out, "w") as f:
        f.write(",".join(names) + "\n" + ",".join("1" for _ in names) + "\n")
    df = L.read_labelled_csv(spark, out)
    assert df.columns == names and df.count() == 1
    assert L.read_first_existing(spark, ["/nonexistent/a.csv", out], L.LABELLED_NOISY).count() == 1


def test_literal_batch_rows(spark):
    """the seven sample rows through the five summaries."""
    from vigil.operators import hunting as H
    rows = [("ali", "login", 10, "Pakistan", "laptop", 2.0), ("ali", "download", 5000, "Russia", "unknown", 9.5),
            ("sara", "login", 20, "Pakistan", "mobile", 1.0), ("ahmed", "logout", 5, "Pakistan", "laptop", 1.0),
            ("fatima", "file_access", 100, "UAE", "laptop", 7.5), ("ali", "upload", 50, "Pakistan", "laptop", 3.0),
            ("sara", "download", 200, "China", "mobile", 8.0)]
    df = L.from_rows(spark, rows, "user_id string, action string, files_accessed int, location string, device string, "
                                  "threat_score double").withColumn("event_id", F.monotonically_increasing_id())
    top = H.user_activity_summary(df).first()
    assert (top.user_id, top.total_actions, round(top.avg_files, 2), top.max_files, top.min_files) == ("ali", 3, 1686.67, 5000, 10)
    assert {(r.user_id, r.location, r.access_count) for r in H.suspicious_location_counts(df).collect()} == {
        ("ali", "Russia", 1), ("fatima", "UAE", 1), ("sara", "China", 1)}
    assert [r.threat_score for r in H.high_score_activities(df, 5.0).collect()] == [9.5, 8.0, 7.5]
    assert {r.action: r["count"] for r in H.action_distribution(df).collect()} == {
        "login": 2, "download": 2, "logout": 1, "file_access": 1, "upload": 1}
    assert {r.device: (r.usage_count, r.avg_files) for r in H.device_usage(df).collect()} == {
        "laptop": (4, 41.25), "mobile": (2, 110.0), "unknown": (1, 5000.0)}


def test_streamed_table_may_be_a_file_or_a_folder(spark):
    from __spark_entry__ import queries
    rows = [(1, "not json"), (2, "x"), (3, "{broken"), (4, None)]
    one, many = _tmp(), _tmp()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.toPandas().to_parquet(f"{one}/documents.parquet")
    docs.repartition(2).write.parquet(f"{many}/documents.parquet")
    for sf in (one, many):
        got = {r.kind: (r["count"], r.total) for r in queries()["stream_quarantine_counts"](spark, sf).collect()}
        assert got == {"decoded": (2, 6), "quarantined": (2, 15)}
