"""Registered streaming queries: each drains a file-source stream over the
driver's ``events`` table (availableNow), then returns the sink read back as
a batch frame.  Where the batch twin has an oracle, the stream is checked
against the same SQL (stream = batch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import alerts as A
from vigil.operators import ueba as U
from vigil.plans import catalog as _catalog  # noqa: F401  (registers the batch twins first)
from vigil.plans import q_alerts as _q_alerts  # noqa: F401
from vigil.plans.registry import ORACLE
from vigil.plans.registry import register, r6
from vigil.sources.fixture import security_logs
from vigil.sources.logs import CORRUPT, decode_json, split_corrupt
from vigil.streaming import streams as S
from vigil.streaming.ueba_state import stream_ueba


@register("stream_detector_alerts")
def q_stream_detector_alerts(spark, sf):
    """T1 + S14: stateless detector over the live stream, idempotent batch writer."""
    out = S.scratch(spark, "stream-detector")
    S.run_foreach_batch(S.stream_detector(S.stream_fixture_logs(spark, sf)), f"{out}/data", f"{out}/ckpt")
    return spark.read.parquet(f"{out}/data").drop("batch_id")


ORACLE["stream_detector_alerts"] = ORACLE["detector_alerts"]


def _drained_in_parts(spark, logs, parts: int, stage, path: str, checkpoint: str) -> None:
    """The events as ``parts`` slices of time: a slice's files are written by
    all tasks, then the stream drains them in one micro-batch, and the next
    run goes on from its checkpoint."""
    files = S.scratch(spark, "event-files")
    first, last = logs.agg(F.min("timestamp"), F.max("timestamp")).first()
    at = F.least(F.lit(parts - 1), F.floor(parts * (F.unix_micros(F.col("timestamp").cast("timestamp")) - _micros(first))
                                          / F.greatest(F.lit(1), _micros(last) - _micros(first))))
    tagged = logs.withColumn("_part", at)
    for i in range(parts):  # a topic's producer: one slice after the other
        tagged.filter(F.col("_part") == i).drop("_part").write.mode("append").parquet(files)
        src = spark.readStream.schema(spark.read.parquet(files).schema).parquet(files)
        S.run_to_parquet(stage(src), path, checkpoint)


def _micros(t):
    return F.unix_micros(F.lit(t).cast("timestamp"))


def _ueba_columns(s):
    return s.select("event_id", "user_id", "n", r6("avg_login_hour"), r6("avg_files"), r6("avg_upload"),
                    "usual_location", "usual_device", "anomaly_score", "is_anomaly",
                    F.array_join("reasons", " | ").alias("reasons"))


@register("stream_ueba_scores")
def q_stream_ueba_scores(spark, sf):
    """Keyed behavioural state over three slices of time, one a micro-batch."""
    out = S.scratch(spark, "stream-ueba")
    _drained_in_parts(spark, security_logs(spark, sf), 3, stream_ueba, f"{out}/data", f"{out}/ckpt")
    return _ueba_columns(spark.read.parquet(f"{out}/data"))


ORACLE["stream_ueba_scores"] = ORACLE["ueba_scores"]


@register("stream_ueba_from_state")
def q_stream_ueba_from_state(spark, sf):
    """T2 from stored profiles: the first half of the events is scored in
    batch, and the stream over the second half starts from its state."""
    logs = security_logs(spark, sf)
    first, last = logs.agg(F.min("timestamp"), F.max("timestamp")).first()
    half = F.lit(first + (last - first) / 2)
    scored, state = U.ueba_resume(logs.filter(F.col("timestamp") < half))
    out = S.scratch(spark, "stream-state")
    _drained_in_parts(spark, logs.filter(F.col("timestamp") >= half), 3, lambda src: stream_ueba(src, state),
                      f"{out}/data", f"{out}/ckpt")
    return _ueba_columns(spark.read.parquet(f"{out}/data")).unionByName(_ueba_columns(scored))


ORACLE["stream_ueba_from_state"] = ORACLE["ueba_scores"]


@register("stream_detector_counts")
def q_stream_detector_counts(spark, sf):
    """T5: running totals in complete mode; the last batch holds the final counts."""
    out = S.scratch(spark, "stream-counts")
    scored = A.detector_scores(S.stream_fixture_logs(spark, sf))
    S.run_foreach_batch(S.stream_counts(scored), f"{out}/data", f"{out}/ckpt", output_mode="complete")
    df = spark.read.parquet(f"{out}/data")
    last = df.select(F.max("batch_id")).scalar()
    return df.filter(F.col("batch_id") == last).drop("batch_id")


ORACLE["stream_detector_counts"] = ORACLE["detector_stats"]


@register("stream_archive_daily_rows", """
SELECT strftime(CAST(timestamp AS DATE), '%Y-%m-%d') AS date, count(*) AS n FROM security_logs GROUP BY 1
""")
def q_stream_archive_daily_rows(spark, sf):
    """Every event appended to the date-partitioned log store."""
    out = S.scratch(spark, "stream-archive")
    logs = S.stream_fixture_logs(spark, sf).withColumn("date", F.to_date("timestamp"))
    S.run_to_parquet(logs, f"{out}/data", f"{out}/ckpt", partition_by=["date"])
    back = spark.read.parquet(f"{out}/data")
    return back.groupBy(F.date_format("date", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("n"))


@register("stream_daily_alert_counts", """
SELECT strftime(date_trunc('day', timestamp), '%Y-%m-%d %H:%M:%S') AS day_start, count(*) AS alerts
FROM scored_logs WHERE threat_score > 0.7 GROUP BY 1
""")
def q_stream_daily_alert_counts(spark, sf):
    """Daily tumbling alert counts with a watermark (update mode, upserted per window)."""
    out = S.scratch(spark, "stream-daily")
    alerts = S.stream_detector(S.stream_fixture_logs(spark, sf))
    S.run_foreach_batch(S.stream_daily_alerts(alerts), f"{out}/data", f"{out}/ckpt", output_mode="update")
    latest = S.latest_per_key(f"{out}/data", spark, ["day_start"])
    return latest.select(F.date_format("day_start", "yyyy-MM-dd HH:mm:ss").alias("day_start"), "alerts")


@register("stream_quarantine_counts", """
SELECT CASE WHEN doc_id % 2 = 0 THEN 'decoded' ELSE 'quarantined' END AS kind, count(*) AS count,
       CAST(sum(CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE length(text) END) AS BIGINT) AS total
FROM documents GROUP BY 1
""")
def q_stream_quarantine_counts(spark, sf):
    """Messages decoded as JSON events; undecodable ones are
    quarantined with their text instead of stopping the stream (every second
    message is a document's text)."""
    docs = S.stream_events_table(spark, sf, "documents")
    message = F.format_string('{"user_id": "u%d", "files_accessed": %d}', F.col("doc_id"), F.col("doc_id"))
    decoded = decode_json(docs.select(F.when(F.col("doc_id") % 2 == 0, message).otherwise(F.col("text")).alias("value")), "value")
    out = S.scratch(spark, "stream-quarantine")

    def tag(batch):
        good, bad = split_corrupt(batch)
        return good.select(F.lit("decoded").alias("kind"), F.col("files_accessed").cast("long").alias("n")).unionByName(
            bad.select(F.lit("quarantined").alias("kind"), F.length(CORRUPT).cast("long").alias("n")))

    S.run_foreach_batch(decoded, f"{out}/data", f"{out}/ckpt", transform=tag)
    return spark.read.parquet(f"{out}/data").groupBy("kind").agg(F.count("*").alias("count"), F.sum("n").alias("total"))
