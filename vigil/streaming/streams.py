"""Structured Streaming twins of the live stages (T1, T3-T7) and runners.

Sources are file folders (a broker is only another format); every query has
its own checkpoint folder, so a restarted query resumes where it stopped and
the idempotent ``foreachBatch`` writers never duplicate a micro-batch.
With ``trigger(availableNow=True)`` a query drains what is there and stops;
``run_until_idle`` keeps reading until nothing has come in for a stated time.
"""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from vigil.functions.times import instant_to_ntz, ntz_to_instant
from vigil.operators import alerts as A
from vigil.schema import RAW_EVENT
from vigil.session import ensure_checkpoint_dir
from vigil.sources import topic
from vigil.sources.fixture import from_events
from vigil.sources.logs import canonical_logs, decode_json, is_folder


# ----------------------------------------------------------------- sources
def stream_events_table(spark: SparkSession, sf_dir: str, table: str = "events",
                        max_files: int | None = None) -> DataFrame:
    """S7 over the driver's tables: a table, one file or a folder of files, as
    an unbounded file source."""
    path = f"{sf_dir}/{table}.parquet"
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if is_folder(spark, path):
        return r.parquet(path)
    return r.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def stream_fixture_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming ``security_logs`` (stateless projection of streaming events)."""
    return from_events(stream_events_table(spark, sf_dir))


def stream_logs(spark: SparkSession, path: str, fmt: str = "json", options: dict | None = None,
                max_files: int | None = None, schema: T.StructType = RAW_EVENT) -> DataFrame:
    """Unbounded log source: a topic of ``segments`` by offset, a folder of
    JSON lines (``max_files`` a batch), or ``kafka`` with options.  Rows that can't be decoded stay, with their text in
    ``_corrupt_record``: ``split_corrupt`` sends them to a quarantine."""
    if fmt == "segments":
        topic.register(spark)
        raw = spark.readStream.format("segments").option("path", path).options(**(options or {})).load()
        return canonical_logs(decode_json(raw, "value", schema))
    if fmt == "kafka":
        raw = spark.readStream.format("kafka").options(**(options or {})).load()
        return canonical_logs(decode_json(raw, "value", schema))
    if fmt == "json":
        r = spark.readStream.schema(T.StructType([T.StructField("value", T.StringType())])).format("text")
        if max_files:
            r = r.option("maxFilesPerTrigger", max_files)
        return canonical_logs(decode_json(r.options(**(options or {})).load(path), "value", schema))
    r = spark.readStream.schema(schema).format(fmt).options(**(options or {}))
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return canonical_logs(r.load(path))


def stream_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alert-topic consumer over a folder of JSON alert values."""
    return spark.readStream.schema(T.StructType([T.StructField("value", T.StringType())])).text(path)


# ----------------------------------------------------------------- runners
def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for one query run."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:8]}"


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None,
                   output_mode: str = "append") -> None:
    """Drain a stream into parquet (file sink, exactly-once via its log)."""
    w = (stream.writeStream.format("parquet").outputMode(output_mode)
               .option("path", path).option("checkpointLocation", checkpoint)
               .trigger(availableNow=True))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.start().awaitTermination()


def run_foreach_batch(stream: DataFrame, path: str, checkpoint: str, output_mode: str = "append",
                      transform=None) -> None:
    """Drain a stream through ``foreachBatch``; each batch overwrites its own
    ``batch_id=N`` folder, so a replayed batch replaces rather than duplicates."""
    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    (stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
           .foreachBatch(write).trigger(availableNow=True).start().awaitTermination())


class IdleStop(StreamingQueryListener):
    """Ends a query once no row has come in for ``seconds`` (the consumers'
    time-out).  Time runs from the start, or from the last batch with rows."""

    def __init__(self, query: StreamingQuery, seconds: float, clock=time.monotonic):
        self.query, self.seconds, self.clock = query, seconds, clock
        self.last = clock()
        self.stopped = False

    def _look(self, of, rows: int) -> None:
        if str(of) != str(self.query.id) or self.stopped:
            return
        if rows:
            self.last = self.clock()
        elif self.clock() - self.last >= self.seconds:
            self.stopped = True
            # the listener's thread must not wait for the query that reports to it
            threading.Thread(target=self.query.stop, daemon=True).start()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self._look(event.progress.id, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        self._look(event.id, 0)

    def onQueryTerminated(self, event) -> None:
        pass


def run_until_idle(stream: DataFrame, path: str, checkpoint: str, seconds: float, every: str = "500 milliseconds") -> None:
    """Read on into parquet until nothing has come in for ``seconds``."""
    spark = stream.sparkSession
    key = "spark.sql.streaming.noDataProgressEventInterval"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(100, int(seconds * 250))))  # idle queries report often enough
    try:
        query = (stream.writeStream.format("parquet").outputMode("append").option("path", path)
                 .option("checkpointLocation", checkpoint).trigger(processingTime=every).start())
    finally:
        spark.conf.set(key, before)
    listener = IdleStop(query, seconds)
    spark.streams.addListener(listener)
    try:
        query.awaitTermination()
    finally:
        spark.streams.removeListener(listener)


# ----------------------------------------------------------------- operators
def stream_detector(logs: DataFrame) -> DataFrame:
    """Stateless per-event detector: test messages dropped, defaults,
    flags, five-rule score, alerts above 0.7 (P18 shape)."""
    return A.detector_alerts(A.detector_scores(logs))


def stream_scorer_batch(models: tuple, batch: DataFrame) -> DataFrame:
    """T3 body for ``foreachBatch``: ensemble of (boosted, forest) models, HIGH → alert."""
    from vigil.operators import ml as ML
    boosted, forest = models
    both = ML.score(forest, ML.score(boosted, batch, "xgb_prob"), "rf_prob")
    return A.ensemble_alerts(A.ensemble_scores(both))


def stream_counts(scored: DataFrame) -> DataFrame:
    """T5: running total, alerts and rate (complete/update mode aggregate)."""
    return scored.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_alert").alias("alerts")) \
                 .withColumn("alert_rate", F.round(F.lit(100.0) * F.col("alerts")
                                                   / F.greatest(F.lit(1), F.col("total")), 6))


def stream_daily_alerts(alerts: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Daily tumbling alert counts with a watermark (late rows beyond it are dropped)."""
    return (alerts.withColumn("event_time", ntz_to_instant("timestamp")).withWatermark("event_time", lateness)
                  .groupBy(F.window("event_time", "1 day")).agg(F.count(F.lit(1)).alias("alerts"))
                  .select(instant_to_ntz(F.col("window.start")).alias("day_start"), "alerts"))


def latest_per_key(path: str, spark: SparkSession, key: list[str]) -> DataFrame:
    """Read an update-mode ``foreachBatch`` output: the row of the last batch per key."""
    df = spark.read.parquet(path)
    last = df.groupBy(*key).agg(F.max("batch_id").alias("batch_id"))
    return df.join(last, key + ["batch_id"]).drop("batch_id")
