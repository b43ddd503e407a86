"""Scale properties: hot keys are split, unbounded plans never go through a
single partition, and keyed stream state carries across micro-batches."""

import os
import tempfile
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from vigil.operators import hunting as H
from vigil.operators import investigate as I
from vigil.operators import ueba as U
from vigil.plans import ordered_scan as OS
from vigil.plans.ordered_scan import CHUNK, sequence_within
from vigil.session import write_once
from vigil.sources.fixture import security_logs
from vigil.streaming import streams as S
from vigil.streaming.ueba_state import stream_ueba


def _hot_frame(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(seconds=i), "hot" if i % 2 == 0 else f"u{i % 50}") for i in range(6000)]
    return spark.createDataFrame(rows, "event_id long, timestamp timestamp_ntz, user_id string")


def test_hot_user_is_split_into_balanced_chunks(spark):
    seq = sequence_within(_hot_frame(spark), "user_id", ["timestamp", "event_id"], num_chunks=8)
    per_chunk = {r[CHUNK]: r["count"] for r in seq.groupBy(CHUNK).count().collect()}
    hot_chunks = seq.filter(F.col("user_id") == "hot").select(CHUNK).distinct().count()
    assert hot_chunks >= 3                       # half of all rows spread over several tasks
    assert max(per_chunk.values()) <= 2.5 * (6000 / len(per_chunk))


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_single_partition_exchange_in_unbounded_plans(spark):
    logs = security_logs(spark, SF_SMALL)
    plans = {
        "ueba": U.ueba_scores(logs),
        "verdicts": I.user_verdicts(logs),
        "summary": H.user_activity_summary(logs),
        "locations": H.suspicious_location_counts(logs),
    }
    for name, df in plans.items():
        plan = _physical(df)
        assert "SinglePartition" not in plan, name


def test_ueba_row_windows_are_partitioned_by_chunk(spark, monkeypatch):
    monkeypatch.setattr(U, "write_once", lambda df, tag: df)  # else the written rows hide their plan
    plan = _physical(U.ueba_scores(security_logs(spark, SF_SMALL)))
    windows = [ln for ln in plan.splitlines() if "Window [" in ln]
    assert windows
    # row-level windows carry the chunk in their partition spec; the only
    # windows without it run over the per-(user, chunk) summaries
    assert any("_chunk" in w for w in windows)


def test_stream_state_carries_across_micro_batches(spark):
    logs = security_logs(spark, SF_SMALL)
    src = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    days = [r[0] for r in logs.select(F.to_date("timestamp").alias("d")).distinct().orderBy("d").collect()]
    base = 1_700_000_000
    for i, d in enumerate(days[:6]):
        path = f"{src}/day={i:02d}"
        logs.filter(F.to_date("timestamp") == F.lit(d)).coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            os.utime(os.path.join(path, f), (base + i, base + i))
    subset = logs.filter(F.to_date("timestamp") <= F.lit(days[5]))
    stream = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1) \
                  .option("recursiveFileLookup", "true").parquet(src)
    out = S.scratch(spark, "stream-batches")
    S.run_to_parquet(stream_ueba(stream), f"{out}/data", f"{out}/ckpt")
    got = {r.event_id: (r.n, r.anomaly_score, r.usual_location) for r in spark.read.parquet(f"{out}/data").collect()}
    want = {r.event_id: (r.n, r.anomaly_score, r.usual_location)
            for r in U.ueba_scores(subset).select("event_id", "n", "anomaly_score", "usual_location").collect()}
    assert got == want


def test_python_workers_need_no_installed_package():
    """Arrow-batched operators run in workers started outside the repo (the
    package is pickled by value)."""
    import subprocess
    import sys
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession, functions as F\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled','false')"
        ".config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "from vigil.operators import explain as X, forest, ml\n"
        "from vigil.schema import FEATURES\n"
        "from vigil.sources import logs, topic\n"
        "df = s.range(50).select('id', *[((F.col('id') + i) %% 10).cast('int').alias(c) for i, c in enumerate(FEATURES)],"
        " (F.col('id') %% 3 == 0).cast('int').alias('is_threat'))\n"
        "model = forest.fit(df, 'is_threat', trees=2)\n"
        "print('ROWS', X.tree_shap(df, model).count())\n"
        "print('BOOSTED', ml.score(ml.train_boosted(df, rounds=2), df, 'p').count())\n"
        "topic.append(df.select(F.col('id').alias('seq'), F.to_json(F.struct('files_accessed')).alias('value')), sys.argv[1], 7)\n"
        "print('TOPIC', logs.read_topic_batch(s, sys.argv[1], n=20, fmt='segments').count())\n"
    ) % os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    out = subprocess.run([sys.executable, "-c", code, f"{folder}/topic"], cwd=folder, capture_output=True, text=True, timeout=600, env=env)
    assert all(x in out.stdout for x in ("ROWS 50", "BOOSTED 50", "TOPIC 20")), out.stderr[-2000:]


def test_investigation_aggregate_does_not_duplicate_rows(spark):
    """One distinct aggregate is rewritten as two partial/final phases, not an
    Expand that copies every row before the shuffle."""
    plan = _physical(I.user_aggregates(security_logs(spark, SF_SMALL)))
    assert "Expand" not in plan
    assert plan.count("HashAggregate") >= 2


def test_joins_split_a_user_with_a_third_of_all_rows(spark):
    """J1, J2 with broadcasts off: Spark's skew-join rule cuts the hot user."""
    from vigil.operators import alerts as A
    keep = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in keep}
    for k, v in keep.items():
        spark.conf.set(k, v)
    try:
        n = 60_000
        events = spark.range(n).select(
            F.col("id").alias("event_id"), F.expr("timestamp'2024-01-01 02:00:00' + make_interval(0,0,0,0,0,0,id)").alias("timestamp"),
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), (F.col("id") % 500).cast("string"))).alias("user_id"),
            F.lit("Iran").alias("location"), F.lit("unknown").alias("device"), F.lit(9000).alias("files_accessed"),
            F.lit(20).alias("login_attempts"), F.lit(1).alias("foreign_ip"), F.lit(1).alias("unknown_device"),
            F.lit(2).alias("hour_of_day"), F.lit(5000).alias("data_uploaded_mb"), F.md5(F.col("id").cast("string")).alias("note")).repartition(12)
        base = events.groupBy("user_id").agg(F.count("*").alias("n"))
        for joined in (A.attach_baseline(events, base), I.risky_user_events(events)):
            # the sink keeps the join's plan: an aggregate would let the optimiser drop columns
            out = S.scratch(spark, "skew")
            joined.write.parquet(out)
            back = spark.read.parquet(out)
            assert back.count() == n
            of_hot = back.filter("user_id = 'hot'").groupBy(F.input_file_name()).count().collect()  # a file a task
            assert len(of_hot) > 3 and max(r["count"] for r in of_hot) < n / 6
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_chunks_and_their_tasks_grow_in_number_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(OS, "CHUNK_ROWS", 100)
    df = spark.range(4000).select((F.col("id") % 3).alias("k"), "id", F.lit(1).alias("one"))
    seq = OS.sequence_within(df, "k", ["id"])
    sizes = [r["count"] for r in seq.groupBy(OS.CHUNK).count().collect()]
    assert len(sizes) == 40 and max(sizes) <= 200
    rows = OS.by_chunk(seq, "k", OS.chunk_prefix(seq, "k", {"n": "*"}))
    assert rows.rdd.getNumPartitions() == 40 and rows.count() == 4000


def test_rows_to_be_ordered_lie_in_files_of_a_chunk(spark, monkeypatch):
    written = {}

    def kept(df, tag, *args):
        written[tag] = write_once(df, tag, *args)
        return written[tag]

    monkeypatch.setattr(OS, "CHUNK_ROWS", 100)
    monkeypatch.setattr(OS, "write_once", kept)
    df = spark.range(0, 4000, 1, 1).select((F.col("id") % 3).alias("k"), "id")
    seq = OS.sequence_within(df, "k", ["id"])
    files = [r["count"] for r in written["unordered"].groupBy(F.input_file_name()).count().collect()]
    assert files == [100] * 40                   # one task wrote them; a packed few are read by one
    assert seq.orderBy(OS.GID).select("k", "id").collect() == df.orderBy("k", "id").collect()


def test_rows_are_not_sorted_for_the_join_with_carries(spark):
    seq = OS.sequence_within(_hot_frame(spark).withColumn("v", F.lit("x")), "user_id", ["timestamp", "event_id"], num_chunks=4)
    carries = OS.chunk_prefix(seq, "user_id", {"n": "*"}).join(OS.running_mode_carry(seq, "user_id", {"v": "v"}), ["user_id", CHUNK])
    rows = OS.with_carries(seq, carries, "user_id", {"v": "v"})
    plan = _physical(rows.withColumn("best", OS.running_mode(Window.partitionBy("user_id", CHUNK).orderBy(OS.GID), "v", "v")))
    joined = plan[:plan.index("ShuffledHashJoin [user_id")]
    assert joined.count("Sort [") == 1 and "Window [" in joined  # for the window; the value counts come before the join
    assert rows.count() == 6000 and rows.groupBy("user_id").agg(F.max("_v_c").alias("c"), F.count("*").alias("n")).filter("c <> n").count() == 0
