"""Offset-addressed topic: batch and stream readers, appends, idle stop."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from vigil.sources import logs as L
from vigil.sources import topic
from vigil.streaming import streams as S


def messages(spark, lo, hi):
    return spark.range(lo, hi).select(F.col("id").alias("seq"), F.format_string(
        '{"user_id": "u%d", "files_accessed": %d}', F.col("id") % 5, F.col("id")).alias("value")).repartition(4)


@pytest.fixture
def path(spark, tmp_path):
    topic.register(spark)
    p = str(tmp_path / "topic")
    assert topic.append(messages(spark, 0, 95), p, per_segment=10) == 10
    return p


def files_of(rows):
    return [r.files_accessed for r in rows]


def test_messages_keep_their_order_and_offsets(spark, path):
    rows = spark.read.format("segments").option("path", path).load().orderBy("partition", "offset").collect()
    assert [r.offset for r in rows] == list(range(95))
    assert [int(r.value.split(": ")[2].rstrip("}")) for r in rows] == list(range(95))
    assert topic.append(messages(spark, 95, 120), path, per_segment=10) == 3
    again = spark.read.format("segments").option("path", path).load().orderBy("offset").collect()
    assert [r.offset for r in again] == list(range(120))


def test_a_capped_read_opens_only_the_first_segments(spark, path):
    reader = topic.SegmentReader({"path": path, "limit": "25"})
    assert [(s.first, s.stop) for s in reader.partitions()] == [(0, 10), (10, 20), (20, 25)]
    for name in sorted(os.listdir(path))[3:]:
        if name.endswith(".jsonl"):
            with open(f"{path}/{name}", "w") as f:
                f.write("never read")
    got = L.read_topic_batch(spark, path, n=25, fmt="segments").collect()
    assert sorted(files_of(got)) == list(range(25))


def test_a_read_from_an_offset(spark, path):
    df = spark.read.format("segments").option("path", path).option("startingOffset", 42).option("limit", 10).load()
    assert sorted(r.offset for r in df.collect()) == list(range(42, 52))


def test_partitions_in_turn(spark, tmp_path):
    p = str(tmp_path / "many")
    topic.append(messages(spark, 0, 60), p, per_segment=7, partitions=3)
    rows = spark.read.format("segments").option("path", p).load().collect()
    assert len(rows) == 60 and len({(r.partition, r.offset) for r in rows}) == 60
    first = spark.read.format("segments").option("path", p).option("limit", 30).load().collect()
    want = sorted((r.partition, r.offset) for r in rows)[:30]
    assert sorted((r.partition, r.offset) for r in first) == want


def test_an_empty_topic(spark, tmp_path):
    assert L.read_topic_batch(spark, str(tmp_path / "none"), n=5, fmt="segments").collect() == []


def test_a_stream_goes_on_after_a_restart(spark, path, tmp_path):
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    S.run_to_parquet(S.stream_logs(spark, path, "segments"), out, ckpt)
    topic.append(messages(spark, 95, 130), path, per_segment=10)
    S.run_to_parquet(S.stream_logs(spark, path, "segments"), out, ckpt)
    assert sorted(files_of(spark.read.parquet(out).collect())) == list(range(130))


def test_late_files_are_read_and_then_the_query_ends(spark, path, tmp_path):
    out = str(tmp_path / "idle")

    def later():
        time.sleep(2)
        topic.append(messages(spark, 95, 105), path, per_segment=5)
    t = threading.Thread(target=later)
    start = time.time()
    t.start()
    S.run_until_idle(S.stream_logs(spark, path, "segments"), out, str(tmp_path / "c"), seconds=5)
    t.join()
    assert sorted(files_of(spark.read.parquet(out).collect())) == list(range(105))
    assert 5 < time.time() - start < 60
    assert not [q for q in spark.streams.active]


def test_idle_time_counts_from_the_last_rows():
    class Query:
        id = "q"
        stopped = threading.Event()

        def stop(self):
            self.stopped.set()
    now = [0.0]
    stop = S.IdleStop(Query(), 5, lambda: now[0])
    for t, rows, done in ((4, 0, False), (4.5, 3, False), (9, 0, False), (9.4, 0, False), (9.6, 0, True)):
        now[0] = t
        stop._look("other", 0)
        stop._look("q", rows)
        assert stop.stopped == done
    assert Query.stopped.wait(2)
