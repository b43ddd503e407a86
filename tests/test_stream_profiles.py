"""Streaming profiles whose values don't fit into the block of a user."""

import json
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from test_ueba_fold import fold as plain
from vigil.operators import ueba as U
from vigil.streaming import streams as S
from vigil.streaming import ueba_state as US
from vigil.streaming.ueba_state import FEW, stream_ueba

SCHEMA = "event_id long, timestamp timestamp_ntz, user_id string, action string, location string, device string, " \
         "files_accessed int, data_uploaded_mb int, login_attempts int, foreign_ip int"


def test_many_values_go_to_the_map(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), "u" if i % 3 else f"v{i % 2}", "x",
             f"place {i % (FEW + 150)}" if i % 5 else "home", "d" if i % 7 else None, i % 11, 1, 1, 0) for i in range(1500)]
    logs = spark.createDataFrame(rows, SCHEMA)
    want = U.ueba_scores(logs)
    for i in range(3):  # three files in order of time
        spark.createDataFrame(rows[i * 500:(i + 1) * 500], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    S.run_to_parquet(stream_ueba(src), str(tmp_path / "out"), str(tmp_path / "c"))
    cols = ["event_id", "n", "usual_location", "usual_device", "anomaly_score", "reasons"]
    got = spark.read.parquet(str(tmp_path / "out")).select(cols)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(cols).collect()), key=str)


class Kept(dict):
    """A state variable that counts its calls."""
    calls = 0

    def _call(self, result):
        self.calls += 1
        return result

    def containsKey(self, key):
        return self._call(key in self)

    def getValue(self, key):
        return self._call(self[key])

    def updateValue(self, key, value):
        self._call(self.update({key: value}))


class Handle:
    def getMapState(self, *_):
        return Kept()


def some_rows(seed, users, n):
    rng, names = random.Random(seed), [c.split()[0] for c in SCHEMA.split(", ")]
    return [dict(zip(names, (i, datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(3 * i, 3 * i + 3)), f"u{rng.randrange(users)}",
                             rng.choice(["x", "y", None]), rng.choice(["p", "q", f"place {i}", None]), rng.choice(["l", "m", None]),
                             rng.choice([None, 1, 5, 300]), rng.choice([None, 0, 7, 90]), rng.choice([None, 1, 6]), rng.choice([0, 1]))))
            for i in range(n)]


@pytest.mark.parametrize("few,size,blocks", [(FEW, US.SLICE, US.BLOCKS), (7, 70, 3), (5, 1, 1), (FEW, 300, 50)])
def test_a_call_folds_a_group_of_users(monkeypatch, few, size, blocks):
    for name, value in (("FEW", few), ("SLICE", size), ("BLOCKS", blocks)):
        monkeypatch.setattr(US, name, value)
    rows = some_rows(5, 40, 1800)
    want = plain(sorted(rows, key=lambda r: (r["timestamp"], r["event_id"])), 1000)
    state, got = US.Profiles(), {}
    state.init(Handle())
    for lo in (0, 300, 301, 1200):  # micro-batches, their rows in no order
        batch = rows[lo:{0: 300, 300: 301, 301: 1200, 1200: 1800}[lo]]
        random.Random(lo).shuffle(batch)
        frames = [pd.DataFrame(batch[:200]), pd.DataFrame(batch[200:])] if len(batch) > 200 else [pd.DataFrame(batch)]
        for out in state.handleInputRows((3,), iter(frames), None):
            assert len(out) <= size
            for r in out.itertuples():
                got[r.event_id] = (r.n, r.anomaly_score, r.usual_location, r.usual_device)
    assert got == want
    kept = [u for b in range(blocks) for u in state._read(b)]
    assert sorted(kept) == sorted({r["user_id"] for r in rows})


def test_a_group_of_users_needs_few_state_calls():
    state = US.Profiles()
    state.init(Handle())
    for seed in (1, 2, 3):
        rows, before = some_rows(seed, 300, 3000), state.blocks.calls
        assert sum(len(out) for out in state.handleInputRows((0,), iter([pd.DataFrame(rows)]), None)) == 3000
        assert state.blocks.calls - before <= 3 * US.BLOCKS  # not one for each of 300 users


def test_the_state_has_a_key_a_group(spark, tmp_path):
    logs = spark.createDataFrame([tuple(r.values()) for r in some_rows(7, 60, 600)], SCHEMA)
    logs.filter("event_id >= 300").write.parquet(str(tmp_path / "in"))
    scored, state = U.ueba_resume(logs.filter("event_id < 300"))
    src = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    S.run_to_parquet(stream_ueba(src, state, groups=5), str(tmp_path / "out"), str(tmp_path / "c"))
    cols = ["event_id", "n", "usual_location", "usual_device", "anomaly_score", "reasons"]
    got = spark.read.parquet(str(tmp_path / "out")).select(cols).union(scored.select(cols))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, U.ueba_scores(logs).select(cols).collect()), key=str)
    kept = spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", "blocks").load()
    rows = kept.selectExpr("key._group AS g", "user_map_key.block AS b", "user_map_value.profiles AS p").collect() \
        if "user_map_key" in kept.columns else kept.selectExpr("key._group AS g", "explode(map_value) AS (k, v)") \
        .selectExpr("g", "k.block AS b", "v.profiles AS p").collect()
    assert {r.g for r in rows} == set(range(5)) and len(rows) <= 5 * US.BLOCKS
    users = [(u, r.b) for r in rows for u, *_ in json.loads(r.p)]
    assert all(US.block_of(u) == b for u, b in users)
    assert sorted(u for u, _ in users) == sorted(r.user_id for r in logs.select("user_id").distinct().collect())
