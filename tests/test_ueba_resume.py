"""Profiles that go on from a stored state equal one pass over all events."""

import random
from datetime import datetime, timedelta

import pytest

from vigil.operators import ueba as U

SCHEMA = "event_id long, timestamp timestamp_ntz, user_id string, action string, location string, device string, " \
         "files_accessed int, data_uploaded_mb int, login_attempts int, foreign_ip int"


def events(seed, n=400):
    rng = random.Random(seed)
    t, rows = datetime(2024, 1, 1), []
    for i in range(n):
        t += timedelta(minutes=rng.choice([0, 1, 90, 400]))
        user = rng.choice(["hot"] * 6 + ["a", "b", None, f"rare{i}"])
        rows.append((i, t, user, rng.choice(["x", "y", None]), rng.choice(["p", "q", "r", None]), rng.choice(["l", "m", None]),
                     rng.choice([None, 1, 5, 300]), rng.choice([None, 0, 7, 90]), rng.choice([None, 1, 6]), rng.choice([0, 1])))
    return rows


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed,cuts,window,chunks", [
    (1, [200], 1000, 4), (2, [130, 131, 300], 25, 7), (3, [5, 390], 10, 3), (4, [100, 200, 300], 40, 1)])
def test_parts_equal_one_pass(spark, tmp_path, seed, cuts, window, chunks):
    rows = events(seed)
    whole = U.ueba_scores(spark.createDataFrame(rows, SCHEMA), window, chunks)
    state, parts = None, []
    for i, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        # parts are cut by time and id, as the order of events is
        scored, state = U.ueba_resume(spark.createDataFrame(rows[lo:hi], SCHEMA), state, window, chunks)
        state.save(str(tmp_path / str(i)))
        state = U.UebaState.load(spark, str(tmp_path / str(i)))
        parts += rows_of(scored.select(whole.columns))
    assert sorted(parts, key=str) == rows_of(whole)
    base = U.user_baseline(whole)
    stored = U.state_baseline(state).select(base.columns)
    for a, b in zip(rows_of(base), rows_of(stored), strict=True):
        assert all(x == y or abs(x - y) < 1e-9 for x, y in zip(a, b))
    logs = spark.createDataFrame(rows, SCHEMA).na.fill("unknown", ["user_id"])
    want = U.user_profile(logs, whole)
    assert rows_of(U.state_profile(state).select(want.columns)) == rows_of(want)


def test_a_state_holds_at_most_the_window(spark):
    _, state = U.ueba_resume(spark.createDataFrame(events(9), SCHEMA), None, window=20)
    sizes = {r.user_id: (r.n, r.k) for r in state.profiles.selectExpr("user_id", "n", "size(ring) AS k").collect()}
    assert all(k == min(n, 20) for n, k in sizes.values()) and sizes["hot"][0] > 20


def test_a_part_scans_only_its_new_events(spark, tmp_path, monkeypatch):
    rows, scanned, whole = events(13), [], U.sequence_within
    monkeypatch.setattr(U, "sequence_within", lambda df, *a: scanned.append(df.count()) or whole(df, *a))
    state = None
    for i, (lo, hi) in enumerate([(0, 250), (250, 370), (370, 400)]):
        scored, state = U.ueba_resume(spark.createDataFrame(rows[lo:hi], SCHEMA), state, 50, folder=str(tmp_path / str(i)))
        assert scored.count() == hi - lo
    assert scanned == [250, 120, 30]


def test_users_without_new_events_stay(spark):
    rows = events(11)
    _, one = U.ueba_resume(spark.createDataFrame(rows, SCHEMA))
    only = [r for r in events(12, 30) if r[2] == "a"]
    scored, two = U.ueba_resume(spark.createDataFrame(only, SCHEMA), one)
    assert {r.user_id for r in scored.collect()} == {"a"}
    assert two.profiles.count() == one.profiles.count()
    a, b = (s.profiles.filter("user_id <> 'a'").orderBy("user_id").select(sorted(s.profiles.columns)).collect() for s in (one, two))
    assert a == b


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_stream_fold_in_slices_equals_a_plain_fold(size):
    import numpy as np
    import pandas as pd

    from test_ueba_fold import fold as plain
    from vigil.streaming import ueba_state as S
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = sorted((r for r in events(21, 600) if r[2] == "hot"), key=lambda r: (r[1], r[0]))
    want = plain([dict(zip(names, r)) for r in rows], 30)
    totals, ring, known = dict(S.EMPTY_TOTALS), np.empty((0, 3), np.int64), {"loc": {}, "dev": {}, "act": {}}
    pdf, got = pd.DataFrame(rows, columns=names), {}
    for lo in range(0, len(pdf), size):
        # as the state does it, only the values of the slice are known
        piece = pdf.iloc[lo:lo + size].reset_index(drop=True)
        out, totals, ring, new = S.fold("hot", piece, totals, ring, {
            a: {v: c for v, c in known[a].items() if v in set(piece[col].where(piece[col].notna(), none))}
            for a, col, none in (("loc", "location", "Unknown"), ("dev", "device", "unknown"), ("act", "action", "unknown"))}, 30)
        for a in known:
            known[a].update(new[a])
        for r in out.itertuples():
            got[r.event_id] = (r.n, r.anomaly_score, r.usual_location, r.usual_device)
    assert got == want
    assert len(ring) == 30 and totals["n"] == len(rows)
