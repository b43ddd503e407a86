"""UEBA against an independent plain-Python fold of the profile semantics:
update before analyse, last-N means, first-seen mode ties, raw-value
comparisons.  Covers the cross-chunk join path (users longer than the window,
many small chunks)."""

from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import SF_SMALL
from vigil.operators import ueba as U
from vigil.sources.fixture import security_logs


def fold(rows, window):
    """rows: dicts sorted by (timestamp, event_id).  Returns {event_id: (n, score, usual_loc, usual_dev)}."""
    prof = defaultdict(lambda: {"h": [], "f": [], "u": [], "loc": {}, "dev": {}, "n": 0})
    out = {}
    for r in rows:
        p = prof[r["user_id"]]
        p["h"].append(r["timestamp"].hour)
        p["f"].append(r["files_accessed"] or 0)
        p["u"].append(r["data_uploaded_mb"] or 0)
        loc = r["location"] if r["location"] is not None else "Unknown"
        dev = r["device"] if r["device"] is not None else "unknown"
        p["loc"][loc] = p["loc"].get(loc, 0) + 1
        p["dev"][dev] = p["dev"].get(dev, 0) + 1
        p["n"] += 1
        for k in ("h", "f", "u"):
            p[k] = p[k][-window:]
        usual_loc = max(p["loc"], key=p["loc"].get)
        usual_dev = max(p["dev"], key=p["dev"].get)
        score = 0
        if p["n"] >= 10:
            ah = sum(p["h"]) / len(p["h"])
            af = sum(p["f"]) / len(p["f"])
            au = sum(p["u"]) / len(p["u"])
            score += 30 if abs(r["timestamp"].hour - ah) > 3 else 0
            score += 50 if (r["files_accessed"] or 0) > af * 3 else 0
            score += 25 if (r["data_uploaded_mb"] or 0) > au * 5 else 0
            score += 20 if r["location"] != usual_loc else 0
            score += 15 if r["device"] != usual_dev else 0
            score += 20 if (r["login_attempts"] if r["login_attempts"] is not None else 1) > 3 else 0
            score += 15 if r["foreign_ip"] == 1 else 0
        out[r["event_id"]] = (p["n"], score, usual_loc, usual_dev)
    return out


def check(spark, logs, window, num_chunks):
    rows = [r.asDict() for r in logs.orderBy("timestamp", "event_id").collect()]
    want = fold(rows, window)
    got = U.ueba_scores(logs, window=window, num_chunks=num_chunks).select(
        "event_id", "n", "anomaly_score", "usual_location", "usual_device").collect()
    assert len(got) == len(want)
    bad = [(g, want[g.event_id]) for g in got
           if (g.n, g.anomaly_score, g.usual_location, g.usual_device) != want[g.event_id]]
    assert not bad, bad[:5]


def test_fixture_small_window_many_chunks(spark):
    # window 20 with 16 chunks: most users exceed the window, many rows need
    # the value 20 rows back from an earlier chunk
    check(spark, security_logs(spark, SF_SMALL), window=20, num_chunks=16)


def test_fixture_default_window(spark):
    check(spark, security_logs(spark, SF_SMALL), window=1000, num_chunks=8)


def test_long_user_crosses_1000_window(spark):
    # one hot user with 2,600 events (a third and more of all rows), the rest small
    t0 = datetime(2024, 1, 1)
    rows = []
    eid = 0
    for i in range(2600):
        k = (i * 37) % 100
        rows.append((eid, t0 + timedelta(minutes=7 * i), "hot", "login", (i * 13) % 97 + (5000 if k > 96 else 0),
                     ["Pakistan", "UAE", None, "UK"][k % 4 if k > 80 else 0], ["laptop", "mobile", "server"][k % 3],
                     1 + k % 5, 1 if k > 90 else 0, (i * 7) % 50))
        eid += 1
    for u in range(5):
        for i in range(40):
            rows.append((eid, t0 + timedelta(hours=i, minutes=u), f"u{u}", "logout", i % 11, "Pakistan",
                         "laptop", 1, 0, i % 3))
            eid += 1
    schema = ("event_id long, timestamp timestamp_ntz, user_id string, action string, files_accessed int, "
              "location string, device string, login_attempts int, foreign_ip int, data_uploaded_mb int")
    logs = spark.createDataFrame(rows, schema)
    check(spark, logs, window=1000, num_chunks=7)


def test_learning_phase_first_nine(spark):
    s = U.ueba_scores(security_logs(spark, SF_SMALL))
    early = s.filter(F.col("n") < 10)
    assert early.filter(F.col("anomaly_score") != 0).count() == 0
    assert early.filter(F.col("reasons")[0] != U.LEARNING_REASON).count() == 0
