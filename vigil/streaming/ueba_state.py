"""The behavioural profile as keyed streaming state.

``transformWithState`` is keyed by GROUPS groups of users (by hash of the
user), since a call, its frames and its Arrow batches cost much more than the
few rows a user has in a micro-batch.  A group's state in RocksDB is a map of
BLOCKS blocks of users (by another hash), since a state call costs more than
a profile's fold.  A block has of every user: totals (events, anomalies, the
usual location and device with their counts), value counts for location,
device and action, and the last ``window`` hour/files/upload values as numbers
in a row.  A user's first FEW values lie in the block, all later ones in a
second map, of which a batch reads only the entries it touches.  So a
micro-batch reads and writes the blocks that its users lie in, and neither a
state call per user or value nor a profile's size matters.  A stream can go on
from stored profiles (``ueba.UebaState``), which the first batch loads.

Within a micro-batch a user's rows are folded in (timestamp, event_id)
order, so a stream that delivers events in order gives exactly the batch
result (``vigil.operators.ueba``).  A group's rows are sorted once as columns
and then folded and given back in slices of SLICE rows: texts and outputs of
one slice are held at a time.  The fold is vectorised over the users of a
slice: window means by prefix sums over rings + slice, running modes by each
user's cumulative max of an encoded (count so far, first seen) key, scores as
numpy masks; only the reason strings are assembled per row.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vigil.operators.ueba import (LEARNING_REASON, REASON_TEXT, UEBA_FOREIGN_IP_SCORE,
                                  UEBA_LOGIN_ATTEMPTS_OVER, UEBA_LOGIN_SCORE, UEBA_MIN_EVENTS, UEBA_THRESHOLDS,
                                  UEBA_WINDOW, UebaState)

SLICE = 1 << 14  # rows of a group folded at a time
FEW = 256        # values of a user kept in one block
GROUPS = 1024    # groups of users; a checkpoint goes on only with the number it began with
GROUP = "_group"
BLOCKS = 16      # blocks of a group's users that lie together in the state; fixed as GROUPS is
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# usual value of an attribute: its count and the number of the event that first had it
TOTALS = ["n", "threat_count", "loc", "loc_count", "loc_first", "dev", "dev_count", "dev_first"]
ATTRS = (("loc", "location", "Unknown"), ("dev", "device", "unknown"), ("act", "action", "unknown"))

OUTPUT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("avg_login_hour", T.DoubleType()),
    T.StructField("avg_files", T.DoubleType()),
    T.StructField("avg_upload", T.DoubleType()),
    T.StructField("usual_location", T.StringType()),
    T.StructField("usual_device", T.StringType()),
    T.StructField("anomaly_score", T.IntegerType()),
    T.StructField("is_anomaly", T.BooleanType()),
    T.StructField("reasons", T.ArrayType(T.StringType())),
    T.StructField("threat_count", T.LongType()),
])


class Rows:
    """Rows of some users, all rows of a user together: ``starts`` (where a
    user's rows begin, and last their number), the ``user`` of a row by
    number, the events ``n0`` of a user before the rows and ``n`` of a row."""

    def __init__(self, starts: np.ndarray, n0: np.ndarray):
        self.starts, self.n0 = starts, n0
        self.user = np.repeat(np.arange(len(n0)), np.diff(starts))
        self.at = np.arange(starts[-1])
        self.n = n0[self.user] + self.at - starts[self.user] + 1


def _window_means(rings: list[np.ndarray], batch: np.ndarray, rows: Rows, window: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Means of a user's last min(n, window) values for each batch row (incl.
    itself) by column, and the users' rings after it."""
    pieces = [x for ring, lo, hi in zip(rings, rows.starts, rows.starts[1:]) for x in (ring, batch[lo:hi])]
    allv = np.concatenate(pieces)
    cs = np.concatenate([np.zeros((1, allv.shape[1]), np.int64), np.cumsum(allv, axis=0)])
    before = np.cumsum([len(ring) for ring in rings])     # ring entries that lie before a user's rows
    idx = np.arange(len(batch)) + before[rows.user] + 1   # prefix length through each batch row
    cnt = np.minimum(rows.n, window)
    ends = (before + rows.starts[1:]).tolist()
    after = [allv[max(lo, hi - window):hi] for lo, hi in zip([0, *ends], ends)]
    return (cs[idx] - cs[idx - cnt]) / cnt[:, None], after


def _filled(col: pd.Series, missing: str) -> np.ndarray:
    values = col.to_numpy(dtype=object)
    return np.where(pd.isna(values), missing, values)


def running_modes(best: list[tuple], known: list[dict], values: np.ndarray, rows: Rows) -> tuple[np.ndarray, list[tuple]]:
    """Each user's running mode of ``values`` (ties to the value seen first),
    going on from the users' ``best`` (value, count, first) and the ``known``
    (count, first) of their values, which are brought forward: the mode at each
    row and the new best.

    A row's key is (count so far) * BIG - first; the mode is the value whose
    key is the user's running maximum."""
    code, names = pd.factorize(values)
    rank, pairs = pd.factorize(rows.user * len(names) + code)  # a pair: a user's value
    firsts = np.unique(rank, return_index=True)[1]
    whose, what = (pairs // len(names)).tolist(), names[pairs % len(names)].tolist()
    start = [known[u].get(v) or (0, n) for u, v, n in zip(whose, what, rows.n[firsts].tolist())]
    base, first = np.array(start, np.int64).reshape(-1, 2).T
    here = np.bincount(rank, minlength=len(pairs))
    nth = np.empty(len(rank), np.int64)  # number of a row among those of its pair
    nth[np.argsort(rank, kind="stable")] = np.arange(1, len(rank) + 1) - np.repeat(np.cumsum(here) - here, here)
    so_far = base[rank] + nth
    big = rows.n0 + np.diff(rows.starts) + 2
    key = so_far * big[rows.user] - first[rank]
    top = np.empty_like(key)
    for lo, hi in zip(rows.starts, rows.starts[1:]):
        np.maximum.accumulate(key[lo:hi], out=top[lo:hi])
    old = np.array([c * b - f if v is not None else np.iinfo(np.int64).min for (v, c, f), b in zip(best, big.tolist())], np.int64)
    # the row that made the running maximum; none yet: the best so far stays
    made = np.maximum.accumulate(np.where((key == top) & (key > old[rows.user]), rows.at, -1))
    changed = made >= rows.starts[rows.user]
    modes = np.where(changed, values[made], np.array([v for v, _, _ in best], object)[rows.user])
    for u, v, c, f in zip(whose, what, (base + here).tolist(), first.tolist()):
        known[u][v] = (c, f)
    last = rows.starts[1:] - 1
    new = zip(changed[last].tolist(), values[made[last]], so_far[made[last]].tolist(), first[rank[made[last]]].tolist())
    return modes, [(v, c, f) if is_new else b for b, (is_new, v, c, f) in zip(best, new)]


def _present(col: pd.Series) -> np.ndarray:
    return col.notna().to_numpy()


def fold_users(pdf: pd.DataFrame, starts: np.ndarray, profiles: list[tuple],
               window: int = UEBA_WINDOW) -> tuple[pd.DataFrame, list[tuple]]:
    """Scores of a slice of some users' rows (a user's rows together and in
    order, ``starts`` as in ``Rows``), and their profiles after it.  A profile
    has the totals, the ring (rows: hour, files, upload) and the value counts
    ((count, first) by attribute and value), which are brought forward."""
    th = UEBA_THRESHOLDS
    rows = Rows(starts, np.array([p[0]["n"] for p in profiles], np.int64))
    hour = pdf["timestamp"].dt.hour.to_numpy(dtype=np.int64)
    files = pdf["files_accessed"].fillna(0).to_numpy(dtype=np.int64)
    upload = pdf["data_uploaded_mb"].fillna(0).to_numpy(dtype=np.int64)
    means, rings = _window_means([p[1] for p in profiles], np.stack([hour, files, upload], axis=1), rows, window)
    avg_h, avg_f, avg_u = means.T
    totals, modes = [dict(p[0]) for p in profiles], {}
    for attr, column, missing in ATTRS:
        names = (attr, f"{attr}_count", f"{attr}_first")
        modes[attr], best = running_modes([tuple(t.get(k) for k in names) for t in totals],
                                          [p[2][attr] for p in profiles], _filled(pdf[column], missing), rows)
        if attr != "act":
            for t, b in zip(totals, best):
                t.update(zip(names, b))
    usual_loc, usual_dev = modes["loc"], modes["dev"]
    scored = rows.n >= UEBA_MIN_EVENTS
    attempts = pdf["login_attempts"].fillna(1).to_numpy()
    loc = pdf["location"].to_numpy(dtype=object)
    dev = pdf["device"].to_numpy(dtype=object)
    has_loc, has_dev = _present(pdf["location"]), _present(pdf["device"])
    terms = {
        "time": (np.abs(hour - avg_h) > th["time_deviation"], th["off_hours_score"]),
        "files": (files > avg_f * th["files_multiplier"], th["high_files_score"]),
        "upload": (upload > avg_u * th["upload_multiplier"], th["high_upload_score"]),
        # the raw value is compared: a missing location never equals the usual one
        "location": (~has_loc | (loc != usual_loc), th["new_location_score"]),
        "device": (~has_dev | (dev != usual_dev), th["new_device_score"]),
        "logins": (attempts > UEBA_LOGIN_ATTEMPTS_OVER, UEBA_LOGIN_SCORE),
        "foreign": (pdf["foreign_ip"].fillna(0).to_numpy() == 1, UEBA_FOREIGN_IP_SCORE),
    }
    fired = {k: scored & cond for k, (cond, _) in terms.items()}
    score = sum(np.where(fired[k], pts, 0) for k, (_, pts) in terms.items()).astype(np.int32)
    is_anom = score >= th["anomaly_threshold"]
    sofar = np.concatenate([[0], np.cumsum(is_anom)])
    threat = np.array([t["threat_count"] for t in totals], np.int64)[rows.user] + sofar[1:] - sofar[starts[rows.user]]

    def whole(x):  # as printed without digits
        return [f"{v:.0f}" for v in x.tolist()]

    def py(x, present):  # Python's str() of an optional value
        return np.where(present, x, "None").tolist()

    # a template's values, of the rows for which its term fired
    texts = {
        "time": lambda at: (hour[at].tolist(), whole(avg_h[at])),
        "files": lambda at: (files[at].tolist(), whole(avg_f[at])),
        "upload": lambda at: (upload[at].tolist(), whole(avg_u[at])),
        "location": lambda at: (py(loc[at], has_loc[at]), usual_loc[at].tolist()),
        "device": lambda at: (py(dev[at], has_dev[at]), usual_dev[at].tolist()),
        "logins": lambda at: (attempts[at].astype(np.int64).tolist(),),
        "foreign": lambda at: (at.tolist(),),  # no place for a value
    }
    reasons = [[] if s else [LEARNING_REASON] for s in scored.tolist()]
    for k in terms:
        at = np.flatnonzero(fired[k])
        for i, *values in zip(at.tolist(), *texts[k](at)):
            reasons[i].append(REASON_TEXT[k].format(*values))
    out = pd.DataFrame({
        "event_id": pdf["event_id"].astype("int64"), "timestamp": pdf["timestamp"], "user_id": pdf["user_id"],
        "n": rows.n, "avg_login_hour": avg_h, "avg_files": avg_f, "avg_upload": avg_u,
        "usual_location": usual_loc, "usual_device": usual_dev, "anomaly_score": score, "is_anomaly": is_anom,
        "reasons": reasons, "threat_count": threat.astype("int64")})
    last = starts[1:] - 1
    for t, n, c in zip(totals, rows.n[last].tolist(), threat[last].tolist()):
        t.update(n=n, threat_count=c)
    return out, [(t, ring, p[2]) for t, ring, p in zip(totals, rings, profiles)]


def fold(user: str, pdf: pd.DataFrame, totals: dict, ring: np.ndarray, known: dict,
         window: int = UEBA_WINDOW) -> tuple[pd.DataFrame, dict, np.ndarray, dict]:
    """``fold_users`` for a slice of one user's rows."""
    out, [profile] = fold_users(pdf.assign(user_id=user), np.array([0, len(pdf)]),
                                [(totals, ring, {a: dict(v) for a, v in known.items()})], window)
    return out, *profile


EMPTY_TOTALS = dict.fromkeys(TOTALS) | {"n": 0, "threat_count": 0}


def block_of(user: str) -> int:
    return zlib.crc32(user.encode("utf-8", "surrogatepass")) % BLOCKS


class Profiles(StatefulProcessor):
    """State of a group of users: totals, value counts and rings of the last
    values by block of users; the values that don't fit into a block."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # JSON: (user, ring's length, totals as in TOTALS, counts by attribute and value); the rings one after the other
        self.blocks = handle.getMapState("blocks", "block int", "profiles string, rings binary")
        self.values = handle.getMapState("values", "user string, attr string, value string", "count long, first long")

    def _read(self, block: int) -> dict[str, tuple]:
        if not self.blocks.containsKey((block,)):
            return {}
        profiles, rings = self.blocks.getValue((block,))
        rings, at, out = np.frombuffer(bytes(rings), np.int64).reshape(-1, 3), 0, {}
        for user, size, totals, known in json.loads(profiles):
            out[user] = (dict(zip(TOTALS, totals)), rings[at:at + size], known)
            at += size
        return out

    def _write(self, block: int, profiles: dict[str, tuple]) -> None:
        text = json.dumps([(user, len(ring), [totals[c] for c in TOTALS], known)
                           for user, (totals, ring, known) in profiles.items()])
        rings = np.concatenate([ring for _, ring, _ in profiles.values()]).astype(np.int64)
        self.blocks.updateValue((block,), (text, rings.tobytes()))

    def _few(self, user: str, known: dict, block: set | None) -> dict:
        """The counts that stay in the block; the others go to the map.
        ``known`` has the values of the ``block`` and those that the slice
        touched (None: all values the user ever had)."""
        if sum(map(len, known.values())) <= FEW:
            return known
        entries = [(attr, value) for attr, counts in known.items() for value in counts]
        few = [e for e in entries if e in block] if block else []
        rest = [e for e in entries if e not in block] if block else entries
        room = max(0, FEW - len(few))
        for attr, value in rest[room:]:
            self.values.updateValue((user, attr, value), tuple(known[attr][value]))
        kept = {a: {} for a in known}
        for attr, value in few + rest[:room]:
            kept[attr][value] = known[attr][value]
        return kept

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Stored profiles: rows of ``profile_rows``."""
        for block, users in initialState.groupby(initialState["user_id"].map(block_of)):
            profiles = self._read(int(block))
            for r in users.itertuples(index=False):
                known: dict = {a: {} for a, _, _ in ATTRS}
                for attr, value, count, first in zip(r.attrs, r.names, r.counts, r.firsts):
                    known[attr][value] = (int(count), int(first))
                totals = {**EMPTY_TOTALS, "n": int(r.n), "threat_count": int(r.threat_count)}
                for attr in ("loc", "dev"):
                    value = max(known[attr], key=lambda v: (known[attr][v][0], -known[attr][v][1]))
                    totals.update(zip((attr, f"{attr}_count", f"{attr}_first"), (value, *known[attr][value])))
                ring = np.stack([np.asarray(x, np.int64) for x in (r.hours, r.files, r.uploads)], axis=1)
                profiles[r.user_id] = (totals, ring, self._few(r.user_id, known, None))
            self._write(int(block), profiles)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = list(rows)
        pdf = rows[0] if len(rows) == 1 else pd.concat(rows, ignore_index=True)
        pdf = pdf.assign(_user=pd.factorize(pdf["user_id"])[0])
        pdf = pdf.sort_values(["_user", "timestamp", "event_id"], kind="stable", ignore_index=True)
        for lo in range(0, len(pdf), SLICE):
            yield self._slice(pdf if len(pdf) <= SLICE else pdf.iloc[lo:lo + SLICE].reset_index(drop=True))

    def _slice(self, pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows of some users, who go on from the state and leave it in it."""
        starts = np.flatnonzero(np.diff(pdf["_user"].to_numpy(), prepend=-1, append=-1))
        users = pdf["user_id"].iloc[starts[:-1]].tolist()
        blocks = {b: self._read(b) for b in set(map(block_of, users))}
        profiles, full = [], []
        for user, lo, hi in zip(users, starts, starts[1:]):
            profile = blocks[block_of(user)].get(user)
            if profile is None:
                profile = (EMPTY_TOTALS, np.empty((0, 3), np.int64), {a: {} for a, _, _ in ATTRS})
            known, block = profile[2], None
            if sum(map(len, known.values())) >= FEW:  # further values lie in the map
                block = {(attr, value) for attr, counts in known.items() for value in counts}
                for attr, column, missing in ATTRS:
                    for value in pd.unique(_filled(pdf[column].iloc[lo:hi], missing)):
                        if value not in known[attr] and self.values.containsKey((user, attr, value)):
                            known[attr][value] = tuple(self.values.getValue((user, attr, value)))
            profiles.append(profile)
            full.append(block)
        out, profiles = fold_users(pdf, starts, profiles)
        for user, (totals, ring, known), block in zip(users, profiles, full):
            blocks[block_of(user)][user] = (totals, ring, self._few(user, known, block))
        for block, entries in blocks.items():
            self._write(block, entries)
        return out

    def close(self) -> None:
        pass


def profile_rows(state: UebaState) -> DataFrame:
    """One row a user: the ring and the value counts as arrays."""
    values = state.values.groupBy("user_id").agg(F.collect_list(F.struct("attr", "value", "count", "first")).alias("v"))
    return state.profiles.join(values, "user_id").select(
        "user_id", "n", "threat_count", F.col("ring.hour").cast("array<long>").alias("hours"), F.col("ring.files").alias("files"),
        F.col("ring.upload").alias("uploads"), F.col("v.attr").alias("attrs"), F.col("v.value").alias("names"),
        F.col("v.count").alias("counts"), F.col("v.first").alias("firsts"))


def stream_ueba(logs: DataFrame, state: UebaState | None = None, groups: int = GROUPS) -> DataFrame:
    """Keyed behavioural scoring of a streaming log frame, from nothing or
    from stored profiles."""
    logs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    cols = ["event_id", "timestamp", "user_id", "action", "location", "device", "files_accessed",
            "data_uploaded_mb", "login_attempts", "foreign_ip"]
    group = F.pmod(F.xxhash64("user_id"), F.lit(groups)).cast("int")
    rows = logs.select(*cols).withColumn("user_id", F.coalesce("user_id", F.lit("unknown"))).withColumn(GROUP, group)
    return rows.groupBy(GROUP).transformWithStateInPandas(
        Profiles(), OUTPUT_SCHEMA, "Append", "None",
        initialState=profile_rows(state).withColumn(GROUP, group).groupBy(GROUP) if state is not None else None)
