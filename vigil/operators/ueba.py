"""Behavioural baselines per user (UEBA) as a skew-proof ordered scan.

Semantics (per user, events in (timestamp, event_id) order; the profile is
updated with an event *before* that event is judged):

- ``n``: events so far including the current one; below ``min_events`` the
  event is in the learning phase and is not scored.
- means of hour / files / upload over the last ``window`` events (incl. current);
  population std of hour and files over the same rows.
- usual location / device: most frequent value so far, ties to the value seen
  first (missing location counts as 'Unknown', missing device as 'unknown',
  but the raw value is what is compared, so a missing location always fires).
- seven additive terms; anomaly when the sum reaches the threshold.

Plan: one range shuffle + checkpoint (``sequence_within``), small per-chunk
summaries, one shuffle on (user, chunk) for the in-chunk windows, and a
self-join restricted to at most ``window`` rows per (user, chunk) for means
whose window starts in an earlier chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.functions.text import py_round, tmpl
from vigil.session import write_once
from vigil.plans.ordered_scan import (CHUNK, GID, UNB, by_chunk, chunk_prefix, running_mode, running_mode_carry,
                                      sequence_within, with_carries)

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------
UEBA_THRESHOLDS = {
    "time_deviation": 3,
    "files_multiplier": 3,
    "upload_multiplier": 5,
    "new_location_score": 20,
    "new_device_score": 15,
    "off_hours_score": 30,
    "high_files_score": 50,
    "high_upload_score": 25,
    "anomaly_threshold": 40,
}
UEBA_LOGIN_ATTEMPTS_OVER = 3
UEBA_LOGIN_SCORE = 20
UEBA_FOREIGN_IP_SCORE = 15
UEBA_MIN_EVENTS = 10
UEBA_WINDOW = 1000
LEARNING_REASON = "Learning phase - need 10+ events"
REASON_TEXT = {
    "time": "⏰ Off-hours: {}h (usual: {}h)",
    "files": "📁 High files: {} (avg: {})",
    "upload": "📤 High upload: {}MB (avg: {}MB)",
    "location": "🌍 New location: {} (usual: {})",
    "device": "💻 New device: {} (usual: {})",
    "logins": "🔑 Multiple logins: {}",
    "foreign": "🌐 Foreign IP detected",
}
UEBA_ALERT_TYPE = "UEBA_ANOMALY"


def _fmt0(x: Column) -> Column:
    """Python ``f'{x:.0f}'`` (half-even on the binary value; exact for 0 digits)."""
    return F.bround(x, 0).cast("long").cast("string")


def _pystr(x: Column) -> Column:
    """Python ``str()`` of an optional value (None prints as 'None')."""
    return F.coalesce(x.cast("string"), F.lit("None"))


def _scan(logs: DataFrame, window: int, num_chunks: int | None, state: "UebaState | None") -> DataFrame:
    """Rows in each user's order with running counts, prefix sums (``cs_*``),
    those ``window`` rows back in the chunk (``lag``) and running modes.
    With a state its rings only set where counts and sums begin; their values
    are counted in the state's value table."""
    base = logs.select(
        "event_id", "timestamp",
        F.coalesce(F.col("user_id"), F.lit("unknown")).alias("user_id"),
        "action", "location", "device", "login_attempts", "foreign_ip",
        F.hour("timestamp").cast("int").alias("hour"),
        F.coalesce(F.col("files_accessed"), F.lit(0)).cast("long").alias("files"),
        F.coalesce(F.col("data_uploaded_mb"), F.lit(0)).cast("long").alias("upload"),
        F.coalesce(F.col("location"), F.lit("Unknown")).alias("loc_key"),
        F.coalesce(F.col("device"), F.lit("unknown")).alias("dev_key"),
    )
    base = base.withColumn("hour2", F.col("hour").cast("long") * F.col("hour")) \
               .withColumn("files2", F.col("files") * F.col("files"))

    seq = sequence_within(base, "user_id", ["timestamp", "event_id"], num_chunks)

    sums = {"n": "*", "sh": "hour", "sf": "files", "su": "upload", "sh2": "hour2", "sf2": "files2"}
    prefix = chunk_prefix(seq, "user_id", sums).withColumn(
        "n_total", F.max("n_end").over(Window.partitionBy("user_id")))  # chunk rows: few a user
    known = None
    if state is not None:
        # counts and sums go on from the state: its events, the sums of its ring
        touched = seq.select("user_id").distinct()
        old = state.profiles.join(touched, "user_id", "left_semi").select(
            "user_id", F.col("n").alias("_n"), *[c.alias(f"_{x}") for x, c in ring_sums().items()])
        begin = {c: x for x in sums for c in ([f"{x}_before", "n_end", "n_total"] if x == "n" else [f"{x}_before"])}
        prefix = prefix.join(old, "user_id", "left").withColumns(
            {c: F.col(c) + F.coalesce(F.col(f"_{x}"), F.lit(0)) for c, x in begin.items()}
            | {"_seen": F.col("_n").isNotNull()}).drop(*[f"_{x}" for x in sums])
        known = state.values.join(touched, "user_id", "left_semi").filter("attr IN ('loc', 'dev')")
    modes = running_mode_carry(seq, "user_id", {"loc": "loc_key", "dev": "dev_key"}, known)
    carries = prefix.join(modes, ["user_id", CHUNK])

    names = ["sh", "sf", "su", "sh2", "sf2"]
    carries = carries.drop(*[f"{x}_end" for x in names])
    rows = with_carries(seq.drop("hour2", "files2"), carries, "user_id", {"loc": "loc_key", "dev": "dev_key"})
    w = Window.partitionBy("user_id", CHUNK).orderBy(GID)
    run = w.rowsBetween(UNB, 0)
    # per-value counts came first (one sort each, without the carries), then
    # every (user, chunk, position) window in one pass

    def so_far(col: Column) -> Column:
        s = F.sum(col).over(run)
        return s if state is None else F.coalesce(s, F.when(F.col("_seen"), 0))

    rows = rows.select(
        "*", F.row_number().over(w).alias("pos"),
        *[(F.col(f"{name}_before") + so_far(col)).alias(f"cs_{name}")
          for name, col in zip(names, [F.col("hour"), F.col("files"), F.col("upload"), F.col("hour").cast("long") * F.col("hour"),
                                       F.col("files") * F.col("files")])],
        running_mode(run, "loc_key", "loc").alias("usual_location"),
        running_mode(run, "dev_key", "dev").alias("usual_device"))
    rows = rows.withColumn("n", F.col("n_before") + F.col("pos"))

    # Means over the last `window` rows: prefix sum minus the prefix sum `window`
    # rows back.  Inside a chunk that is a lag; rows whose window starts in an
    # earlier chunk (at most `window` per (user, chunk)) get it from an equi-join
    # on (user, position).  One plan for users of any length: the windowed rows
    # are written once, and users within the window add no row to the join.
    rows = rows.withColumn("lag", F.lag(F.struct(*[f"cs_{x}" for x in names]), window).over(w))
    drop = ["loc_prev", "dev_prev", "_loc_c", "_dev_c", "_loc_fs", "_dev_fs", "loc_key", "dev_key", "_seen", GID]
    return write_once(rows.drop(*drop, *[f"{x}_before" for x in names]), "windowed")


def _with_back(rows: DataFrame, window: int, rings: DataFrame | None = None) -> DataFrame:
    """``back_*``: the prefix sums ``window`` rows before each row; ``rings``
    has those of events before the rows (user_id, _ref_n, back_*)."""
    names = ["sh", "sf", "su", "sh2", "sf2"]
    needs_join = (F.col("n") > window) & (F.col("pos") <= window)
    direct = rows.filter(~needs_join).select(
        "*", *[F.when(F.col("n") > window, F.col(f"lag.cs_{x}")).otherwise(F.lit(0)).alias(f"back_{x}")
               for x in names])
    refs = rows.filter((F.col("n") + window > F.col("n_end")) & (F.col("n") + window <= F.col("n_total"))).select(
        "user_id", F.col("n").alias("_ref_n"), *[F.col(f"cs_{x}").alias(f"back_{x}") for x in names])
    if rings is not None:
        refs = refs.unionByName(rings)
    joined = (rows.filter(needs_join).withColumn("_ref_n", F.col("n") - window)
                  .join(refs, ["user_id", "_ref_n"], "left").drop("_ref_n"))
    return direct.unionByName(joined)


def ueba_features(logs: DataFrame, window: int = UEBA_WINDOW, num_chunks: int | None = None) -> DataFrame:
    """Running count, last-``window`` means/stds and running modes per event."""
    return _features(_scan(logs, window, num_chunks, None), window)


def _features(scanned: DataFrame, window: int, rings: DataFrame | None = None) -> DataFrame:
    rows = _with_back(scanned, window, rings)
    cnt = F.least(F.col("n"), F.lit(window)).cast("double")

    def mean(x: str) -> Column:
        return (F.col(f"cs_{x}") - F.col(f"back_{x}")) / cnt

    def pop_std(x: str, x2: str) -> Column:
        # n * sum(x^2) - sum(x)^2 in exact integers: nothing cancels
        wide = "decimal(38,0)"
        s1 = (F.col(f"cs_{x}") - F.col(f"back_{x}")).cast("decimal(19,0)")
        s2 = (F.col(f"cs_{x2}") - F.col(f"back_{x2}")).cast("decimal(19,0)")
        k = F.least(F.col("n"), F.lit(window)).cast("decimal(10,0)")
        return F.sqrt((s2 * k - s1 * s1).cast(wide).cast("double")) / cnt

    return rows.select(
        "event_id", "timestamp", "user_id", "action", "location", "device", "login_attempts",
        "foreign_ip", "hour", "files", "upload", "n",
        mean("sh").alias("avg_login_hour"), pop_std("sh", "sh2").alias("std_login_hour"),
        mean("sf").alias("avg_files"), pop_std("sf", "sf2").alias("std_files"),
        mean("su").alias("avg_upload"),
        "usual_location", "usual_device",
    )


def ueba_score(features: DataFrame, th: dict = UEBA_THRESHOLDS, min_events: int = UEBA_MIN_EVENTS) -> DataFrame:
    """Seven additive terms, anomaly flag and reason texts."""
    scored = features.withColumn("has_baseline", F.col("n") >= min_events)
    terms = {
        "time": (F.abs(F.col("hour") - F.col("avg_login_hour")) > th["time_deviation"], th["off_hours_score"]),
        "files": (F.col("files") > F.col("avg_files") * th["files_multiplier"], th["high_files_score"]),
        "upload": (F.col("upload") > F.col("avg_upload") * th["upload_multiplier"], th["high_upload_score"]),
        "location": (~F.col("location").eqNullSafe(F.col("usual_location")), th["new_location_score"]),
        "device": (~F.col("device").eqNullSafe(F.col("usual_device")), th["new_device_score"]),
        "logins": (F.coalesce(F.col("login_attempts"), F.lit(1)) > UEBA_LOGIN_ATTEMPTS_OVER, UEBA_LOGIN_SCORE),
        "foreign": (F.coalesce(F.col("foreign_ip"), F.lit(0)) == 1, UEBA_FOREIGN_IP_SCORE),
    }
    for name, (cond, _) in terms.items():
        scored = scored.withColumn(f"t_{name}", F.col("has_baseline") & cond)
    total = F.lit(0)
    for name, (_, pts) in terms.items():
        total = total + F.when(F.col(f"t_{name}"), F.lit(pts)).otherwise(F.lit(0))
    r = REASON_TEXT
    texts = {
        "time": tmpl(r["time"], F.col("hour"), _fmt0(F.col("avg_login_hour"))),
        "files": tmpl(r["files"], F.col("files"), _fmt0(F.col("avg_files"))),
        "upload": tmpl(r["upload"], F.col("upload"), _fmt0(F.col("avg_upload"))),
        "location": tmpl(r["location"], _pystr(F.col("location")), F.col("usual_location")),
        "device": tmpl(r["device"], _pystr(F.col("device")), F.col("usual_device")),
        "logins": tmpl(r["logins"], _pystr(F.col("login_attempts"))),
        "foreign": F.lit(r["foreign"]),
    }
    reasons = F.filter(F.array(*[F.when(F.col(f"t_{k}"), v) for k, v in texts.items()]), lambda x: x.isNotNull())
    scored = (scored.withColumn("anomaly_score", total.cast("int"))
                    .withColumn("is_anomaly", F.col("anomaly_score") >= th["anomaly_threshold"])
                    .withColumn("reasons", F.when(F.col("has_baseline"), reasons)
                                .otherwise(F.array(F.lit(LEARNING_REASON)))))
    return scored.drop(*[f"t_{k}" for k in terms])


def ueba_scores(logs: DataFrame, window: int = UEBA_WINDOW, num_chunks: int | None = None) -> DataFrame:
    """W1-W5 in one call: every event with its baseline, score and reasons."""
    return ueba_score(ueba_features(logs, window, num_chunks))


def running_threat_count(scored: DataFrame, num_chunks: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Anomalies per user so far (incl. current) — the profile's threat counter.
    Same chunked prefix scan as the baseline, so a hot user is not one task."""
    base = scored.select("event_id", "timestamp", "user_id", *keep,
                         F.col("is_anomaly").cast("int").alias("_a"))
    seq = sequence_within(base, "user_id", ["timestamp", "event_id"], num_chunks)
    pre = chunk_prefix(seq, "user_id", {"na": "_a"})
    w = Window.partitionBy("user_id", CHUNK).orderBy(GID).rowsBetween(UNB, 0)
    out = by_chunk(seq, "user_id", pre).select(
        "event_id", "user_id", *keep, (F.col("na_before") + F.sum("_a").over(w)).alias("threat_count"))
    return out


def ueba_anomalies(scored: DataFrame) -> DataFrame:
    """Anomalous events as behavioural alerts (event time, not wall clock)."""
    return scored.filter(F.col("is_anomaly")).select(
        F.col("timestamp"),
        F.lit(UEBA_ALERT_TYPE).alias("alert_type"),
        "user_id", "anomaly_score", "reasons",
        F.struct(F.col("action"), F.col("files"), F.col("location"), F.col("device"),
                 F.col("hour")).alias("activity"),
        F.struct(py_round(F.col("avg_files"), 1).cast("double").alias("avg_files"), F.col("usual_location"),
                 F.col("n").alias("total_events")).alias("baseline"),
        "event_id",
    )


def ueba_stats(scored: DataFrame) -> DataFrame:
    """Events, anomalies, distinct users and anomaly rate in one aggregate."""
    return scored.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("is_anomaly")).alias("anomalies"),
        F.count_distinct("user_id").alias("users_tracked"),
    ).withColumn("anomaly_rate", F.round(F.lit(100.0) * F.col("anomalies")
                                         / F.greatest(F.lit(1), F.col("total_events")), 6))


def user_baseline(scored: DataFrame, min_events: int = UEBA_MIN_EVENTS) -> DataFrame:
    """Each user's baseline after their last event (users with >= min_events).
    The last event per user is a max over (n, ...) — an algebraic aggregate."""
    last = scored.groupBy("user_id").agg(F.max(F.struct(
        "n", "avg_login_hour", "std_login_hour", "avg_files", "std_files", "avg_upload",
        "usual_location", "usual_device")).alias("b"))
    return last.filter(F.col("b.n") >= min_events).select(
        "user_id",
        F.col("b.avg_login_hour").alias("avg_login_hour"), F.col("b.std_login_hour").alias("std_login_hour"),
        F.col("b.avg_files").alias("avg_files"), F.col("b.std_files").alias("std_files"),
        F.col("b.avg_upload").alias("avg_upload"),
        F.col("b.usual_location").alias("usual_location"), F.col("b.usual_device").alias("usual_device"),
        F.col("b.n").alias("total_events"))


def user_profile(logs: DataFrame, scored: DataFrame) -> DataFrame:
    """Per-user counters — total, first/last seen, action counts
    (pre-aggregated per (user, action), so a hot user is combined map-side),
    and anomaly count."""
    per = logs.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"))
    acts = (logs.groupBy("user_id", F.coalesce(F.col("action"), F.lit("unknown")).alias("action"))
                .agg(F.count(F.lit(1)).alias("n"))
                .groupBy("user_id")
                .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "n")))).alias("actions")))
    threats = scored.groupBy("user_id").agg(F.count_if(F.col("is_anomaly")).alias("threat_count"))
    return per.join(acts, "user_id", "left").join(threats, "user_id", "left")


def periodic_stats(scored: DataFrame, every: int = 50) -> DataFrame:
    """Running totals per user at every ``every``-th event (events so far,
    anomalies so far, rate).  Per user, so no global single-partition order."""
    return (running_threat_count(scored, keep=("n",)).filter(F.col("n") % every == 0)
                  .select("user_id", "event_id", F.col("n").cast("long").alias("events"),
                          F.col("threat_count").alias("anomalies"),
                          F.round(F.lit(100.0) * F.col("threat_count") / F.col("n"), 6).alias("anomaly_rate")))


# ----------------------------------------------------------------- stored profiles
@dataclass
class UebaState:
    """Profiles to go on from: ``profiles`` (user_id, n, threat_count,
    first_seen, last_seen, ring of the last values) has one row a user of at
    most ``UEBA_WINDOW`` ring entries; ``values`` (user_id, attr, value,
    count, first) counts locations, devices and actions, ``first`` being the
    number of the event that first had the value."""
    profiles: DataFrame
    values: DataFrame

    def save(self, path: str) -> None:
        self.profiles.write.mode("overwrite").parquet(f"{path}/profiles")
        self.values.write.mode("overwrite").parquet(f"{path}/values")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "UebaState":
        return cls(spark.read.parquet(f"{path}/profiles"), spark.read.parquet(f"{path}/values"))


def ring_sums() -> dict[str, Column]:
    """Sums over a profile's ring, as the scan's prefix sums are named."""
    def total(f):
        return F.aggregate("ring", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(f(x).cast("long"), F.lit(0)))
    return {"sh": total(lambda x: x["hour"]), "sf": total(lambda x: x["files"]), "su": total(lambda x: x["upload"]),
            "sh2": total(lambda x: x["hour"] * x["hour"]), "sf2": total(lambda x: x["files"] * x["files"])}


def _ring_refs(scanned: DataFrame, state: UebaState, window: int) -> DataFrame:
    """Prefix sums at the ring entries that leave the window while new events
    come in: only users past ``window``, at most as many entries as they have
    new events."""
    past = scanned.filter(F.col("n_total") > window).groupBy("user_id").agg(F.max("n_total").alias("n_total"))
    rows = state.profiles.join(past, "user_id").select(
        "user_id", "n_total", (F.col("n") - F.size("ring")).alias("_skip"), F.posexplode("ring").alias("_at", "r"))
    run = Window.partitionBy("user_id").orderBy("_at").rowsBetween(UNB, 0)  # a ring: at most `window` rows
    h, f, u = (F.col(f"r.{x}").cast("long") for x in ("hour", "files", "upload"))
    at = F.col("_skip") + F.col("_at") + 1
    return rows.select("user_id", "n_total", at.alias("_ref_n"), *[
        F.coalesce(F.sum(c).over(run), F.lit(0)).alias(f"back_{x}")
        for x, c in {"sh": h, "sf": f, "su": u, "sh2": h * h, "sf2": f * f}.items()
    ]).filter(F.col("_ref_n") + window <= F.col("n_total")).drop("n_total")


def ueba_resume(logs: DataFrame, state: UebaState | None = None, window: int = UEBA_WINDOW,
                num_chunks: int | None = None, folder: str | None = None) -> tuple[DataFrame, UebaState]:
    """W1-W5, A43, A44 going on from a stored state: new events scored, and the
    state after them (saved to ``folder`` and read back, if given).  History isn't read again, only the rings and value
    counts of users with new events, and no ring's entries are rows of the scan."""
    scanned = _scan(logs, window, num_chunks, state)
    fresh = _features(scanned, window, None if state is None else _ring_refs(scanned, state, window))
    scored = write_once(ueba_score(fresh), "scored")

    # new entries of a ring: at most `window`, from at most two chunks' ends
    ring = scanned.filter(F.col("n") > F.col("n_total") - window).groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("n", "hour", "files", "upload"))).alias("r"))
    ring = ring.select("user_id", F.transform("r", lambda x: F.struct(x["hour"], x["files"], x["upload"])).alias("ring"))
    totals = scored.groupBy("user_id").agg(
        F.max("n").alias("n"), F.count_if("is_anomaly").alias("threat_count"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    profiles = totals.join(ring, "user_id")
    one = F.array(F.struct(F.lit("loc").alias("attr"), F.coalesce("location", F.lit("Unknown")).alias("value")),
                  F.struct(F.lit("dev").alias("attr"), F.coalesce("device", F.lit("unknown")).alias("value")),
                  F.struct(F.lit("act").alias("attr"), F.coalesce("action", F.lit("unknown")).alias("value")))
    values = scored.select("user_id", "n", F.explode(one).alias("v")).groupBy("user_id", "v.attr", "v.value").agg(
        F.count("*").alias("count"), F.min("n").alias("first"))
    if state is not None:
        old = state.profiles.select("user_id", *[F.col(c).alias(f"_{c}") for c in ("n", "threat_count", "first_seen", "last_seen", "ring")])
        profiles = profiles.join(old, "user_id", "full").select(
            "user_id", F.coalesce("n", "_n").alias("n"),
            (F.coalesce("threat_count", F.lit(0)) + F.coalesce("_threat_count", F.lit(0))).alias("threat_count"),
            F.least("first_seen", "_first_seen").alias("first_seen"), F.greatest("last_seen", "_last_seen").alias("last_seen"),
            F.concat(F.coalesce("_ring", F.array()), F.coalesce("ring", F.array())).alias("ring"))
        profiles = profiles.withColumn("ring", F.slice("ring", F.greatest(F.lit(1), F.size("ring") - window + 1), window))
        values = values.unionByName(state.values).groupBy("user_id", "attr", "value").agg(
            F.sum("count").alias("count"), F.min("first").alias("first"))
    if folder is None:
        return scored, UebaState(write_once(profiles, "profiles"), write_once(values, "values"))
    UebaState(profiles, values).save(folder)
    return scored, UebaState.load(profiles.sparkSession, folder)


def state_modes(state: UebaState) -> DataFrame:
    """(user_id, usual_location, usual_device) of a state: the most frequent
    value, ties to the one seen first."""
    best = F.max(F.struct("count", -F.col("first"), "value"))["value"]
    return state.values.groupBy("user_id").pivot("attr", ["loc", "dev"]).agg(best) \
        .select("user_id", F.col("loc").alias("usual_location"), F.col("dev").alias("usual_device"))


def state_baseline(state: UebaState, min_events: int = UEBA_MIN_EVENTS) -> DataFrame:
    """A43 from a stored state alone."""
    def total(f):
        return F.aggregate("ring", F.lit(0).cast("long"), lambda a, x: a + f(x))
    k = F.size("ring")
    rows = state.profiles.filter(F.col("n") >= min_events).withColumns({
        "_k": k, "_h": total(lambda x: x["hour"]), "_f": total(lambda x: x["files"]), "_u": total(lambda x: x["upload"]),
        "_h2": total(lambda x: x["hour"] * x["hour"]), "_f2": total(lambda x: x["files"] * x["files"])})

    def std(x: str, x2: str) -> Column:
        exact = F.col(x2).cast("decimal(19,0)") * F.col("_k") - F.col(x).cast("decimal(19,0)") * F.col(x).cast("decimal(19,0)")
        return F.sqrt(exact.cast("double")) / F.col("_k")
    return rows.join(state_modes(state), "user_id").select(
        "user_id", (F.col("_h") / F.col("_k")).alias("avg_login_hour"), std("_h", "_h2").alias("std_login_hour"),
        (F.col("_f") / F.col("_k")).alias("avg_files"), std("_f", "_f2").alias("std_files"),
        (F.col("_u") / F.col("_k")).alias("avg_upload"), "usual_location", "usual_device", F.col("n").alias("total_events"))


def state_profile(state: UebaState) -> DataFrame:
    """A44 / W12 from a stored state alone."""
    acts = state.values.filter("attr = 'act'").groupBy("user_id").agg(F.map_from_entries(F.array_sort(
        F.collect_list(F.struct(F.col("value").alias("action"), F.col("count").alias("n"))))).alias("actions"))
    return state.profiles.select("user_id", F.col("n").alias("total_events"), "first_seen", "last_seen", "threat_count") \
        .join(acts, "user_id")
