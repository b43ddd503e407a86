"""Registered queries over stored behavioural profiles: the events in three
parts, each going on from the state that the part before left on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators import ueba as U
from vigil.plans.catalog import _ueba_out
from vigil.plans.registry import ORACLE, register, r6
from vigil.sources.fixture import security_logs
from vigil.streaming import streams as S

PARTS = 3


def resumed(spark, sf, parts: int = PARTS) -> tuple[list[DataFrame], U.UebaState]:
    """Scored events of every part, and the last state read back from disk."""
    logs = security_logs(spark, sf)
    first, last = logs.agg(F.min("timestamp"), F.max("timestamp")).first()
    cuts = [first + (last - first) * i / parts for i in range(1, parts)]
    out, state, folder = [], None, S.scratch(spark, "profiles")
    for i, (lo, hi) in enumerate(zip([None, *cuts], [*cuts, None])):
        part = logs
        if lo is not None:
            part = part.filter(F.col("timestamp") >= F.lit(lo))
        if hi is not None:
            part = part.filter(F.col("timestamp") < F.lit(hi))
        scored, state = U.ueba_resume(part, state, folder=f"{folder}/{i}")
        out.append(scored)
    return out, state


@register("ueba_scores_resumed")
def q_ueba_scores_resumed(spark, sf):
    """Every event scored by the profile its user had by then."""
    parts, _ = resumed(spark, sf)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _ueba_out(out)


ORACLE["ueba_scores_resumed"] = ORACLE["ueba_scores"]


@register("user_baseline_resumed")
def q_user_baseline_resumed(spark, sf):
    """Baselines read from the stored state alone."""
    b = U.state_baseline(resumed(spark, sf)[1])
    return b.select("user_id", r6("avg_login_hour"), r6("avg_files"), r6("avg_upload"), r6("std_login_hour"), r6("std_files"),
                    "usual_location", "usual_device", F.col("total_events").cast("long").alias("total_events"))


ORACLE["user_baseline_resumed"] = ORACLE["user_baseline"]


@register("user_profile_resumed")
def q_user_profile_resumed(spark, sf):
    """Profiles read from the stored state alone."""
    p = U.state_profile(resumed(spark, sf)[1])
    acts = F.array_join(F.transform(F.map_entries("actions"),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return p.select("user_id", "total_events", "first_seen", "last_seen", acts.alias("actions"), "threat_count")


ORACLE["user_profile_resumed"] = ORACLE["user_profile"]
