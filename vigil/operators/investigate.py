"""Automated user investigation: risk factors, verdicts, rankings, statistics.

All users are judged by one plan: algebraic per-user aggregates (partial
aggregation combines a hot user map-side) plus small pre-aggregates per
(user, location), (user, hour) and (user, device) whose per-user size is
bounded by the attribute's domain.  A single user is the same plan with a
filter that Catalyst pushes below the aggregates and into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.scoring import HIGH_RISK_COUNTRIES, HOME_COUNTRY
from vigil.functions.text import fmt_fixed, fmt_int0, py_dict_text, tmpl
from vigil.plans.ordered_scan import global_rank
from vigil.session import write_once

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------
RISK_WEIGHTS = {
    "night_activity": 25,
    "foreign_location": 20,
    "high_files": 30,
    "unknown_device": 15,
    "multiple_logins": 10,
    "high_upload": 15,
    "foreign_ip": 20,
    "new_location": 20,
    "off_hours": 15,
}
THREAT_THRESHOLDS = {"CRITICAL": 80, "HIGH": 60, "MEDIUM": 40, "LOW": 20}
VERDICT_TEXT = {
    "CRITICAL": ("🔴", "IMMEDIATE BLOCK + Investigation"),
    "HIGH": ("🟠", "Block suspicious activity, enable MFA"),
    "MEDIUM": ("🟡", "Monitor closely, review access"),
    "LOW": ("🟢", "Continue routine monitoring"),
    "CLEAN": ("✅", "No action needed"),
}
SEVERITY_EMOJI = {"CRITICAL": "🔴", "HIGH": "🟠", "MEDIUM": "🟡", "LOW": "🟢", "CLEAN": "✅"}
FACTOR_TEXT = {
    "night": ("Night Activity", "{}% activity at night (12-5AM)"),
    "foreign": ("Foreign Location", "{}% foreign access"),
    "files_critical": ("Excessive File Access", "Max {} files, Avg {}, {} events >1000"),
    "files_medium": ("High File Access", "Max {} files, Avg {}"),
    "device": ("Unknown Device", "{}% from unknown devices"),
    "logins": ("Multiple Logins", "{} events with >5 login attempts"),
    "upload": ("High Data Upload", "{} events >500MB, Avg {}MB"),
    "foreign_ip": ("Foreign IP", "{}% from foreign IPs"),
}
PATTERN_TEXT = {
    "night_high": "🔴 Night owl: {}% activity during 12AM-5AM",
    "night_some": "🟡 Occasional late work: {}% night activity",
    "night_none": "🟢 Normal working hours",
    "mobility_high": "🔴 High mobility: {} different locations",
    "mobility_some": "🟡 Travel pattern: {} locations",
    "mobility_none": "🟢 Single location",
    "files_erratic": "🔴 Erratic file access (high variance)",
    "files_steady": "🟢 Consistent file access pattern",
    "device_high": "🔴 {}% unknown devices - possible security bypass",
    "device_some": "🟡 {}% unknown devices",
    "device_none": "🟢 All known devices",
}
USER_RECOMMENDATIONS = {
    "disable": "🚨 IMMEDIATE: Disable account and initiate security investigation",
    "escalate": "📞 Escalate to SOC Manager immediately",
    "mfa": "🔐 Enable MFA immediately",
    "review": "📋 Review all recent activity logs",
    "countries": "🌍 Block access from high-risk countries ({} events)",
    "dlp": "📁 Review data loss prevention (DLP) policies",
    "devices": "💻 Enforce device compliance policy",
    "none": "✅ No immediate action required",
    "always": "📊 Schedule next review in 24 hours",
}
REPORT_TEXT = {
    "title": "🔍 USER INVESTIGATION REPORT",
    "generated": "🕐 Generated: {}",
    "user": "👤 User: {}",
    "source": "📁 Source: {}",
    "records": "📊 Records: {}",
    "verdict": "{} RISK VERDICT: {}",
    "score": "  Risk Score: {}/100",
    "action": "  Action: {}",
    "factors": "⚠️  RISK FACTORS FOUND:",
    "no_factors": "  ✅ No significant risk factors found",
    "stats": "📊 ACTIVITY STATISTICS",
    "patterns": "🧠 BEHAVIORAL PATTERNS",
    "recommendations": "💡 RECOMMENDATIONS",
    "complete": "✅ INVESTIGATION COMPLETE",
}


def _has(df: DataFrame, c: str) -> bool:
    return c in df.columns


def user_aggregates(df: DataFrame) -> DataFrame:
    """Per-user algebraic aggregates behind every factor and statistic."""
    aggs = [F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_seen")]
    if _has(df, "hour_of_day"):
        aggs.append(F.count_if(F.col("hour_of_day").between(0, 5)).alias("night_count"))
    if _has(df, "location"):
        aggs += [F.count_if(~F.col("location").eqNullSafe(F.lit(HOME_COUNTRY))).alias("foreign_count"),
                 F.count_if(F.col("location").isin(HIGH_RISK_COUNTRIES)).alias("high_risk_count"),
                 F.count_distinct("location").alias("unique_locations")]
    if _has(df, "files_accessed"):
        aggs += [F.avg("files_accessed").alias("avg_files"), F.max("files_accessed").alias("max_files"),
                 F.count_if(F.col("files_accessed") > 1000).alias("files_over_1000"),
                 F.stddev_samp("files_accessed").alias("std_files")]
    if _has(df, "unknown_device"):
        aggs.append(F.sum("unknown_device").cast("long").alias("unknown_count"))
    if _has(df, "login_attempts"):
        aggs += [F.count_if(F.col("login_attempts") > 5).alias("attempts_over_5"),
                 F.avg("login_attempts").alias("avg_logins")]
    if _has(df, "data_uploaded_mb"):
        aggs += [F.count_if(F.col("data_uploaded_mb") > 500).alias("uploads_over_500"),
                 F.avg("data_uploaded_mb").alias("avg_upload"),
                 F.sum("data_uploaded_mb").cast("long").alias("total_upload")]
    if _has(df, "foreign_ip"):
        aggs.append(F.sum("foreign_ip").cast("long").alias("foreign_ip_count"))
    if _has(df, "threat_score"):
        aggs += [F.avg("threat_score").alias("avg_threat_score"), F.max("threat_score").alias("max_threat_score")]
    return df.groupBy("user_id").agg(*aggs)


def value_counts(df: DataFrame, attrs: list[str]) -> DataFrame:
    """Per (user, attribute, value) counts of several attributes in one pass
    (attributes stacked as rows; partial aggregation runs before the shuffle,
    so a hot user is combined map-side).  Bounded per user by the domains."""
    stacked = df.select("user_id", F.explode(F.array(*[
        F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("value")) for a in attrs])).alias("e"))
    return (stacked.select("user_id", "e.attr", "e.value").filter(F.col("value").isNotNull())
                   .groupBy("user_id", "attr", "value").agg(F.count(F.lit(1)).alias("n")))


def _mode_smallest(counts: DataFrame, attr: str, out: str, cast: str = "string") -> DataFrame:
    """Most frequent non-null value per user, smallest on ties (pandas ``mode()[0]``):
    a min over (-count, value) of the pre-aggregated counts."""
    c = counts.filter(F.col("attr") == attr)
    v = F.col("value").cast(cast)
    best = F.min(F.struct(F.negative("n").alias("k"), v.alias("v")))
    return c.groupBy("user_id").agg(best["v"].alias(out))


def _count_map(counts: DataFrame, attr: str, out: str, exclude: str | None = None) -> DataFrame:
    """value -> count per user, most first (ties by value)."""
    c = counts.filter(F.col("attr") == attr)
    if exclude is not None:
        c = c.filter(F.col("value") != exclude)
    entries = F.sort_array(F.collect_list(F.struct(F.negative("n").alias("k"), F.col("value"), F.col("n"))))
    return c.groupBy("user_id").agg(
        F.map_from_entries(F.transform(entries, lambda e: F.struct(e["value"], e["n"]))).alias(out))


def location_map(df: DataFrame) -> DataFrame:
    """Foreign location counts per user (NULL excluded), most first."""
    return _count_map(value_counts(df, ["location"]), "location", "locations", exclude=HOME_COUNTRY)


def device_map(df: DataFrame) -> DataFrame:
    """Device -> count per user, most first."""
    return _count_map(value_counts(df, ["device"]), "device", "devices")


def _pct(num: str) -> Column:
    return F.lit(100.0) * F.col(num) / F.col("events")


def risk_factors(agg: DataFrame, locations: DataFrame | None = None) -> DataFrame:
    """Fired factors per user (sorted by score, stable) and the verdict."""
    w = RISK_WEIGHTS
    cols = agg.columns
    df = agg if locations is None else agg.join(locations, "user_id", "left")
    empty_map = F.create_map().cast("map<string,bigint>")

    def factor(ordinal: int, cond: Column, name: str | Column, detail: Column, score: Column,
               severity: str | Column, locs: Column | None = None) -> Column:
        s = F.struct(
            (-score).alias("neg_score"), F.lit(ordinal).alias("ord"),
            (name if isinstance(name, Column) else F.lit(name)).alias("factor"),
            detail.alias("detail"), score.cast("int").alias("score"),
            (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
            (locs if locs is not None else F.lit(None).cast("map<string,bigint>")).alias("locations"))
        return F.when(cond, s)

    fs: list[Column] = []
    contrib: list[Column] = []
    if "night_count" in cols:
        night = _pct("night_count")
        c1 = night > 30
        fs.append(factor(1, c1, FACTOR_TEXT["night"][0], tmpl(FACTOR_TEXT["night"][1], fmt_int0(night)),
                         F.lit(w["night_activity"]), "HIGH"))
        contrib.append(F.when(c1, w["night_activity"]).otherwise(0))
    if "foreign_count" in cols:
        foreign = _pct("foreign_count")
        c2 = foreign > 20
        hr = F.col("high_risk_count") > 0
        locs = F.coalesce(F.col("locations"), empty_map) if locations is not None else None
        fs.append(factor(2, c2, FACTOR_TEXT["foreign"][0], tmpl(FACTOR_TEXT["foreign"][1], fmt_int0(foreign)),
                         F.lit(w["foreign_location"]) + F.when(hr, 10).otherwise(0),
                         F.when(hr, "CRITICAL").otherwise("HIGH"), locs))
        contrib.append(F.when(c2, w["foreign_location"] + F.when(hr, 10).otherwise(0)).otherwise(0))
    if "max_files" in cols:
        c3a = F.col("max_files") > 5000
        c3b = ~c3a & (F.col("max_files") > 1000)
        fs.append(factor(3, c3a, FACTOR_TEXT["files_critical"][0],
                         tmpl(FACTOR_TEXT["files_critical"][1], fmt_int0(F.col("max_files")),
                              fmt_int0(F.col("avg_files")), F.col("files_over_1000")),
                         F.lit(w["high_files"]), "CRITICAL"))
        fs.append(factor(3, c3b, FACTOR_TEXT["files_medium"][0],
                         tmpl(FACTOR_TEXT["files_medium"][1], fmt_int0(F.col("max_files")),
                              fmt_int0(F.col("avg_files"))),
                         F.lit(w["high_files"] // 2), "MEDIUM"))
        contrib.append(F.when(c3a, w["high_files"]).when(c3b, w["high_files"] // 2).otherwise(0))
    if "unknown_count" in cols:
        unk = _pct("unknown_count")
        c4 = unk > 30
        fs.append(factor(4, c4, FACTOR_TEXT["device"][0], tmpl(FACTOR_TEXT["device"][1], fmt_int0(unk)),
                         F.lit(w["unknown_device"]), "HIGH"))
        contrib.append(F.when(c4, w["unknown_device"]).otherwise(0))
    if "attempts_over_5" in cols:
        k = F.col("attempts_over_5")
        c5 = k > 0
        pts = F.least(F.lit(w["multiple_logins"]), k * 2)
        fs.append(factor(5, c5, FACTOR_TEXT["logins"][0], tmpl(FACTOR_TEXT["logins"][1], k), pts, "MEDIUM"))
        contrib.append(F.when(c5, pts).otherwise(0))
    if "uploads_over_500" in cols:
        c6 = F.col("uploads_over_500") > 0
        fs.append(factor(6, c6, FACTOR_TEXT["upload"][0],
                         tmpl(FACTOR_TEXT["upload"][1], F.col("uploads_over_500"), fmt_int0(F.col("avg_upload"))),
                         F.lit(w["high_upload"]),
                         F.when(F.col("avg_upload") > 1000, "HIGH").otherwise("MEDIUM")))
        contrib.append(F.when(c6, w["high_upload"]).otherwise(0))
    if "foreign_ip_count" in cols:
        fip = _pct("foreign_ip_count")
        c7 = fip > 20
        fs.append(factor(7, c7, FACTOR_TEXT["foreign_ip"][0], tmpl(FACTOR_TEXT["foreign_ip"][1], fmt_int0(fip)),
                         F.lit(w["foreign_ip"]), "HIGH"))
        contrib.append(F.when(c7, w["foreign_ip"]).otherwise(0))

    raw_total = F.lit(0)
    for x in contrib:
        raw_total = raw_total + x
    def by_score(a: Column, b: Column) -> Column:  # score desc, then factor order (stable)
        return (F.when(a["neg_score"] < b["neg_score"], -1).when(a["neg_score"] > b["neg_score"], 1)
                 .when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0))

    fired = F.array_sort(F.filter(F.array(*fs), lambda x: x.isNotNull()), by_score)
    fired = F.transform(fired, lambda x: x.dropFields("neg_score", "ord"))
    t = THREAT_THRESHOLDS
    out = df.withColumn("risk_factors", fired).withColumn("total_score", F.least(F.lit(100), raw_total).cast("int"))
    s = F.col("total_score")
    level = (F.when(s >= t["CRITICAL"], "CRITICAL").when(s >= t["HIGH"], "HIGH")
             .when(s >= t["MEDIUM"], "MEDIUM").when(s >= t["LOW"], "LOW").otherwise("CLEAN"))
    out = out.withColumn("risk_level", level)
    emoji = F.element_at(F.create_map(*[F.lit(x) for k, v in VERDICT_TEXT.items() for x in (k, v[0])]),
                         F.col("risk_level"))
    action = F.element_at(F.create_map(*[F.lit(x) for k, v in VERDICT_TEXT.items() for x in (k, v[1])]),
                          F.col("risk_level"))
    return out.withColumn("emoji", emoji).withColumn("action", action)


def user_verdicts(df: DataFrame) -> DataFrame:
    """A30 input: every user's aggregates, factors and verdict."""
    locs = location_map(df) if _has(df, "location") else None
    return risk_factors(user_aggregates(df), locs)


def user_risk_ranking(df: DataFrame) -> DataFrame:
    """Users by score, highest first; ties keep the order users first
    appear in the data.  The rank is a distributed global rank."""
    v = user_verdicts(df).select("user_id", "total_score", "risk_level", "events", "first_seen")
    ranked = global_rank(v, [F.col("total_score").desc(), F.col("first_seen")], "rank")
    return ranked.select("rank", "user_id", F.col("total_score").alias("score"),
                         F.col("risk_level").alias("level"), "events")


def risk_level_members(ranking: DataFrame) -> DataFrame:
    """Users per level with the level's size.  Members stay rows (ordered by
    rank) rather than one collected list, so a huge level is never one row."""
    sizes = ranking.groupBy("level").agg(F.count(F.lit(1)).alias("level_users"))
    return ranking.join(F.broadcast(sizes), "level").select("level", "level_users", "rank", "user_id")


def risky_user_events(df: DataFrame, levels=("CRITICAL", "HIGH")) -> DataFrame:
    """Every event of users whose verdict is in ``levels`` (left-semi join;
    the users are written first, so that a user with a large part of all
    events is split among tasks)."""
    risky = write_once(user_verdicts(df).filter(F.col("risk_level").isin(list(levels))).select("user_id"), "risky")
    return df.join(risky, "user_id", "left_semi")


STAT_ATTRS = ("hour_of_day", "location", "device")


def user_statistics(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """The statistics block per user.  Peak hour, top location and
    the device map come from one stacked (user, attribute, value) count."""
    out = user_aggregates(df)
    attrs = [a for a in STAT_ATTRS if _has(df, a)]
    if not attrs:
        return out
    counts = counts if counts is not None else value_counts(df, attrs)
    if "hour_of_day" in attrs:
        out = out.join(_mode_smallest(counts, "hour_of_day", "peak_hour", "int"), "user_id", "left")
    if "location" in attrs:
        out = out.join(_mode_smallest(counts, "location", "top_location"), "user_id", "left")
    if "device" in attrs:
        out = out.join(_count_map(counts, "device", "devices"), "user_id", "left")
    return out


def user_statistics_text(stats: DataFrame) -> DataFrame:
    """Statistics as the report's ``key: value`` lines (array, in report order)."""
    cols = stats.columns
    items = [F.concat(F.lit("Total Events: "), F.col("events").cast("string"))]
    if "peak_hour" in cols:
        items.append(F.concat(F.lit("Peak Hour: "), F.coalesce(F.col("peak_hour").cast("string"), F.lit("N/A")),
                              F.lit(":00")))
        items.append(F.concat(F.lit("Night Activity: "), F.col("night_count").cast("string"), F.lit(" events ("),
                              fmt_int0(_pct("night_count")), F.lit("%)")))
    if "top_location" in cols:
        items.append(F.concat(F.lit("Locations: "), F.col("unique_locations").cast("string"),
                              F.lit(" unique (Most: "), F.coalesce(F.col("top_location"), F.lit("N/A")), F.lit(")")))
    if "avg_files" in cols:
        items.append(F.concat(F.lit("Avg Files: "), fmt_int0(F.col("avg_files"))))
        items.append(F.concat(F.lit("Max Files: "), fmt_int0(F.col("max_files"))))
    if "avg_threat_score" in cols:
        items.append(F.concat(F.lit("Avg Threat Score: "), fmt_fixed(F.col("avg_threat_score"), 2)))
        items.append(F.concat(F.lit("Max Threat Score: "), fmt_fixed(F.col("max_threat_score"), 2)))
    if "devices" in cols:
        items.append(F.concat(F.lit("Devices Used: "), py_dict_text(F.col("devices"))))
    if "avg_logins" in cols:
        items.append(F.concat(F.lit("Avg Logins: "), fmt_fixed(F.col("avg_logins"), 1)))
    if "total_upload" in cols:
        items.append(F.concat(F.lit("Total Upload: "), F.col("total_upload").cast("string"), F.lit(" MB")))
    return stats.select("user_id", F.array(*items).alias("stats_lines"))


def behaviour_patterns(stats: DataFrame) -> DataFrame:
    """Pattern lines per user."""
    cols = stats.columns
    t = PATTERN_TEXT
    pats = []
    if "night_count" in cols:
        night = _pct("night_count")
        pats.append(F.when(night > 30, tmpl(t["night_high"], fmt_int0(night)))
                    .when(night > 10, tmpl(t["night_some"], fmt_int0(night)))
                    .otherwise(F.lit(t["night_none"])))
    if "unique_locations" in cols:
        u = F.col("unique_locations")
        pats.append(F.when(u > 3, tmpl(t["mobility_high"], u)).when(u > 1, tmpl(t["mobility_some"], u))
                    .otherwise(F.lit(t["mobility_none"])))
    if "std_files" in cols:
        pats.append(F.when(F.col("std_files") > 1000, F.lit(t["files_erratic"]))
                    .otherwise(F.lit(t["files_steady"])))
    if "unknown_count" in cols:
        unk = _pct("unknown_count")
        pats.append(F.when(unk > 20, tmpl(t["device_high"], fmt_int0(unk)))
                    .when(unk > 0, tmpl(t["device_some"], fmt_int0(unk)))
                    .otherwise(F.lit(t["device_none"])))
    return stats.select("user_id", F.array(*pats).alias("patterns"))


def user_recommendations(verdicts: DataFrame) -> DataFrame:
    """Rule list from score, countries, files and devices; fallback; always
    the 24 h review."""
    s = F.col("total_score")
    cols = verdicts.columns
    r = USER_RECOMMENDATIONS
    rules = [F.when(s >= 80, F.lit(r["disable"])), F.when(s >= 80, F.lit(r["escalate"])),
             F.when(s >= 60, F.lit(r["mfa"])), F.when(s >= 60, F.lit(r["review"]))]
    if "high_risk_count" in cols:
        rules.append(F.when(F.col("high_risk_count") > 0, tmpl(r["countries"], F.col("high_risk_count"))))
    if "max_files" in cols:
        rules.append(F.when(F.col("max_files") > 5000, F.lit(r["dlp"])))
    if "unknown_count" in cols:
        rules.append(F.when(F.col("unknown_count") > 0, F.lit(r["devices"])))
    fired = F.filter(F.array(*rules), lambda x: x.isNotNull())
    fired = F.when(F.size(fired) == 0, F.array(F.lit(r["none"]))).otherwise(fired)
    return verdicts.select("user_id", F.concat(fired, F.array(F.lit(r["always"])))
                           .alias("recommendations"))


def investigation_report(df: DataFrame, user: str | None = None, source: str = "parquet",
                         generated: Column | None = None) -> DataFrame:
    """The investigation report as ordered text lines per user
    (``user_id, line_no, line``).  ``user`` restricts to one user; the filter
    is pushed into the scan.  ``generated`` is the report's time (now if not
    given)."""
    stamp = F.date_format(F.current_timestamp() if generated is None else generated, "yyyy-MM-dd HH:mm:ss")
    if user is not None:
        df = df.filter(F.col("user_id") == F.lit(user))
    attrs = [a for a in STAT_ATTRS if _has(df, a)]
    counts = value_counts(df, attrs) if attrs else None
    stats = user_statistics(df, counts)
    locs = _count_map(counts, "location", "locations", exclude=HOME_COUNTRY) if "location" in attrs else None
    verdict = risk_factors(stats, locs)
    joined = (verdict.join(user_statistics_text(stats), "user_id")
                     .join(behaviour_patterns(stats), "user_id")
                     .join(user_recommendations(verdict), "user_id"))
    bar, thin = "=" * 70, "-" * 70
    rt = REPORT_TEXT
    sev = F.create_map(*[F.lit(x) for k in ["CRITICAL", "HIGH", "MEDIUM", "LOW"] for x in (k, SEVERITY_EMOJI[k])])

    def factor_lines(i, f):
        head = F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". ["), F.rpad(f["severity"], 8, " "),
                        F.lit("] "), F.coalesce(F.element_at(sev, f["severity"]), F.lit("⚪")), F.lit(" "),
                        f["factor"])
        lines = F.array(head, F.concat(F.lit("     "), f["detail"]),
                        F.concat(F.lit("     Risk Contribution: +"), f["score"].cast("string")))
        with_locs = F.concat(lines, F.array(F.concat(F.lit("     Locations: "), py_dict_text(f["locations"]))))
        return F.concat(F.when(f["locations"].isNotNull(), with_locs).otherwise(lines), F.array(F.lit("")))

    factors = F.flatten(F.transform(F.col("risk_factors"), lambda f, i: factor_lines(i, f)))
    factors = F.when(F.size("risk_factors") > 0,
                     F.concat(F.array(F.lit(thin), F.lit(rt["factors"]), F.lit(thin)), factors)) \
               .otherwise(F.array(F.lit(rt["no_factors"]), F.lit("")))
    header = F.array(
        F.lit(bar), F.lit(rt["title"]), F.lit(bar),
        tmpl(rt["generated"], stamp), tmpl(rt["user"], F.col("user_id")), tmpl(rt["source"], F.lit(source)),
        tmpl(rt["records"], F.col("events")), F.lit(""),
        F.lit(bar), tmpl(rt["verdict"], F.col("emoji"), F.col("risk_level")), F.lit(bar),
        tmpl(rt["score"], F.col("total_score")), tmpl(rt["action"], F.col("action")), F.lit(""))
    stats_block = F.concat(F.array(F.lit(thin), F.lit(rt["stats"]), F.lit(thin)),
                           F.transform("stats_lines", lambda x: F.concat(F.lit("  "), x)), F.array(F.lit("")))
    pat_block = F.concat(F.array(F.lit(thin), F.lit(rt["patterns"]), F.lit(thin)),
                         F.transform("patterns", lambda x: F.concat(F.lit("  "), x)), F.array(F.lit("")))
    rec_block = F.concat(F.array(F.lit(thin), F.lit(rt["recommendations"]), F.lit(thin)),
                         F.transform("recommendations",
                                     lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x)),
                         F.array(F.lit(""), F.lit(bar), F.lit(rt["complete"]), F.lit(bar)))
    lines = F.concat(header, factors, stats_block, pat_block, rec_block)
    return joined.select("user_id", F.posexplode(lines).alias("line_no", "line"))
