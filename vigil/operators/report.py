"""Threat report (A37) as ordered text lines, plus its JSON statistics.

Every section is a small aggregate of the canonical alert frame (top-k,
24 hours, one row per type/model); the report is their union keyed by
``(section, pos)``, so nothing is gathered on the driver.  ``report_type``
(daily/weekly/monthly) is only a label, as in the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.text import bar, ljust, rjust, tmpl
from vigil.functions.scoring import odd_hour
from vigil.operators import alerts as A
from vigil.plans.ordered_scan import global_rank
from vigil.session import write_once

W68 = 68

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results:
# section title rows and the row layouts ({} = value).
# ---------------------------------------------------------------------------
TITLE_ROWS = {
    "summary": "│" + " " * 22 + "EXECUTIVE SUMMARY" + " " * 27 + "│",
    "breakdown": "│" + " " * 21 + "THREAT BREAKDOWN" + " " * 29 + "│",
    "top": "│" + " " * 23 + "TOP THREATS" + " " * 33 + "│",
    "hourly": "│" + " " * 20 + "HOURLY DISTRIBUTION" + " " * 28 + "│",
    "engines": "│" + " " * 20 + "DETECTION ENGINES" + " " * 29 + "│",
    "actions": "│" + " " * 20 + "RECOMMENDED ACTIONS" + " " * 28 + "│",
}
HEADER_ROWS = [
    "║" + " " * 15 + "CYBERSECURITY THREAT REPORT" + " " * 23 + "║",
    "║" + " " * 18 + "{} ANALYSIS" + " " * 28 + "║",
    "║  Generated: {}" + " " * 23 + "║",
    "║  Report Type: {} Threat Report" + " " * 23 + "║",
    "║  Classification: CONFIDENTIAL" + " " * 37 + "║",
]
SUMMARY_ROWS = [
    "│  Total Alerts (24h):     {}" + " " * 25 + "│",
    "│  High Risk Users:        {}" + " " * 25 + "│",
    "│  Threats Blocked:        {}" + " " * 25 + "│",
    "│  Overall Risk Level:     {} │",
]
BREAKDOWN_TYPE_HEAD = "│  📊 By Alert Type:" + " " * 49 + "│"
BREAKDOWN_TYPE_ROW = "│    {} {} {} │"
BREAKDOWN_LOC_HEAD = "│  🌍 By Location:" + " " * 51 + "│"
BREAKDOWN_LOC_ROW = "│    {} {}" + " " * 16 + "│"
TOP_ROW = "│  {}. {} {} {} alerts          │"
HOUR_ROW = "│  {}:00 {} {}{} │"
NIGHT_MARK = " 🌙"
ENGINE_ROW = "│  🤖 {} {} detections     │"
ACTION_ROW = "│  {}. {} │"
FOOTER_ROWS = [
    "║" + " " * 10 + "Report generated by AI Cybersecurity Platform" + " " * 9 + "║",
    "║" + " " * 15 + "© {} - All Rights Reserved" + " " * 19 + "║",
]


def _lit_lines(spark, section: int, lines: list) -> DataFrame:
    arr = F.array(*[x if isinstance(x, Column) else F.lit(x) for x in lines])
    return (spark.range(1).select(F.posexplode(arr).alias("pos", "line"))
                 .select(F.lit(section).alias("section"), "pos", "line"))


def _box(section: str) -> list[str]:
    return ["┌" + "─" * W68 + "┐", TITLE_ROWS[section], "├" + "─" * W68 + "┤"]


_BOX_END = "└" + "─" * W68 + "┘"


def threat_report(al: DataFrame, report_type: str = "daily", generated: Column | None = None) -> DataFrame:
    """Report lines ``(section, pos, line)``; order by both to read it."""
    spark = al.sparkSession
    # every counter comes from one GROUPING SETS pass, written once
    r = write_once(A.alert_rollups(al), "rollups")
    gen = generated if generated is not None else \
        r.filter(F.col("dim") == "total").select(F.max("max_ts")).scalar()
    gen = F.coalesce(gen, F.localtimestamp())  # no alerts: the report's own time
    gen_text = F.date_format(gen, "yyyy-MM-dd HH:mm:ss")
    year = F.year(gen).cast("string")
    rt = report_type
    parts = []

    # 1. header
    h = HEADER_ROWS
    parts.append(_lit_lines(spark, 1, [
        "╔" + "═" * W68 + "╗", h[0], h[1].format(rt.upper()), "╠" + "═" * W68 + "╣",
        tmpl(h[2], gen_text), h[3].format(rt.capitalize()), h[4], "╚" + "═" * W68 + "╝", ""]))

    # 2. executive summary
    summ = A.summary_from_rollups(r)
    sr = SUMMARY_ROWS
    s_lines = F.array(
        *[F.lit(x) for x in _box("summary")],
        tmpl(sr[0], rjust(F.col("total_alerts"), 6)), tmpl(sr[1], rjust(F.col("high_risk_users"), 6)),
        tmpl(sr[2], rjust(F.col("threats_blocked"), 6)), tmpl(sr[3], ljust(F.col("risk_level"), 30)),
        F.lit(_BOX_END), F.lit(""))
    parts.append(summ.select(F.lit(2).alias("section"), F.posexplode(s_lines).alias("pos", "line")))

    # 3. breakdown by type (top 5, bars relative to the largest) and foreign locations (top 3)
    by_type = A.rollup_dim(r, "alert_type")
    mx = by_type.select(F.max("count")).scalar()
    by_count = [F.col("count").desc(), F.col("first_seq")]
    ranked = F.row_number().over(Window.orderBy(*by_count))  # only ever over a handful of rows
    types = by_type.orderBy(*by_count).limit(5).withColumn("rk", ranked)
    blen = F.least(F.lit(30), F.floor(F.col("count") * 30 / F.greatest(F.lit(1), mx)))
    type_lines = types.select(F.lit(3).alias("section"), (F.col("rk") + 1).alias("pos"),
                              tmpl(BREAKDOWN_TYPE_ROW, ljust(F.col("alert_type"), 30), rjust(F.col("count"), 4),
                                   bar(blen)).alias("line"))
    parts.append(_lit_lines(spark, 3, [*_box("breakdown"), BREAKDOWN_TYPE_HEAD]).withColumn(
        "pos", F.col("pos") - 10))
    parts.append(type_lines)
    by_loc = A.rollup_dim(r, "location").filter(F.col("location") != "Pakistan")
    locs = by_loc.orderBy(*by_count).limit(3).withColumn("rk", ranked)
    parts.append(_lit_lines(spark, 4, ["│" + " " * W68 + "│", BREAKDOWN_LOC_HEAD])
                 .withColumn("pos", F.col("pos") - 10))
    parts.append(locs.select(F.lit(4).alias("section"), F.col("rk").alias("pos"),
                             tmpl(BREAKDOWN_LOC_ROW, ljust(F.col("location"), 30), rjust(F.col("count"), 4))
                             .alias("line")))
    parts.append(_lit_lines(spark, 5, [_BOX_END, ""]))

    # 4. top threats
    users = A.rollup_dim(r, "user_id")
    top = users.orderBy(*by_count).limit(5).withColumn(
        "severity", F.when(F.col("count") > 10, "🔴").when(F.col("count") > 5, "🟠").otherwise("🟡"))
    top = top.withColumn("rk", ranked)
    parts.append(_lit_lines(spark, 6, _box("top")).withColumn("pos", F.col("pos") - 10))
    parts.append(top.select(F.lit(6).alias("section"), F.col("rk").alias("pos"),
                            tmpl(TOP_ROW, rjust(F.col("rk"), 2), F.col("severity"), ljust(F.col("user_id"), 25),
                                 rjust(F.col("count"), 4)).alias("line")))
    parts.append(_lit_lines(spark, 7, [_BOX_END, ""]))

    # 5. hourly distribution (24 rows), bars relative to the busiest hour
    per_hour = A.rollup_dim(r, "hour").filter(F.col("hour").isNotNull()) \
        .select(F.col("hour").cast("int").alias("hour"), F.col("count").alias("n"))
    hours = (spark.range(24).select(F.col("id").cast("int").alias("hour"))
                  .join(F.broadcast(per_hour), "hour", "left")            # at most 24 rows
                  .select("hour", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("count"),
                          odd_hour(F.col("hour")).alias("night")))
    hmax = hours.select(F.max("count")).scalar()
    h = hours
    hlen = F.when(hmax > 0, F.floor(F.col("count") * 40 / hmax)).otherwise(0)
    parts.append(_lit_lines(spark, 8, _box("hourly")).withColumn("pos", F.col("pos") - 10))
    parts.append(h.select(F.lit(8).alias("section"), F.col("hour").alias("pos"),
                          tmpl(HOUR_ROW, F.lpad(F.col("hour").cast("string"), 2, "0"), ljust(bar(hlen), 40),
                               rjust(F.col("count"), 4),
                               F.when(F.col("night"), F.lit(NIGHT_MARK)).otherwise(F.lit(""))).alias("line")))
    parts.append(_lit_lines(spark, 9, [_BOX_END, ""]))

    # 6. detection engines, first-seen order
    models = A.rollup_dim(r, "model")
    models = global_rank(models, ["first_seq"], "pos")
    parts.append(_lit_lines(spark, 10, _box("engines")).withColumn("pos", F.col("pos") - 10))
    parts.append(models.select(F.lit(10).alias("section"), "pos",
                               tmpl(ENGINE_ROW, ljust(F.col("model"), 30), rjust(F.col("count"), 4)).alias("line")))
    parts.append(_lit_lines(spark, 11, [_BOX_END, ""]))

    # 7. recommendations
    recs = A.report_recommendations(summ)
    parts.append(_lit_lines(spark, 12, _box("actions")).withColumn("pos", F.col("pos") - 10))
    parts.append(recs.select(F.lit(12).alias("section"), F.col("pos"),
                             tmpl(ACTION_ROW, F.col("pos"), ljust(F.col("recommendation"), 60)).alias("line")))
    parts.append(_lit_lines(spark, 13, [_BOX_END, ""]))

    # 8. footer
    parts.append(_lit_lines(spark, 14, ["╔" + "═" * W68 + "╗", FOOTER_ROWS[0], tmpl(FOOTER_ROWS[1], year),
                                        "╚" + "═" * W68 + "╝"]))

    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select("section", F.col("pos").cast("int").alias("pos"), "line"))
    # without alerts there are no hourly, engine, type and location sections
    total = summ.select(F.max("total_alerts")).scalar()
    typed = (F.col("section") == 3) & (F.col("line") == BREAKDOWN_TYPE_HEAD) | \
        (F.col("section") == 4) & (F.col("line") == BREAKDOWN_LOC_HEAD)
    return out.filter((F.coalesce(total, F.lit(0)) > 0) | ~(F.col("section").between(8, 11) | typed)) \
        .select("section", F.col("pos").cast("int").alias("pos"), "line")


def report_statistics(al: DataFrame) -> DataFrame:
    """S17 content: the report's counters as one JSON-able row, from one
    GROUPING SETS pass.  Count maps by type, location, engine and hour are
    bounded by those domains; per-user counts and the timeline are unbounded,
    so they stay frames of their own (``alerts_by(al, 'user_id')``,
    ``alert_timeline``); only the top five users enter the row."""
    r = write_once(A.alert_rollups(al), "rollups")
    summ = A.summary_from_rollups(r)

    def count_map(dim: str) -> Column:
        d = A.rollup_dim(r, dim, "k").filter(F.col("k").isNotNull())
        entries = F.transform(F.array_sort(F.collect_list(F.struct("first_seq", "k", "count"))),
                              lambda e: F.struct(e["k"], e["count"]))
        return d.select(F.map_from_entries(entries)).scalar()

    hours = A.rollup_dim(r, "hour", "k").filter(F.col("k").isNotNull())
    by_hour = hours.select(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(F.col("k").cast("int").alias("hour"), "count"))))).scalar()
    top5 = A.rollup_dim(r, "user_id").orderBy(F.col("count").desc(), "first_seq").limit(5)
    top = top5.select(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), "first_seq", "user_id", "count"))),
        lambda e: F.struct(e["user_id"].alias("user"), e["count"].alias("count")))).scalar()
    return summ.select("*", count_map("alert_type").alias("threats_by_type"),
                       count_map("location").alias("threats_by_location"),
                       by_hour.alias("threats_by_hour"), top.alias("top_threats"),
                       count_map("model").alias("model_stats"))
