"""Daily threat counts and the seven-day linear forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.scoring import trend_label


def daily_counts(events: DataFrame, ts: str = "timestamp") -> DataFrame:
    """One row per calendar day from the first to the last event, days
    without events count 0.  The spine is an exploded ``sequence`` of the
    (min, max) dates — one row per day, independent of the data volume."""
    per_day = events.groupBy(F.to_date(ts).alias("date")).agg(F.count(F.lit(1)).alias("threats"))
    bounds = per_day.agg(F.min("date").alias("d0"), F.max("date").alias("d1"))
    spine = bounds.select(F.explode(F.sequence("d0", "d1", F.expr("INTERVAL 1 DAY"))).alias("date"))
    return (spine.join(per_day, "date", "left")
                 .select("date", F.coalesce(F.col("threats"), F.lit(0)).cast("long").alias("threats")))


def last_n_days(daily: DataFrame, n: int = 30) -> DataFrame:
    """The most recent ``n`` days, numbered 1..n (oldest first)."""
    last = daily.select(F.max("date")).scalar()
    recent = daily.filter(F.col("date") > F.date_sub(last, n))
    first = recent.select(F.min("date")).scalar()
    return recent.withColumn("day", (F.datediff("date", first) + 1).cast("int"))


def forecast(history: DataFrame, days: int = 7) -> DataFrame:
    """Least-squares line of threats on day, extended ``days`` days past
    the history; predictions truncated to int and floored at 0."""
    fit = history.agg(F.regr_slope("threats", "day").alias("slope"),
                      F.regr_intercept("threats", "day").alias("intercept"),
                      F.count(F.lit(1)).alias("n"))
    out = fit.select("slope", "intercept",
                     F.explode(F.sequence(F.lit(1), F.lit(days))).alias("i"), "n")
    pred = F.col("intercept") + F.col("slope") * (F.col("n") + F.col("i")).cast("double")
    out = out.select(F.concat(F.lit("Day "), F.col("i").cast("string")).alias("day"),
                     F.col("i").cast("int").alias("step"),
                     F.round(pred, 6).alias("predicted"),
                     F.greatest(F.lit(0), pred.cast("int")).alias("threats"))
    return out.withColumn("trend", trend_label("threats"))
