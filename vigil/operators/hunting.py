"""Batch summaries and hunting queries over ``security_logs``.

Each function is one logical plan: scan → (pushed) filter → partial/final
aggregate → top-k.  Aggregates are algebraic, so a hot user or location is
combined map-side before the shuffle; top-k compiles to TakeOrderedAndProject.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.scoring import HOME_COUNTRY, HIGH_RISK_COUNTRIES, night_hour


# --------------------------------------------------------------------- predicates
def has_column(df: DataFrame, name: str) -> bool:
    """Analyses only run when their column exists (decided at plan time)."""
    return name in df.columns


def when_column(df: DataFrame, name: str, analysis: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """The analysis, or None without its column."""
    return analysis(df) if has_column(df, name) else None


def one_per_class(df: DataFrame, label: str, order: str = "event_id") -> DataFrame:
    """O3: the first row of each class (a minimum, no sort of the rows)."""
    rest = [c for c in df.columns if c not in (label, order)]
    return df.groupBy(label).agg(F.min_by(F.struct(order, *rest), order).alias("r")).select("r.*", label)


def foreign_strict(df: DataFrame, home: str = HOME_COUNTRY) -> DataFrame:
    """``location != home``; rows without a location are dropped."""
    return df.filter(F.col("location") != F.lit(home))


def foreign_nullsafe(df: DataFrame, home: str = HOME_COUNTRY) -> DataFrame:
    """Not home, rows without a location kept."""
    return df.filter(~F.col("location").eqNullSafe(F.lit(home)))


def score_above(df: DataFrame, t: float, inclusive: bool = False, col: str = "threat_score") -> DataFrame:
    """P5."""
    return df.filter(F.col(col) >= t if inclusive else F.col(col) > t)


def night_events(df: DataFrame) -> DataFrame:
    """Hour 0..5.  ``hour_of_day`` is a plain column, so the range is pushed to the scan."""
    return df.filter(night_hour("hour_of_day"))


def high_risk_country(df: DataFrame) -> DataFrame:
    """P7."""
    return df.filter(F.col("location").isin(HIGH_RISK_COUNTRIES))


def events_of_user(df: DataFrame, user: str) -> DataFrame:
    """P8."""
    return df.filter(F.col("user_id") == F.lit(user))


def user_deep_dive(df: DataFrame, user: str, t: float = 0.5, n: int = 20) -> DataFrame:
    """One user's rows with score >= t, highest first, five columns."""
    return (df.filter((F.col("user_id") == F.lit(user)) & (F.col("threat_score") >= t))
              .orderBy(F.col("threat_score").desc(), F.col("event_id"))
              .limit(n)
              .select("event_id", "timestamp", "location", "device", "files_accessed", "threat_score"))


def recent(df: DataFrame, hours: int = 24, as_of: Column | None = None, ts: str = "timestamp") -> DataFrame:
    """P10: ``ts >= as_of - hours``.  ``as_of`` defaults to the newest event
    (a scalar subquery Catalyst evaluates once), so results are reproducible."""
    if as_of is None:
        as_of = df.select(F.max(ts)).scalar()
    return df.filter(F.col(ts) >= as_of - F.make_interval(hours=F.lit(hours)))


def threat_rows(df: DataFrame, default_score: float = 0.7) -> DataFrame:
    """Score > 0.5 if a score exists, else ``is_threat = 1``; a default
    score fills missing values.  The branch is chosen at plan time."""
    if has_column(df, "threat_score"):
        out = df.filter(F.col("threat_score") > 0.5)
        return out.withColumn("threat_score", F.coalesce("threat_score", F.lit(default_score)))
    if has_column(df, "is_threat"):
        return df.filter(F.col("is_threat") == 1).withColumn("threat_score", F.lit(default_score))
    return df.limit(0).withColumn("threat_score", F.lit(default_score))


def read_index_query(df: DataFrame, min_score: float = 0.5, hours: int = 24,
                     size: int | None = None) -> DataFrame:
    """Filtered (pushed to the scan), sorted 'index' query; ``size`` caps
    the rows if the caller asks for it."""
    out = recent(df.filter(F.col("threat_score") >= min_score), hours)
    out = out.orderBy(F.col("threat_score").desc_nulls_last(), F.col("event_id"))
    return out if size is None else out.limit(size)


def profile(df: DataFrame, n: int = 5) -> tuple[int, str, DataFrame]:
    """Record count, schema and the first ``n`` rows in a stable order."""
    return df.count(), df.schema.simpleString(), df.orderBy("event_id").limit(n)


# --------------------------------------------------------------------- summaries
def user_activity_summary(df: DataFrame, n: int = 10) -> DataFrame:
    """A1: per user count and avg/max/min files, busiest first."""
    return (df.groupBy("user_id")
              .agg(F.count(F.lit(1)).alias("total_actions"),
                   F.avg("files_accessed").alias("avg_files"),
                   F.max("files_accessed").alias("max_files"),
                   F.min("files_accessed").alias("min_files"))
              .orderBy(F.col("total_actions").desc(), F.col("user_id"))
              .limit(n))


def suspicious_location_counts(df: DataFrame) -> DataFrame:
    """A2: strict-foreign rows per (user, location), most first."""
    return (foreign_strict(df).groupBy("user_id", "location")
            .agg(F.count(F.lit(1)).alias("access_count"))
            .orderBy(F.col("access_count").desc(), "user_id", "location"))


def high_score_activities(df: DataFrame, t: float = 0.5, n: int = 10) -> DataFrame:
    """A3: rows with score above ``t``, highest first."""
    return (df.filter(F.col("threat_score") > t)
              .select("event_id", "user_id", "action", "threat_score")
              .orderBy(F.col("threat_score").desc(), "event_id")
              .limit(n))


def action_distribution(df: DataFrame) -> DataFrame:
    """A4."""
    return (df.groupBy("action").agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.col("count").desc(), "action"))


def device_usage(df: DataFrame) -> DataFrame:
    """A5."""
    return (df.groupBy("device")
              .agg(F.count(F.lit(1)).alias("usage_count"), F.avg("files_accessed").alias("avg_files"))
              .orderBy(F.col("usage_count").desc(), "device"))


def night_activity_by_user(df: DataFrame) -> DataFrame:
    """Night events per user."""
    return (night_events(df).groupBy("user_id").agg(F.count(F.lit(1)).alias("night_events"))
            .orderBy(F.col("night_events").desc(), "user_id"))


def top_foreign_locations(df: DataFrame, n: int = 10) -> DataFrame:
    """Value counts of location among null-safe foreign rows (NULL not counted)."""
    return (foreign_nullsafe(df).filter(F.col("location").isNotNull())
            .groupBy("location").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), "location").limit(n))


def score_histogram(df: DataFrame, col: str = "threat_score", bins: int = 30,
                    by: str | None = None) -> DataFrame:
    """Equal-width histogram from min to max, last bin closed on the
    right (the numpy rule, including its edge corrections).  With ``by`` (a
    class label) each group gets its own range, as separate plots would.

    Bounds are one partial aggregate per group, held as one map in a scalar
    subquery (a group is a class label, so there are few): the rows are neither
    joined nor shuffled on the label.  Bin counts are a partial aggregate; an
    exploded ``sequence`` gives empty bins.
    """
    x = F.col(col).cast("double")
    g = F.col(by) if by else F.lit(0)
    vals = df.select(g.alias("_g"), x.alias("_x")).filter(F.col("_x").isNotNull())
    bounds = vals.groupBy("_g").agg(F.min("_x").alias("_lo0"), F.max("_x").alias("_hi0"))
    same = F.col("_lo0") == F.col("_hi0")
    bounds = bounds.select(
        "_g",
        F.when(same, F.col("_lo0") - 0.5).otherwise(F.col("_lo0")).alias("_lo"),
        F.when(same, F.col("_hi0") + 0.5).otherwise(F.col("_hi0")).alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    norm = F.lit(float(bins)) / (F.col("_hi") - F.col("_lo"))

    def edge(i: Column) -> Column:
        return F.when(i >= bins, F.col("_hi")).otherwise(i.cast("double") * step + F.col("_lo"))

    ranges = bounds.select(F.map_from_entries(F.collect_list(F.struct("_g", F.struct("_lo", "_hi"))))).scalar()
    vals = vals.withColumn("_r", F.element_at(ranges, F.col("_g"))) \
        .select("_g", "_x", F.col("_r._lo").alias("_lo"), F.col("_r._hi").alias("_hi"))
    i = F.least(F.floor((F.col("_x") - F.col("_lo")) * norm).cast("int"), F.lit(bins - 1))
    vals = vals.withColumn("_i", i)
    vals = vals.withColumn("_i", F.when(F.col("_x") < edge(F.col("_i")), F.col("_i") - 1)
                           .otherwise(F.col("_i")))
    vals = vals.withColumn("_i", F.when((F.col("_x") >= edge(F.col("_i") + 1)) & (F.col("_i") != bins - 1),
                                        F.col("_i") + 1).otherwise(F.col("_i")))
    counts = vals.groupBy("_g", "_i").agg(F.count(F.lit(1)).alias("n"))
    spine = bounds.select("_g", "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("_i"))
    out = spine.join(counts, ["_g", "_i"], "left")
    keys = [F.col("_g").alias(by)] if by else []
    return out.select(
        *keys,
        F.col("_i").alias("bin"),
        F.round(edge(F.col("_i")), 6).alias("bin_lo"),
        F.round(edge(F.col("_i") + 1), 6).alias("bin_hi"),
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"),
    ).orderBy(*([by] if by else []), "bin")


def distinct_users(df: DataFrame) -> DataFrame:
    """O6."""
    return df.select("user_id").distinct()
