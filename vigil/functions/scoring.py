"""Column expressions for scores, flags and levels.

All functions return ``Column`` objects so they compile into whole-stage
codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------
HOME_COUNTRY = "Pakistan"
DETECTOR_DOMESTIC = ["Pakistan", "UAE"]
DETECTOR_UNKNOWN_DEVICES = ["unknown", "server", "tor-node"]
HIGH_RISK_COUNTRIES = ["Russia", "China", "North Korea", "Iran"]
# live detector defaults for missing fields
DETECTOR_DEFAULTS = {"files_accessed": 0, "login_attempts": 1, "location": "Pakistan",
                     "device": "laptop", "data_mb": 0}
# ensemble / API defaults for missing model features
FEATURE_DEFAULTS = {"hour_of_day": 0, "files_accessed": 0, "login_attempts": 1,
                    "foreign_ip": 0, "unknown_device": 0, "data_uploaded_mb": 0}
# five additive detector rules: (points, condition) in the order they are summed
RULE_POINTS = {"foreign_ip": 0.3, "unknown_device": 0.2, "files": 0.3,
               "attempts": 0.2, "odd_hour": 0.1}
RULE_FILES_OVER = 1000
RULE_ATTEMPTS_OVER = 5
RULE_ALERT_OVER = 0.7
# ensemble weights and cut-offs; API cut-offs differ
ENSEMBLE_WEIGHTS = {"boosted": 0.6, "forest": 0.4}
ENSEMBLE_CUTS = (0.3, 0.1)
API_CUTS = (0.7, 0.4)
AGREEMENT_GAP = 0.2


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def detector_foreign_ip(location="location") -> Column:
    """1 when the (defaulted) location is outside the detector's home list."""
    loc = F.coalesce(c(location), F.lit(DETECTOR_DEFAULTS["location"]))
    return F.when(loc.isin(DETECTOR_DOMESTIC), F.lit(0)).otherwise(F.lit(1))


def detector_unknown_device(device="device") -> Column:
    dev = F.coalesce(c(device), F.lit(DETECTOR_DEFAULTS["device"]))
    return F.when(dev.isin(DETECTOR_UNKNOWN_DEVICES), F.lit(1)).otherwise(F.lit(0))


def odd_hour(hour="hour_of_day") -> Column:
    """Detector / report notion of night: before 06:00 or after 22:00."""
    h = c(hour)
    return (h < 6) | (h > 22)


def night_hour(hour="hour_of_day") -> Column:
    """Hunting / investigation notion of night: 00:00-05:59."""
    return c(hour).between(0, 5)


def rule_score(hour="hour_of_day", files="files_accessed", attempts="login_attempts",
               foreign="foreign_ip", unknown="unknown_device") -> Column:
    """Five additive rules as DOUBLE, summed left to right in the reference order."""
    terms = [
        (c(foreign) == 1, RULE_POINTS["foreign_ip"]),
        (c(unknown) == 1, RULE_POINTS["unknown_device"]),
        (c(files) > RULE_FILES_OVER, RULE_POINTS["files"]),
        (c(attempts) > RULE_ATTEMPTS_OVER, RULE_POINTS["attempts"]),
        (odd_hour(hour), RULE_POINTS["odd_hour"]),
    ]
    total = F.lit(0.0)
    for cond, pts in terms:
        total = total + F.when(cond, F.lit(pts)).otherwise(F.lit(0.0))
    return total


def detector_score(df_cols_prefix: str = "") -> Column:
    """Rule score from raw log fields, with the detector's own flag derivation."""
    p = df_cols_prefix
    return rule_score(hour=f"{p}hour_of_day",
                      files=F.coalesce(F.col(f"{p}files_accessed"), F.lit(0)),
                      attempts=F.coalesce(F.col(f"{p}login_attempts"), F.lit(1)),
                      foreign=detector_foreign_ip(f"{p}location"),
                      unknown=detector_unknown_device(f"{p}device"))


def risk_level(score, hi: float, mid: float) -> Column:
    """HIGH / MEDIUM / LOW with strict cut-offs."""
    s = c(score)
    return F.when(s > hi, "HIGH").when(s > mid, "MEDIUM").otherwise("LOW")


def risk_action(score, hi: float, mid: float) -> Column:
    s = c(score)
    return F.when(s > hi, "BLOCK").when(s > mid, "MONITOR").otherwise("ALLOW")


def risk_emoji(score, hi: float, mid: float) -> Column:
    s = c(score)
    return F.when(s > hi, "🚨").when(s > mid, "⚠️").otherwise("✅")


def trend_label(threats) -> Column:
    """Forecast trend label for a predicted daily count."""
    t = c(threats)
    return F.when(t > 20, "🔺 High").when(t < 12, "🔻 Normal").otherwise("➡️ Moderate")


def safe_pct(num, den) -> Column:
    """100 * num / max(1, den) as DOUBLE."""
    return F.lit(100.0) * c(num) / F.greatest(F.lit(1), c(den))


# Fixed value: dotted-quad IPv4 pattern (each octet 0-255).
IPV4_PATTERN = r"^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"


def is_ipv4(col="ip_address") -> Column:
    """The index maps ``ip_address`` as an IP; text must be a dotted quad."""
    return c(col).rlike(IPV4_PATTERN)
