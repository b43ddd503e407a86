"""Typed schemas for the security-log domain."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw activity event as it arrives on the wire (JSON text, ISO timestamps).
RAW_EVENT = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("ip_address", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("files_accessed", T.IntegerType()),
    T.StructField("location", T.StringType()),
    T.StructField("device", T.StringType()),
    T.StructField("success", T.BooleanType()),
    # optional live fields
    T.StructField("login_attempts", T.IntegerType()),
    T.StructField("data_mb", T.IntegerType()),
    T.StructField("data_uploaded_mb", T.IntegerType()),
    T.StructField("foreign_ip", T.IntegerType()),
    T.StructField("test", T.BooleanType()),
])

# Canonical typed log row (what every batch operator consumes).
SECURITY_LOG = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("files_accessed", T.IntegerType()),
    T.StructField("location", T.StringType()),
    T.StructField("device", T.StringType()),
    T.StructField("hour_of_day", T.IntegerType()),
    T.StructField("login_attempts", T.IntegerType()),
    T.StructField("foreign_ip", T.IntegerType()),
    T.StructField("unknown_device", T.IntegerType()),
    T.StructField("data_uploaded_mb", T.IntegerType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("is_threat", T.IntegerType()),
])

# The six model features, fixed order.
FEATURES = ["hour_of_day", "files_accessed", "login_attempts",
            "foreign_ip", "unknown_device", "data_uploaded_mb"]

# Labelled data sets (CSV): clean = raw event + features + label, noisy = features + label.
LABELLED_NOISY = T.StructType([T.StructField(c, T.IntegerType()) for c in FEATURES]
                              + [T.StructField("is_threat", T.IntegerType())])
LABELLED_CLEAN = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("ip_address", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("files_accessed", T.IntegerType()),
    T.StructField("location", T.StringType()),
    T.StructField("device", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("hour_of_day", T.IntegerType()),
    T.StructField("login_attempts", T.IntegerType()),
    T.StructField("foreign_ip", T.IntegerType()),
    T.StructField("unknown_device", T.IntegerType()),
    T.StructField("data_uploaded_mb", T.IntegerType()),
    T.StructField("is_threat", T.IntegerType()),
])

# One alert shape for all producers (detector, behavioural, ensemble).
CANONICAL_ALERT = T.StructType([
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("alert_type", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("raw_score", T.DoubleType()),
    T.StructField("model", T.StringType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("reasons", T.ArrayType(T.StringType())),
    T.StructField("source", T.StringType()),
    T.StructField("seq", T.LongType()),
])
