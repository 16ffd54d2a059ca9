"""Column names and types of the tables that the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "record_id"
TIME = "timestamp"

RAW_NUMERIC = [
    "packet_size",
    "inter_arrival_ms",
    "request_rate",
    "latency_ms",
    "jitter_ms",
    "duplicate_ratio",
    "value_deviation",
]
CATEGORICAL = ["mms_service", "src_asset", "dst_asset"]
META = [TIME, "label", "attack_type"]
ENGINEERED = ["rolling_request_rate_mean", "rolling_latency_std", "packet_size_zscore"]
FEATURES = RAW_NUMERIC + ENGINEERED


def _fields(names: list[str], kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names]


# What a client submits: no key, no labels, the time still text.
SUBMITTED = T.StructType(
    _fields([TIME], T.StringType()) + _fields(RAW_NUMERIC, T.DoubleType()) + _fields(CATEGORICAL, T.StringType())
)

TRAFFIC = T.StructType(
    _fields([KEY], T.LongType())
    + _fields([TIME], T.TimestampType())
    + _fields(RAW_NUMERIC, T.DoubleType())
    + _fields(CATEGORICAL, T.StringType())
    + _fields(["label", "attack_type"], T.StringType())
)

# Parsed replies; a field missing from the reply is null.
SUMMARY_REPLY = T.StructType(_fields(["summary"], T.StringType()))
CAUSE_REPLY = T.StructType(
    [
        T.StructField("likely_cause", T.StringType()),
        T.StructField("supporting_evidence", T.ArrayType(T.StringType())),
        T.StructField("confidence", T.DoubleType()),
    ]
)
RISK_REPLY = T.StructType(
    _fields(["asset_criticality", "operational_impact", "attack_severity"], T.StringType())
    + _fields(["business_risk_score"], T.DoubleType())
)
ACTIONS_REPLY = T.StructType([T.StructField("recommended_actions", T.ArrayType(T.StringType()))])
