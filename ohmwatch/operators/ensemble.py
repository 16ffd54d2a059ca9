"""Combining two detectors into one verdict, and selecting from the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ohmwatch.schema import KEY, TIME

# Fixed values of the default configuration.
STRATEGY = "union"
SCORE_THRESHOLD = 0.5


def add_verdict(
    df: DataFrame,
    strategy: str = STRATEGY,
    threshold: float = SCORE_THRESHOLD,
    first: str = "if",
    second: str = "lof",
) -> DataFrame:
    """``ensemble_score`` and ``is_anomaly`` from ``<name>_score`` and ``<name>_is_anomaly`` of both detectors."""
    score = (F.col(f"{first}_score") + F.col(f"{second}_score")) / 2
    a, b = F.col(f"{first}_is_anomaly"), F.col(f"{second}_is_anomaly")
    agreed = (a | b) if strategy == "union" else (a & b)
    return df.withColumn("ensemble_score", score).withColumn(
        "is_anomaly", agreed | (F.col("ensemble_score") >= threshold)
    )


def anomalies(scored: DataFrame) -> DataFrame:
    return scored.where("is_anomaly")


def top_anomalies(scored: DataFrame, n: int = 3, key: str = KEY) -> DataFrame:
    """The n flagged records with the highest score, ties by key."""
    return anomalies(scored).orderBy(F.desc("ensemble_score"), key).limit(n)


def time_text(column: Column) -> Column:
    """Timestamp as text, with microseconds only when there are any."""
    micros = F.pmod(F.unix_micros(column), F.lit(1_000_000))
    plain = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
    return F.when(micros == 0, plain).otherwise(F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def verdicts(scored: DataFrame, key: str = KEY) -> DataFrame:
    """What a caller of the detector gets back per record."""
    return scored.select(
        key,
        time_text(F.col(TIME)).alias(TIME),
        F.col("is_anomaly").cast("boolean").alias("is_anomaly"),
        F.col("ensemble_score").cast("double").alias("ensemble_score"),
    )
