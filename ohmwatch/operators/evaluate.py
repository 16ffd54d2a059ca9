"""Aggregates over scored and labelled records.  All combine map-side; none gathers rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NO_ATTACK = "None"


def is_attack(attack_type: str = "attack_type") -> Column:
    return F.col(attack_type) != NO_ATTACK


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def anomaly_rates(scored: DataFrame) -> DataFrame:
    """Share flagged, true attack share, number flagged and number of records."""
    return scored.agg(
        F.avg(F.col("is_anomaly").cast("double")).alias("anomaly_rate"),
        F.avg(is_attack().cast("double")).alias("attack_rate"),
        F.count_if(F.col("is_anomaly")).alias("anomaly_count"),
        F.count(F.lit(1)).alias("record_count"),
    )


def flag_rate_by_class(scored: DataFrame) -> DataFrame:
    """Share flagged among attacks and among the rest."""
    return scored.groupBy(is_attack().alias("is_attack")).agg(
        F.avg(F.col("is_anomaly").cast("double")).alias("flag_rate"), F.count(F.lit(1)).alias("n")
    )


def confusion(scored: DataFrame, truth: Column | None = None, flag: str = "is_anomaly") -> DataFrame:
    """Confusion cells with precision, recall and F1; a ratio without cases is 0."""
    actual = is_attack() if truth is None else truth
    said = F.col(flag)
    cells = scored.agg(
        F.count_if(said & actual).alias("tp"),
        F.count_if(said & ~actual).alias("fp"),
        F.count_if(~said & actual).alias("fn"),
        F.count_if(~said & ~actual).alias("tn"),
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return cells.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
        }
    )
