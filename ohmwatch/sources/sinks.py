"""Sinks for traffic tables, incident reports and alerts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ohmwatch.schema import KEY
from ohmwatch.session import store


def write_csv(df: DataFrame, path: str) -> None:
    """Labelled table as CSV files with a header."""
    df.write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)


def append_alerts(alerts: DataFrame, path: str, run: str, key: str = KEY) -> None:
    """Add the alerts of one run to the alerts table, each record once.

    A run has a folder of its own, so a run that is repeated replaces what it wrote; records that another run has
    alerted are left out.  Of several alerts for a record within the run the least payload stays.
    """
    spark = alerts.sparkSession
    once = alerts.groupBy(key).agg(F.min(F.struct("payload", *[c for c in alerts.columns if c not in (key, "payload")])).alias("_a")).select(key, "_a.*")
    sent = read_alerts(spark, path, once.schema)
    if sent is not None:
        other = sent.where(F.col("run") != run).select(F.col(key).alias("_sent")).distinct()
        once = once.join(other, F.col(key).eqNullSafe(F.col("_sent")), "left_anti")
    # The rows are worked out before the folder is replaced, as they may depend on what it holds.
    store(once, "alerts").write.mode("overwrite").parquet(f"{path}/run={run}")


def read_alerts(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """All alerts with their run, or none if nothing has been written yet."""
    try:
        reader = spark.read.option("basePath", path)
        if schema is not None:
            reader = reader.schema(T.StructType([*schema.fields, T.StructField("run", T.StringType())]))
        return reader.parquet(f"{path}/run=*")
    except AnalysisException:
        return None
