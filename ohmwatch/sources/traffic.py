"""Sources of traffic records: raw event tables, CSV captures and submitted JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ohmwatch.operators.ordered import BUCKET, BUCKET_ROWS, CARRIED, cut_order, row_window, with_buckets
from ohmwatch.schema import CATEGORICAL, KEY, RAW_NUMERIC, SUBMITTED, TIME, TRAFFIC
from ohmwatch.session import small_or_stored

_DAY = 86_400
_HOUR = 3_600
_RECENT = 10


def read_traffic(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Typed traffic table from Parquet, CSV or JSON files; malformed text fails the read."""
    reader = spark.read.schema(TRAFFIC)
    if fmt in ("csv", "json"):
        reader = reader.option("mode", "FAILFAST")
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def traffic_from_json(df: DataFrame, column: str) -> DataFrame:
    """One row per record of a JSON array column; times are parsed, an empty array gives no rows."""
    parsed = F.from_json(F.col(column), T.ArrayType(SUBMITTED), {"mode": "FAILFAST"})
    others = [c for c in df.columns if c != column]
    return (
        df.select(*others, F.inline(parsed))
        .withColumn(TIME, F.to_timestamp(TIME))
        .select(*others, TIME, *RAW_NUMERIC, *CATEGORICAL)
    )


def _asset(number: Column) -> Column:
    return F.concat(F.lit("asset-"), (number % 7).cast("string"))


def _requests_last_hour(placed: DataFrame, second: str) -> DataFrame:
    """Rows of the asset in the hour up to and including each second, per (bucket, asset, second).

    Rows are counted per second first, so a busy second is one row per bucket; the hour then slides over
    day-long groups, each holding the seconds of its day and of the hour before it.
    """
    counted = placed.groupBy(BUCKET, "src_asset", second).agg(F.count(F.lit(1)).alias("n"))
    day = F.floor(F.col(second) / _DAY)
    days = F.when(F.pmod(F.col(second), F.lit(_DAY)) >= _DAY - _HOUR, F.array(day, day + 1)).otherwise(F.array(day))
    hour = Window.partitionBy("src_asset", "day").orderBy(second).rangeBetween(-_HOUR, 0)
    return (
        counted.withColumn("day", F.explode(days))
        .withColumn("rate", F.sum("n").over(hour).cast("double"))
        .where(F.col("day") == day)
        .select(BUCKET, "src_asset", second, "rate")
    )


def ingest_events(events: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Traffic records from an event table ``(event_id, ts, user_id, event_type, value, props)``.

    Per-asset columns run over buckets of the (asset, time, id) order, since a few assets hold all rows.
    """
    k = F.get_json_object("props", "$.k").cast("long")
    rows = events.select(
        F.col("event_id").alias(KEY),
        F.col("ts").cast("timestamp").alias(TIME),
        F.col("value").cast("double").alias("packet_size"),
        k.cast("double").alias("latency_ms"),
        F.col("event_type").alias("mms_service"),
        _asset(F.col("user_id")).alias("src_asset"),
        _asset(k).alias("dst_asset"),
        F.col("props").alias("__props"),
    )
    keys, order, second = ["src_asset"], [TIME, KEY], "__second"
    keyed = events.select(_asset(F.col("user_id")).alias("src_asset"), F.col("ts").cast("timestamp").alias(TIME),
                          F.col("event_id").alias(KEY))
    buckets = cut_order(keyed, [*keys, *order], bucket_rows)

    placed = with_buckets(rows, buckets, keys, order, [*keys, *order, "__props"], _RECENT)
    placed = placed.withColumn(second, F.floor(F.unix_micros(TIME) / 1_000_000))
    counts = buckets.place(keyed).withColumn(
        second, F.floor(F.unix_micros(TIME) / 1_000_000)
    )
    # Rates travel as extra rows of their bucket, so the wide rows are shuffled once for everything below.
    rates = _requests_last_hour(counts, second)
    same_second = Window.partitionBy(BUCKET, *keys).orderBy(second).rangeBetween(0, 0)
    placed = (
        placed.unionByName(rates, allowMissingColumns=True)
        .withColumn("request_rate", F.max("rate").over(same_second))
        .where(F.col("rate").isNull())
    )

    window = row_window(keys, order)
    before = window.rowsBetween(-_RECENT, -1)
    now = F.unix_micros(TIME)
    gap = F.coalesce((now - F.lag(now, 1).over(window)) / 1000.0, F.lit(0.0))
    gap_before = F.coalesce((F.lag(now, 1).over(window) - F.lag(now, 2).over(window)) / 1000.0, F.lit(0.0))
    first = F.lag(now, 1).over(window).isNull()
    placed = (
        placed.withColumn("inter_arrival_ms", gap)
        .withColumn("jitter_ms", F.when(first, F.lit(0.0)).otherwise(F.abs(gap - gap_before)))
        .withColumn("__recent", F.collect_list("__props").over(before))
        .where(~F.col(CARRIED))
    )
    same = F.size(F.filter("__recent", lambda p: p == F.col("__props")))
    recent = F.size("__recent")

    service = events.groupBy(F.col("event_type").alias("__service")).agg(
        F.avg("value").alias("__mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("__std")
    )
    moments = small_or_stored(service, "service-moments")
    faulty = F.coalesce(F.col("mms_service") == "error", F.lit(False))
    return (
        placed.withColumn("duplicate_ratio", F.when(recent > 0, same / recent).otherwise(F.lit(0.0)))
        .join(moments, F.col("mms_service").eqNullSafe(F.col("__service")), "left")
        .withColumn("value_deviation", (F.col("packet_size") - F.col("__mean")) / (F.col("__std") + 1e-6))
        .withColumn("label", F.when(faulty, "Attack").otherwise("Normal"))
        .withColumn("attack_type", F.when(faulty, "Fault").otherwise("None"))
        .select(*TRAFFIC.names)
    )
