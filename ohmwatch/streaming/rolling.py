"""Rolling features on a stream of records that may arrive out of order.

The stream's own watermark and state hold a record until no record before it can come any more, drop what is late and
recover after a failure.  What they release is in order from batch to batch, so each batch gets the same windows as a
table would give it, with the last rows of each key from the batches before.  A busy key is no busy task: waiting
records are spread by their id, and windows run over buckets of the order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter

from ohmwatch.operators.features import ROLLING_ROWS, nan_to_null
from ohmwatch.operators.ordered import BUCKET_ROWS, over_order
from ohmwatch.schema import KEY, TIME
from ohmwatch.session import store

_DONE = "__done"
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _windows() -> dict[str, Callable]:
    def frame(window):
        return window.rowsBetween(1 - ROLLING_ROWS, 0)

    return {
        "rolling_request_rate_mean": lambda w: F.avg("request_rate").over(frame(w)),
        "rolling_latency_std": lambda w: F.coalesce(F.stddev_samp("latency_ms").over(frame(w)), F.lit(0.0)),
    }


def in_order(stream: DataFrame, delay: timedelta) -> DataFrame:
    """The stream's rows as JSON (``row``), each released when the watermark has passed its time.

    A time and record id is an entry of the state, written once and taken out once, whatever waits beside it.
    Rows that come more than ``delay`` after the latest time seen are late and dropped, as are rows without a time.
    """
    rows = nan_to_null(stream).where(F.col(TIME).isNotNull())
    marked = rows.select(TIME, KEY, F.struct(*rows.columns).alias("row")).withWatermark(TIME, f"{int(delay.total_seconds() * 1000)} milliseconds")
    waiting = marked.groupBy(TIME, KEY).agg(F.collect_list("row").alias("rows"))
    return waiting.select(F.explode("rows").alias("row")).select(F.to_json("row", _JSON).alias("row"))


class RollingStream:
    """Results in ``out/result/batch=n`` and the last rows of each key in ``out/tails/batch=n``.

    Batch n reads the tails of the last batch before it, so running a batch again gives the same files.
    """

    def __init__(
        self,
        spark: SparkSession,
        out: str,
        delay: timedelta,
        schema: T.StructType,
        keys: Sequence[str] = ("src_asset",),
        bucket_rows: int = BUCKET_ROWS,
    ):
        self.spark, self.out, self.delay, self.schema, self.keys = spark, out, delay, schema, list(keys)
        self.bucket_rows = bucket_rows

    def _tails(self, before: int) -> DataFrame | None:
        try:
            tails = self.spark.read.parquet(f"{self.out}/tails").where(F.col("batch") < before)
        except AnalysisException:
            return None
        last = tails.agg(F.max("batch")).first()[0]
        return None if last is None else self.spark.read.parquet(f"{self.out}/tails/batch={last}")

    def process(self, released: DataFrame, number: int) -> None:
        """Windows over the rows that a batch released, after the tails of earlier ones."""
        batch = released.select(F.from_json("row", self.schema, _JSON).alias("r")).select("r.*").withColumn(_DONE, F.lit(False))
        tails = self._tails(number)
        rows = store(batch if tails is None else batch.unionByName(tails), f"rolling-{number}")
        if rows.where(~F.col(_DONE)).isEmpty():
            return
        result = over_order(
            rows, _windows(), [TIME, KEY], self.keys, ["request_rate", "latency_ms", _DONE], ROLLING_ROWS - 1,
            self.bucket_rows,
        )
        result.where(~F.col(_DONE)).drop(_DONE).write.mode("overwrite").parquet(f"{self.out}/result/batch={number}")
        newest_first = Window.partitionBy(*self.keys).orderBy(F.desc(TIME), F.desc(KEY))
        kept = rows.withColumn("__n", F.row_number().over(newest_first)).where(F.col("__n") < ROLLING_ROWS).drop("__n")
        kept.withColumn(_DONE, F.lit(True)).write.mode("overwrite").parquet(f"{self.out}/tails/batch={number}")

    def end(self, newest) -> DataFrame:
        """A row to feed when the source has ended: its time lets the watermark pass ``newest``, and it waits for ever."""
        late = newest + self.delay + timedelta(seconds=1)
        row = self.spark.createDataFrame([(late,)], f"{TIME} timestamp")
        return row.select(*[F.col(f.name) if f.name == TIME else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema])

    def write(self, stream: DataFrame) -> DataStreamWriter:
        return in_order(stream, self.delay).writeStream.outputMode("append").foreachBatch(self.process)

    def result(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/result").drop("batch")
