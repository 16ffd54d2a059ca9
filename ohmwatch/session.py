"""Session settings and the shared folder that multi-pass jobs write to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F

_LOCAL_FOLDERS: dict[str, str] = {}

# A side of a join is broadcast only when it was counted and holds at most this many rows.
BROADCAST_ROWS = 20_000

# With this setting a job's shuffle files go when it ends, and not when the driver happens to collect its garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Tables stored by the innermost ``passing`` of this thread.
_PASSING: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("passing", default=None)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ohmwatch") -> SparkSession:
    """Single-machine session for tests and the benchmark; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Small local tables are still worth all cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach, named by ``spark.checkpoint.dir``.

    Only a local master may run without the setting; it then gets one temporary folder per application.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="ohmwatch-")
    return _LOCAL_FOLDERS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``df`` as Parquet; shuffle files of the job do not outlast it, since nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(_FREED, None)
    conf.set(_FREED, "true")
    try:
        df.write.mode(mode).parquet(path)
    finally:
        conf.unset(_FREED) if before is None else conf.set(_FREED, before)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several passes read one result: it cuts the lineage, survives lost executors, and lets each
    pass prune columns.  Within ``passing`` the table goes with it.
    """
    return _stored(df, name, _PASSING.get())


def _stored(df: DataFrame, name: str, held: list[tuple[SparkSession, str]] | None) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if held is not None:
        held.append((spark, path))
    write(df, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables stored inside are deleted at its end, so that steps of a long job do not add up on disk.

    What comes out must not read them: it is a number, or a table stored by the function that this gives, which is
    like ``store`` outside.
    """
    outer, own = _PASSING.get(), []
    token = _PASSING.set(own)
    try:
        yield lambda df, name: _stored(df, name, outer)
    finally:
        _PASSING.reset(token)
        for spark, path in own:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def small_or_stored(df: DataFrame, name: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The join side ``df``, computed once into a stored table; with at most ``limit`` rows it is broadcast.

    Beyond the limit no hint is given, so Spark shuffles the join and AQE splits its skewed partitions.
    """
    kept = store(df, name)
    return F.broadcast(kept) if kept.count() <= limit else kept


def fan_out(table: DataFrame) -> DataFrame:
    """Deal a small stored table out to all cores before costly work on its rows.

    Files are split by bytes, so a few megabytes are one task.  A table that already has as many partitions
    as there are cores is left alone, so nothing large is shuffled.  Pass a scan, not a computed result.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
