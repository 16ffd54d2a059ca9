"""Row-frame windows over one long order, without putting the order on one task.

``Window.orderBy`` with no partition, or with a key that holds a third of all rows, sorts everything in one
task.  Here the order is cut into contiguous buckets of bounded size.  The last rows of what precedes a
bucket are copied into it, so a frame of n rows sees what it would see in the uncut order.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ohmwatch.session import BROADCAST_ROWS, small_or_stored, store

BUCKET = "__bucket"
CARRIED = "__carried"

BUCKET_ROWS = 250_000
# Cut points that go into the plan; an order that needs more buckets is cut again inside each of these.
COARSE = 1_000
_OVERSAMPLE = 20
_CUTS = "__cuts"


def _order_struct(df: DataFrame, order: Sequence[str]) -> Column:
    """The order columns as one comparable struct; times become microseconds."""
    parts = []
    for i, name in enumerate(order):
        kind = df.schema[name].dataType
        column = F.unix_micros(F.col(name)) if isinstance(kind, T.TimestampType) else F.col(name)
        parts.append(column.alias(f"o{i}"))
    return F.struct(*parts)


def count_below(cuts: Column, key: Column, most: int) -> Column:
    """How many of the sorted cut points, ``most`` at most, are at or below a key, by binary search."""
    steps = [1 << i for i in reversed(range(max(1, most).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(step) for step in steps]),
        F.lit(0),
        lambda low, step: F.when(
            (low + step <= F.size(cuts)) & (F.get(cuts, low + step - 1) <= key), low + step
        ).otherwise(low),
    )


@dataclass(frozen=True)
class Buckets:
    """Cut points of an order, lowest first: at most ``COARSE`` in the plan and, for long orders, a table of more.

    ``fine`` has (coarse, cuts) for the pieces between the coarse points, ``most`` is the greatest number of cuts in
    one.  Its rows hold about ``BUCKET_ROWS`` rows per cut whatever the length of the order.
    """

    order: tuple[str, ...]
    points: tuple[dict, ...]
    point_type: T.DataType | None
    fine: DataFrame | None = None
    most: int = 0

    def coarse(self, key: Column) -> Column:
        if not self.points:
            return F.lit(0)
        return count_below(F.from_json(F.lit(json.dumps(self.points)), T.ArrayType(self.point_type)), key, len(self.points))

    def place(self, df: DataFrame) -> DataFrame:
        """Add ``BUCKET``, whose numbers rise with the order."""
        key = _order_struct(df, self.order)
        if self.fine is None:
            return df.withColumn(BUCKET, self.coarse(key).cast("long"))
        cuts = self.fine.select(F.col("coarse").alias("__piece"), F.col("cuts").alias(_CUTS))
        small = self.most * (len(self.points) + 1) <= BROADCAST_ROWS
        pieced = df.withColumn("__coarse", self.coarse(key))
        joined = pieced.join(F.broadcast(cuts) if small else cuts, F.col("__coarse") == F.col("__piece"), "left")
        inside = F.coalesce(count_below(F.col(_CUTS), _order_struct(joined, self.order), self.most), F.lit(0))
        number = F.shiftleft(F.col("__coarse").cast("long"), 32) + inside
        return joined.withColumn(BUCKET, number).drop("__coarse", "__piece", _CUTS)

    def cut_keys(self, keys: Sequence[str], df: DataFrame) -> DataFrame:
        """The leading order columns of all cut points, which alone lie in more than one bucket."""
        schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys])
        found = df.sparkSession.createDataFrame([*{tuple(point[f"o{i}"] for i in range(len(keys))) for point in self.points}], schema)
        if self.fine is None:
            return F.broadcast(found)  # at most ``COARSE`` rows
        more = self.fine.select(F.explode("cuts").alias("o")).select(*[F.col(f"o.o{i}").alias(k) for i, k in enumerate(keys)])
        return small_or_stored(found.unionByName(more).distinct(), "cut-keys")


def _sampled(df: DataFrame, order: Sequence[str], total: int, buckets: int) -> tuple[DataFrame, int]:
    """A hash sample of the order structs with about 20 rows to a bucket, and how many stand for a bucket."""
    modulus = max(1, total // (buckets * _OVERSAMPLE))
    sample = df.select(_order_struct(df, order).alias("o")).where(F.pmod(F.xxhash64("o"), F.lit(modulus)) == 0)
    return sample, max(1, total // (modulus * buckets))


def cut_order(df: DataFrame, order: Sequence[str], bucket_rows: int = BUCKET_ROWS, coarse: int = COARSE) -> Buckets:
    """Choose cut points from a hash sample of the order columns, which must be unique together.

    The coarse sample holds about ``coarse * 20`` rows, so sorting it in one place is bounded work.  The fine one grows
    with the table, about 20 rows to a bucket; each piece of it is sorted by itself and stays a table.
    """
    total = df.count()
    buckets = -(-total // bucket_rows)
    if buckets <= 1:
        return Buckets(tuple(order), (), None)
    sample, every = _sampled(df, order, total, min(coarse, buckets))
    points = (
        sample.withColumn("n", F.row_number().over(Window.orderBy("o"))).where(F.col("n") % every == 0).orderBy("o")
    )
    rows = [row.o.asDict() for row in points.select("o").collect()]
    found = Buckets(tuple(order), tuple(rows), points.schema["o"].dataType)
    if buckets <= coarse:
        return found
    sample, every = _sampled(df, order, total, buckets)
    own = Window.partitionBy("coarse").orderBy("o")
    pieces = sample.withColumn("coarse", found.coarse(F.col("o"))).withColumn("n", F.row_number().over(own)).where(F.col("n") % every == 0)
    fine = store(pieces.groupBy("coarse").agg(F.sort_array(F.collect_list("o")).alias("cuts")), "cuts")
    return replace(found, fine=fine, most=fine.agg(F.max(F.size("cuts"))).first()[0] or 0)


def with_buckets(
    df: DataFrame,
    buckets: Buckets,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    lookback: int,
) -> DataFrame:
    """Add ``BUCKET`` and ``CARRIED``; carried rows are copies of the ``lookback`` rows before a bucket.

    ``columns`` names what the windows read; carried rows hold only these.  Windows go over
    ``row_window(keys, order)``, and the caller drops carried rows afterwards.
    """
    placed = buckets.place(df).withColumn(CARRIED, F.lit(False))
    if not buckets.points:
        return placed
    narrow = placed.select(BUCKET, *dict.fromkeys([*keys, *order, *columns]))
    if keys:
        spanning = buckets.cut_keys(keys, df)
        same = [narrow[k].eqNullSafe(spanning[k]) for k in keys]  # a null key is a key
        narrow = narrow.join(spanning, reduce(Column.__and__, same), "left_semi")

    group = [BUCKET, *keys]
    newest_first = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
    tails = narrow.withColumn("__back", F.row_number().over(newest_first)).where(F.col("__back") <= lookback)
    # At most lookback rows per bucket and key are left; stored, since both join sides read them.
    tails = store(tails, "tails-of-buckets")
    # Their places along the order: those of the buckets before, one narrow row to a bucket, and within the bucket.
    along = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    counts = tails.groupBy(*group).agg(F.count(F.lit(1)).alias("__held"))
    counts = counts.withColumn("__base", F.coalesce(F.sum("__held").over(along), F.lit(0)))
    counts = counts.select(F.col(BUCKET).alias("__of"), *[F.col(k).alias(f"__of_{k}") for k in keys], "__base", "__held")
    own = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys], F.col(BUCKET) == F.col("__of"))
    at = F.col("__base") + F.col("__held") - F.col("__back") + 1
    tails = tails.join(counts, own).withColumn("__at", at).drop("__of", *[f"__of_{k}" for k in keys], "__base", "__held", "__back")
    tails = store(tails, "tails")
    named = [F.col(k).alias(f"__key_{k}") for k in keys]
    starts = tails.groupBy(*group).agg(F.min("__at").alias("__first")).select(*named, F.col(BUCKET).alias("__to"), "__first")
    met = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys], F.col("__start") == F.col("__first"))
    carried = (
        tails.withColumn("__start", F.explode(F.sequence(F.col("__at") + 1, F.col("__at") + lookback)))
        .join(starts, met)
        .withColumn(BUCKET, F.col("__to"))
        .drop("__at", "__start", "__first", "__to", *[f"__key_{k}" for k in keys])
        .withColumn(CARRIED, F.lit(True))
    )
    return placed.unionByName(carried, allowMissingColumns=True)


def row_window(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(BUCKET, *keys).orderBy(*order)


def over_order(
    df: DataFrame,
    windows: dict,
    order: Sequence[str],
    keys: Sequence[str] = (),
    columns: Sequence[str] = (),
    lookback: int = 9,
    bucket_rows: int = BUCKET_ROWS,
    coarse: int = COARSE,
) -> DataFrame:
    """Add window columns over the whole order (or per key); each value maps a window to a column.

    A frame may reach back ``lookback`` rows at most.
    """
    buckets = cut_order(df, [*keys, *order], bucket_rows, coarse)
    placed = with_buckets(df, buckets, keys, order, columns, lookback)
    window = row_window(keys, order)
    return (
        placed.withColumns({name: build(window) for name, build in windows.items()})
        .where(~F.col(CARRIED))
        .drop(BUCKET, CARRIED)
    )
