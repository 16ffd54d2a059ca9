"""Feature columns and the numeric feature matrix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ohmwatch.operators.ordered import BUCKET_ROWS, over_order
from ohmwatch.schema import CATEGORICAL, KEY, META, TIME
from ohmwatch.session import BROADCAST_ROWS, store

# Fixed values of the feature definitions.
ROLLING_ROWS = 10
STD_FLOOR = 1e-6
FLAT_RANGE = 1e-9

# Values that are numbered in one task.
GROUP_VALUES = 50_000


@dataclass(frozen=True)
class Moments:
    """Fitted statistics of one column, for scoring that must not depend on its batch."""

    mean: float
    std: float


def moments(df: DataFrame, column: str) -> DataFrame:
    """One row: mean, sample standard deviation (0 when undefined), least and greatest value."""
    c = F.col(column)
    return df.agg(
        F.avg(c).alias("mean"),
        F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std"),
        F.min(c).alias("lo"),
        F.max(c).alias("hi"),
    )


def fit_moments(df: DataFrame, column: str) -> Moments:
    row = moments(nan_to_null(df), column).first()
    return Moments(row["mean"] or 0.0, row["std"])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing, so that averages skip it."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType)) for c in floats})


def numeric_columns(df: DataFrame, exclude: Sequence[str] = (KEY, *META)) -> list[str]:
    """Columns with a numeric type, in table order; booleans, text and the excluded ones are left out."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def add_zscore(df: DataFrame, column: str, name: str, source: Moments | DataFrame | None = None) -> DataFrame:
    """``(x - mean) / (std + 1e-6)`` with the moments of ``source``: a table, fitted ones, or ``df`` itself."""
    if isinstance(source, Moments):
        mean, std = F.lit(source.mean), F.lit(source.std)
    else:
        batch = moments(df if source is None else source, column)
        mean, std = batch.select("mean").scalar(), batch.select("std").scalar()
    return df.withColumn(name, (F.col(column) - mean) / (std + STD_FLOOR))


def add_rolling(
    df: DataFrame,
    partition_by: Sequence[str] = (),
    key: str = KEY,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Mean request rate and latency spread of the last 10 rows in time order, overall or per key."""

    def frame(window):
        return window.rowsBetween(1 - ROLLING_ROWS, 0)

    return over_order(
        df,
        {
            "rolling_request_rate_mean": lambda w: F.avg("request_rate").over(frame(w)),
            "rolling_latency_std": lambda w: F.coalesce(F.stddev_samp("latency_ms").over(frame(w)), F.lit(0.0)),
        },
        order=[TIME, key],
        keys=partition_by,
        columns=["request_rate", "latency_ms"],
        lookback=ROLLING_ROWS - 1,
        bucket_rows=bucket_rows,
    )


def categories(df: DataFrame, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    """Distinct values as rows ``(column, value)``; one pass over the table for all columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).select("p.*").where(F.col("value").isNotNull()).distinct()


def fit_categories(df: DataFrame, columns: Sequence[str] = CATEGORICAL, limit: int = 10_000) -> dict[str, list[str]]:
    """Sorted values per column, frozen at fit time.  Each becomes a column, so there must be few."""
    rows = categories(df, columns).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} category values; these columns are not categorical")
    return {c: sorted(r["value"] for r in rows if r["column"] == c) for c in columns}


def one_hot(df: DataFrame, values: Mapping[str, Sequence[str]]) -> DataFrame:
    """Replace each column by indicator columns ``column_value``; an unseen value sets none of them."""
    added = {
        f"{c}_{v}": F.coalesce(F.col(c) == F.lit(v), F.lit(False)) for c, kept in values.items() for v in kept
    }
    return df.withColumns(added).drop(*values)


def value_table(df: DataFrame, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    """(column, value, index): a stored table of the values seen, numbered from 0, for columns with any number of values.

    Numbers run through hash groups of about ``GROUP_VALUES`` values, by the column and value within a group; only the
    sizes of the groups are ordered in one place.
    """
    seen = store(categories(df, columns), "values")
    groups = max(1, -(-seen.count() // GROUP_VALUES))
    seen = seen.withColumn("__group", F.pmod(F.xxhash64("column", "value"), F.lit(groups)))
    before = Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = seen.groupBy(F.col("__group").alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    bases = sizes.select("__of", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    place = F.row_number().over(Window.partitionBy("__group").orderBy("column", "value"))
    numbered = seen.withColumn("__place", place).join(bases, F.col("__group") == F.col("__of"))
    return store(numbered.select("column", "value", (F.col("__base") + F.col("__place") - 1).alias("index")), "value-table")


def sparse_one_hot(df: DataFrame, values: DataFrame, columns: Sequence[str] = CATEGORICAL, name: str = "indicators") -> DataFrame:
    """Replace the columns by one sparse vector: a struct of size, sorted indices of the indicators that are set, and ones.

    ``values`` is a ``value_table``, joined by value: broadcast when it is small, else shuffled.  A null or a value
    that the table does not have sets no indicator.
    """
    size = values.count()
    for i, c in enumerate(columns):
        own = values.where(F.col("column") == c).select(F.col("value").alias("__value"), F.col("index").alias(f"__index{i}"))
        df = df.join(F.broadcast(own) if size <= BROADCAST_ROWS else own, F.col(c) == F.col("__value"), "left").drop("__value")
    found = F.array_sort(F.array_compact(F.array(*[F.col(f"__index{i}") for i in range(len(columns))])))
    vector = F.struct(F.lit(size).cast("long").alias("size"), found.alias("indices"), F.transform(found, lambda _: F.lit(1.0)).alias("values"))
    return df.withColumn(name, vector).drop(*columns, *[f"__index{i}" for i in range(len(columns))])


def fill_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null and NaN become 0."""
    return nan_to_null(df).fillna(0, list(columns))


def align(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the given feature columns in order: missing ones are 0, extra ones go."""
    return df.select(*keep, *[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns])


def split_meta(df: DataFrame, key: str = KEY) -> tuple[list[str], list[str]]:
    """Names of the carried columns that are present, and of the feature candidates."""
    meta = [c for c in META if c in df.columns]
    return meta, [c for c in df.columns if c not in (key, *meta)]


def feature_matrix(
    df: DataFrame,
    key: str = KEY,
    stats: Moments | None = None,
    include_categoricals: Mapping[str, Sequence[str]] | None = None,
    partition_by: Sequence[str] = (),
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Key, carried columns and the numeric features of each record, without nulls.

    ``df`` is read more than once, so pass a stored table.  With ``include_categoricals`` the given values
    become 0/1 features; without it categorical columns do not reach the matrix.
    """
    clean = nan_to_null(df)
    # The moments are taken before the rolling columns, which do not change them.
    out = add_rolling(clean, partition_by, key, bucket_rows)
    out = add_zscore(out, "packet_size", "packet_size_zscore", clean if stats is None else stats)
    if include_categoricals:
        out = one_hot(out, include_categoricals)
        flags = [f"{c}_{v}" for c, kept in include_categoricals.items() for v in kept]
        out = out.withColumns({c: F.col(c).cast("double") for c in flags})
    meta, candidates = split_meta(out, key)
    kept = [c for c in numeric_columns(out, exclude=(key, *meta)) if c in candidates]
    return fill_missing(out, kept).select(key, *meta, *kept)


def clip(column: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Bound a column; a missing value stays missing."""
    out = column
    if lower is not None:
        out = F.greatest(out, F.lit(lower))
    if upper is not None:
        out = F.least(out, F.lit(upper))
    return F.when(column.isNotNull(), out)


def scale_between(column: Column, lo: Column, hi: Column) -> Column:
    """``(x - lo) / (hi - lo)``, 0 when the range is flat."""
    return F.when(hi - lo < FLAT_RANGE, F.lit(0.0)).otherwise((column - lo) / (hi - lo))


def add_minmax(df: DataFrame, column: str, name: str, bounds: tuple[float, float] | None = None) -> DataFrame:
    """Min-max scaled column, over ``df`` itself or between fitted bounds (not clipped)."""
    if bounds is None:
        batch = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
        lo, hi = batch.select("lo").scalar(), batch.select("hi").scalar()
    else:
        lo, hi = F.lit(bounds[0]), F.lit(bounds[1])
    return df.withColumn(name, scale_between(F.col(column), lo, hi))
