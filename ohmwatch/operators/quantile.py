"""Exact interpolated quantiles of columns of any length."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ohmwatch.operators.ordered import count_below

# Up to here the built-in, which keeps every distinct value in one buffer, is cheap.
BUILTIN_ROWS = 1_000_000
# Bins of about equal numbers of rows that a pass counts.
_BINS = 512


def exact_quantile(
    df: DataFrame,
    column: str,
    q: float,
    weight: str | None = None,
    builtin_rows: int = BUILTIN_ROWS,
) -> float | None:
    """The q-quantile with linear interpolation between the two closest ranks.

    Longer columns are narrowed by a mergeable sketch of their quantiles and exact counts between its points: each
    pass keeps the bin that holds the wanted rank, about one row in 512 whatever the scale of the values, so only
    sketches and bin counts move.  ``weight`` counts a row several times.
    """
    w = F.col(weight) if weight else F.lit(1)
    rows = df.select(F.col(column).cast("double").alias("v"), w.cast("long").alias("w")).where("v is not null and w > 0")
    total, stored = rows.agg(F.sum("w"), F.count(F.lit(1))).first()
    if not total:
        return None
    if stored <= builtin_rows:
        return rows.agg(F.percentile("v", q, F.col("w"))).first()[0]
    at = q * (total - 1)
    below, above = math.floor(at), math.ceil(at)
    low_value = _ranked(rows, below)
    high_value = low_value if above == below else _next(rows, low_value, above)
    return low_value if low_value == high_value else low_value + (high_value - low_value) * (at - below)


def _next(rows: DataFrame, value: float, rank: int) -> float:
    """The value at a rank that follows the rank of ``value``: the same, or the least greater one."""
    v = F.col("v")
    reached, following = rows.agg(F.sum(F.when(v <= value, F.col("w"))), F.min(F.when(v > value, v))).first()
    return value if reached > rank else following


def _ranked(rows: DataFrame, rank: int) -> float:
    """The value at a 0-based rank in Spark's order: minus infinity, numbers, infinity, NaN.  Only numbers are narrowed."""
    v, number = F.col("v"), ~F.isnan("v") & (F.abs("v") < math.inf)
    n_low, n_finite, n_high, lo, hi = rows.agg(
        F.sum(F.when(v == -math.inf, F.col("w"))), F.sum(F.when(number, F.col("w"))), F.sum(F.when(v == math.inf, F.col("w"))),
        F.min(F.when(number, v)), F.max(F.when(number, v)),
    ).first()
    rank -= n_low or 0
    if rank < 0:
        return -math.inf
    if rank < (n_finite or 0):
        return _value_at(rows.where(number), rank, lo, hi)
    return math.inf if rank < (n_finite or 0) + (n_high or 0) else math.nan


def _value_at(rows: DataFrame, rank: int, lo: float, hi: float) -> float:
    """The value at a 0-based rank of the sorted, weighted column.

    Points of the sketch that are the least value separate nothing; if there are no others, that value holds nearly all
    rows and is counted by itself.  So every pass narrows the range.
    """
    skipped = 0
    v = F.col("v")
    shares = [i / _BINS for i in range(1, _BINS)]
    while lo < hi:
        inside = rows.where(v.between(lo, hi))
        points = sorted({p for p in inside.agg(F.percentile_approx("v", shares, 20 * _BINS)).first()[0] if p > lo})
        if not points:
            held, following = inside.agg(F.sum(F.when(v == lo, F.col("w"))), F.min(F.when(v > lo, v))).first()
            if skipped + held > rank:
                return lo
            skipped, lo = skipped + held, following
            continue
        bin_of = count_below(F.array(*map(F.lit, points)), v, len(points))
        bins = (
            inside.groupBy(bin_of.alias("bin"))
            .agg(F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .orderBy("lo")
            .collect()
        )
        for row in bins:
            if skipped + row["n"] > rank:
                break
            skipped += row["n"]
        lo, hi = row["lo"], row["hi"]
    return lo
