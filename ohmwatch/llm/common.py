"""Helpers shared by the operators: tables, words, labels, stored results, running totals."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ohmwatch.session import store

#: A word is a run of characters other than blank, tab, line breaks, vertical tab and form feed.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id gives 0, so it is in one fold as well."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % divisor, F.lit(0))


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, as UTF-8: ``bytes`` splits at exactly the six white-space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each, so that arrays made from one part stay small.

    A single longer text is a part of its own.
    """
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield batch.slice(start)


def arrow_parts(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, column, limit)


def running_offset(rows: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str, to: str) -> DataFrame:
    """Adds ``to``: the sum of ``value`` over the rows of the same keys that come before, by bucket and then ``order``.

    A key may hold most rows, so no window spans a key: the rows of a bucket are summed in one window, the totals
    of buckets in another.  The caller deals out buckets so that each holds a bounded number of rows.
    """
    totals = rows.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col(bucket).alias("_bucket"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base")
    )
    same = reduce(Column.__and__, [rows[k].eqNullSafe(base[f"_{k}"]) for k in keys] + [rows[bucket] == base["_bucket"]])
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = reduce(Column.__and__, [summed[k].eqNullSafe(base[f"_{k}"]) for k in keys] + [summed[bucket] == base["_bucket"]])
    return (
        summed.join(base, same)
        .withColumn(to, F.col("_base") + F.col("_inside"))
        .drop("_inside", "_bucket", "_base", *[f"_{k}" for k in keys])
    )


__all__ = ["SPACE", "SPACES", "WORD", "arrow_parts", "remainder", "running_offset", "slices", "store", "table", "word_runs", "words_of"]


def word_runs(text: str | None, size: int = 1 << 20, lower: bool = True) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased if so asked, in lists made from about ``size`` bytes each; most texts are one list."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    data = data.lower() if lower else data
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):  # go on to the end of the word
            cut = SPACE.search(data, end)
            end = cut.start() if cut else len(data)
        yield (data[start:end] if start or end < len(data) else data).split()
        start = end
