"""Sources of knowledge text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_text_folder(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, source, text)`` of each ``*.txt`` file; ``doc_id`` depends on the file name only.

    Numbering by name order would need all names in one place, so ties between chunks follow the hash.
    """
    files = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    source = F.col("_metadata.file_name")
    return files.select(F.xxhash64(source).alias("doc_id"), source.alias("source"), F.col("value").alias("text"))


def documents_from_table(table: DataFrame) -> DataFrame:
    return table.select("doc_id", "source", "text")
