"""Exact duplicates by a tree merge of digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ohmwatch.llm.common import SPACES, store, table

#: Runs that one merge brings together.
FAN_IN = 8


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, digest and a check value, each from the whole normalised text."""
    text = F.col("_text")
    return docs.select("doc_id", normalised(docs["text"]).alias("_text")).select(
        "doc_id",
        F.sha2(text, 256).alias("text_sha256"),
        F.struct(F.octet_length(text).alias("bytes"), F.xxhash64(text).alias("hash")).alias("proof"),
    )


def merge_runs(rows: DataFrame, runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """Digest groups: text_sha256, proof, keep_id, group_size.

    Each of ``runs`` runs holds some rows as one entry per digest with the smallest id and a count.  A round brings
    ``fan_in`` runs together and merges equal entries, until one run is left.  A run is dealt out by digest, so the
    last run lies over all tasks like the first.  The proof (length and a second hash) is part of what must be
    equal: a collision of digests would stay two groups.  Copies meet before each exchange, so one text that fills
    a third of the table crosses it as one entry per task.
    """
    entries = rows.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(runs)).alias("run"), "text_sha256", "proof", F.col("doc_id").alias("keep_id"), F.lit(1).alias("group_size")
    )
    while True:
        entries = entries.groupBy("run", "text_sha256", "proof").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        if runs == 1:
            return entries.drop("run")
        runs = -(-runs // fan_in)
        entries = entries.withColumn("run", F.col("run") % runs)


def runs_for(docs: DataFrame) -> int:
    """As many runs as the session deals rows into; results do not depend on it."""
    return max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def duplicates(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``, which needs doc_id and text.

    Null text counts as empty.  Rows with a null id are never the one that stays while the group has another id; in
    a group of null ids only, keep_id is null and all rows stay, because none can be told from the others.
    Rows that repeat an id and its text are all copies of that id: the one that stays is named, and kept is true
    for each of them.  Other columns are not read.  An empty table gives an empty result.
    """
    rows = store(digests(docs), "digests")
    groups = merge_runs(rows, runs_for(docs), fan_in)
    copied = groups.filter("group_size > 1").select(
        F.col("text_sha256").alias("_digest"), F.col("proof").alias("_proof"), F.col("keep_id").alias("_keep"), F.col("group_size").alias("_size")
    )
    # Only digests with copies take part; adaptive execution splits the partition of a frequent digest.
    joined = rows.join(copied, (rows["text_sha256"] == copied["_digest"]) & (rows["proof"] == copied["_proof"]), "left")
    keep = F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256",
    )


def drop_duplicates(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row of ``docs`` for each group of equal texts, with all its columns: a row with the smallest id.

    Where several rows repeat that id and text, or a group has null ids only, one of them stays.
    """
    rows = store(digests(docs), "digests")
    groups = store(merge_runs(rows, runs_for(docs), fan_in).filter("group_size > 1"), "groups")
    again = rows.join(groups, ["text_sha256", "proof"]).filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("text_sha256", "proof").count()
    repeated = not again.filter("count > 1").isEmpty()
    side = groups.select(F.struct("text_sha256", "proof").alias("_group_of_copies"), F.col("keep_id").alias("_kept_copy"))
    text = normalised(docs["text"])
    digest = F.struct(F.sha2(text, 256).alias("text_sha256"), F.struct(F.octet_length(text).alias("bytes"), F.xxhash64(text).alias("hash")).alias("proof"))
    # The digest is a column before the join, so sorting compares values; the number of groups has no bound, so they are not broadcast.
    marked = docs.withColumn("_own_digest", digest)
    joined = marked.join(side.hint("merge"), F.col("_own_digest") == F.col("_group_of_copies"), "left")
    single, kept = F.col("_group_of_copies").isNull(), F.col("doc_id").eqNullSafe(F.col("_kept_copy"))
    if not repeated:
        return joined.filter(single | kept).select(*[marked[c] for c in docs.columns])
    one = joined.filter(~single & kept).groupBy("_group_of_copies").agg(F.first(F.struct(*[marked[c] for c in docs.columns])).alias("_row"))
    return joined.filter(single).select(*[marked[c] for c in docs.columns]).unionByName(one.select("_row.*"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""
