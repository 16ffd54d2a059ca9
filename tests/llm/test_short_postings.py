"""Postings of the Jaccard join go through their shuffle with 64 bits of a class's key and without its size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ohmwatch.llm import jaccard


def test_postings_are_shuffled_with_short_keys(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "five other words stand here")], "doc_id long, text string")
    found = jaccard.shared_postings(jaccard._referred(docs), np.ones(jaccard.CELLS, np.int64))
    assert dict(found.dtypes) == {"token": "bigint", "short": "bigint", "least": "int", "hot": "boolean", "held": "int"}
    keys = spark.createDataFrame([(bytearray(jaccard.set_key(jaccard.shingle_set(t))),) for t in (text, text + " more")], "key binary")
    shorts = sorted(r["s"] for r in keys.select(jaccard.short("key").alias("s")).collect())
    lists = found.groupBy("token").agg(F.sort_array(F.collect_list("short")).alias("all")).collect()
    assert lists and all(r["all"] == shorts for r in lists)
