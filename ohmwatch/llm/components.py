"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ohmwatch.llm.common import store


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One round over links (high, low), high > low.

    Large star: a node's larger neighbours are hung on its smallest neighbour.  Small star: so are its smaller
    ones and the node itself.  The smallest neighbour is an aggregate that is joined back, so no task holds a
    node's neighbours together.
    """
    both = links.select(F.col("high").alias("node"), F.col("low").alias("other"))
    if large:
        both = both.unionByName(links.select(F.col("low").alias("node"), F.col("high").alias("other")))
    least = both.groupBy("node").agg(F.min("other").alias("least"))
    least = least.select(F.col("node").alias("_node"), F.least("node", "least").alias("least"))
    joined = both.join(least, F.col("node") == F.col("_node"))
    if large:
        pairs = joined.filter("other > node").select(F.col("other").alias("high"), F.col("least").alias("low"))
    else:
        pairs = joined.select(F.col("other").alias("high"), F.col("least").alias("low")).unionByName(least.select(F.col("_node").alias("high"), F.col("least").alias("low")))
    return pairs.filter("high > low").distinct()


def roots(links: DataFrame) -> DataFrame:
    """node, root for every node of the links (a, b): root is the smallest node it is connected with.

    Rounds of large and small star, each written to the shared folder, until the links stay the same; their number
    grows with the logarithm of the longest chain.  Links with a null end or from a node to itself are ignored.
    """
    now = store(links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).filter("high > low").distinct(), "links")
    print_of = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
    before = print_of(now)
    while before[0]:
        now = store(_star(_star(now, True), False), "links")
        after = print_of(now)
        if after == before:
            break
        before = after
    node = now.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return node.unionByName(now.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
