"""Lists of the Jaccard join: classes by short numbers, one shuffle for the components of a list."""

from __future__ import annotations

from ohmwatch.llm import jaccard
from ohmwatch.llm.common import store

ROWS = [
    # token, key, n, least, hot, central, root
    (1, 10, 50, 1, False, 2.0, 10), (1, 11, 50, 1, False, 3.0, 10), (1, 12, 50, 1, False, 1.0, 12), (1, 13, 50, 1, False, 1.5, 13),
    (2, 10, 50, 1, False, 2.0, 10), (2, 11, 50, 1, False, 3.0, 10),
    (3, 10, 50, 1, True, 2.0, 10), (3, 11, 50, 1, True, 3.0, 10), (3, 12, 50, 1, True, 1.0, 12),
]
SCHEMA = "token long, key long, n int, least int, hot boolean, central float, root long"


def test_components_of_lists(spark):
    now = spark.createDataFrame(ROWS, SCHEMA)
    found = jaccard._open(now, True).select("token", "key", "major", "apart").collect()
    assert sorted(map(tuple, found)) == [(1, 10, 10, 2), (1, 11, 10, 2), (1, 12, 10, 2), (1, 13, 10, 2), (3, 10, 10, 1), (3, 11, 10, 1), (3, 12, 10, 1)]
    pivots = jaccard._pivots(store(jaccard._open(now, True), "open"), True).select("token", "p.key").distinct().collect()
    assert sorted(map(tuple, pivots)) == [(1, 13), (3, 12)]


def test_components_of_lists_take_one_shuffle(spark):
    plan = jaccard._open(store(spark.createDataFrame(ROWS, SCHEMA), "now"), False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
