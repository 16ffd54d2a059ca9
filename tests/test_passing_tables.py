"""Tables and shuffle files of steps that are over do not stay on disk."""

from __future__ import annotations

from pathlib import Path

import pytest

from ohmwatch import session
from ohmwatch.operators import lof


def _left(spark):
    """Names of the tables in the shared folder."""
    folder = Path(session.shared_folder(spark).removeprefix("file://"), spark.sparkContext.applicationId)
    return {p.name for p in folder.iterdir()} if folder.exists() else set()


def test_tables_stored_inside_passing_go_at_its_end(spark):
    """Steps of a long job must not add up on disk; what the given function stores belongs to what is outside."""
    before = _left(spark)
    with session.passing() as stay:
        inner = session.store(spark.range(3), "inner")
        with session.passing() as nearer:
            session.store(spark.range(4), "innermost")
            middle = nearer(spark.range(5), "middle")
        assert {n.rsplit("-", 1)[0] for n in _left(spark) - before} == {"inner", "middle"}
        kept = stay(inner.join(middle, "id"), "kept")
    with pytest.raises(ValueError), session.passing():
        session.store(spark.range(6), "failed")
        raise ValueError
    assert {n.rsplit("-", 1)[0] for n in _left(spark) - before} == {"kept"}
    assert sorted(r.id for r in kept.collect()) == [0, 1, 2]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"  # only while a table is written


def test_a_fitted_outlier_factor_leaves_one_table(spark):
    points = session.store(spark.range(400).selectExpr("id", "array(cast(id * 7 % 101 AS double), cast(id AS double)) AS point"), "points")
    before = _left(spark)
    model = lof.fit(points, 5, cell_rows=40)
    assert {n.rsplit("-", 1)[0] for n in _left(spark) - before} == {"lof-refs"}
    assert model.refs.count() == 400
    before = _left(spark)
    assert lof.score(model, points, 40).where("factor > 0").count() == 400
    assert {n.rsplit("-", 1)[0] for n in _left(spark) - before} == {"knn-apart", "knn-lists"}
