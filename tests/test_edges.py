"""Null keys, numbers that are not finite, damaged files and loose JSON."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter, Window, functions as F

from ohmwatch.functions.incidents import detection_finding
from ohmwatch.operators import features, iforest, knn, ordered, quantile, retrieval
from ohmwatch.operators.quantile import exact_quantile
from ohmwatch.session import store
from ohmwatch.sources import published, sinks


@pytest.mark.parametrize("values", [[*range(99), math.nan], [-math.inf, 1.0, 2.0, math.inf], [-1.7e308, 0.0, 1.7e308], [1e15, 1e15 + 1, 1e15 + 2], [0.0, 5e-324, 1e-323]])
@pytest.mark.parametrize("q", [0.0, 0.5, 1.0])
def test_quantile_is_the_same_on_both_paths(spark, values, q):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert exact_quantile(df, "x", q) == pytest.approx(exact_quantile(df, "x", q, builtin_rows=0), nan_ok=True)


def test_infinite_reference_is_nobodys_neighbour():
    r = np.array([[0.0, 0.0], [np.inf, 0.0], [1.0, 1.0]])
    i, j, d = knn.closest(np.array([[0.1, 0.0]]), np.array([9]), r, np.arange(3), 2, None, False)
    assert i.tolist() == [0, 0] and sorted(j.tolist()) == [0, 2]


def test_forest_draws_from_the_whole_table(spark):
    df = spark.range(60_000).select(F.col("id").alias("record_id"), F.rand(1).alias("x"))
    drawn = iforest._tree_samples(df, ["x"], "record_id", 100, 256, 42)
    assert drawn.groupBy("tree").count().where("count = 256").count() == 100
    # 25,600 draws from 60,000 rows; independent ones would reach about 20,800 different rows, bounded repeats some more.
    assert 20_000 < drawn.select("id").distinct().count() < 24_500


def test_strict_replies(spark):
    df = spark.createDataFrame([("{'summary': 'x'}",), ('{"summary": "y"}',), ("\n plain \n",)], "reply string")
    event = F.struct(F.lit(0.5).alias("ensemble_score"), F.lit("a").alias("src_asset"), F.lit("b").alias("dst_asset"), F.lit("Read").alias("mms_service"), F.lit("t").alias("timestamp"))
    got = [r[0] for r in df.select(detection_finding(event, F.col("reply"))["summary"]).collect()]
    assert got == ["{'summary': 'x'}", "y", "plain"]


def test_damaged_index_is_built_again(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "breaker opened on command"), (2, "b", "relay reset")], "doc_id long, source string, text string")
    path = str(tmp_path / "index")
    retrieval.save_index(retrieval.index_documents(docs), path)
    for part in (tmp_path / "index" / "versions").glob("*/vectors/*.parquet"):
        part.write_bytes(b"damaged")
    assert retrieval.load_index(spark, path) is None
    assert retrieval.load_or_build(spark, path, docs).chunks.count() == 2


def test_a_save_that_breaks_off_leaves_the_version_before(spark, tmp_path, monkeypatch):
    """Every write of the save fails once, the manifest's too."""
    path = str(tmp_path / "set")
    rows = lambda n: {name: spark.range(n + i).toDF("x") for i, name in enumerate(("one", "two", "three"))}
    published.publish(rows(5), path, {"n": 5})

    class Broken(Exception):
        pass

    for at in range(4):
        writes = iter(range(100))

        def breaking(real):
            def write(self, *args, **kwargs):
                if next(writes) == at:
                    raise Broken
                return real(self, *args, **kwargs)

            return write

        with monkeypatch.context() as patch:
            for kind in ("parquet", "text"):
                patch.setattr(DataFrameWriter, kind, breaking(getattr(DataFrameWriter, kind)))
            with pytest.raises(Broken):
                published.publish(rows(7), path, {"n": 7})
        found = published.latest(spark, path)
        assert found.facts == {"n": 5} and [found.tables[n].count() for n in ("one", "two", "three")] == [5, 6, 7]
    newer = published.publish(rows(7), path, {"n": 7})
    assert published.latest(spark, path).name == newer
    next((tmp_path / "set" / "versions" / newer / "two").glob("*.parquet")).unlink()  # rows are missing: passed over
    assert published.latest(spark, path).facts == {"n": 5}
    assert published.latest(spark, str(tmp_path / "nothing")) is None


def test_alerts_are_written_once(spark, tmp_path):
    path = str(tmp_path / "alerts")
    alerts = spark.createDataFrame([(i, f"p{i}", False, "mock", None) for i in (1, 2, 3, 3)], "record_id long, payload string, sent boolean, mode string, status_code int")
    for run, part in (("a", alerts.where("record_id < 3")), ("a", alerts.where("record_id < 3")), ("b", alerts), ("b", alerts), ("c", alerts.limit(0))):
        sinks.append_alerts(part, path, run)
    rows = sinks.read_alerts(spark, path).collect()
    assert sorted((r["record_id"], r["run"]) for r in rows) == [(1, "a"), (2, "a"), (3, "b")]
    sinks.append_alerts(alerts.where("record_id = 1"), path, "a")  # the first run is repeated with other rows
    assert sorted(r["record_id"] for r in sinks.read_alerts(spark, path).collect()) == [1, 3]


def test_null_keys_carry_rows_over_buckets(spark):
    df = spark.range(1200).select("id", F.when(F.col("id") % 5 < 2, F.lit("k")).alias("key"), (F.col("id") % 7).cast("double").alias("v"))
    plain = df.withColumn("s", F.sum("v").over(Window.partitionBy("key").orderBy("id").rowsBetween(-3, 0)))
    windows = {"s": lambda w: F.sum("v").over(w.rowsBetween(-3, 0))}
    for coarse in (ordered.COARSE, 4):
        got = ordered.over_order(df, windows, ["id"], keys=["key"], columns=["v"], lookback=3, bucket_rows=50, coarse=coarse)
        assert plain.select("id", "s").exceptAll(got.select("id", "s")).count() == 0


def test_buckets_stay_small_however_many_there_are(spark):
    """An order cut twice: four points in the plan, a table of cuts inside; rows per bucket do not grow with the table."""
    windows = {"s": lambda w: F.sum("v").over(w.rowsBetween(-9, 0))}
    for n in (4_000, 32_000):
        df = store(spark.range(n).select("id", (F.col("id") * 7919 % 101).cast("double").alias("v")), "order")
        buckets = ordered.cut_order(df, ["id"], bucket_rows=100, coarse=4)
        assert len(buckets.points) <= 6 and buckets.fine is not None
        sizes = buckets.place(df).groupBy(ordered.BUCKET).count()
        assert sizes.agg(F.max("count")).first()[0] < 400 and sizes.count() > n / 400
        plain = df.withColumn("s", F.sum("v").over(Window.orderBy("id").rowsBetween(-9, 0)))
        got = ordered.over_order(df, windows, ["id"], columns=["v"], lookback=9, bucket_rows=100, coarse=4)
        assert got.count() == n and plain.select("id", "s").exceptAll(got.select("id", "s")).count() == 0


def test_many_category_values_are_encoded_without_columns(spark):
    """A value for every row: more than the dense form takes; unseen values and nulls set nothing."""
    df = spark.range(300_000).select("id", F.concat(F.lit("v"), "id").alias("tag"), F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("kind"))
    values = features.value_table(df, ["tag", "kind"])
    assert values.count() == 300_002 and values.agg(F.count_distinct("index"), F.min("index"), F.max("index")).first()[:] == (300_002, 0, 300_001)
    vectors = features.sparse_one_hot(df.union(spark.createDataFrame([(-1, "never", "1"), (-2, None, None)], "id long, tag string, kind string")), values, ["tag", "kind"])
    assert vectors.columns == ["id", "indicators"]
    held = {r["n"]: r["count"] for r in vectors.select(F.size("indicators.indices").alias("n")).groupBy("n").count().collect()}
    assert held == {2: 200_000, 1: 100_001, 0: 1}
    back = vectors.where("id = 7").select(F.explode("indicators.indices").alias("index")).join(values, "index").collect()
    assert {(r["column"], r["value"]) for r in back} == {("tag", "v7"), ("kind", "1")}


def test_quantile_of_values_of_all_scales_takes_few_passes(spark, monkeypatch):
    """Values over 600 powers of ten, most rows one value, and weights: the same as sorting, in a handful of passes."""
    draw = np.random.default_rng(9)
    values = np.concatenate([10.0 ** draw.uniform(-300, 300, 6000), np.full(3000, 1e-5), -(10.0 ** draw.uniform(-300, 300, 1000))])
    df = store(spark.createDataFrame([(float(v), int(w)) for v, w in zip(values, draw.integers(1, 4, len(values)))], "x double, w long"), "scales")
    passes = []
    real = quantile.F.percentile_approx
    monkeypatch.setattr(quantile.F, "percentile_approx", lambda *a: passes.append(1) or real(*a))
    whole = np.repeat(*map(np.array, zip(*[(r["x"], r["w"]) for r in df.collect()])))
    for q in (0.01, 0.35, 0.5, 0.99):
        passes.clear()
        assert exact_quantile(df, "x", q, weight="w", builtin_rows=0) == pytest.approx(np.quantile(whole, q), rel=1e-12)
        assert len(passes) <= 3
