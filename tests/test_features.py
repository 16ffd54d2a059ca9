from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ohmwatch.operators import features as f
from ohmwatch.operators.ordered import over_order
from ohmwatch.operators.quantile import exact_quantile
from ohmwatch.operators import split
from ohmwatch.schema import FEATURES, KEY, TRAFFIC
from ohmwatch.sources.traffic import ingest_events, read_traffic, traffic_from_json
from ohmwatch.sources.sinks import write_csv
from ohmwatch.session import scratch_path

from conftest import SF, labelled_frame


def pandas_features(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["timestamp", "record_id"]).reset_index(drop=True)
    size = frame["packet_size"]
    return pd.DataFrame(
        {
            "record_id": frame["record_id"],
            "mean": frame["request_rate"].rolling(10, min_periods=1).mean().fillna(0),
            "std": frame["latency_ms"].rolling(10, min_periods=1).std().fillna(0),
            "z": ((size - size.mean()) / (size.std() + 1e-6)).fillna(0),
        }
    ).sort_values("record_id")


@pytest.mark.parametrize("bucket_rows", [250_000, 40])
def test_matrix_equals_pandas_with_gaps_and_ties(spark, bucket_rows):
    frame = labelled_frame(400, 0.2, 2)
    frame.loc[5:9, "latency_ms"] = np.nan
    frame.loc[50:70, "request_rate"] = np.nan
    frame.loc[100:220, "timestamp"] = frame.loc[100, "timestamp"]
    out = f.feature_matrix(spark.createDataFrame(frame, TRAFFIC), bucket_rows=bucket_rows).toPandas()
    assert list(out.columns) == [KEY, "timestamp", "label", "attack_type", *FEATURES]
    assert len(out) == 400 and not out[FEATURES].isna().any().any()
    out, expected = out.sort_values(KEY), pandas_features(frame)
    np.testing.assert_allclose(out["rolling_request_rate_mean"], expected["mean"], atol=1e-9)
    np.testing.assert_allclose(out["rolling_latency_std"], expected["std"], atol=1e-6)
    np.testing.assert_allclose(out["packet_size_zscore"], expected["z"], atol=1e-9)


def test_one_row_and_empty_batches(spark):
    one = spark.createDataFrame(labelled_frame(1, 0.0, 4), TRAFFIC)
    row = f.feature_matrix(one).first()
    assert row["packet_size_zscore"] == 0 and row["rolling_latency_std"] == 0
    assert f.feature_matrix(one.limit(0)).count() == 0


def test_bucketed_windows_with_a_hot_key_and_sparse_keys(spark):
    rng = np.random.default_rng(1)
    keys = np.where(rng.random(3000) < 0.6, "hot", rng.integers(0, 400, 3000).astype(str))
    frame = pd.DataFrame({"id": np.arange(3000), "k": keys, "t": rng.integers(0, 500, 3000), "v": rng.random(3000)})
    df = spark.createDataFrame(frame)
    build = {"s": lambda w: F.sum("v").over(w.rowsBetween(-4, 0)), "p": lambda w: F.lag("id", 3).over(w)}
    whole = over_order(df, build, ["t", "id"], ["k"], ["v"], 4).toPandas()
    cut = over_order(df, build, ["t", "id"], ["k"], ["v"], 4, bucket_rows=50).toPandas()
    a, b = whole.sort_values("id", ignore_index=True), cut.sort_values("id", ignore_index=True)
    pd.testing.assert_frame_equal(a, b[a.columns])


def test_ingest_does_not_depend_on_bucket_size(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    a = ingest_events(events).toPandas().sort_values(KEY, ignore_index=True)
    b = ingest_events(events, bucket_rows=60).toPandas().sort_values(KEY, ignore_index=True)
    pd.testing.assert_frame_equal(a, b)


def test_ingest_plan_never_sorts_all_rows_of_an_asset_in_one_task(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    plan = ingest_events(events, bucket_rows=60)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("q", [0.0, 0.13, 0.5, 0.9, 1.0])
def test_quantile_by_narrowing_equals_numpy(spark, q):
    values = np.concatenate([np.full(700, 3.25), np.random.default_rng(5).normal(size=900), [1e9, -1e9]])
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    expected = np.quantile(values, q)
    assert exact_quantile(df, "v", q) == pytest.approx(expected, rel=1e-12)
    assert exact_quantile(df, "v", q, builtin_rows=0) == pytest.approx(expected, rel=1e-12)


def test_weighted_quantile_counts_rows_several_times(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 1), (9.0, 4)], "v double, w int")
    expected = np.quantile([1.0] * 5 + [2.0] + [9.0] * 4, 0.55)
    assert exact_quantile(df, "v", 0.55, "w") == pytest.approx(expected)
    assert exact_quantile(df, "v", 0.55, "w", builtin_rows=0) == pytest.approx(expected)


def test_align_one_hot_clip_and_fill(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "z", float("nan")), (3, None, None)], "record_id long, c string, v double")
    assert f.fit_categories(df, ["c"]) == {"c": ["a", "z"]}
    hot = f.one_hot(df, {"c": ["a", "b"]}).orderBy(KEY).collect()
    assert [(r["c_a"], r["c_b"]) for r in hot] == [(True, False), (False, False), (False, False)]
    assert f.numeric_columns(f.one_hot(df, {"c": ["a"]})) == ["v"]
    filled = f.fill_missing(df, ["v"]).orderBy(KEY)
    assert [r["v"] for r in filled.collect()] == [2.0, 0.0, 0.0]
    aligned = f.align(filled, ["w", "v"], [KEY])
    assert aligned.columns == [KEY, "w", "v"] and aligned.first()["w"] == 0.0
    clipped = df.select(f.clip(F.col("v"), 3.0).alias("x")).collect()
    assert clipped[0]["x"] == 3.0 and clipped[2]["x"] is None


def test_minmax_of_a_flat_column_is_zero(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert {r["s"] for r in f.add_minmax(df, "v", "s").collect()} == {0.0}


def test_split_is_a_partition_and_repeatable(spark):
    df = spark.range(2000).withColumnRenamed("id", KEY)
    train, test = split.split(df)
    assert train.count() + test.count() == 2000 and 0.65 < train.count() / 2000 < 0.75
    assert split.without(df, train).exceptAll(test).count() == 0
    again, _ = split.split(df.repartition(7))
    assert again.exceptAll(train).count() == 0


def test_csv_and_json_sources(spark, labelled):
    path = scratch_path(spark, "csv")
    write_csv(labelled, path)
    assert read_traffic(spark, path, "csv").exceptAll(labelled).count() == 0
    text = (
        '[{"timestamp": "2026-01-01T00:00:00", "packet_size": 70, "inter_arrival_ms": 3, "request_rate": 85,'
        ' "latency_ms": 55, "jitter_ms": 2, "duplicate_ratio": 0.05, "value_deviation": 0.1, "mms_service": "Read",'
        ' "src_asset": "RTU-01", "dst_asset": "NAN-Gateway"}]'
    )
    df = spark.createDataFrame([(1, text), (2, "[]")], "request long, records string")
    rows = traffic_from_json(df, "records").collect()
    assert len(rows) == 1 and rows[0]["packet_size"] == 70.0 and rows[0]["timestamp"].year == 2026
