"""Registered queries against their SQL on the smallest data set."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
from check import compare, connect

from conftest import SF

# The others take part in the full check, which is check.py.
SELECTED = [
    "traffic_ingest", "rolling_features", "feature_matrix", "one_hot", "minmax_scale", "train_test_split", "anomaly_rates",
    "confusion_metrics", "top_anomalies", "lof_embeddings", "knn_join", "ensemble_verdict", "text_folder", "chunk_documents",
    "tfidf_weights", "retrieve_topk", "incident_report", "alert_selection", "reply_parse", "detection_replies", "risk_replies",
    "response_replies", "prompt_columns",
]


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", SELECTED)
def test_query_equals_sql(spark, db, name):
    got = entry_point.queries()[name](spark, SF).toPandas()
    assert compare(got, db.sql(entry_point.oracle_sql()[name]).df()) == ""


def test_every_sql_has_its_query(spark):
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert entry_point.entry(spark).count() > 0
