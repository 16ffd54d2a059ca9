from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ohmwatch import fixed_values as V
from ohmwatch.functions import incidents as I
from ohmwatch.operators.retrieval import index_documents
from ohmwatch.plans import incidents

EVENT = {"request_rate": 82.0, "packet_size": 68.0}


@pytest.fixture(scope="module")
def flagged(spark):
    rows = [
        (1, "2026-01-01 00:00:21", "RTU-02", "IED-Breaker-A", "Read", 0.9, 82.0, 12.0, 0.1, 0.0),
        (2, "2026-01-01 00:00:22.5", None, None, None, 0.6, 5.0, 45.0, 9.0, 0.9),
        (3, "2026-01-01 00:00:23", "RTU-01", "NAN-Gateway", "Write", 0.7, 5.0, None, -3.0, 0.9),
        (4, "2026-01-01 00:00:24", "RTU-01", "NAN-Gateway", "Read", 0.7, 5.0, 1.0, 1.0, 0.9),
        (5, "2026-01-01 00:00:25", "RTU-01", "NAN-Gateway", "Read", 0.7, 5.0, 1.0, 1.0, 0.1),
    ]
    df = spark.createDataFrame(
        rows,
        "record_id long, timestamp string, src_asset string, dst_asset string, mms_service string, ensemble_score double,"
        " request_rate double, latency_ms double, value_deviation double, duplicate_ratio double",
    ).withColumn("timestamp", F.to_timestamp("timestamp"))
    return df.select("record_id", incidents.event(df).alias("event"))


def test_event_defaults_and_missing_features(flagged):
    e = flagged.where("record_id = 3").first()["event"]
    assert e["if_is_anomaly"] and e["lof_is_anomaly"] and "latency_ms" not in e["raw_features"]
    assert flagged.where("record_id = 2").first()["event"]["timestamp"] == "2026-01-01 00:00:22.500000"


def test_rules_and_labels(flagged):
    out = incidents.reports(incidents.findings(flagged)).orderBy("record_id").collect()
    assert [r["attack_type"] for r in out] == [
        "Denial of Service", "Man-in-the-Middle", "False Data Injection", "Replay", "Unknown",
    ]
    first = out[0]
    assert "denial of service" in first["root_cause"].lower() and first["target"] == "IED-Breaker-A"
    assert first["severity"] == "High" and first["impact"] == V.IMPACT_TEXTS["High"] and first["confidence"] == 0.8
    assert first["recommended_actions"] == V.ESCALATION and first["protocol"] == "MMS"


def test_detection_finding(flagged):
    for row in incidents.findings(flagged).collect():
        assert row["detection"]["summary"] and 0 <= row["detection"]["confidence"] <= 1


def test_risk_profiles(spark):
    df = spark.createDataFrame([("IED-Breaker-A", 0.9), ("RTU-01", 0.4), (None, 0.4)], "t string, s double")
    fallback = [r[0] for r in df.select(I.risk(F.col("t"), F.col("s"))).collect()]
    assert [r["asset_criticality"] for r in fallback] == ["High", "Medium", "Medium"]
    assert fallback[0]["business_risk_score"] == 0.9 and fallback[0]["attack_severity"] == "Medium"
    canned = df.select(I.risk(F.col("t"), F.col("s"), "canned")).first()[0]
    assert tuple(canned) == V.CANNED_RISK
    reply = F.lit('{"asset_criticality": "", "attack_severity": "Low", "business_risk_score": "0.25"}')
    parsed = df.select(I.risk(F.col("t"), F.col("s"), reply=reply)).first()[0]
    assert tuple(parsed) == ("High", "Medium", "Low", 0.25)
    total = df.select(I.weighted_risk(I.risk(F.col("t"), F.col("s"), "canned"), F.lit(0.8))).first()[0]
    assert total == pytest.approx(0.35 + 0.15 + 0.25 + 0.08)


def test_alert_rules(spark):
    df = spark.createDataFrame([("Low",), ("Medium",), ("High",), ("Critical",), ("Strange",), (None,)], "s string")
    s = F.col("s")
    assert [r[0] for r in df.select(I.should_notify(s)).collect()] == [False, True, True, True, True, True]
    assert [r[0] for r in df.select(I.should_notify(s, "Critical")).collect()] == [False, False, False, True, True, True]
    assert all(r[0] for r in df.select(I.should_notify(s, "Other")).collect())
    assert [r[0]["mode"] for r in df.select(I.dispatch(s)).collect()][:2] == ["skipped", "mock"]
    assert [r[0] for r in df.select(I.impact_text(s)).collect()][3] == "Unknown"


REPLIES = {
    '{"likely_cause": "x", "supporting_evidence": ["a", "b"], "confidence": 0.7}': ("x", ["a", "b"], 0.7),
    '{"likely_cause": "x", "confidence": "0.25"}': ("x", [], 0.25),
    '{"likely_cause": "x"} and more': (V.UNKNOWN_CAUSE, [], 0.5),
    '{"likely_cause": "x"': (V.UNKNOWN_CAUSE, [], 0.5),
    "no json": (V.UNKNOWN_CAUSE, [], 0.5),
    "": (V.UNKNOWN_CAUSE, [], 0.5),
    None: (V.UNKNOWN_CAUSE, [], 0.5),
    "{}": (V.UNKNOWN_CAUSE, [], 0.5),
}


def test_replies(spark):
    df = spark.createDataFrame([(r,) for r in REPLIES], "reply string")
    for row in df.select("reply", I.cause_from_reply(F.col("reply")).alias("c")).collect():
        assert tuple(row["c"]) == REPLIES[row["reply"]]
    actions = spark.createDataFrame([('{"recommended_actions": []}',), ('{"recommended_actions": ["x"]}',), ("?",)], "r string")
    assert [r[0] for r in actions.select(I.actions_from_reply(F.col("r"))).collect()] == [V.ESCALATION, ["x"], V.ESCALATION]


def test_query_text(spark):
    df = spark.createDataFrame([("Read", "flood"), (None, ""), ("", None)], "service string, hint string")
    got = [r[0] for r in df.select(I.query_text(F.col("service"), F.col("hint"))).collect()]
    assert got == ["flood Read ICS smart grid attack", "ICS smart grid attack", "ICS smart grid attack"]


def test_numbers_in_text(spark):
    df = spark.createDataFrame([('{"request_rate": 82.5, "x": 1}',), ('{"request_rate" : -3}',), ("none",)], "t string")
    assert [r[0] for r in df.select(I.json_number(F.col("t"), "request_rate")).collect()] == [82.5, -3.0, None]


def test_knowledge_text_can_decide_the_cause(spark, flagged):
    documents = spark.createDataFrame(
        [(1, "a.txt", "Smart grid attack notes on false data injection and ICS")], "doc_id long, source string, text string"
    )
    found = incidents.attach_knowledge(flagged, index_documents(documents))
    assert all(len(r["knowledge_references"]) == 1 for r in found.collect())
    by_rules = incidents.reports(incidents.findings(found)).where("record_id = 5").first()
    by_text = incidents.reports(incidents.findings(found, context_keywords=True)).where("record_id = 5").first()
    assert by_rules["attack_type"] == "Unknown" and by_text["attack_type"] == "False Data Injection"


def test_alert_payload_is_the_report(flagged):
    row = incidents.alerts(incidents.reports(incidents.findings(flagged))).where("record_id = 1").first()
    payload = json.loads(row["payload"])
    assert set(payload) == set(incidents.REPORT) and payload["severity"] == "High"
    assert (row["sent"], row["mode"], row["status_code"]) == (False, "mock", None)
