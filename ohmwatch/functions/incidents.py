"""Incident columns: findings, risk, response, report and alert, each an expression over its inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

from ohmwatch import fixed_values as V
from ohmwatch.functions.text import strip


def texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def any_word(column: Column, words: Sequence[str]) -> Column:
    """Whether any of the words occurs anywhere in the lower-cased text."""
    lowered = F.lower(column)
    found = F.lit(False)
    for word in words:
        found = found | lowered.contains(word)
    return found


def json_number(text: Column, key: str) -> Column:
    """The plain decimal number that follows ``"key":`` in a text, null when there is none."""
    digits = F.regexp_extract(text, f'"{key}"\\s*:\\s*(-?\\d+\\.?\\d*)', 1)
    return F.when(digits != "", digits.cast("double"))


def detection_summary(event: Column) -> Column:
    """One sentence on what the detectors flagged."""
    flagged = F.concat_ws(
        " and ",
        F.when(event["if_is_anomaly"], F.lit("isolation forest")),
        F.when(event["lof_is_anomaly"], F.lit("local outlier factor")),
    )
    return F.concat(
        F.coalesce(event["mms_service"], F.lit("unknown")),
        F.lit(" traffic from "),
        F.coalesce(event["src_asset"], F.lit("unknown")),
        F.lit(" to "),
        F.coalesce(event["dst_asset"], F.lit("unknown")),
        F.lit(" at "),
        event["timestamp"],
        F.lit(" flagged by "),
        F.when(flagged == "", F.lit("ensemble score")).otherwise(flagged),
    )


def detection_finding(event: Column, reply: Column | None = None) -> Column:
    """Summary and confidence; a stored reply replaces the template, as a whole when it does not parse."""
    summary = detection_summary(event)
    if reply is not None:
        parsed = parse_reply(reply, T.StructType([T.StructField("summary", T.StringType())]))
        summary = F.coalesce(parsed["summary"], strip(reply))
    return F.struct(summary.alias("summary"), event["ensemble_score"].alias("confidence"))


def _finding(cause: str, evidence: Sequence[str]) -> Column:
    return F.struct(
        F.lit(cause).alias("likely_cause"),
        texts(evidence).alias("supporting_evidence"),
        F.lit(V.CAUSE_CONFIDENCE).alias("confidence"),
    )


def root_cause(features: Column, context: Column | None = None) -> Column:
    """First rule that matches the event's raw features; a missing feature counts as 0.

    With ``context`` the rules read that text instead: its keywords, and the numbers in its JSON.
    """

    def number(name: str) -> Column:
        if context is None:
            return F.coalesce(F.try_element_at(features, F.lit(name)), F.lit(0.0))
        return F.coalesce(json_number(F.lower(context), name), F.lit(0.0))

    def rule(words: Sequence[str], limit: Column) -> Column:
        return limit if context is None else any_word(context, words) | limit

    dos = rule(V.DOS_WORDS, number("request_rate") > V.DOS_REQUEST_RATE)
    mitm = rule(V.MITM_WORDS, number("latency_ms") > V.MITM_LATENCY_MS)
    fdi = rule(V.FDI_WORDS, F.abs(number("value_deviation")) > V.FDI_VALUE_DEVIATION)
    replay = rule(V.REPLAY_WORDS, number("duplicate_ratio") > V.REPLAY_DUPLICATE_RATIO)
    return (
        F.when(dos, _finding(V.DOS_CAUSE, V.DOS_EVIDENCE))
        .when(mitm, _finding(V.MITM_CAUSE, V.MITM_EVIDENCE))
        .when(fdi, _finding(V.FDI_CAUSE, V.FDI_EVIDENCE))
        .when(replay, _finding(V.REPLAY_CAUSE, V.REPLAY_EVIDENCE))
        .otherwise(_finding(V.OTHER_CAUSE, V.OTHER_EVIDENCE))
    )


def attack_label(cause: Column) -> Column:
    """Attack type named by a cause text."""
    label = F.lit(V.UNKNOWN_ATTACK)
    for name, words in reversed(list(V.ATTACK_LABELS.items())):
        label = F.when(any_word(cause, words), F.lit(name)).otherwise(label)
    return label


def risk(target: Column, ensemble_score: Column, profile: str = "fallback", reply: Column | None = None) -> Column:
    """Risk levels and business score.

    ``canned`` is the constant reply, ``fallback`` the asset rule with medium levels; a stored reply comes
    before either and is completed by the fallback.
    """
    asset_rule = F.when(target.isin(*V.HIGH_CRITICALITY_ASSETS), F.lit("High")).otherwise(F.lit(V.DEFAULT_LEVEL))
    fallback = [asset_rule, F.lit(V.DEFAULT_LEVEL), F.lit(V.DEFAULT_LEVEL), ensemble_score]
    names = ["asset_criticality", "operational_impact", "attack_severity", "business_risk_score"]
    if reply is not None:
        parsed = parse_reply(reply, T.StructType([T.StructField(n, T.StringType()) for n in names]))
        given = [F.nullif(parsed[names[0]], F.lit("")), parsed[names[1]], parsed[names[2]]]
        given.append(parsed[names[3]].try_cast("double"))
        values = [F.coalesce(a, b) for a, b in zip(given, fallback)]
    elif profile == "canned":
        values = [F.lit(v) for v in V.CANNED_RISK]
    else:
        values = fallback
    return F.struct(*[v.alias(n) for v, n in zip(values, names)])


def level_value(level: Column) -> Column:
    """Low, Medium and High as 0, 0.5 and 1; the scale is ours, an unknown level counts as Medium."""
    return F.when(level == "Low", F.lit(0.0)).when(level == "High", F.lit(1.0)).otherwise(F.lit(0.5))


def weighted_risk(assessment: Column, confidence: Column) -> Column:
    """Risk score from levels and confidence with the configured weights."""
    total = confidence * V.RISK_WEIGHTS["confidence"]
    for name in ("asset_criticality", "operational_impact", "attack_severity"):
        total = total + level_value(assessment[name]) * V.RISK_WEIGHTS[name]
    return total


def response_actions(given: Column | None = None, profile: str = "fallback") -> Column:
    """Recommended actions; none or an empty list becomes the escalation line."""
    if profile == "canned":
        return texts(V.CANNED_ACTIONS)
    if given is None:
        return texts(V.ESCALATION)
    return F.when(F.size(given) > 0, given).otherwise(texts(V.ESCALATION))


def impact_text(severity: Column) -> Column:
    text = F.lit(V.UNKNOWN_IMPACT)
    for level, sentence in V.IMPACT_TEXTS.items():
        text = F.when(severity == level, F.lit(sentence)).otherwise(text)
    return text


def should_notify(severity: Column, threshold: str = V.NOTIFY_THRESHOLD) -> Column:
    """Whether a severity reaches the threshold; an unknown one always does."""
    order = texts(V.SEVERITY_ORDER)
    rank = F.array_position(order, severity)
    if threshold not in V.SEVERITY_ORDER:
        return F.lit(True)
    least = V.SEVERITY_ORDER.index(threshold) + 1
    return F.coalesce((rank == 0) | (rank >= least), F.lit(True))


def dispatch(severity: Column, threshold: str = V.NOTIFY_THRESHOLD, target_set: bool = False) -> Column:
    """Status of an alert before any external sender: below threshold, logged only, or due to be sent."""
    due = F.lit("live" if target_set else "mock")
    return F.struct(
        F.lit(False).alias("sent"),
        F.when(should_notify(severity, threshold), due).otherwise(F.lit("skipped")).alias("mode"),
        F.lit(None).cast("int").alias("status_code"),
    )


def query_text(service: Column, hint: Column | None = None) -> Column:
    """Retrieval query of an event: its non-empty parts joined by blanks."""
    blank = F.lit("")
    parts = [F.nullif(part, blank) for part in ([hint] if hint is not None else []) + [service]]
    return strip(F.concat_ws(" ", *parts, F.lit(V.KNOWLEDGE_QUERY)))


def parse_reply(reply: Column, schema: T.StructType) -> Column:
    """Fields of a JSON reply; text that is not exactly one JSON value gives nulls.

    A parser alone stops after the first value and would accept text behind it; inside an array it cannot.
    """
    wrapped = F.concat(F.lit("["), reply, F.lit("]"))
    values = F.from_json(wrapped, T.ArrayType(schema), {"mode": "PERMISSIVE", "allowSingleQuotes": "false"})
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def cause_from_reply(reply: Column) -> Column:
    """Root-cause finding in a stored reply, with defaults for what is missing."""
    parsed = parse_reply(
        reply,
        T.StructType(
            [
                T.StructField("likely_cause", T.StringType()),
                T.StructField("supporting_evidence", T.ArrayType(T.StringType())),
                T.StructField("confidence", T.StringType()),
            ]
        ),
    )
    none = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(parsed["likely_cause"], F.lit(V.UNKNOWN_CAUSE)).alias("likely_cause"),
        F.coalesce(parsed["supporting_evidence"], none).alias("supporting_evidence"),
        F.coalesce(parsed["confidence"].try_cast("double"), F.lit(V.UNKNOWN_CONFIDENCE)).alias("confidence"),
    )


def actions_from_reply(reply: Column) -> Column:
    schema = T.StructType([T.StructField("recommended_actions", T.ArrayType(T.StringType()))])
    return response_actions(parse_reply(reply, schema)["recommended_actions"])


def event_json(event: Column, names: Sequence[str]) -> Column:
    """The event as JSON, numbers with six decimals so that the text does not depend on the engine."""
    number = "decimal(28,6)"
    features = F.struct(*[F.try_element_at(event["raw_features"], F.lit(n)).cast(number).alias(n) for n in names])
    return F.to_json(
        F.struct(
            event["timestamp"].alias("timestamp"),
            event["src_asset"].alias("src_asset"),
            event["dst_asset"].alias("dst_asset"),
            event["mms_service"].alias("mms_service"),
            event["ensemble_score"].cast(number).alias("ensemble_score"),
            event["if_is_anomaly"].alias("if_is_anomaly"),
            event["lof_is_anomaly"].alias("lof_is_anomaly"),
            features.alias("raw_features"),
        )
    )


def bullets(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda line: F.concat(F.lit("- "), line)), "\n")


def detection_prompt(event_text: Column) -> Column:
    return F.concat(
        F.lit("Anomaly event:\n"), event_text, F.lit("\n\nSummarize what the detector flagged in 1-2 sentences.")
    )


def cause_prompt(summary: Column, event_text: Column, references: Column) -> Column:
    return F.concat(
        F.lit("Detection finding: "), summary,
        F.lit("\n\nAnomaly event:\n"), event_text,
        F.lit("\n\nRelevant knowledge base context:\n"), bullets(references),
    )


def risk_prompt(cause: Column, target: Column, ensemble_score: Column) -> Column:
    evidence = F.array_join(cause["supporting_evidence"], "; ")
    return F.concat(
        F.lit("Root cause finding: "), cause["likely_cause"],
        F.lit("\nEvidence: "), evidence,
        F.lit("\nConfidence: "), cause["confidence"].cast("decimal(28,6)").cast("string"),
        F.lit("\nTarget asset: "), F.coalesce(target, F.lit("None")),
        F.lit("\nDetector ensemble score: "), ensemble_score.cast("decimal(28,6)").cast("string"),
    )


def response_prompt(cause: Column, assessment: Column) -> Column:
    return F.concat(
        F.lit("Root cause: "), cause["likely_cause"],
        F.lit("\nRisk: criticality="), assessment["asset_criticality"],
        F.lit(", impact="), assessment["operational_impact"],
        F.lit(", severity="), assessment["attack_severity"],
        F.lit(", business_risk_score="), assessment["business_risk_score"].cast("decimal(28,6)").cast("string"),
    )


def prompt_id(system: Column, user: Column) -> Column:
    """First eight hex digits of the SHA-256 of both prompts."""
    return F.substring(F.sha2(F.concat(system, user), 256), 1, 8)
