"""Texts, levels and rule limits that results must carry unchanged."""

# Rule limits on the raw features of an event, and the keywords that count when rules read free text.
DOS_REQUEST_RATE = 30
MITM_LATENCY_MS = 30
FDI_VALUE_DEVIATION = 2
REPLAY_DUPLICATE_RATIO = 0.5
DOS_WORDS = ["dos"]
MITM_WORDS = ["mitm", "man-in-the-middle"]
FDI_WORDS = ["fdi", "false data injection"]
REPLAY_WORDS = ["replay"]

# Cause sentences and their evidence.
DOS_CAUSE = (
    "Traffic pattern consistent with a Denial of Service attempt against the target asset: "
    "elevated request rate with reduced packet size."
)
DOS_EVIDENCE = ["request_rate significantly above baseline", "packet_size below normal operating range"]
MITM_CAUSE = (
    "Traffic pattern consistent with a Man-in-the-Middle interception: elevated latency and jitter."
)
MITM_EVIDENCE = ["latency_ms above baseline", "jitter_ms elevated", "unexpected src/dst asset pairing"]
FDI_CAUSE = (
    "Reported value statistically inconsistent with historical baseline, consistent with False Data Injection."
)
FDI_EVIDENCE = ["value_deviation outside normal range", "Write/Report service call involved"]
REPLAY_CAUSE = "Near-duplicate payloads with unnaturally regular timing, consistent with a Replay attack."
REPLAY_EVIDENCE = ["duplicate_ratio elevated", "inter_arrival_ms unusually consistent"]
OTHER_CAUSE = (
    "Anomalous protocol pattern flagged, but evidence is insufficient to attribute a specific attack technique."
)
OTHER_EVIDENCE = ["Deviation from baseline traffic profile", "No single feature dominates the anomaly score"]
CAUSE_CONFIDENCE = 0.8

# What stands in when a reply does not parse or lacks a field.
UNKNOWN_CAUSE = "Unable to determine root cause from available context."
UNKNOWN_CONFIDENCE = 0.5
DEFAULT_LEVEL = "Medium"
ESCALATION = ["Escalate to on-call ICS security engineer for manual review."]

# Attack-type labels and the words that select them, first match wins.
ATTACK_LABELS = {
    "Denial of Service": ["dos", "denial of service", "flood"],
    "Man-in-the-Middle": ["mitm", "man-in-the-middle", "man in the middle"],
    "False Data Injection": ["fdi", "false data injection", "spoof"],
    "Replay": ["replay", "duplicate"],
}
UNKNOWN_ATTACK = "Unknown"

# Risk levels.
HIGH_CRITICALITY_ASSETS = ["IED-Breaker-A", "IED-Breaker-B", "Merging-Unit-01"]
CANNED_RISK = ("High", "Medium", "High", 0.78)
RISK_WEIGHTS = {
    "asset_criticality": 0.35,
    "operational_impact": 0.30,
    "attack_severity": 0.25,
    "confidence": 0.10,
}
CANNED_ACTIONS = [
    "Isolate affected asset from the control network segment",
    "Enable enhanced monitoring on related IEDs",
    "Notify on-call ICS security engineer",
]

# Reports and alerts.
PROTOCOL = "MMS"
IMPACT_TEXTS = {
    "Low": "Minimal - no operational disruption expected",
    "Medium": "Possible degraded monitoring/control visibility",
    "High": "Communication disruption / potential loss of protective function",
}
UNKNOWN_IMPACT = "Unknown"
SEVERITY_ORDER = ["Low", "Medium", "High", "Critical"]
NOTIFY_THRESHOLD = "Medium"
KNOWLEDGE_QUERY = "ICS smart grid attack"
