"""DuckDB SQL with the same result as the registered query of the same name."""

from __future__ import annotations

from ohmwatch import fixed_values as V
from ohmwatch.functions.text import BLANKS, CHUNK_OVERLAP, CHUNK_SIZE, REFERENCE_CHARS, TOKEN
from ohmwatch.operators import iforest
from ohmwatch.schema import CATEGORICAL, FEATURES, RAW_NUMERIC

SERVICES = ["click", "error", "purchase", "signup", "view"]
ASSETS = [f"asset-{i}" for i in range(7)]


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def r6(expression: str, name: str | None = None) -> str:
    return f"round({expression}, 6) AS {name or expression}"


def r6_all(names: list[str]) -> str:
    return ", ".join(r6(n) for n in names)


TRAFFIC = """
base AS (
  SELECT event_id AS record_id, ts AS t, epoch_us(ts) AS ts_us, value AS packet_size, props,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS mms_service,
         'asset-' || (user_id % 7) AS src_asset
  FROM events),
gaps AS (
  SELECT *, 'asset-' || (k % 7) AS dst_asset, CAST(k AS DOUBLE) AS latency_ms,
         coalesce((ts_us - lag(ts_us) OVER w) / 1e3, 0.0) AS inter_arrival_ms,
         CAST(count(*) OVER (PARTITION BY src_asset ORDER BY ts_us // 1000000
                             RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS DOUBLE) AS request_rate,
         list(props) OVER (PARTITION BY src_asset ORDER BY ts_us, record_id
                           ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS recent,
         avg(value_) OVER (PARTITION BY mms_service) AS service_mean,
         stddev_samp(value_) OVER (PARTITION BY mms_service) AS service_std
  FROM (SELECT *, packet_size AS value_ FROM base)
  WINDOW w AS (PARTITION BY src_asset ORDER BY ts_us, record_id)),
traffic AS (
  SELECT record_id, t, ts_us, packet_size, inter_arrival_ms, request_rate, latency_ms,
         coalesce(abs(inter_arrival_ms - lag(inter_arrival_ms) OVER w), 0.0) AS jitter_ms,
         CASE WHEN coalesce(len(recent), 0) = 0 THEN 0.0
              ELSE len(list_filter(recent, lambda p: p = props)) / CAST(len(recent) AS DOUBLE) END AS duplicate_ratio,
         (packet_size - service_mean) / (coalesce(service_std, 0) + 1e-6) AS value_deviation,
         mms_service, src_asset, dst_asset,
         CASE WHEN mms_service = 'error' THEN 'Attack' ELSE 'Normal' END AS label,
         CASE WHEN mms_service = 'error' THEN 'Fault' ELSE 'None' END AS attack_type
  FROM gaps
  WINDOW w AS (PARTITION BY src_asset ORDER BY ts_us, record_id))"""

SLOT = "CAST('0x' || substr(md5(CAST(record_id AS VARCHAR)), 1, 7) AS BIGINT) % 1000"


def matrix_of(source: str, name: str, stats: str | None = None, part: str = "", id: str = "record_id") -> str:
    """Features of the records of ``source``, deviations by its own moments or those of another table; of each part alone if so asked."""
    by = f"PARTITION BY {part}" if part else ""
    mean, std = f"avg(packet_size) OVER ({by})", f"stddev_samp(packet_size) OVER ({by})"
    if stats:
        mean, std = f"(SELECT avg(packet_size) FROM {stats})", f"(SELECT stddev_samp(packet_size) FROM {stats})"
    return f"""
{name} AS MATERIALIZED (
  SELECT *, {id} AS id, avg(request_rate) OVER w AS rolling_request_rate_mean,
         coalesce(stddev_samp(latency_ms) OVER w, 0.0) AS rolling_latency_std,
         (packet_size - {mean}) / (coalesce({std}, 0) + 1e-6) AS packet_size_zscore,
         {SLOT} AS slot
  FROM {source}
  WINDOW w AS ({by} ORDER BY ts_us, record_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""


MATRIX = TRAFFIC + "," + matrix_of("traffic", "matrix")


def minmax(column: str, table: str) -> str:
    lo, hi = f"(SELECT min({column}) FROM {table})", f"(SELECT max({column}) FROM {table})"
    return f"CASE WHEN {hi} - {lo} < 1e-9 THEN 0.0 ELSE ({column} - {lo}) / ({hi} - {lo}) END"


SCORED = (
    MATRIX
    + f""",
raws AS (SELECT *, abs(packet_size_zscore) AS if_raw, rolling_latency_std AS lof_raw FROM matrix),
flags AS (
  SELECT *, {minmax('if_raw', 'raws')} AS if_score, {minmax('lof_raw', 'raws')} AS lof_score,
         if_raw > (SELECT quantile_cont(if_raw, 0.9) FROM raws) AS if_is_anomaly,
         lof_raw > (SELECT quantile_cont(lof_raw, 0.9) FROM raws) AS lof_is_anomaly
  FROM raws),
scored AS (
  SELECT *, (if_score + lof_score) / 2 AS ensemble_score,
         if_is_anomaly OR lof_is_anomaly OR (if_score + lof_score) / 2 >= 0.5 AS is_anomaly
  FROM flags)"""
)

TIME_TEXT = (
    "CASE WHEN ts_us % 1000000 = 0 THEN strftime(t, '%Y-%m-%d %H:%M:%S') "
    "ELSE strftime(t, '%Y-%m-%d %H:%M:%S.%f') END"
)


def distance(width_names: list[str] | int, a: str, b: str) -> str:
    """Squared differences added from the first axis to the last, as the Spark side adds them."""
    if isinstance(width_names, int):
        terms = [f"({a}.p[{i}] - {b}.p[{i}]) * ({a}.p[{i}] - {b}.p[{i}])" for i in range(1, width_names + 1)]
    else:
        terms = [f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in width_names]
    return "sqrt(" + " + ".join(terms) + ")"


def lof_tables(axes: list[str] | int, k: int) -> str:
    """From ``train(id, ...)``: neighbours, k-distances, densities, factors."""
    d = distance(axes, "a", "b")
    return f""",
near AS (
  SELECT id, unnest(list_slice(list_sort(n), 1, {k})) AS n FROM (
    SELECT a.id, min({{'d': {d}, 'id': b.id}}, {k}) AS n
    FROM train a JOIN train b ON a.id <> b.id GROUP BY a.id)),
kdist AS (SELECT id, max(n.d) AS kd FROM near GROUP BY id),
density AS (
  SELECT near.id, 1.0 / (avg(greatest(kdist.kd, n.d)) + 1e-10) AS lrd
  FROM near JOIN kdist ON kdist.id = n.id GROUP BY near.id),
factors AS (
  SELECT near.id, avg(o.lrd) / any_value(s.lrd) AS factor
  FROM near JOIN density o ON o.id = n.id JOIN density s ON s.id = near.id GROUP BY near.id),
cutoff AS (SELECT quantile_cont(factor, 0.9) AS c FROM factors)"""


def lof_events() -> str:
    return (
        MATRIX
        + """,
train AS (SELECT * FROM matrix WHERE slot < 700),
test AS (SELECT * FROM matrix WHERE slot >= 700)"""
        + outer_lof()
    )


def outer_lof() -> str:
    """Factors of ``test`` against ``train``."""
    d = distance(FEATURES, "q", "b")
    return (
        lof_tables(FEATURES, 20)
        + f""",
found AS (
  SELECT id, unnest(n) AS n FROM (
    SELECT q.id, min({{'d': {d}, 'id': b.id}}, 20) AS n FROM test q CROSS JOIN train b GROUP BY q.id)),
outer_lrd AS (
  SELECT found.id, 1.0 / (avg(greatest(kd, n.d)) + 1e-10) AS lrd
  FROM found JOIN kdist ON kdist.id = n.id GROUP BY found.id),
outer_lof AS (
  SELECT found.id, avg(density.lrd) / any_value(o.lrd) AS factor
  FROM found JOIN density ON density.id = n.id JOIN outer_lrd o ON o.id = found.id GROUP BY found.id)"""
    )


TREES, SAMPLE, DEPTH = iforest.N_ESTIMATORS, iforest.SAMPLE_ROWS, iforest.depth_limit(iforest.SAMPLE_ROWS)
PATH = (
    "(CASE WHEN {n} <= 1 THEN 0 WHEN {n} = 2 THEN 1 ELSE round((2 * (ln({n} - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) "
    "- 2 * ({n} - 1.0::DOUBLE) / {n}) * 4294967296) / 4294967296 END)"
)


def forest_tables(train: str, scored: str, columns: list[str]) -> str:
    """``grown``, the node table of the forest of ``train(id, columns)``, and ``forest(id, score)`` of ``scored``.

    Each tree grows level by level: a node's least and greatest values, then its axis and cut from the digest of its
    place, then its rows' way down.  Every record then walks down every tree by the written nodes.
    """
    number = lambda digest, start: f"CAST('0x' || substr({digest}, {start}, 10) AS BIGINT)"
    seed, axes = iforest.SEED, len(columns)
    lows, highs = (f"[{', '.join(f'CAST({f}({c}) AS DOUBLE)' for c in columns)}]" for f in ("min", "max"))
    point = f"[{', '.join(f'CAST({c} AS DOUBLE)' for c in columns)}]"
    parts = [f"""
chance AS (SELECT {iforest.SPARE * SAMPLE * TREES}::DOUBLE / count(*) AS each FROM {train}),
dealt AS MATERIALIZED (
  SELECT DISTINCT id, tree FROM (
    SELECT id, CASE WHEN each >= {TREES} THEN go ELSE {number('digest', 11)} % {TREES} END AS tree,
           each >= {TREES} OR {number('digest', 1)} < floor(each / ceil(each) * 1099511627776) AS chosen
    FROM (SELECT *, md5(id || ':' || go || ':{seed}') AS digest FROM (
      SELECT id, each, unnest(range(CASE WHEN each >= {TREES} THEN {TREES} ELSE CAST(ceil(each) AS BIGINT) END)) AS go FROM {train}, chance)))
  WHERE chosen),
at0 AS MATERIALIZED (
  SELECT tree, id, 0 AS slot FROM (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY md5(id || ':' || tree || ':{seed}:tree'), id) AS place FROM dealt)
  WHERE place <= {SAMPLE})"""]
    for d in range(DEPTH + 1):
        parts.append(f"""
n{d} AS MATERIALIZED (
  SELECT tree, slot, {d} AS depth, size, feature, CASE WHEN cut < highs[feature] THEN cut ELSE lows[feature] END AS cut FROM (
    SELECT *, lows[feature] + {number('digest', 11)} / 1099511627776.0::DOUBLE * (highs[feature] - lows[feature]) AS cut FROM (
      SELECT *, CASE WHEN {d} = {DEPTH} OR size < 2 OR len(axes) = 0 THEN 0
                     ELSE axes[1 + CAST(floor({number('digest', 1)} / 1099511627776.0::DOUBLE * len(axes)) AS INT)] END AS feature
      FROM (SELECT *, list_filter(range(1, {axes + 1}), lambda i: highs[i] - lows[i] > 1e-9 * greatest(1.0, abs(lows[i]), abs(highs[i]))) AS axes
            FROM (SELECT tree, slot, count(*) AS size, {lows} AS lows, {highs} AS highs, md5('{seed}:' || tree || ':' || slot) AS digest
                  FROM at{d} JOIN (SELECT id, {', '.join(columns)} FROM {train}) USING (id) GROUP BY tree, slot)))))""")
        if d < DEPTH:
            parts.append(f"""
at{d + 1} AS MATERIALIZED (
  SELECT tree, id, 2 * slot + CASE WHEN {point}[feature] <= cut THEN 1 ELSE 2 END AS slot
  FROM at{d} JOIN n{d} USING (tree, slot) JOIN (SELECT id, {', '.join(columns)} FROM {train}) USING (id) WHERE feature > 0)""")
    parts.append("\ngrown AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM n{d}" for d in range(DEPTH + 1)) + ")")
    parts.append(f"\nw0 AS (SELECT id, {point} AS p, tree, 0 AS slot FROM {scored}, range({TREES}) t(tree))")
    for d in range(DEPTH):
        parts.append(f"""
w{d + 1} AS (
  SELECT id, p, tree, CASE WHEN feature = 0 THEN slot ELSE 2 * slot + CASE WHEN p[feature] <= cut THEN 1 ELSE 2 END END AS slot
  FROM w{d} JOIN grown USING (tree, slot))""")
    norm = f"({TREES} * greatest({PATH.format(n=SAMPLE)}, 1.0))"
    parts.append(f"""
forest AS MATERIALIZED (
  SELECT id, pow(2.0::DOUBLE, -sum(depth + {PATH.format(n='size')}) / {norm}) AS score FROM w{DEPTH} JOIN grown USING (tree, slot) GROUP BY id)""")
    return ",".join(parts)


def detector_tables() -> str:
    """Both models fitted on ``train``, their scores on ``test``, cutoffs and training ranges."""
    return (
        outer_lof()
        + f""",
every AS (SELECT id, {', '.join(FEATURES)} FROM train UNION ALL SELECT id, {', '.join(FEATURES)} FROM test),"""
        + forest_tables("train", "every", FEATURES)
        + """,
grades AS (SELECT score FROM forest JOIN train USING (id)),
limits AS (
  SELECT (SELECT quantile_cont(score, 0.9) FROM grades) AS if_cut, (SELECT c FROM cutoff) AS lof_cut,
         (SELECT min(score) FROM grades) AS if_lo, (SELECT max(score) FROM grades) AS if_hi,
         (SELECT min(factor) FROM factors) AS lof_lo, (SELECT max(factor) FROM factors) AS lof_hi),
raw AS MATERIALIZED (
  SELECT test.*, forest.score AS if_raw, outer_lof.factor AS lof_raw, forest.score > if_cut AS if_is_anomaly, outer_lof.factor > lof_cut AS lof_is_anomaly
  FROM test JOIN forest USING (id) JOIN outer_lof USING (id), limits)"""
    )


def split_traffic(test: str = "test_records", stats: str | None = None) -> str:
    """Traffic, train and test records, and the features of both."""
    return (
        TRAFFIC.replace("traffic AS (", "traffic AS MATERIALIZED (")
        + f""",
train_records AS (SELECT * FROM traffic WHERE {SLOT} < 700),
test_records AS (SELECT * FROM traffic WHERE {SLOT} >= 700),"""
        + matrix_of("train_records", "train")
        + ","
        + matrix_of(test, "test", stats)
    )


def verdict(scale, table: str) -> str:
    """Scaled scores, the ensemble's and the verdict, for rows of ``raw``."""
    return f"""
ranked AS (SELECT *, {scale('if')} AS if_score, {scale('lof')} AS lof_score FROM {table}),
judged AS (
  SELECT *, (if_score + lof_score) / 2 AS ensemble_score,
         if_is_anomaly OR lof_is_anomaly OR (if_score + lof_score) / 2 >= 0.5 AS is_anomaly FROM ranked)"""


def streamed() -> str:
    """Train records, and all records in two micro-batches of equal time, each with features and scores of its own."""
    scaled = lambda n: (
        f"CASE WHEN max({n}_raw) OVER p - min({n}_raw) OVER p < 1e-9 THEN 0.0 "
        f"ELSE ({n}_raw - min({n}_raw) OVER p) / (max({n}_raw) OVER p - min({n}_raw) OVER p) END"
    )
    return (
        TRAFFIC.replace("traffic AS (", "traffic AS MATERIALIZED (")
        + f""",
train_records AS (SELECT * FROM traffic WHERE {SLOT} < 700),
times AS (SELECT min(ts_us) AS lo, max(ts_us) AS hi FROM traffic),
fed AS (SELECT traffic.*, least(floor((ts_us - lo) * 2 / greatest(1, hi - lo)), 1) AS step FROM traffic, times),"""
        + matrix_of("train_records", "train")
        + ","
        + matrix_of("fed", "test", part="step", id="record_id + 1000000000000")
        + detector_tables()
        + ","
        + verdict(scaled, "raw").replace("FROM raw)", "FROM raw WINDOW p AS (PARTITION BY step))")
    )


def in_batch(name: str) -> str:
    return minmax(f"{name}_raw", "raw")


def in_training(name: str) -> str:
    return f"CASE WHEN {name}_hi - {name}_lo < 1e-9 THEN 0.0 ELSE ({name}_raw - {name}_lo) / ({name}_hi - {name}_lo) END"


BLANK_SET = lit(BLANKS)
STEP = CHUNK_SIZE - CHUNK_OVERLAP

CHUNKS = f"""
windows AS (
  SELECT doc_id, source, text, unnest(range(0, length(text), {STEP})) AS s FROM documents),
chunks AS (
  SELECT doc_id, s // {STEP} AS chunk_no, source, trim(substring(text, s + 1, {CHUNK_SIZE}), {BLANK_SET}) AS text
  FROM windows
  WHERE length(trim(substring(text, s + 1, {CHUNK_SIZE}), {BLANK_SET})) > 0)"""

TERMS = (
    CHUNKS
    + f""",
tokens AS (
  SELECT doc_id, chunk_no, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM chunks),
tf AS (SELECT doc_id, chunk_no, term, count(*) AS tf FROM tokens GROUP BY ALL)"""
)

WEIGHTS = (
    TERMS
    + """,
totals AS (SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM tf GROUP BY term),
vocabulary AS (
  SELECT term, row_number() OVER (ORDER BY tf DESC, term) - 1 AS term_id, tf, df,
         ln((1 + (SELECT count(*) FROM chunks)) / (1.0 + df)) + 1 AS idf
  FROM totals ORDER BY tf DESC, term LIMIT 4096),
raw AS (
  SELECT doc_id, chunk_no, term, tf.tf * idf AS w FROM tf JOIN vocabulary USING (term)),
weights AS (
  SELECT doc_id, chunk_no, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, chunk_no)) AS weight FROM raw)"""
)

REFERENCE = f"'[' || source || '] ' || substring(text, 1, {REFERENCE_CHARS})"


def search(queries: str, k: int = 4) -> str:
    """Hits of ``queries`` (a SELECT of query_id, text) in ``weights``."""
    return f""",
queries AS ({queries}),
asked AS (
  SELECT query_id, term, count(*) AS n
  FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM queries) GROUP BY ALL),
asked_raw AS (SELECT query_id, term, n * idf AS w FROM asked JOIN vocabulary USING (term)),
asked_weights AS (
  SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS weight FROM asked_raw),
matches AS (
  SELECT query_id, doc_id, chunk_no, round(sum(a.weight * b.weight), 9) AS score
  FROM asked_weights a JOIN weights b USING (term) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_no) AS rank FROM matches
  WHERE score > 0 QUALIFY rank <= {k})"""


KNOWLEDGE = (
    search(f"SELECT DISTINCT mms_service AS query_id, mms_service || ' {V.KNOWLEDGE_QUERY}' AS text FROM scored")
    + """,
first_chunks AS (SELECT doc_id, chunk_no FROM chunks ORDER BY doc_id, chunk_no LIMIT 4),
padded AS (
  SELECT query_id, doc_id, chunk_no, max(score) AS score FROM (
    SELECT query_id, doc_id, chunk_no, score FROM ranked
    UNION ALL SELECT query_id, doc_id, chunk_no, 0.0 FROM queries, first_chunks) GROUP BY ALL),
chosen AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_no) AS rank FROM padded
  QUALIFY rank <= 4),
knowledge AS (
  SELECT query_id AS mms_service, string_agg("""
    + REFERENCE
    + """, chr(10) ORDER BY rank) AS knowledge_references
  FROM chosen JOIN chunks USING (doc_id, chunk_no) GROUP BY query_id)"""
)


def cause_case(kind: str) -> str:
    rules = [
        (f"request_rate > {V.DOS_REQUEST_RATE}", V.DOS_CAUSE, V.DOS_EVIDENCE),
        (f"latency_ms > {V.MITM_LATENCY_MS}", V.MITM_CAUSE, V.MITM_EVIDENCE),
        (f"abs(value_deviation) > {V.FDI_VALUE_DEVIATION}", V.FDI_CAUSE, V.FDI_EVIDENCE),
        (f"duplicate_ratio > {V.REPLAY_DUPLICATE_RATIO}", V.REPLAY_CAUSE, V.REPLAY_EVIDENCE),
    ]

    def value(cause: str, evidence: list[str]) -> str:
        return lit(cause) if kind == "cause" else lit(" | ".join(evidence))

    whens = " ".join(f"WHEN {test} THEN {value(c, e)}" for test, c, e in rules)
    return f"CASE {whens} ELSE {value(V.OTHER_CAUSE, V.OTHER_EVIDENCE)} END"


def label_case(text: str) -> str:
    whens = []
    for name, words in V.ATTACK_LABELS.items():
        test = " OR ".join(f"contains(lower({text}), {lit(w)})" for w in words)
        whens.append(f"WHEN {test} THEN {lit(name)}")
    return f"CASE {' '.join(whens)} ELSE '{V.UNKNOWN_ATTACK}' END"


def impact_case(severity: str) -> str:
    whens = " ".join(f"WHEN {severity} = {lit(k)} THEN {lit(v)}" for k, v in V.IMPACT_TEXTS.items())
    return f"CASE {whens} ELSE {lit(V.UNKNOWN_IMPACT)} END"


CAUSE = cause_case("cause")
SEVERITY = "CASE o_orderkey % 5 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' WHEN 3 THEN 'Critical' ELSE 'Odd' END"
FLAGGED = ", flagged AS (SELECT * FROM scored WHERE is_anomaly)"
SUMMARY = (
    f"mms_service || ' traffic from ' || src_asset || ' to ' || dst_asset || ' at ' || {TIME_TEXT} || ' flagged by ' || "
    "CASE WHEN if_is_anomaly AND lof_is_anomaly THEN 'isolation forest and local outlier factor' "
    "WHEN if_is_anomaly THEN 'isolation forest' WHEN lof_is_anomaly THEN 'local outlier factor' "
    "ELSE 'ensemble score' END"
)


def decimal_text(expression: str) -> str:
    return f"CAST(CAST({expression} AS DECIMAL(28, 6)) AS VARCHAR)"


EVENT_JSON = (
    f"""'{{"timestamp":"' || {TIME_TEXT} || '","src_asset":"' || src_asset || '","dst_asset":"' || dst_asset"""
    f""" || '","mms_service":"' || mms_service || '","ensemble_score":' || {decimal_text('ensemble_score')}"""
    """ || ',"if_is_anomaly":' || CAST(if_is_anomaly AS VARCHAR) || ',"lof_is_anomaly":' || CAST(lof_is_anomaly AS VARCHAR)"""
    """ || ',"raw_features":{' || """
    + " || ',' || ".join(f"""'"{c}":' || {decimal_text(c)}""" for c in RAW_NUMERIC)
    + " || '}}'"
)

REPLIES = """
made AS (
  SELECT conv_id, turn, text, (conv_id + turn) % 4 AS kind,
         to_json({'likely_cause': text, 'supporting_evidence': [role, CAST(turn AS VARCHAR)], 'confidence': turn / 8.0})
           AS whole
  FROM conversations),
replies AS (
  SELECT conv_id, turn,
         CASE kind WHEN 0 THEN CAST(whole AS VARCHAR) WHEN 1 THEN CAST(to_json({'likely_cause': text}) AS VARCHAR)
                   WHEN 2 THEN text ELSE substring(CAST(whole AS VARCHAR), 1, 12) END AS reply
  FROM made),
parsed AS (
  SELECT conv_id, turn, CASE WHEN json_valid(reply) THEN CAST(reply AS JSON) END AS j FROM replies)"""



def spelled(*parts: str) -> str:
    """A text with the turn and the role put between its parts, in that order."""
    values = ["turn", "coalesce(role, 'none')"]
    return " || ".join([lit(parts[0]), *[f"{v} || {lit(p)}" for v, p in zip(values, parts[1:])]])


def stored_replies(first: str, second: str, third: str, last: str) -> str:
    return f"""replies AS (
  SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN {first} WHEN 1 THEN {second} WHEN 2 THEN {third} ELSE {last} END AS reply
  FROM conversations),
parsed AS (SELECT *, CASE WHEN json_valid(reply) THEN CAST(reply AS JSON) END AS j FROM replies)"""


TRAFFIC_COLUMNS = f"record_id, ts_us, {r6_all(RAW_NUMERIC)}, {', '.join(CATEGORICAL)}"


def one_hot_flags() -> str:
    values = {"mms_service": SERVICES, "src_asset": ASSETS, "dst_asset": ASSETS}
    return ", ".join(f"""{c} = '{v}' AS "{c}_{v}\"""" for c, kept in values.items() for v in kept)


def on_scored(select: str, extra: str = "") -> str:
    return f"WITH {SCORED}{extra} {select}"


def on_flagged(select: str) -> str:
    return f"WITH {SCORED}{FLAGGED} SELECT {select} FROM flagged"


ORACLE: dict[str, str] = {
    "traffic_ingest": f"WITH {TRAFFIC} SELECT {TRAFFIC_COLUMNS}, label, attack_type FROM traffic",
    "traffic_csv": f"WITH {TRAFFIC} SELECT {TRAFFIC_COLUMNS}, label, attack_type FROM traffic",
    "json_records": f"WITH {TRAFFIC} SELECT {TRAFFIC_COLUMNS} FROM traffic",
    "rolling_features": f"WITH {MATRIX} SELECT record_id, {r6_all(['rolling_request_rate_mean', 'rolling_latency_std'])} FROM matrix",
    "rolling_features_by_asset": f"""WITH {TRAFFIC}
        SELECT record_id, {r6('avg(request_rate) OVER w', 'rolling_request_rate_mean')},
               {r6('coalesce(stddev_samp(latency_ms) OVER w, 0.0)', 'rolling_latency_std')}
        FROM traffic
        WINDOW w AS (PARTITION BY src_asset ORDER BY ts_us, record_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    "zscore_feature": f"""SELECT event_id AS record_id,
        {r6('(value - avg(value) OVER ()) / (stddev_samp(value) OVER () + 1e-6)', 'packet_size_zscore')} FROM events""",
    "feature_matrix": f"WITH {MATRIX} SELECT record_id, label, attack_type, {r6_all(FEATURES)} FROM matrix",
    "feature_matrix_with_categories": f"""WITH {MATRIX} SELECT record_id, {r6('packet_size')},
        {', '.join(f"CAST(mms_service = '{s}' AS DOUBLE) AS mms_service_{s}" for s in SERVICES)} FROM matrix""",
    "one_hot": f"WITH {TRAFFIC} SELECT record_id, {one_hot_flags()} FROM traffic",
    "one_hot_sparse": """WITH texts AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS customer, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders),
        flat AS (SELECT o_orderkey, 'customer' AS "column", customer AS value FROM texts UNION ALL SELECT o_orderkey, 'day', day FROM texts)
        SELECT o_orderkey, (SELECT count(DISTINCT customer) + count(DISTINCT day) FROM texts) AS size, "column", value FROM flat WHERE value IS NOT NULL""",
    "feature_meta_split": f"WITH {TRAFFIC} SELECT record_id, label, attack_type, {r6_all(RAW_NUMERIC)} FROM traffic",
    "align_columns": f"""WITH {TRAFFIC} SELECT record_id, {r6('latency_ms')}, CAST(0 AS DOUBLE) AS mms_service_unseen,
        {r6('packet_size')} FROM traffic""",
    "null_fill": """SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "minmax_scale": f"SELECT event_id AS record_id, {r6(minmax('value', 'events'), 'scaled')} FROM events",
    "clip_values": """SELECT event_id AS record_id, least(greatest(value, 5.0), 100.0) AS "both", greatest(value, 20.0) AS low,
        least(value, 30.0) AS high FROM events""",
    "train_test_split": """SELECT event_id AS record_id,
        CASE WHEN CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 7) AS BIGINT) % 1000 < 700
             THEN 'train' ELSE 'test' END AS part FROM events""",
    "anti_selection": """SELECT event_id AS record_id, event_type FROM events
        WHERE CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 7) AS BIGINT) % 1000 >= 700""",
    "union_of_classes": f"WITH {TRAFFIC} SELECT record_id, attack_type, label FROM traffic",
    "sort_by_time": "SELECT event_id AS record_id, event_type FROM events ORDER BY ts, event_id",
    "shuffle_rows": "SELECT event_id AS record_id, event_type FROM events",
    "first_records": "SELECT event_id AS record_id, event_type FROM events ORDER BY ts, event_id LIMIT 10",
    "value_counts": f"WITH {TRAFFIC} SELECT attack_type, count(*) AS n FROM traffic GROUP BY attack_type",
    "distinct_values": f"""WITH {TRAFFIC} SELECT DISTINCT 'label' AS "column", label AS value FROM traffic
        UNION ALL SELECT DISTINCT 'attack_type', attack_type FROM traffic""",
    "column_moments": f"""SELECT {r6('avg(value)', 'mean')}, {r6('stddev_samp(value)', 'std')}, min(value) AS lo,
        max(value) AS hi FROM events""",
    "quantile_cutoff": f"""SELECT CAST(q AS DOUBLE) AS q, {r6('cutoff')} FROM (
        SELECT 0.5 AS q, quantile_cont(value, 0.5) AS cutoff FROM events
        UNION ALL SELECT 0.9, quantile_cont(value, 0.9) FROM events
        UNION ALL SELECT 0.99, quantile_cont(value, 0.99) FROM events)""",
    "anomaly_rates": on_scored(
        f"""SELECT {r6('avg(CAST(is_anomaly AS DOUBLE))', 'anomaly_rate')},
            {r6("avg(CAST(attack_type <> 'None' AS DOUBLE))", 'attack_rate')},
            count(*) FILTER (is_anomaly) AS anomaly_count, count(*) AS record_count FROM scored"""
    ),
    "flag_rate_by_label": on_scored(
        f"""SELECT attack_type <> 'None' AS is_attack, {r6('avg(CAST(is_anomaly AS DOUBLE))', 'flag_rate')}, count(*) AS n
            FROM scored GROUP BY 1"""
    ),
    "confusion_metrics": on_scored(
        f"""SELECT tp, fp, fn, tn, {r6('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END', 'precision')},
            {r6('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END', 'recall')},
            {r6('CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END', 'f1')}
            FROM (SELECT count(*) FILTER (is_anomaly AND label = 'Attack') AS tp,
                         count(*) FILTER (is_anomaly AND label <> 'Attack') AS fp,
                         count(*) FILTER (NOT is_anomaly AND label = 'Attack') AS fn,
                         count(*) FILTER (NOT is_anomaly AND label <> 'Attack') AS tn FROM scored)"""
    ),
    "anomaly_filter": on_flagged(f"record_id, {r6('ensemble_score')}"),
    "top_anomalies": on_scored(
        f"SELECT record_id, {r6('ensemble_score')} FROM flagged ORDER BY scored_.ensemble_score DESC, record_id LIMIT 3"
        .replace("FROM flagged", "FROM flagged AS scored_"),
        FLAGGED,
    ),
    "verdict_projection": on_scored(
        f'SELECT record_id, {TIME_TEXT} AS "timestamp", is_anomaly, {r6("ensemble_score")} FROM scored'
    ),
    "key_lookup": on_flagged(f"record_id, {', '.join(CATEGORICAL)}, {r6('packet_size')}"),
    "knn_join": f"""WITH p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS p FROM embeddings),
        pairs AS (SELECT a.id AS query_id, b.id AS ref_id, {distance(64, 'a', 'b')} AS distance FROM p a JOIN p b ON a.id <> b.id)
        SELECT query_id, ref_id, rank, {r6('distance')} FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rank FROM pairs) WHERE rank <= 10""",
    "lof_embeddings": f"""WITH train AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS p FROM embeddings)
        {lof_tables(64, 20)}
        SELECT id AS vec_id, {r6('factor')}, factor > (SELECT c FROM cutoff) AS is_outlier FROM factors""",
    "lof_events": f"""WITH {lof_events()}
        SELECT id AS record_id, {r6('factor')}, factor > (SELECT c FROM cutoff) AS is_outlier FROM outer_lof""",
    "iforest_scores": f"""WITH {MATRIX},{forest_tables('matrix', 'matrix', FEATURES)}
        SELECT id AS record_id, {r6('score')}, score > (SELECT quantile_cont(score, 0.9) FROM forest) AS is_outlier FROM forest""",
    "iforest_line_items": f"""WITH items AS MATERIALIZED (
          SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem),
        {forest_tables('items', 'items', ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'])}
        SELECT id AS record_id, {r6('score')}, score > (SELECT quantile_cont(score, 0.9) FROM forest) AS is_outlier FROM forest""",
    "detector_verdict": f"""WITH {split_traffic()}{detector_tables()},{verdict(in_batch, 'raw')}
        SELECT record_id, attack_type, if_is_anomaly, {r6('if_score')}, lof_is_anomaly, {r6('lof_score')}, {r6('ensemble_score')}, is_anomaly FROM judged""",
    "detector_reload": f"""WITH {split_traffic(stats='train_records')}{detector_tables()},{verdict(in_training, 'raw, limits')}
        SELECT record_id, {r6('ensemble_score')}, is_anomaly FROM judged""",
    "stream_verdict": f"""WITH {split_traffic(stats='train_records')}{detector_tables()},{verdict(in_training, 'raw, limits')}
        SELECT record_id, attack_type, if_is_anomaly, {r6('if_score')}, lof_is_anomaly, {r6('lof_score')}, {r6('ensemble_score')}, is_anomaly FROM judged""",
    "stream_stateless": f"""WITH {TRAFFIC},{matrix_of('traffic', 'prepared')},{forest_tables('prepared', 'prepared', [*RAW_NUMERIC, 'packet_size_zscore'])}
        SELECT record_id, {r6('packet_size_zscore')}, {r6('score', 'if_raw')}, score > (SELECT quantile_cont(score, 0.9) FROM forest) AS if_is_anomaly
        FROM prepared JOIN forest USING (id)""",
    "stream_micro_batch": f"WITH {streamed()} SELECT record_id, attack_type, {r6('ensemble_score')}, is_anomaly FROM judged",
    "stream_alerts": f"""WITH {streamed()}
        SELECT record_id, {label_case(CAUSE)} AS attack_type, false AS sent, 'mock' AS mode FROM judged WHERE is_anomaly""",
    "ensemble_verdict": f"""WITH {lof_events()},
        r AS (SELECT record_id, attack_type, abs(packet_size_zscore) AS if_raw, factor AS lof_raw,
                     abs(packet_size_zscore) > (SELECT quantile_cont(abs(packet_size_zscore), 0.9) FROM train) AS if_is_anomaly,
                     factor > (SELECT c FROM cutoff) AS lof_is_anomaly
              FROM test JOIN outer_lof USING (id)),
        s AS (SELECT *, {minmax('if_raw', 'r')} AS if_score, {minmax('lof_raw', 'r')} AS lof_score FROM r)
        SELECT record_id, attack_type, {r6('if_score')}, if_is_anomaly, {r6('lof_score')}, lof_is_anomaly,
               {r6('(s.if_score + s.lof_score) / 2', 'ensemble_score')},
               if_is_anomaly OR lof_is_anomaly OR (s.if_score + s.lof_score) / 2 >= 0.5 AS is_anomaly FROM s""",
    "ensemble_intersection": on_scored(
        f"""SELECT record_id, {r6('ensemble_score')},
            (if_is_anomaly AND lof_is_anomaly) OR scored.ensemble_score >= 0.6 AS is_anomaly FROM scored"""
    ),
    "text_source": "SELECT doc_id, source, length(text) AS chars FROM documents",
    "text_folder": f"""WITH documents AS (SELECT item_id AS doc_id, 'x' AS source, text FROM benchmark), {CHUNKS}
        SELECT chunk_no, text FROM chunks""",
    "chunk_documents": f"WITH {CHUNKS} SELECT doc_id, chunk_no, source, text FROM chunks",
    "reference_lines": f"WITH {CHUNKS} SELECT doc_id, chunk_no, {REFERENCE} AS reference FROM chunks",
    "term_frequency": f"WITH {TERMS} SELECT doc_id, chunk_no, term, tf FROM tf",
    "document_frequency": f"WITH {TERMS} SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM tf GROUP BY term",
    "vocabulary_top": f"WITH {WEIGHTS} SELECT term, term_id, tf, df, {r6('idf')} FROM vocabulary",
    "tfidf_weights": f"WITH {WEIGHTS} SELECT doc_id, chunk_no, term, {r6('weight')} FROM weights",
    "retrieve_topk": f"""WITH {WEIGHTS}{search('SELECT item_id AS query_id, text FROM benchmark')}
        SELECT query_id, rank, doc_id, chunk_no, {r6('score')}, {REFERENCE} AS reference
        FROM ranked JOIN chunks USING (doc_id, chunk_no)""",
    "event_build": on_flagged(
        f"""record_id, {TIME_TEXT} AS "timestamp", src_asset, dst_asset, mms_service, {r6('ensemble_score')}, if_is_anomaly,
            lof_is_anomaly, {r6_all(RAW_NUMERIC)}"""
    ),
    "detection_finding": on_flagged(f"record_id, {SUMMARY} AS summary, {r6('ensemble_score', 'confidence')}"),
    "root_cause": on_flagged(
        f"""record_id, {CAUSE} AS likely_cause, {cause_case('evidence')} AS supporting_evidence,
            CAST({V.CAUSE_CONFIDENCE} AS DOUBLE) AS confidence"""
    ),
    "root_cause_from_text": f"""SELECT doc_id,
        CASE WHEN contains(lower(text), 'dos') OR doc_id % 60 > 30 THEN {lit(V.DOS_CAUSE)}
             WHEN contains(lower(text), 'mitm') OR contains(lower(text), 'man-in-the-middle') THEN {lit(V.MITM_CAUSE)}
             WHEN contains(lower(text), 'fdi') OR contains(lower(text), 'false data injection') THEN {lit(V.FDI_CAUSE)}
             WHEN contains(lower(text), 'replay') THEN {lit(V.REPLAY_CAUSE)}
             ELSE {lit(V.OTHER_CAUSE)} END AS likely_cause, CAST(doc_id % 60 AS DOUBLE) AS request_rate FROM documents""",
    "attack_type_label": on_flagged(f"record_id, {label_case(CAUSE)} AS attack_label"),
    "attack_label_of_texts": f"SELECT doc_id, {label_case('text')} AS attack_label FROM documents",
    "risk_assessment": on_flagged(
        f"""record_id, CASE WHEN dst_asset IN ({', '.join(map(lit, V.HIGH_CRITICALITY_ASSETS))}) THEN 'High' ELSE 'Medium' END
            AS asset_criticality, 'Medium' AS operational_impact, 'Medium' AS attack_severity,
            {r6('ensemble_score', 'business_risk_score')}"""
    ),
    "risk_assessment_canned": on_flagged(
        """record_id, 'High' AS asset_criticality, 'Medium' AS operational_impact, 'High' AS attack_severity,
           CAST(0.78 AS DOUBLE) AS business_risk_score"""
    ),
    "weighted_risk": on_flagged(
        f"""record_id, {r6('''0.1 * flagged.ensemble_score
            + 0.35 * CASE WHEN dst_asset IN ('IED-Breaker-A', 'IED-Breaker-B', 'Merging-Unit-01') THEN 1.0 ELSE 0.5 END
            + 0.3 * 0.5 + 0.25 * 0.5''', 'weighted_risk')}"""
    ),
    "response_actions": on_flagged(
        f"""record_id, CASE WHEN record_id % 3 = 0 THEN dst_asset ELSE {lit(V.ESCALATION[0])} END AS actions,
            {lit(' | '.join(V.CANNED_ACTIONS))} AS canned"""
    ),
    "impact_text": f"SELECT o_orderkey, {SEVERITY} AS severity, {impact_case(SEVERITY)} AS impact FROM orders",
    "query_texts": f"""SELECT event_id AS record_id, event_type || ' {V.KNOWLEDGE_QUERY}' AS plain,
        CASE WHEN event_id % 2 = 0 THEN 'replay ' ELSE '' END || CASE WHEN event_id % 3 > 0 THEN event_type || ' ' ELSE '' END
          || '{V.KNOWLEDGE_QUERY}' AS hinted FROM events""",
    "knowledge_attach": on_scored(
        "SELECT record_id, knowledge_references FROM scored JOIN knowledge USING (mms_service) WHERE is_anomaly",
        "," + WEIGHTS + KNOWLEDGE,
    ),
    "incident_report": on_scored(
        f"""SELECT record_id, {label_case(CAUSE)} AS attack_type, '{V.PROTOCOL}' AS protocol, dst_asset AS target,
            'High' AS severity, CAST({V.CAUSE_CONFIDENCE} AS DOUBLE) AS confidence, {lit(V.IMPACT_TEXTS['High'])} AS impact,
            {lit(V.ESCALATION[0])} AS recommended_actions, {CAUSE} AS root_cause, knowledge_references
            FROM scored JOIN knowledge USING (mms_service) WHERE is_anomaly""",
        "," + WEIGHTS + KNOWLEDGE,
    ),
    "alert_selection": f"""SELECT o_orderkey, {SEVERITY} AS severity, {SEVERITY} <> 'Low' AS at_medium,
        {SEVERITY} IN ('Critical', 'Odd') AS at_critical FROM orders""",
    "dispatch_status": f"""SELECT o_orderkey, false AS sent, CASE WHEN {SEVERITY} = 'Low' THEN 'skipped' ELSE 'mock' END AS mode,
        CAST(-1 AS INTEGER) AS status_code FROM orders""",
    "alert_table": on_flagged(
        f"""record_id, false AS sent, 'mock' AS mode, CAST(-1 AS INTEGER) AS status_code, {label_case(CAUSE)} AS attack_type,
            dst_asset AS target, 'High' AS severity, CAST({V.CAUSE_CONFIDENCE} AS DOUBLE) AS confidence"""
    ),
    "reply_parse": f"""WITH {REPLIES}
        SELECT conv_id, turn, coalesce(j->>'$.likely_cause', {lit(V.UNKNOWN_CAUSE)}) AS likely_cause,
               coalesce(array_to_string(CAST(j->'$.supporting_evidence' AS VARCHAR[]), ' | '), '') AS supporting_evidence,
               coalesce(CAST(j->>'$.confidence' AS DOUBLE), CAST({V.UNKNOWN_CONFIDENCE} AS DOUBLE)) AS confidence FROM parsed""",
    "reply_fields": f"""WITH {REPLIES} SELECT conv_id, turn, j->>'$.likely_cause' AS likely_cause,
        CAST(j->>'$.confidence' AS DOUBLE) AS confidence FROM parsed""",
    "detection_replies": f"""WITH {stored_replies("to_json({'summary': coalesce(text, '')})::VARCHAR",
        spelled("{'summary': 'Flagged turn ", " of ", "'}"), "chr(10) || chr(9) || ' ' || coalesce(text, '') || ' ' || chr(10)",
        spelled('{"summary": "Flagged turn ', " of ", '"} and more'))}
        SELECT conv_id, turn, coalesce(j->>'$.summary', trim(reply, {BLANK_SET})) AS summary, {r6('turn / 8', 'confidence')} FROM parsed""",
    "risk_replies": f"""WITH {stored_replies(
        spelled('{"asset_criticality": "Low", "attack_severity": "Critical", "business_risk_score": ', ', "operational_impact": "', '"}'),
        spelled('{"asset_criticality": "", "business_risk_score": "about ', '", "attack_severity": "', '"}'), "coalesce(text, '')",
        spelled("{'asset_criticality': '", "', 'attack_severity': '", "'}"))}
        SELECT conv_id, turn,
               coalesce(nullif(j->>'$.asset_criticality', ''), CASE WHEN turn % 3 = 0 THEN 'High' ELSE 'Medium' END) AS asset_criticality,
               coalesce(j->>'$.operational_impact', 'Medium') AS operational_impact,
               coalesce(j->>'$.attack_severity', 'Medium') AS attack_severity,
               {r6("coalesce(TRY_CAST(j->>'$.business_risk_score' AS DOUBLE), turn / 8)", 'business_risk_score')} FROM parsed""",
    "response_replies": f"""WITH {stored_replies(
        spelled('{"recommended_actions": ["Check turn ', '", "Ask ', '"]}'), lit('{"recommended_actions": []}'), "coalesce(text, '')",
        spelled('{"recommended_actions": ["Check turn ', '", "Ask ', '"]} as said'))}
        SELECT conv_id, turn, coalesce(nullif(array_to_string(CAST(j->'$.recommended_actions' AS VARCHAR[]), ' | '), ''),
               {lit(V.ESCALATION[0])}) AS actions FROM parsed""",
    "prompt_columns": on_flagged(
        f"""record_id, 'Anomaly event:' || chr(10) || {EVENT_JSON} || chr(10) || chr(10)
              || 'Summarize what the detector flagged in 1-2 sentences.' AS detection_prompt,
            'Detection finding: ' || {SUMMARY} || chr(10) || chr(10) || 'Anomaly event:' || chr(10) || {EVENT_JSON} || chr(10)
              || chr(10) || 'Relevant knowledge base context:' || chr(10) || '- first' || chr(10) || '- second' AS cause_prompt,
            'Root cause finding: ' || {CAUSE} || chr(10) || 'Evidence: ' || replace({cause_case('evidence')}, ' | ', '; ')
              || chr(10) || 'Confidence: 0.800000' || chr(10) || 'Target asset: ' || dst_asset || chr(10)
              || 'Detector ensemble score: ' || {decimal_text('ensemble_score')} AS risk_prompt,
            'Root cause: ' || {CAUSE} || chr(10)
              || 'Risk: criticality=High, impact=Medium, severity=High, business_risk_score=0.780000' AS response_prompt"""
    ),
    "prompt_hash": "SELECT conv_id, turn, substr(sha256(role || text), 1, 8) AS prompt_id FROM conversations",
    "index_reload": f"""WITH {WEIGHTS}{search('SELECT item_id AS query_id, text FROM benchmark')}
        SELECT query_id, rank, doc_id, chunk_no, {r6('score')} FROM ranked""",
    "stream_zscore": f"""SELECT event_id AS record_id, event_type AS mms_service,
        {r6('(value - avg(value) OVER ()) / (stddev_samp(value) OVER () + 1e-6)', 'packet_size_zscore')} FROM events""",
    "stream_rolling": f"""WITH {TRAFFIC}
        SELECT record_id, {r6('avg(request_rate) OVER w', 'rolling_request_rate_mean')},
               {r6('coalesce(stddev_samp(latency_ms) OVER w, 0.0)', 'rolling_latency_std')}
        FROM traffic
        WINDOW w AS (PARTITION BY src_asset ORDER BY ts_us, record_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
}
