"""Named queries over the driver tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ohmwatch.functions import incidents as I
from ohmwatch.functions import text as X
from ohmwatch.operators import ensemble, evaluate, features, iforest, knn, lof, retrieval, split
from ohmwatch.operators.quantile import exact_quantile
from ohmwatch.plans import detector, incidents
from ohmwatch.schema import CAUSE_REPLY, CATEGORICAL, FEATURES, KEY, RAW_NUMERIC, TIME
from ohmwatch.session import fan_out, passing, scratch_path, store, write
from ohmwatch.sources import documents as documents_source
from ohmwatch.sources import sinks, traffic as traffic_source
from ohmwatch.streaming import scoring
from ohmwatch.streaming.rolling import RollingStream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register under the function's name.  Times are read as UTC whatever the session's zone."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_pass_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For queries that read the records once: nothing is written, and columns nobody asks for are not computed."""
    return traffic_source.ingest_events(table(spark, sf_dir, "events"))


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(traffic_source.ingest_events(table(spark, sf_dir, "events")), "traffic")


def matrix(records: DataFrame) -> DataFrame:
    return store(features.feature_matrix(records), "matrix")


def r6(column: str | Column, name: str | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, 6).alias(name or column)


def joined(column: str, separator: str = " | ") -> Column:
    return F.array_join(column, separator).alias(column)


# Features


@query
def traffic_ingest(spark, sf_dir):
    t = traffic_source.ingest_events(table(spark, sf_dir, "events"))
    return t.select(KEY, F.unix_micros(TIME).alias("ts_us"), *map(r6, RAW_NUMERIC), *CATEGORICAL, "label", "attack_type")


@query
def traffic_csv(spark, sf_dir):
    path = scratch_path(spark, "traffic-csv")
    sinks.write_csv(traffic_source.ingest_events(table(spark, sf_dir, "events")), path)
    t = traffic_source.read_traffic(spark, path, "csv")
    return t.select(KEY, F.unix_micros(TIME).alias("ts_us"), *map(r6, RAW_NUMERIC), *CATEGORICAL, "label", "attack_type")


@query
def json_records(spark, sf_dir):
    t = traffic_source.ingest_events(table(spark, sf_dir, "events"))
    stamped = t.withColumn(TIME, F.date_format(TIME, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    wrapped = stamped.select(KEY, F.to_json(F.array(F.struct(TIME, *RAW_NUMERIC, *CATEGORICAL))).alias("records"))
    out = traffic_source.traffic_from_json(wrapped, "records")
    return out.select(KEY, F.unix_micros(TIME).alias("ts_us"), *map(r6, RAW_NUMERIC), *CATEGORICAL)


@query
def rolling_features(spark, sf_dir):
    out = features.add_rolling(traffic(spark, sf_dir))
    return out.select(KEY, r6("rolling_request_rate_mean"), r6("rolling_latency_std"))


@query
def rolling_features_by_asset(spark, sf_dir):
    out = features.add_rolling(traffic(spark, sf_dir), partition_by=["src_asset"])
    return out.select(KEY, r6("rolling_request_rate_mean"), r6("rolling_latency_std"))


@query
def zscore_feature(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias(KEY), F.col("value").alias("packet_size"))
    return features.add_zscore(events, "packet_size", "z").select(KEY, r6("z", "packet_size_zscore"))


@query
def feature_matrix(spark, sf_dir):
    out = features.feature_matrix(traffic(spark, sf_dir))
    return out.select(KEY, "label", "attack_type", *map(r6, FEATURES))


@query
def feature_matrix_with_categories(spark, sf_dir):
    t = traffic(spark, sf_dir)
    out = features.feature_matrix(t, include_categoricals=features.fit_categories(t, ["mms_service"]))
    flags = [c for c in out.columns if c.startswith("mms_service_")]
    return out.select(KEY, r6("packet_size"), *flags)


@query
def one_hot(spark, sf_dir):
    t = traffic(spark, sf_dir).select(KEY, *CATEGORICAL)
    return features.one_hot(t, features.fit_categories(t))


@query
def one_hot_sparse(spark, sf_dir):
    """Indicators of a column with a value for each few rows, decoded again by the value table."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    texts = orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("customer"), F.col("o_orderdate").cast("date").cast("string").alias("day"))
    values = features.value_table(texts, ["customer", "day"])
    encoded = features.sparse_one_hot(texts, values, ["customer", "day"])
    flat = encoded.select("o_orderkey", F.col("indicators.size").alias("size"), F.explode("indicators.indices").alias("index"))
    return flat.join(values, "index").select("o_orderkey", "size", "column", "value")


@query
def feature_meta_split(spark, sf_dir):
    t = one_pass_traffic(spark, sf_dir)
    meta, candidates = features.split_meta(t)
    numeric = [c for c in features.numeric_columns(t) if c in candidates]
    return t.select(KEY, *[c for c in meta if c != TIME], *map(r6, numeric))


@query
def align_columns(spark, sf_dir):
    wanted = ["latency_ms", "mms_service_unseen", "packet_size"]
    return features.align(one_pass_traffic(spark, sf_dir), wanted, keep=[KEY]).select(
        KEY, r6("latency_ms"), "mms_service_unseen", r6("packet_size")
    )


@query
def null_fill(spark, sf_dir):
    labelled = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return features.fill_missing(labelled, ["quality", "toxic"])


@query
def minmax_scale(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias(KEY), "value")
    return features.add_minmax(events, "value", "scaled").select(KEY, r6("scaled"))


@query
def clip_values(spark, sf_dir):
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias(KEY),
        features.clip(value, 5.0, 100.0).alias("both"),
        features.clip(value, lower=20.0).alias("low"),
        features.clip(value, upper=30.0).alias("high"),
    )


# Rows: split, order, union


@query
def train_test_split(spark, sf_dir):
    train, test = split.split(table(spark, sf_dir, "events").select(F.col("event_id").alias(KEY)))
    return split.union_all(train.withColumn("part", F.lit("train")), test.withColumn("part", F.lit("test")))


@query
def anti_selection(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias(KEY), "event_type")
    train, _ = split.split(events)
    return split.without(events, train)


@query
def union_of_classes(spark, sf_dir):
    t = one_pass_traffic(spark, sf_dir).select(KEY, "attack_type", "label")
    return split.union_all(t.where("label = 'Normal'"), t.where("label = 'Attack'"))


@query
def sort_by_time(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias(KEY), "event_type", "ts")
    return events.orderBy("ts", KEY).select(KEY, "event_type")


@query
def shuffle_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias(KEY), "event_type")
    return split.shuffled(events)


@query
def first_records(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias(KEY), "event_type", "ts")
    return split.head(events, 10, ["ts", KEY]).select(KEY, "event_type")


# Aggregates


@query
def value_counts(spark, sf_dir):
    return evaluate.value_counts(one_pass_traffic(spark, sf_dir), "attack_type")


@query
def distinct_values(spark, sf_dir):
    return features.categories(one_pass_traffic(spark, sf_dir), ["label", "attack_type"])


@query
def column_moments(spark, sf_dir):
    m = features.moments(table(spark, sf_dir, "events"), "value")
    return m.select(r6("mean"), r6("std"), "lo", "hi")


@query
def quantile_cutoff(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = [(q, exact_quantile(events, "value", q)) for q in (0.5, 0.9, 0.99)]
    return spark.createDataFrame(rows, "q double, cutoff double").select("q", r6("cutoff"))


def scored(records: DataFrame) -> DataFrame:
    """Verdicts of two one-column detectors, which SQL can repeat: packet-size deviation and latency spread."""
    m = matrix(records).withColumns(
        {"if_raw": F.abs("packet_size_zscore"), "lof_raw": F.col("rolling_latency_std")}
    )
    for name in ("if", "lof"):
        m = features.add_minmax(m, f"{name}_raw", f"{name}_score")
        m = m.withColumn(f"{name}_is_anomaly", F.col(f"{name}_raw") > exact_quantile(m, f"{name}_raw", 0.9))
    kept = [KEY, TIME, "label", "attack_type", "if_score", "if_is_anomaly", "lof_score", "lof_is_anomaly"]
    return store(ensemble.add_verdict(m.select(*kept)), "scored")


@query
def anomaly_rates(spark, sf_dir):
    out = evaluate.anomaly_rates(scored(traffic(spark, sf_dir)))
    return out.select(r6("anomaly_rate"), r6("attack_rate"), "anomaly_count", "record_count")


@query
def flag_rate_by_label(spark, sf_dir):
    return evaluate.flag_rate_by_class(scored(traffic(spark, sf_dir))).select("is_attack", r6("flag_rate"), "n")


@query
def confusion_metrics(spark, sf_dir):
    out = evaluate.confusion(scored(traffic(spark, sf_dir)))
    return out.select("tp", "fp", "fn", "tn", r6("precision"), r6("recall"), r6("f1"))


@query
def anomaly_filter(spark, sf_dir):
    return ensemble.anomalies(scored(traffic(spark, sf_dir))).select(KEY, r6("ensemble_score"))


@query
def top_anomalies(spark, sf_dir):
    return ensemble.top_anomalies(scored(traffic(spark, sf_dir)), 3).select(KEY, r6("ensemble_score"))


@query
def verdict_projection(spark, sf_dir):
    return ensemble.verdicts(scored(traffic(spark, sf_dir))).select(KEY, TIME, "is_anomaly", r6("ensemble_score"))


@query
def key_lookup(spark, sf_dir):
    records = traffic(spark, sf_dir)
    out = incidents.enrich(ensemble.anomalies(scored(records)), records)
    return out.select(KEY, *CATEGORICAL, r6("packet_size"))


# Models


@query
def knn_join(spark, sf_dir):
    points = store(embeddings(spark, sf_dir), "points")
    rows = knn.as_rows(knn.neighbours(points, points, 10, skip_self=True))
    return rows.select("query_id", "ref_id", F.col("rank").cast("long").alias("rank"), r6("distance"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("point"))


@query
def lof_embeddings(spark, sf_dir):
    points = store(embeddings(spark, sf_dir), "points")
    model = lof.fit(points)
    out = lof.training_factors(model, points)
    return out.select(F.col("id").alias("vec_id"), r6("factor"), (F.col("factor") > model.cutoff).alias("is_outlier"))


def lof_of_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train features, test features, and the scores of the test records."""
    with passing() as stay:
        rows = stay(features.feature_matrix(traffic(spark, sf_dir)), "matrix")
    train, test = split.split(rows)
    model = lof.fit(lof.as_points(train, FEATURES))
    return train, test, lof.score(model, lof.as_points(test, FEATURES))


@query
def lof_events(spark, sf_dir):
    _, _, out = lof_of_events(spark, sf_dir)
    return out.select(F.col("id").alias(KEY), r6("factor"), "is_outlier")


@query
def ensemble_verdict(spark, sf_dir):
    with passing() as stay:
        train, test, out = lof_of_events(spark, sf_dir)
        limit = exact_quantile(train.select(F.abs("packet_size_zscore").alias("z")), "z", 0.9)
        factors = out.select(F.col("id").alias(KEY), F.col("factor").alias("lof_raw"), F.col("is_outlier").alias("lof_is_anomaly"))
        raw = test.select(KEY, "attack_type", F.abs("packet_size_zscore").alias("if_raw"))
        raw = stay(raw.withColumn("if_is_anomaly", F.col("if_raw") > limit).join(factors, KEY), "raw")
    both = features.add_minmax(features.add_minmax(raw, "if_raw", "if_score"), "lof_raw", "lof_score")
    return ensemble.add_verdict(both).select(
        KEY, "attack_type", r6("if_score"), "if_is_anomaly", r6("lof_score"), "lof_is_anomaly", r6("ensemble_score"),
        "is_anomaly",
    )


@query
def ensemble_intersection(spark, sf_dir):
    both = scored(traffic(spark, sf_dir)).drop("ensemble_score", "is_anomaly")
    return ensemble.add_verdict(both, "intersection", 0.6).select(KEY, r6("ensemble_score"), "is_anomaly")


@query
def iforest_scores(spark, sf_dir):
    m = matrix(traffic(spark, sf_dir))
    model = iforest.fit(m, FEATURES)
    out = iforest.score(model, fan_out(m.select(KEY, *FEATURES)), "score")
    return out.select(KEY, r6("score"), (F.col("score") > model.cutoff).alias("is_outlier"))


@query
def iforest_line_items(spark, sf_dir):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    items = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias(KEY), *columns)
    model = iforest.fit(items, columns)
    out = iforest.score(model, fan_out(items), "score")
    return out.select(KEY, r6("score"), (F.col("score") > model.cutoff).alias("is_outlier"))


@query
def detector_verdict(spark, sf_dir):
    train, test = split.split(traffic(spark, sf_dir))
    model = detector.fit(train)
    out = detector.predict(model, test)
    return out.select(
        KEY, "attack_type", "if_is_anomaly", r6("if_score"), "lof_is_anomaly", r6("lof_score"), r6("ensemble_score"),
        "is_anomaly",
    )


# Text


@query
def text_source(spark, sf_dir):
    d = documents_source.documents_from_table(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "source", F.length("text").cast("long").alias("chars"))


@query
def text_folder(spark, sf_dir):
    """Test items written as text files, one each, then read back and chunked."""
    path = scratch_path(spark, "text-folder")
    table(spark, sf_dir, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    c = X.chunk(documents_source.read_text_folder(spark, path))
    return c.select(F.col("chunk_no").cast("long").alias("chunk_no"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents_source.documents_from_table(table(spark, sf_dir, "documents"))
    return X.chunk(fan_out(d))


@query
def chunk_documents(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return c.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "source", "text")


@query
def reference_lines(spark, sf_dir):
    c = chunks(spark, sf_dir)
    line = X.reference_line(F.col("source"), F.col("text")).alias("reference")
    return c.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), line)


@query
def term_frequency(spark, sf_dir):
    return retrieval.chunk_terms(retrieval.counted(chunks(spark, sf_dir))).select(
        "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "term", "tf"
    )


@query
def document_frequency(spark, sf_dir):
    return retrieval.term_totals(retrieval.counted(chunks(spark, sf_dir)))


@query
def vocabulary_top(spark, sf_dir):
    v = retrieval.vocabulary(store(retrieval.counted(chunks(spark, sf_dir)), "counted"))
    return v.select("term", F.col("term_id").cast("long").alias("term_id"), "tf", "df", r6("idf"))


def index(spark: SparkSession, sf_dir: str) -> retrieval.TextIndex:
    return retrieval.index_documents(table(spark, sf_dir, "documents"))


@query
def tfidf_weights(spark, sf_dir):
    ix = index(spark, sf_dir)
    rows = ix.vectors.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.inline("terms"))
    named = rows.join(F.broadcast(ix.vocabulary.select("term", "term_id")), "term_id")
    return named.select("doc_id", "chunk_no", "term", r6("weight"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query
def retrieve_topk(spark, sf_dir):
    out = retrieval.retrieve(index(spark, sf_dir), benchmark_queries(spark, sf_dir))
    return out.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"),
        r6("score"), "reference",
    )


# Incidents


def flagged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = traffic(spark, sf_dir)
    return incidents.events(scored(records), records)


@query
def event_build(spark, sf_dir):
    e = flagged_events(spark, sf_dir)
    return e.select(
        KEY, "event.timestamp", "event.src_asset", "event.dst_asset", "event.mms_service",
        r6("event.ensemble_score", "ensemble_score"), "event.if_is_anomaly", "event.lof_is_anomaly",
        *[r6(F.try_element_at("event.raw_features", F.lit(c)), c) for c in RAW_NUMERIC],
    )


@query
def detection_finding(spark, sf_dir):
    e = flagged_events(spark, sf_dir).withColumn("finding", I.detection_finding(F.col("event")))
    return e.select(KEY, "finding.summary", r6("finding.confidence", "confidence"))


def all_findings(spark: SparkSession, sf_dir: str, profile: str = "canned") -> DataFrame:
    return incidents.findings(flagged_events(spark, sf_dir), profile)


@query
def root_cause(spark, sf_dir):
    f = all_findings(spark, sf_dir)
    return f.select(
        KEY, "cause.likely_cause", joined("cause.supporting_evidence").alias("supporting_evidence"), "cause.confidence"
    )


@query
def root_cause_from_text(spark, sf_dir):
    context = F.concat(F.lit('{"request_rate": '), (F.col("doc_id") % 60).cast("string"), F.lit("} "), F.col("text"))
    cause = I.root_cause(F.lit(None), context)
    return table(spark, sf_dir, "documents").select(
        "doc_id", cause["likely_cause"].alias("likely_cause"),
        I.json_number(context, "request_rate").alias("request_rate"),
    )


@query
def attack_type_label(spark, sf_dir):
    f = all_findings(spark, sf_dir)
    return f.select(KEY, I.attack_label(F.col("cause")["likely_cause"]).alias("attack_label"))


@query
def attack_label_of_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", I.attack_label(F.col("text")).alias("attack_label"))


@query
def risk_assessment(spark, sf_dir):
    f = all_findings(spark, sf_dir, "fallback")
    return f.select(
        KEY, "risk.asset_criticality", "risk.operational_impact", "risk.attack_severity",
        r6("risk.business_risk_score", "business_risk_score"),
    )


@query
def risk_assessment_canned(spark, sf_dir):
    return all_findings(spark, sf_dir).select(KEY, "risk.*")


@query
def weighted_risk(spark, sf_dir):
    f = all_findings(spark, sf_dir, "fallback")
    return f.select(KEY, r6(I.weighted_risk(F.col("risk"), F.col("event.ensemble_score")), "weighted_risk"))


@query
def response_actions(spark, sf_dir):
    f = flagged_events(spark, sf_dir)
    empty = F.array().cast("array<string>")
    given = F.when(F.col(KEY) % 3 == 0, F.array(F.col("event.dst_asset"))).when(F.col(KEY) % 3 == 1, empty)
    return f.select(
        KEY, F.array_join(I.response_actions(given), " | ").alias("actions"),
        F.array_join(I.response_actions(profile="canned"), " | ").alias("canned"),
    )


@query
def impact_text(spark, sf_dir):
    severity = F.initcap("o_priority")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey"), severities().alias("o_priority"))
    return orders.select("o_orderkey", F.col("o_priority").alias("severity"), I.impact_text(severity).alias("impact"))


def severities() -> Column:
    """A severity per order, with levels above and outside the report's."""
    levels = ["Low", "Medium", "High", "Critical", "Odd"]
    return F.element_at(F.array(*[F.lit(v) for v in levels]), (F.col("o_orderkey") % 5 + 1).cast("int"))


@query
def query_texts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    hint = F.when(F.col("event_id") % 2 == 0, F.lit("replay")).otherwise(F.lit(""))
    service = F.when(F.col("event_id") % 3 > 0, F.col("event_type"))
    return events.select(
        F.col("event_id").alias(KEY), I.query_text(F.col("event_type")).alias("plain"),
        I.query_text(service, hint).alias("hinted"),
    )


@query
def knowledge_attach(spark, sf_dir):
    out = incidents.attach_knowledge(flagged_events(spark, sf_dir), index(spark, sf_dir))
    return out.select(KEY, joined("knowledge_references", "\n"))


@query
def incident_report(spark, sf_dir):
    records = traffic(spark, sf_dir)
    out = incidents.investigate(scored(records), records, index(spark, sf_dir))
    return out.select(
        KEY, "attack_type", "protocol", "target", "severity", "confidence", "impact", joined("recommended_actions"),
        "root_cause", joined("knowledge_references", "\n"),
    )


@query
def alert_selection(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", severities().alias("severity"))
    return orders.select(
        "o_orderkey", "severity", I.should_notify(F.col("severity")).alias("at_medium"),
        I.should_notify(F.col("severity"), "Critical").alias("at_critical"),
    )


@query
def dispatch_status(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", severities().alias("severity"))
    return orders.select("o_orderkey", I.dispatch(F.col("severity")).alias("d")).select(
        "o_orderkey", "d.sent", "d.mode", F.coalesce("d.status_code", F.lit(-1)).alias("status_code")
    )


@query
def alert_table(spark, sf_dir):
    records = traffic(spark, sf_dir)
    reported = incidents.investigate(scored(records), records)
    path, alerts = scratch_path(spark, "alerts"), store(incidents.alerts(reported), "reported")
    # The second run repeats the first one's records, and is itself repeated.
    for run, part in (("a", alerts.where(F.col(KEY) % 2 == 0)), ("b", alerts), ("b", alerts)):
        sinks.append_alerts(part, path, run)
    sent = sinks.read_alerts(spark, path)
    payload = F.from_json("payload", "struct<attack_type:string,target:string,severity:string,confidence:double>")
    status = F.coalesce("status_code", F.lit(-1)).alias("status_code")
    return sent.select(KEY, "sent", "mode", status, payload.alias("p")).select(
        KEY, "sent", "mode", "status_code", "p.*"
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored replies made from conversations: whole, with a field missing, plain text, and cut short."""
    c = table(spark, sf_dir, "conversations")
    whole = F.to_json(
        F.struct(
            F.col("text").alias("likely_cause"),
            F.array("role", F.col("turn").cast("string")).alias("supporting_evidence"),
            (F.col("turn") / 8).alias("confidence"),
        )
    )
    partial = F.to_json(F.struct(F.col("text").alias("likely_cause")))
    kind = (F.col("conv_id") + F.col("turn")) % 4
    reply = (
        F.when(kind == 0, whole)
        .when(kind == 1, partial)
        .when(kind == 2, F.col("text"))
        .otherwise(F.substring(whole, 1, 12))
    )
    return c.select("conv_id", "turn", reply.alias("reply"))


@query
def reply_parse(spark, sf_dir):
    r = replies(spark, sf_dir).withColumn("cause", I.cause_from_reply(F.col("reply")))
    return r.select(
        "conv_id", "turn", "cause.likely_cause", joined("cause.supporting_evidence").alias("supporting_evidence"),
        "cause.confidence",
    )


@query
def reply_fields(spark, sf_dir):
    parsed = I.parse_reply(F.col("reply"), T.StructType([CAUSE_REPLY["likely_cause"], CAUSE_REPLY["confidence"]]))
    return replies(spark, sf_dir).select("conv_id", "turn", parsed.alias("p")).select("conv_id", "turn", "p.*")


def reply_kind() -> Column:
    return (F.col("conv_id") + F.col("turn")) % 4


def by_kind(*replies: Column) -> Column:
    """One of four replies, by conversation and turn."""
    first, second, third, last = replies
    kind = reply_kind()
    return F.when(kind == 0, first).when(kind == 1, second).when(kind == 2, third).otherwise(last)


def spelled(*parts: str) -> Column:
    """A text with the turn and the role put between its parts, in that order."""
    given = [F.col("turn").cast("string"), F.coalesce("role", F.lit("none"))]
    pieces = [F.lit(parts[0])]
    for value, part in zip(given, parts[1:]):
        pieces += [value, F.lit(part)]
    return F.concat(*pieces)


@query
def detection_replies(spark, sf_dir):
    """Replies that parse, with single quotes, with white space around plain text, and with text behind the JSON."""
    reply = by_kind(
        F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("summary"))),
        spelled("{'summary': 'Flagged turn ", " of ", "'}"),
        F.concat(F.lit("\n\t "), F.coalesce("text", F.lit("")), F.lit(" \n")),
        spelled('{"summary": "Flagged turn ', " of ", '"} and more'),
    )
    event = F.struct(
        *[F.lit("x").alias(c) for c in ("timestamp", "src_asset", "dst_asset", "mms_service")],
        *[F.lit(True).alias(c) for c in ("if_is_anomaly", "lof_is_anomaly")],
        (F.col("turn") / 8).alias("ensemble_score"),
    )
    c = table(spark, sf_dir, "conversations").withColumn("finding", I.detection_finding(event, reply))
    return c.select("conv_id", "turn", "finding.summary", r6("finding.confidence", "confidence"))


@query
def risk_replies(spark, sf_dir):
    """Whole replies, partial ones with an empty level, plain text, and single quotes."""
    reply = by_kind(
        spelled('{"asset_criticality": "Low", "attack_severity": "Critical", "business_risk_score": ', ', "operational_impact": "', '"}'),
        spelled('{"asset_criticality": "", "business_risk_score": "about ', '", "attack_severity": "', '"}'),
        F.coalesce("text", F.lit("")),
        spelled("{'asset_criticality': '", "', 'attack_severity': '", "'}"),
    )
    target = F.when(F.col("turn") % 3 == 0, F.lit("IED-Breaker-A")).otherwise(F.lit("RTU-1"))
    risk = I.risk(target, (F.col("turn") / 8).cast("double"), reply=reply)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", risk.alias("risk"))
    return c.select(
        "conv_id", "turn", "risk.asset_criticality", "risk.operational_impact", "risk.attack_severity",
        r6("risk.business_risk_score", "business_risk_score"),
    )


@query
def response_replies(spark, sf_dir):
    """Replies with actions, with an empty list, plain text, and text behind the JSON."""
    reply = by_kind(
        spelled('{"recommended_actions": ["Check turn ', '", "Ask ', '"]}'),
        F.lit('{"recommended_actions": []}'),
        F.coalesce("text", F.lit("")),
        spelled('{"recommended_actions": ["Check turn ', '", "Ask ', '"]} as said'),
    )
    actions = I.actions_from_reply(reply)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(actions, " | ").alias("actions"))


@query
def prompt_columns(spark, sf_dir):
    f = incidents.findings(flagged_events(spark, sf_dir), "canned")
    e, no_references = F.col("event"), F.array(F.lit("first"), F.lit("second"))
    text = I.event_json(e, RAW_NUMERIC)
    return f.select(
        KEY,
        I.detection_prompt(text).alias("detection_prompt"),
        I.cause_prompt(I.detection_summary(e), text, no_references).alias("cause_prompt"),
        I.risk_prompt(F.col("cause"), e["dst_asset"], e["ensemble_score"]).alias("risk_prompt"),
        I.response_prompt(F.col("cause"), F.col("risk")).alias("response_prompt"),
    )


@query
def prompt_hash(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", I.prompt_id(F.col("role"), F.col("text")).alias("prompt_id")
    )


# Streams.  Each runs over all rows of the events table, as one or more micro-batches.


def feed(records: DataFrame, parts: int, writer_of, name: str, end=None) -> None:
    """Append the records to a folder in ``parts`` steps of time; after each the stream reads what is new.

    ``end`` makes a last part from the latest time.

    The stream stops and resumes from its progress in between, as it would after a failure.
    """
    spark = records.sparkSession
    folder, progress = scratch_path(spark, f"{name}-input"), scratch_path(spark, f"{name}-progress")
    now = F.unix_micros(TIME)
    lo, hi = records.agg(F.min(now), F.max(now)).first()
    step = F.least(F.floor((now - lo) * parts / max(1, hi - lo)), F.lit(parts - 1))
    frames = [records.where(step == part) for part in range(parts)]
    if end is not None:
        frames.append(end(records.agg(F.max(TIME)).first()[0]))
    for frame in frames:
        write(frame, folder, "append")
        source = scoring.read_stream(spark, folder, records.schema)
        started = writer_of(source).option("checkpointLocation", progress).trigger(availableNow=True).start()
        started.awaitTermination()


@query
def stream_micro_batch(spark, sf_dir):
    records = traffic(spark, sf_dir)
    train, _ = split.split(records)
    model = detector.fit(train)
    out = scratch_path(spark, "stream-scored")
    feed(records, 2, lambda source: scoring.score_batches(source, model, out), "micro-batch")
    return spark.read.parquet(out).select(KEY, "attack_type", r6("ensemble_score"), "is_anomaly")


@query
def stream_stateless(spark, sf_dir):
    records = traffic(spark, sf_dir)
    prepared = features.add_zscore(records, "packet_size", "packet_size_zscore")
    forest = iforest.fit(store(prepared, "prepared"), [*RAW_NUMERIC, "packet_size_zscore"])
    out, moments = scratch_path(spark, "stream-rows"), features.fit_moments(records, "packet_size")

    def writer(source):
        rows = scoring.score_rows(source, forest, moments)
        return rows.writeStream.format("parquet").option("path", out)

    feed(records, 2, writer, "stateless")
    return spark.read.parquet(out).select(KEY, r6("packet_size_zscore"), r6("if_raw"), "if_is_anomaly")


@query
def stream_verdict(spark, sf_dir):
    train, test = split.split(traffic(spark, sf_dir))
    model = detector.fit(train)
    carried, out = store(features.add_rolling(test), "carried"), scratch_path(spark, "stream-verdict")
    feed(carried, 3, lambda source: scoring.judge_rows(source, model, out), "verdict")
    return spark.read.parquet(out).select(
        KEY, "attack_type", "if_is_anomaly", r6("if_score"), "lof_is_anomaly", r6("lof_score"), r6("ensemble_score"),
        "is_anomaly",
    )


@query
def stream_zscore(spark, sf_dir):
    records, out = traffic(spark, sf_dir), scratch_path(spark, "stream-zscore")
    moments = features.fit_moments(records, "packet_size")

    def writer(source):
        rows = features.add_zscore(source, "packet_size", "packet_size_zscore", moments)
        return rows.writeStream.format("parquet").option("path", out)

    feed(records, 2, writer, "zscore")
    return spark.read.parquet(out).select(KEY, "mms_service", r6("packet_size_zscore"))


@query
def stream_rolling(spark, sf_dir):
    records = traffic(spark, sf_dir)
    rolling = RollingStream(spark, scratch_path(spark, "stream-rolling"), timedelta(hours=1), records.schema)
    feed(records, 3, rolling.write, "rolling", rolling.end)
    return rolling.result().select(KEY, r6("rolling_request_rate_mean"), r6("rolling_latency_std"))


@query
def stream_alerts(spark, sf_dir):
    records = traffic(spark, sf_dir)
    train, _ = split.split(records)
    model = detector.fit(train)
    out = scratch_path(spark, "stream-alerts")
    feed(records, 2, lambda source: scoring.raise_alerts(source, model, out), "alerts")
    sent = spark.read.parquet(out)
    return sent.select(KEY, F.get_json_object("payload", "$.attack_type").alias("attack_type"), "sent", "mode")


@query
def detector_reload(spark, sf_dir):
    train, test = split.split(traffic(spark, sf_dir))
    path = scratch_path(spark, "detector")
    detector.save(detector.fit(train), path)
    out = detector.predict(detector.load(spark, path), test, mode="fitted")
    return out.select(KEY, r6("ensemble_score"), "is_anomaly")


@query
def index_reload(spark, sf_dir):
    path = scratch_path(spark, "text-index")
    retrieval.save_index(index(spark, sf_dir), path)
    loaded = retrieval.load_or_build(spark, path, table(spark, sf_dir, "documents"))
    out = retrieval.retrieve(loaded, benchmark_queries(spark, sf_dir))
    return out.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"),
        r6("score"),
    )
