"""Scans, decoders, extraction and per-batch statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.constants import ANALYTICS, ERRORS, LOGS, METRICS, TRACES
from beaconry.functions.columns import (
    exception_fields, is_error_log, is_error_span, payload_format, service_name)
from beaconry.functions.maps import nonempty
from beaconry.functions.values import any_value, attribute, bytes_value, kvlist_values, list_values
from beaconry.operators.extract import extract_error_logs, extract_error_spans
from beaconry.operators.stats import (
    batch_service_names, batch_stats, count_logs, count_metrics, count_spans, estimate_items, max_severity,
    profile_batches)
from beaconry.plans import fixtures as fx
from beaconry.plans.registry import query
from beaconry.plans.scratch import shared_folder
from beaconry.plans.sql import sql
from beaconry.sources import otlp
from beaconry.sources.envelopes import read_envelopes, stream_envelopes
from beaconry.sources.requests import classify_rejects, read_analytics, read_error_reports

ms = F.unix_millis

_ENVELOPES = sql("""SELECT batch_id, received_ms, 'logs' AS signal, content_type, header_source, header_node_id,
  header_tenant, header_tenant_alt, true AS has_payload FROM bt""")


def _envelope_row(env: DataFrame) -> DataFrame:
    return env.select(
        "batch_id", ms("received_at").alias("received_ms"), "signal", "content_type", "header_source",
        "header_node_id", "header_tenant", "header_tenant_alt", (F.octet_length("payload") > 0).alias("has_payload"))


@query("a1_envelope_scan", _ENVELOPES)
def a1(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark)
    fx.envelopes(spark, d, LOGS).write.parquet(path)
    return _envelope_row(read_envelopes(spark, path))


@query("a2_stream_envelopes", _ENVELOPES)
def a2(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark)
    fx.envelopes(spark, d, LOGS).write.parquet(f"{path}/in")
    stream = _envelope_row(stream_envelopes(spark, f"{path}/in"))
    run = (stream.writeStream.format("parquet").option("path", f"{path}/out")
           .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


_SPANS = sql(f"""SELECT batch_id, svc AS service_name, 'host-' || svc AS host, 'scope' AS scope_name, trace_id, span_id,
  parent_span_id, 'GET /' || event_type AS name, 2 AS kind, ms AS start_ms, (us + cents * 1000) // 1000 AS end_ms,
  coalesce(status_code, 0) AS status_code, status_message, 6 AS attribute_count,
  CASE WHEN has_exc THEN CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END ELSE 0 END AS event_count FROM sp""")


def _span_rows(spans: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return spans.select(
        "batch_id", "service_name", F.col("resource_attrs")["host.name"].alias("host"), "scope_name", "trace_id", "span_id",
        "parent_span_id", "name", "kind", ms("start_ts").alias("start_ms"), ms("end_ts").alias("end_ms"),
        F.coalesce("status_code", F.lit(0)).alias("status_code"),
        F.nullif(F.col("status_message"), F.lit("")).alias("status_message"), n("attributes").alias("attribute_count"),
        n("events").alias("event_count"))


@query("a3_decode_spans", _SPANS)
def a3(spark: SparkSession, d: str) -> DataFrame:
    return _span_rows(otlp.decode_spans(fx.envelopes(spark, d, TRACES)))


_METRICS = sql("""SELECT DISTINCT batch_id, svc AS service_name, name, name || ' of a service' AS description, unit, kind
  FROM ev, (VALUES ('events.total', '1', 'sum'), ('value.last', 'usd', 'gauge'),
            ('value.dist', 'usd', 'histogram')) m(name, unit, kind)""")


def _metric_rows(metrics: DataFrame) -> DataFrame:
    return metrics.select("batch_id", "service_name", "name", "description", "unit", "kind")


@query("a4_decode_metrics", _METRICS)
def a4(spark: SparkSession, d: str) -> DataFrame:
    return _metric_rows(otlp.decode_metrics(fx.envelopes(spark, d, METRICS)))


_POINTS = sql("""SELECT batch_id, svc AS service_name, m.name, arg_max(ms, event_id) AS point_ms,
  CASE WHEN m.name = 'events.total' THEN count(*) END AS as_int,
  CASE WHEN m.name = 'value.last' THEN arg_max(value, event_id) END AS as_double,
  CASE WHEN m.name = 'value.dist' THEN count(*) END AS point_count,
  CASE WHEN m.name = 'value.dist' THEN cast(round(sum(value) * 100) AS bigint) END AS point_sum_cents,
  CASE WHEN m.name = 'value.dist' THEN min(value) END AS point_min,
  CASE WHEN m.name = 'value.dist' THEN max(value) END AS point_max,
  CASE WHEN m.name = 'value.dist' THEN count_if(value <= 50) END AS b0,
  CASE WHEN m.name = 'value.dist' THEN count_if(value > 50 AND value <= 100) END AS b1,
  CASE WHEN m.name = 'value.dist' THEN count_if(value > 100 AND value <= 200) END AS b2,
  CASE WHEN m.name = 'value.dist' THEN count_if(value > 200) END AS b3,
  CASE m.name WHEN 'events.total' THEN 2 WHEN 'value.dist' THEN 1 END AS temporality,
  CASE WHEN m.name = 'events.total' THEN true END AS monotonic
  FROM ev, (VALUES ('events.total'), ('value.last'), ('value.dist')) m(name) GROUP BY batch_id, svc, m.name""")


_POINT_COLUMNS = ("as_int", "as_double", "count", "sum", "min", "max", "bucket_counts")


def _point_rows(points: DataFrame) -> DataFrame:
    return points.select(
        "batch_id", "service_name", "name", ms("ts").alias("point_ms"), "as_int",
        "as_double", F.col("count").cast("bigint").alias("point_count"),
        F.round(F.col("sum") * 100).cast("bigint").alias("point_sum_cents"), F.col("min").alias("point_min"), F.col("max").alias("point_max"),
        *[F.get("bucket_counts", F.lit(i)).cast("bigint").alias(f"b{i}") for i in range(4)], "temporality", "monotonic")


@query("a5_metric_points", _POINTS)
def a5(spark: SparkSession, d: str) -> DataFrame:
    return _point_rows(otlp.decode_points(fx.envelopes(spark, d, METRICS), _POINT_COLUMNS))


_LOGS = sql("""SELECT batch_id, svc AS service_name, ms AS ts_ms, sev AS severity_number, sev_text AS severity_text, body,
  trace_id, span_id, 8 + has_exc::int + has_msg::int AS attribute_count FROM log""")


def _log_rows(logs: DataFrame) -> DataFrame:
    return logs.select(
        "batch_id", "service_name", ms("ts").alias("ts_ms"), "severity_number", "severity_text", "body", "trace_id",
        "span_id", F.size("attributes").alias("attribute_count"))


@query("a6_decode_logs", _LOGS)
def a6(spark: SparkSession, d: str) -> DataFrame:
    return _log_rows(otlp.decode_logs(fx.envelopes(spark, d, LOGS)))


@query("a7_decode_spans_proto", _SPANS)
def a7(spark: SparkSession, d: str) -> DataFrame:
    return _span_rows(otlp.decode_spans_proto(fx.proto_envelopes(spark, d, TRACES)))


@query("a8_decode_logs_proto", _LOGS)
def a8(spark: SparkSession, d: str) -> DataFrame:
    return _log_rows(otlp.decode_logs_proto(fx.proto_envelopes(spark, d, LOGS)))


@query("a9_decode_metrics_proto", _POINTS)
def a9(spark: SparkSession, d: str) -> DataFrame:
    return _point_rows(otlp.decode_points_proto(fx.proto_envelopes(spark, d, METRICS), _POINT_COLUMNS))


_NESTED = """'hop-' || batch_no AS hop, 4 AS hops, batch_no AS n, true AS flag, 0.5::double AS half, batch_no AS caller_id,
  'a, {b}' AS tag, batch_id AS digest"""


def _nested_columns(attributes: Column) -> list[Column]:
    """What the list, the key-value list and the bytes of ``fx.nested`` hold, opened level by level or as VARIANT."""
    route, caller = attribute(attributes, "route"), kvlist_values(attribute(attributes, "caller"))
    hops = list_values(route)
    return [
        F.try_variant_get(any_value(route), "$.values[0].stringValue", "string").alias("hop"), F.size(hops).alias("hops"),
        F.get(hops, F.lit(1))["intValue"].cast("bigint").alias("n"), F.get(hops, F.lit(2))["boolValue"].alias("flag"),
        F.get(list_values(F.get(hops, F.lit(3))), F.lit(0))["doubleValue"].alias("half"),
        caller["id"]["intValue"].cast("bigint").alias("caller_id"),
        F.get(list_values(caller["tags"]), F.lit(0))["stringValue"].alias("tag"),
        bytes_value(attribute(attributes, "digest")).cast("string").alias("digest")]


def _nested_logs(logs: DataFrame) -> DataFrame:
    return logs.select("batch_id", "span_id", "body", kvlist_values(F.col("body_value"))["text"]["stringValue"].alias("body_text"),
                       *_nested_columns(F.col("attributes")))


_NESTED_LOGS = sql(f"SELECT batch_id, span_id, cast(NULL AS varchar) AS body, body AS body_text, {_NESTED} FROM log")
_NESTED_POINTS = sql(f"""SELECT DISTINCT batch_id, svc AS service_name, name, {_NESTED}
  FROM ev, (VALUES ('events.total'), ('value.last'), ('value.dist')) m(name)""")


@query("a3_nested_values", sql(f"SELECT batch_id, span_id, {_NESTED} FROM sp"))
def a3_nested(spark: SparkSession, d: str) -> DataFrame:
    spans = otlp.decode_spans(fx.nested(spark, d, TRACES))
    return spans.select("batch_id", "span_id", *_nested_columns(F.col("attributes")))


@query("a5_nested_values", _NESTED_POINTS)
def a5_nested(spark: SparkSession, d: str) -> DataFrame:
    return _nested_points(otlp.decode_metrics(fx.nested(spark, d, METRICS)))


def _nested_points(metrics: DataFrame) -> DataFrame:
    return otlp.metric_points(metrics).select("batch_id", "service_name", "name", *_nested_columns(F.col("attributes")))


@query("a6_nested_values", _NESTED_LOGS)
def a6_nested(spark: SparkSession, d: str) -> DataFrame:
    return _nested_logs(otlp.decode_logs(fx.nested(spark, d, LOGS)))


@query("a8_nested_values_proto", _NESTED_LOGS)
def a8_nested(spark: SparkSession, d: str) -> DataFrame:
    return _nested_logs(otlp.decode_logs_proto(fx.as_proto(fx.nested(spark, d, LOGS), LOGS)))


@query("a9_nested_values_proto", _NESTED_POINTS)
def a9_nested(spark: SparkSession, d: str) -> DataFrame:
    return _nested_points(otlp.decode_metrics_proto(fx.as_proto(fx.nested(spark, d, METRICS), METRICS)))


@query("p5_extract_error_logs_proto", sql("""SELECT batch_id, span_id, svc AS service_name, body AS message,
  sev AS severity_number, exc_type, exc_msg, 6 + has_exc::int + has_msg::int AS attribute_count,
  regexp_replace(cast(value AS varchar), '\\.0$', '') AS raw_text FROM log WHERE proto_error"""))
def p5_proto(spark: SparkSession, d: str) -> DataFrame:
    errors = extract_error_logs(otlp.decode_logs_proto(fx.proto_envelopes(spark, d, LOGS)))
    return errors.select(
        "batch_id", "span_id", "service_name", "message", "severity_number",
        F.col("exception_type").alias("exc_type"), F.col("exception_message").alias("exc_msg"),
        F.size("attributes").alias("attribute_count"), F.col("attributes")["raw"].alias("raw_text"))


@query("p4_extract_error_spans_proto", sql("""SELECT batch_id, 'GET /' || event_type AS span_name, svc AS service_name,
  coalesce(status_message, exc_msg) AS error_message, exc_type AS exception_type, stack AS stack_trace, span_id,
  5 + (k % 10 = 0)::int AS attribute_count FROM sp WHERE is_error"""))
def p4_proto(spark: SparkSession, d: str) -> DataFrame:
    errors = extract_error_spans(otlp.decode_spans_proto(fx.proto_envelopes(spark, d, TRACES)), fmt="protobuf")
    return errors.select("batch_id", "span_name", "service_name", "error_message", "exception_type", "stack_trace", "span_id",
                         F.size("attributes").alias("attribute_count"))


@query("g7_batch_stats_proto", sql("""SELECT batch_id,
  CASE WHEN batch_no % 16 = 15 THEN greatest(1, 14 // 150) ELSE count(*) END AS item_count,
  CASE WHEN batch_no % 16 = 15 THEN 'estimated' ELSE 'exact' END AS count_method,
  CASE WHEN batch_no % 16 = 15 THEN 0 ELSE count_if(proto_error) END AS error_count,
  CASE WHEN batch_no % 16 = 15 THEN 0 ELSE max(sev) END AS max_severity,
  CASE WHEN batch_no % 16 <> 15 THEN arg_min(svc, event_id) END AS first_service
  FROM log GROUP BY batch_id, batch_no"""))
def g7_proto(spark: SparkSession, d: str) -> DataFrame:
    profile = profile_batches(fx.proto_envelopes(spark, d, LOGS, broken=True), LOGS)
    return profile.select("batch_id", "item_count", "count_method", F.coalesce("error_count", F.lit(0)).alias("error_count"),
                          "max_severity", F.get("service_names", F.lit(0)).alias("first_service"))


@query("a10_payload_format", sql("""SELECT batch_id, CASE WHEN batch_no % 8 >= 5 THEN 'protobuf' ELSE 'json' END
  AS source_format FROM bt"""))
def a10(spark: SparkSession, d: str) -> DataFrame:
    return fx.malformed(spark, d, LOGS).select("batch_id", payload_format(F.col("content_type")).alias("source_format"))


_AN_COLUMNS = """batch_id, pos, event_type AS event_name, ts_ms, distinct_id, uid AS user_id,
  session_id, correlation_id, node_id, tenant AS tenant_id, environment, an_source AS source_name,
  an_node AS source_node_id, an_header_tenant AS header_tenant, k, 4 AS property_count"""


@query("a11_read_analytics", sql(f"SELECT {_AN_COLUMNS} FROM an WHERE batch_no % 10 < 6"))
def a11(spark: SparkSession, d: str) -> DataFrame:
    return _analytics_rows(fx.envelopes(spark, d, ANALYTICS, broken=True))


def _analytics_rows(envelopes: DataFrame) -> DataFrame:
    events, _ = read_analytics(envelopes)
    return events.select(
        "batch_id", F.col("pos").cast("bigint").alias("pos"), "event_name", ms("ts").alias("ts_ms"), "distinct_id", "user_id",
        "session_id", "correlation_id", "node_id", "tenant_id", "environment", "source_name", "source_node_id",
        "header_tenant", F.try_variant_get(F.col("properties")["k"], "$", "int").alias("k"),
        F.size("properties").alias("property_count"))


_ER_COLUMNS = """report_id AS batch_id, message, severity, correlation_id, operation_id,
  node_id, uid AS user_id, environment, source_name, '/api/' || (k % 4) AS endpoint, er_tenant AS tenant_tag,
  CASE WHEN er_tenant IS NULL THEN 2 ELSE 3 END AS tag_count, cents, stack AS stack_trace"""


@query("a12_read_error_reports", sql(f"SELECT {_ER_COLUMNS} FROM er WHERE k % 10 NOT IN (6, 7)"))
def a12(spark: SparkSession, d: str) -> DataFrame:
    return _report_rows(fx.envelopes(spark, d, ERRORS, broken=True))


def _report_rows(envelopes: DataFrame) -> DataFrame:
    errors, _ = read_error_reports(envelopes)
    tags = F.col("tags")
    return errors.select(
        "batch_id", "message", "severity", "correlation_id", "operation_id", "node_id", "user_id", "environment",
        "source_name", tags["endpoint"].alias("endpoint"), tags["tenant_id"].alias("tenant_tag"),
        F.size(tags).alias("tag_count"), F.try_variant_get(F.col("extra")["cents"], "$", "bigint").alias("cents"), "stack_trace")


@query("a13_classify_rejects", sql("""SELECT batch_id, 'analytics' AS signal,
  CASE WHEN batch_no % 10 = 8 THEN 'Invalid JSON format' ELSE 'No events provided' END AS reason
  FROM bt WHERE batch_no % 10 >= 6
  UNION ALL SELECT batch_id || '-' || form, 'analytics', CASE form WHEN 5 THEN 'Invalid JSON format'
    ELSE 'No events provided' END FROM bt, range(2, 6) t(form)
  UNION ALL SELECT report_id, 'errors', CASE WHEN k % 10 = 6 THEN 'Invalid request' ELSE 'Invalid JSON format' END
  FROM er WHERE k % 10 IN (6, 7)"""))
def a13(spark: SparkSession, d: str) -> DataFrame:
    both = fx.envelopes(spark, d, ANALYTICS, broken=True).unionByName(fx.envelopes(spark, d, ERRORS, broken=True)).unionByName(
        fx.spaced_requests(spark, d))
    return classify_rejects(both).select("batch_id", "signal", "reason")


@query("a11_any_case", sql(f"SELECT {_AN_COLUMNS} FROM an"))
def a11_any_case(spark: SparkSession, d: str) -> DataFrame:
    """Field names in any case are the same fields."""
    return _analytics_rows(fx.renamed_requests(spark, d, ANALYTICS))


@query("a12_any_case", sql(f"SELECT {_ER_COLUMNS} FROM er"))
def a12_any_case(spark: SparkSession, d: str) -> DataFrame:
    return _report_rows(fx.renamed_requests(spark, d, ERRORS))


@query("a13_wrong_types", sql("""SELECT batch_id || '-' || form AS batch_id, 'analytics' AS signal, 'Invalid JSON format' AS reason
  FROM bt, range(2, 12) t(form)
  UNION ALL SELECT report_id || '-' || form, 'errors', 'Invalid JSON format' FROM er, range(2, 11) t(form)"""))
def a13_wrong_types(spark: SparkSession, d: str) -> DataFrame:
    """One field of a wrong type refuses the whole request."""
    return classify_rejects(fx.wrong_requests(spark, d)).select("batch_id", "signal", "reason")


@query("c6_service_name", sql("SELECT DISTINCT batch_id, svc AS service_name FROM ev"))
def c6(spark: SparkSession, d: str) -> DataFrame:
    decoded = otlp.decode_json(fx.envelopes(spark, d, LOGS), LOGS)
    return decoded.select("batch_id", F.explode(nonempty(F.col("doc.resourceLogs"))).alias("r")).select(
        "batch_id", service_name(F.col("r.resource"), "json").alias("service_name"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return otlp.decode_spans(fx.envelopes(spark, d, TRACES))


def _logs(spark: SparkSession, d: str) -> DataFrame:
    return otlp.decode_logs(fx.envelopes(spark, d, LOGS))


@query("p1_is_error_span", sql("SELECT batch_id, span_id, is_error FROM sp"))
def p1(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select(
        "batch_id", "span_id", is_error_span(F.col("status_code"), F.col("events")).alias("is_error"))


@query("p2_exception_fields", sql("""SELECT span_id, exc_type AS exception_type, exc_msg AS exception_message,
  stack AS stack_trace FROM sp"""))
def p2(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("span_id", exception_fields(F.col("events"), "json").alias("x")).select("span_id", "x.*")


@query("p3_is_error_log", sql("SELECT span_id, json_error AS as_json, proto_error AS as_protobuf FROM log"))
def p3(spark: SparkSession, d: str) -> DataFrame:
    def test(fmt: str) -> Column:
        return is_error_log(F.col("severity_number"), F.col("severity_text"), F.col("attributes"), fmt)

    return _logs(spark, d).select("span_id", test("json").alias("as_json"), test("protobuf").alias("as_protobuf"))


@query("p4_extract_error_spans", sql("""SELECT batch_id, 'GET /' || event_type AS span_name, svc AS service_name,
  coalesce(status_message, exc_msg) AS error_message, exc_type AS exception_type, exc_msg AS exception_message,
  stack AS stack_trace, trace_id, span_id, 4 + (k % 10 = 0)::int AS attribute_count, cast(k AS varchar) AS k_text,
  big AS big_text FROM sp WHERE is_error"""))
def p4(spark: SparkSession, d: str) -> DataFrame:
    return extract_error_spans(_spans(spark, d), fmt="json").select(
        "batch_id", "span_name", "service_name", "error_message", "exception_type", "exception_message", "stack_trace",
        "trace_id", "span_id", F.size("attributes").alias("attribute_count"), F.col("attributes")["k"].alias("k_text"),
        F.col("attributes")["big"].alias("big_text"))


@query("p5_extract_error_logs", sql(f"""SELECT batch_id, body AS message, sev AS severity_number, sev_text AS severity_text,
  ms AS ts_ms, svc AS service_name, trace_id, span_id, exc_type AS exception_type, exc_msg AS exception_message,
  5 + has_exc::int + has_msg::int AS attribute_count, 'last' AS dup FROM log WHERE json_error"""))
def p5(spark: SparkSession, d: str) -> DataFrame:
    return extract_error_logs(_logs(spark, d), fmt="json").select(
        "batch_id", "message", "severity_number", "severity_text", ms("ts").alias("ts_ms"), "service_name", "trace_id",
        "span_id", "exception_type", "exception_message", F.size("attributes").alias("attribute_count"),
        F.col("attributes")["dup"].alias("dup"))


_COUNT = """SELECT batch_id, CASE WHEN batch_no % 8 = 0 THEN {good} WHEN batch_no % 8 = 1 THEN 0
  WHEN batch_no % 8 = 4 THEN greatest(1, 19 * (batch_no % 97 + 1) // {per}) WHEN batch_no % 8 = 7 THEN 0
  WHEN batch_no % 8 < 5 THEN 1 WHEN batch_no % 997 = 0 THEN 0 ELSE greatest(1, batch_no % 997 // {per}) END AS item_count{more}
  FROM {source}"""


@query("g1_count_spans", sql(_COUNT.format(good="n", per=300, more="", source="bt")))
def g1(spark: SparkSession, d: str) -> DataFrame:
    return count_spans(fx.malformed(spark, d, TRACES))


@query("g2_count_metrics", sql(
    "SELECT batch_id, item_count, item_count AS estimated_points, exact_points FROM (" + _COUNT.format(
        good="3 * services", per=100, more=", CASE WHEN batch_no % 8 = 0 THEN 3 * services ELSE 0 END AS exact_points",
        source="(SELECT batch_id, batch_no, count(DISTINCT svc) AS services FROM ev GROUP BY batch_id, batch_no)") + ")"))
def g2(spark: SparkSession, d: str) -> DataFrame:
    return count_metrics(fx.malformed(spark, d, METRICS)).withColumn("exact_points", F.coalesce("exact_points", F.lit(0)))


@query("g3_count_logs", sql(_COUNT.format(good="n", per=150, more="", source="bt")))
def g3(spark: SparkSession, d: str) -> DataFrame:
    return count_logs(fx.malformed(spark, d, LOGS))


#: No SQL: the good documents' size is that of their encoder. The tests hold this against the payloads.
@query("g4_estimate_items")
def g4(spark: SparkSession, d: str) -> DataFrame:
    parts = [estimate_items(fx.malformed(spark, d, s)) for s in (TRACES, METRICS, LOGS)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("g4_estimate_texts", """SELECT 'd' || doc_id AS batch_id, s.signal,
  CASE WHEN coalesce(octet_length(encode(text)), 0) = 0 THEN 0 ELSE greatest(1, octet_length(encode(text)) // per) END AS estimated_items
  FROM documents, (VALUES ('traces', 300), ('metrics', 100), ('logs', 150)) s(signal, per)""")
def g4_texts(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of any kind, here the whole texts of ``documents``, as each signal."""
    texts = spark.read.parquet(f"{d}/documents.parquet").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("batch_id"), F.col("text").cast("binary").alias("payload"),
        F.explode(F.array(*[F.lit(s) for s in (TRACES, METRICS, LOGS)])).alias("signal"))
    return estimate_items(texts)


@query("g5_batch_service_names", sql("""SELECT batch_id, string_agg(svc, '|' ORDER BY p) AS service_names FROM (
  SELECT batch_id, arg_min(svc, event_id) AS svc, min(event_id) AS p FROM ev GROUP BY batch_id, lower(svc))
  GROUP BY batch_id"""))
def g5(spark: SparkSession, d: str) -> DataFrame:
    return batch_service_names(fx.mixed(spark, d, LOGS), LOGS).select(
        "batch_id", F.array_join("service_names", "|").alias("service_names"))


@query("g6_max_severity", sql("SELECT batch_id, max_sev AS max_severity FROM bt"))
def g6(spark: SparkSession, d: str) -> DataFrame:
    return max_severity(fx.mixed(spark, d, LOGS))


@query("g7_batch_stats", sql("""SELECT batch_id, 'logs' AS signal, count(*) AS item_count, 0 AS data_point_count,
  count_if(mixed_error) AS error_count, max(sev) AS max_severity, count(DISTINCT lower(svc)) AS service_count
  FROM log GROUP BY batch_id UNION ALL
  SELECT batch_id, 'traces', count(*), 0, count_if(is_error), 0, count(DISTINCT lower(svc)) FROM sp GROUP BY batch_id
  UNION ALL SELECT batch_id, 'metrics', 3 * count(DISTINCT svc), 3 * count(DISTINCT svc), 0, 0,
  count(DISTINCT lower(svc)) FROM ev GROUP BY batch_id"""))
def g7(spark: SparkSession, d: str) -> DataFrame:
    def one(signal: str) -> DataFrame:
        stats = batch_stats(profile_batches(fx.mixed(spark, d, signal), signal, records=False))
        return stats.select("batch_id", "signal", "item_count", "data_point_count", "error_count", "max_severity",
                            F.size("service_names").alias("service_count"))

    return one(LOGS).unionByName(one(TRACES)).unionByName(one(METRICS))
