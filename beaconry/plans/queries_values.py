"""Scalar functions, predicates and analytics projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.constants import ANALYTICS, ERRORS, KEYS, LEVEL_MIN_SEVERITY, LOGS
from beaconry.context import CollectorOptions
from beaconry.functions.columns import (
    any_value_text, attrs_map, backend_level, event_name, hex_id, is_deliverable, is_safe_tenant, meter_name,
    min_severity, nano_ts, severity_level, severity_name, source_name, tag_key, valid_resource)
from beaconry.functions.maps import nonempty
from beaconry.operators.analytics import (
    batch_tenant, capture_events, capture_properties, event_distinct_id, filter_properties, pack_batches, tag_map,
    to_analytics_request, with_field, with_property)
from beaconry.operators.enrich import fill_tenant
from beaconry.operators.errors import apply_default_tags, deliverable, error_delivery, sample, with_tag
from beaconry.plans import fixtures as fx
from beaconry.plans.registry import query
from beaconry.plans.sql import CUT_KEY, LONG_KEY, safe, sql, values
from beaconry.sources import otlp
from beaconry.sources.requests import read_analytics, read_error_reports

ms = F.unix_millis


def text(variant: Column) -> Column:
    return F.try_variant_get(variant, "$", "string")


def _logs(spark: SparkSession, d: str) -> DataFrame:
    return otlp.decode_logs(fx.envelopes(spark, d, LOGS))


def _any_value_rows(logs: DataFrame) -> DataFrame:
    return logs.select("source_format", "span_id", F.posexplode("attributes").alias("pos", "a")).select(
        "source_format", "span_id", "pos", F.col("a.key").alias("key"),
        any_value_text(F.col("a.value"), F.col("source_format")).alias("text"))


def _any_value_sql(fmt: str, raw: str) -> str:
    return sql(f"""SELECT '{fmt}' AS source_format, span_id, pos, key, text FROM log, LATERAL (
      SELECT row_number() OVER (ORDER BY i) - 1 AS pos, key, text FROM (VALUES
        (0, 'k', cast(k AS varchar), true), (1, 'cents', cast(cents AS varchar), true), (2, 'big', big, true),
        (3, 'raw', {raw}, true), (4, 'empty', '', true), (5, 'dup', 'first', true), (6, 'dup', 'last', true),
        (7, '{LONG_KEY}', 'long', true), (8, 'exception.type', exc_type, has_exc),
        (9, 'exception.message', exc_msg, has_msg)) t(i, key, text, c) WHERE c) v(pos, key, text)""".replace(
        "log, LATERAL", "(SELECT * EXCLUDE (pos) FROM log), LATERAL"))


@query("c1_any_value_text", _any_value_sql("json", "cast(NULL AS varchar)"))
def c1(spark: SparkSession, d: str) -> DataFrame:
    return _any_value_rows(_logs(spark, d))


@query("c1_any_value_text_proto", _any_value_sql("protobuf", "regexp_replace(cast(value AS varchar), '\\.0$', '')"))
def c1_proto(spark: SparkSession, d: str) -> DataFrame:
    return _any_value_rows(otlp.decode_logs_proto(fx.proto_envelopes(spark, d, LOGS)))


@query("c2_body_text", """SELECT 'd' || doc_id AS batch_id, source AS service_name, length(text) AS chars,
  md5(text) AS body_hash FROM documents""")
def c2(spark: SparkSession, d: str) -> DataFrame:
    return otlp.decode_logs(fx.document_logs(spark, d)).select(
        "batch_id", "service_name", F.length("body").cast("bigint").alias("chars"), F.md5("body").alias("body_hash"))


@query("c3_hex_id", sql("SELECT event_id, CASE WHEN event_id % 5 > 0 THEN md5(batch_id) END AS id FROM ev"))
def c3(spark: SparkSession, d: str) -> DataFrame:
    binary = F.when(F.col("event_id") % 5 > 0, F.unhex(F.md5("batch_id"))).otherwise(F.lit("").cast("binary"))
    return fx.base(spark, d).select("event_id", hex_id(binary).alias("id"))


@query("c4_nano_ts", sql("""SELECT event_id,
  CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 7000 ELSE ms END AS as_json,
  CASE event_id % 4 WHEN 0 THEN 7000 WHEN 1 THEN 7000 ELSE ms END AS as_protobuf FROM ev"""))
def c4(spark: SparkSession, d: str) -> DataFrame:
    e, us = F.col("event_id"), F.col("us")
    nanos = F.when(e % 4 == 0, "0").when(e % 4 == 1, F.lit(None)).otherwise((us * 1000).cast("string"))
    arrival = F.timestamp_millis(F.lit(7000))
    return fx.base(spark, d).select("event_id", ms(nano_ts(nanos, arrival, "json")).alias("as_json"),
                                    ms(nano_ts(nanos, arrival, "protobuf")).alias("as_protobuf"))


_LOG_ATTRIBUTES = values(
    ("k", "k", "true"), ("cents", "cents", "true"), ("big", "big", "true"), ("dup", "'last'", "true"),
    (LONG_KEY, "'long'", "true"), ("exception.type", "exc_type", "has_exc"), ("exception.message", "exc_msg", "has_msg"))


@query("c5_attrs_map", sql(f"SELECT span_id, m.key, m.value FROM log, LATERAL {_LOG_ATTRIBUTES} m"))
def c5(spark: SparkSession, d: str) -> DataFrame:
    return _logs(spark, d).select("span_id", F.explode(attrs_map(F.col("attributes"), "json")).alias("key", "value"))


@query("c7_severity_level", sql("""SELECT event_id, CASE WHEN n >= 21 THEN 4 WHEN n >= 17 THEN 3 WHEN n >= 13 THEN 2
  WHEN n >= 9 THEN 1 ELSE 0 END AS level, CASE WHEN n >= 21 THEN 'Fatal' WHEN n >= 17 THEN 'Error'
  WHEN n >= 13 THEN 'Warning' WHEN n >= 9 THEN 'Info' ELSE 'Debug' END AS name
  FROM (SELECT event_id, k % 26 AS n FROM ev)"""))
def c7(spark: SparkSession, d: str) -> DataFrame:
    level = severity_level(F.col("k") % 26)
    return fx.base(spark, d).select("event_id", level.alias("level"), severity_name(level).alias("name"))


@query("c8_min_severity", sql("""SELECT event_id, coalesce([1, 5, 9, 13, 17, 21, 2147483647][k % 8 + 1], 0) AS min_severity
  FROM ev"""))
def c8(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in LEVEL_MIN_SEVERITY])
    level = F.coalesce(F.get(names, F.col("k") % 8), F.lit("Verbose"))
    return fx.base(spark, d).select("event_id", min_severity(level).alias("min_severity"))


@query("c9_backend_level", sql("""SELECT event_id, CASE k % 7 WHEN 0 THEN 'debug' WHEN 1 THEN 'info' WHEN 2 THEN 'warning'
  WHEN 4 THEN 'fatal' ELSE 'error' END AS level FROM ev"""))
def c9(spark: SparkSession, d: str) -> DataFrame:
    return fx.base(spark, d).select("event_id", backend_level(F.col("k") % 7).alias("level"))


@query("c10_tag_key", sql("""SELECT event_id, substr(repeat(event_type || '.', k % 9 + 1), 1, 32) AS key FROM ev"""))
def c10(spark: SparkSession, d: str) -> DataFrame:
    key = F.repeat(F.concat("event_type", F.lit(".")), F.col("k") % 9 + 1)
    return fx.base(spark, d).select("event_id", tag_key(key).alias("key"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read_analytics(fx.envelopes(spark, d, ANALYTICS))[0]


_DISTINCT = """coalesce(distinct_id, uid, 'session:' || session_id, 'anon:' || correlation_id,
  'anon:' || md5(batch_id || '/' || pos))"""


@query("c11_distinct_id", sql(f"SELECT batch_id, pos, {_DISTINCT} AS resolved_id FROM an"))
def c11(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("batch_id", F.col("pos").cast("bigint").alias("pos"), event_distinct_id().alias("resolved_id"))


def _map_rows(df: DataFrame, m: Column) -> DataFrame:
    return df.select("batch_id", F.col("pos").cast("bigint").alias("pos"), F.explode(nonempty(m)).alias("key", "v")).select(
        "batch_id", "pos", "key", text(F.col("v")).alias("value"))


def _key(name: str) -> str:
    return KEYS.of(name)


_OWN = (("k", "k", "true"), ("cents", "cents", "true"), ("password", "'hunter2'", "true"), ("Secret", "'x'", "true"))
_TAGS = values((_key("node_id"), "node_id", "true"), (_key("correlation_id"), "correlation_id", "true"),
               (_key("tenant_id"), "tenant", "true"), (_key("user_id"), "uid", "true"),
               (_key("session_id"), "session_id", "true"), (_key("environment"), "environment", "true"), *_OWN)


@query("c12_tag_map", sql(f"SELECT batch_id, pos, m.key, m.value FROM an, LATERAL {_TAGS} m"))
def c12(spark: SparkSession, d: str) -> DataFrame:
    return _map_rows(_events(spark, d), tag_map())


_CAPTURED = values((_key("node_id"), "node_id", "true"), (_key("correlation_id"), "correlation_id", "true"),
                   (_key("tenant_id"), "tenant", "true"), (_key("session_id"), "session_id", "true"),
                   (_key("environment"), "environment", "true"), *_OWN[:2])
FILTERED = CollectorOptions(excluded_properties=("PASSWORD", "secret"))


@query("c13_capture_properties", sql(f"SELECT batch_id, pos, m.key, m.value FROM an, LATERAL {_CAPTURED} m"))
def c13(spark: SparkSession, d: str) -> DataFrame:
    return _map_rows(_events(spark, d), capture_properties(FILTERED))


def _json(path: str, column: str = "json") -> Column:
    return F.get_json_object(column, path)


@query("c14_capture_events", sql(f"""SELECT batch_id, pos, event_type AS event, {_DISTINCT} AS distinct_id,
  strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g+00:00') AS timestamp, cast(k AS varchar) AS k,
  tenant AS tenant_id, false AS has_password FROM an"""))
def c14(spark: SparkSession, d: str) -> DataFrame:
    return capture_events(_events(spark, d), FILTERED).select(
        "batch_id", F.col("pos").cast("bigint").alias("pos"), _json("$.event").alias("event"),
        _json("$.distinct_id").alias("distinct_id"), _json("$.timestamp").alias("timestamp"),
        _json("$.properties.k").alias("k"), _json("$.properties.tenant_id").alias("tenant_id"),
        _json("$.properties.password").isNotNull().alias("has_password"))


@query("c15_to_analytics_request", sql("""SELECT batch_id, 'shop' AS source_service, count(*) AS events,
  arg_min(event_type, pos) AS first_event, arg_max(k, pos) AS last_k,
  strftime(make_timestamp(arg_max(ts_ms, pos) * 1000), '%Y-%m-%dT%H:%M:%S.%g+00:00') AS last_time,
  arg_max(tenant, pos) FILTER (pos = 1) AS second_tenant FROM an GROUP BY batch_id"""))
def c15(spark: SparkSession, d: str) -> DataFrame:
    requests = to_analytics_request(_events(spark, d), "shop")
    return requests.select(
        "batch_id", _json("$.sourceService", "request").alias("source_service"),
        F.json_array_length(_json("$.events", "request")).cast("bigint").alias("events"),
        _json("$.events[0].eventName", "request").alias("first_event"),
        _json("$.events[3].properties.k", "request").cast("int").alias("last_k"),
        _json("$.events[3].timestamp", "request").alias("last_time"),
        _json("$.events[1].tenantId", "request").alias("second_tenant"))


@query("c16_names", sql("""SELECT event_id, 'Acme.User.' || event_type AS event_name, 'Acme.' || svc AS source_name,
  'Acme.' || svc || '.Metrics' AS meter_name FROM ev"""))
def c16(spark: SparkSession, d: str) -> DataFrame:
    return fx.base(spark, d).select(
        "event_id", event_name("Acme", F.lit("User"), F.col("event_type")).alias("event_name"),
        source_name("Acme", F.col("svc")).alias("source_name"), meter_name("Acme", F.col("svc")).alias("meter_name"))


@query("c17_with_property", sql("""SELECT batch_id, pos, 'renamed' AS event_name, event_type AS password,
  true AS has_empty, 5 AS property_count FROM an"""))
def c17(spark: SparkSession, d: str) -> DataFrame:
    changed = with_property(with_property(_events(spark, d), "password", F.col("event_name")), "nothing", None)
    properties = F.col("properties")
    return with_field(changed, "event_name", "renamed").select(
        "batch_id", F.col("pos").cast("bigint").alias("pos"), "event_name", text(properties["password"]).alias("password"),
        F.map_contains_key(properties, "nothing").alias("has_empty"), F.size(properties).alias("property_count"))


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return read_error_reports(fx.envelopes(spark, d, ERRORS))[0]


def _tag_rows(df: DataFrame) -> DataFrame:
    return df.select("batch_id", F.explode(nonempty(F.col("tags"))).alias("key", "value"))


@query("c17_with_tag", sql(f"""SELECT report_id AS batch_id, m.key, m.value FROM er, LATERAL {values(
    ("endpoint", "'everywhere'", "true"), ("http.method", "'POST'", "true"), ("tenant_id", "er_tenant", "true"))} m"""))
def c17_tag(spark: SparkSession, d: str) -> DataFrame:
    return _tag_rows(with_tag(_reports(spark, d), "endpoint", "everywhere"))


@query("c18_apply_default_tags", sql(f"""SELECT report_id AS batch_id, m.key, m.value FROM er, LATERAL {values(
    ("endpoint", "'/api/' || (k % 4)", "true"), ("http.method", "'ANY'", "true"), ("region", "'eu'", "true"),
    ("tenant_id", "er_tenant", "true"))} m"""))
def c18(spark: SparkSession, d: str) -> DataFrame:
    return _tag_rows(apply_default_tags(_reports(spark, d), {"http.method": "ANY", "region": "eu"}))


@query("c19_error_delivery", sql(f"""SELECT report_id AS batch_id, uid AS user, cents,
  CASE severity WHEN 0 THEN 'debug' WHEN 1 THEN 'info' WHEN 2 THEN 'warning' WHEN 4 THEN 'fatal' ELSE 'error' END AS level,
  m.key, m.value FROM er, LATERAL {values(
    ("endpoint", "'/api/' || (k % 4)", "true"), ("http.method", "'POST'", "true"), ("tenant_id", "er_tenant", "true"),
    (_key("correlation_id"), "correlation_id", "true"), (_key("operation_id"), "operation_id", "true"),
    (_key("node_id"), "node_id", "true"))} m"""))
def c19(spark: SparkSession, d: str) -> DataFrame:
    return error_delivery(_reports(spark, d)).select(
        "batch_id", "user", F.try_variant_get(F.col("extra")["cents"], "$", "bigint").alias("cents"), "level",
        F.explode(nonempty(F.col("tags"))).alias("key", "value"))


@query("p7_filter_properties", sql(f"""SELECT batch_id, pos, m.key, m.value FROM an, LATERAL {values(*_OWN[1:2], *_OWN[3:])} m"""))
def p7(spark: SparkSession, d: str) -> DataFrame:
    kept = filter_properties(_events(spark, d), excluded=("K",), approved=("Cents", "SECRET", "k"))
    return _map_rows(kept, F.col("properties"))


@query("p8_is_safe_tenant", sql(f"SELECT event_id, {safe('tenant')} IS NOT NULL AS safe FROM ev"))
def p8(spark: SparkSession, d: str) -> DataFrame:
    return fx.base(spark, d).select("event_id", is_safe_tenant(F.col("tenant")).alias("safe"))


@query("p9_validate_resource", sql("""SELECT event_id, k % 3 = 1 AS valid FROM ev"""))
def p9(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    some = F.create_map(F.lit("host.name"), F.col("svc"))
    named = F.create_map(F.lit("host.name"), F.col("svc"), F.lit("service.name"), F.col("svc"))
    resource = F.when(k % 3 == 0, some).when(k % 3 == 1, named)
    return fx.base(spark, d).select("event_id", valid_resource(resource).alias("valid"))


@query("p10_is_deliverable", sql("SELECT report_id AS batch_id FROM er WHERE message IS NOT NULL"))
def p10(spark: SparkSession, d: str) -> DataFrame:
    return deliverable(_reports(spark, d)).select("batch_id")


@query("p10_is_deliverable_exception", sql("SELECT event_id, k % 2 = 0 OR event_type <> 'view' AS ok FROM ev"))
def p10_exception(spark: SparkSession, d: str) -> DataFrame:
    message = F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    exception = F.when(F.col("k") % 2 == 0, "boom")
    return fx.base(spark, d).select("event_id", is_deliverable(message, exception).alias("ok"))


@query("p11_sample", sql("""SELECT report_id AS batch_id FROM er
  WHERE cast('0x' || substr(md5(report_id), 1, 8) AS bigint) < 1073741824"""))
def p11(spark: SparkSession, d: str) -> DataFrame:
    return sample(_reports(spark, d), 0.25, "batch_id").select("batch_id")


@query("g12_batch_tenant", sql("""SELECT batch_id, CASE WHEN count(DISTINCT lower(tenant)) = 1
  THEN arg_min(tenant, pos) FILTER (tenant IS NOT NULL) END AS batch_tenant FROM an GROUP BY batch_id"""))
def g12(spark: SparkSession, d: str) -> DataFrame:
    return batch_tenant(_events(spark, d))


@query("d7_fill_tenant", sql("""SELECT batch_id, pos, coalesce(tenant, an_header_tenant) AS tenant_id FROM an"""))
def d7(spark: SparkSession, d: str) -> DataFrame:
    return fill_tenant(_events(spark, d)).select("batch_id", F.col("pos").cast("bigint").alias("pos"), "tenant_id")


@query("r13_pack_batches", sql("""SELECT batch_id, pos // 3 AS doc_no, count(*) AS event_count,
  string_agg(event_type, ',' ORDER BY pos) AS events, cast(sum(k) AS bigint) AS k_sum FROM an GROUP BY batch_id, pos // 3"""))
def r13(spark: SparkSession, d: str) -> DataFrame:
    packed = pack_batches(capture_events(_events(spark, d)), 3)
    parsed = F.from_json("document", "struct<batch:array<struct<event:string,properties:struct<k:int>>>>")["batch"]
    return packed.select("batch_id", "doc_no", "event_count", parsed.alias("b")).select(
        "batch_id", "doc_no", "event_count", F.array_join("b.event", ",").alias("events"),
        F.aggregate("b.properties.k", F.lit(0), lambda a, v: a + v).alias("k_sum"))


@query("r13_pack_batches_threshold", sql("SELECT batch_id, count(*) AS events, cast(sum(k) AS bigint) AS k_sum FROM an GROUP BY batch_id"))
def r13_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Which document a request lands in depends on the partitioning; that each is whole does not."""
    captured = capture_events(with_property(_events(spark, d), "batch", F.col("batch_id")))
    packed = pack_batches(captured, 100, "threshold")
    parsed = F.from_json("document", "struct<batch:array<struct<properties:struct<k:int,batch:string>>>>")["batch"]
    return packed.select(F.explode(parsed).alias("e")).groupBy(F.col("e.properties.batch").alias("batch_id")).agg(
        F.count("*").alias("events"), F.sum("e.properties.k").alias("k_sum"))
