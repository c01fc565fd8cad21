"""Enrichment, error events and attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.constants import ANALYTICS, ERRORS, KEYS, LOGS, METRICS, TRACES
from beaconry.context import CollectorOptions, Context, ServiceOptions
from beaconry.functions.maps import entries, merge_last, nonempty
from beaconry.operators.enrich import (
    attribute_batches, enrich_errors, enrich_events, enrich_properties, enrich_resource, enrich_span,
    ingestion_metadata, set_span_tags, stamp_resource, with_context)
from beaconry.operators.errors import explode_errors, log_errors_to_events, span_errors_to_events
from beaconry.operators.stats import profile_batches
from beaconry.plans import fixtures as fx
from beaconry.plans.registry import query
from beaconry.plans.sql import CUT_KEY, LONG_KEY, sql, values
from beaconry.sources import otlp
from beaconry.sources.requests import read_analytics, read_error_reports

CTX = Context("corr-ctx", "op-ctx", "node-ctx", "tenant-ctx", "grid-env")
OPTS = CollectorOptions(environment="prod")
KEY = KEYS.of


def text(variant: Column) -> Column:
    return F.try_variant_get(variant, "$", "string")


def _maps(spark: SparkSession, d: str) -> DataFrame:
    """Attribute maps derived from events: some keys there already, in several spellings."""
    k = F.col("k")
    present = entries([
        ("host.name", F.col("svc")), ("Service.Name", F.when(k % 3 == 0, F.col("svc"))),
        (KEY("node_id").upper(), F.when(k % 4 == 0, F.concat(F.lit("own-"), F.col("svc")))),
        (KEY("environment"), F.when(k % 5 == 0, F.lit("own-env"))),
        (KEY("correlation_id"), F.when(k % 6 == 0, F.lit("own-corr"))),
        (KEYS.ingested_at, F.when(k % 7 == 0, F.lit("12")))])
    return fx.base(spark, d).select(
        "event_id", "svc", F.timestamp_millis(F.floor(F.col("us") / 1000)).alias("received_at"),
        F.when(k % 11 > 0, merge_last(present)).alias("m"))


def _rows(df: DataFrame, column: str = "m") -> DataFrame:
    return df.select("event_id", F.explode(nonempty(F.col(column))).alias("key", "value"))


def _own(*extra: tuple[str, str, str]) -> str:
    has = "k % 11 > 0 AND "
    return values(
        ("host.name", "svc", has + "true"), ("Service.Name", "svc", has + "k % 3 = 0"),
        (KEY("node_id").upper(), "'own-' || svc", has + "k % 4 = 0"),
        (KEY("environment"), "'own-env'", has + "k % 5 = 0"),
        (KEY("correlation_id"), "'own-corr'", has + "k % 6 = 0"), (KEYS.ingested_at, "12", has + "k % 7 = 0"), *extra)


def _absent(mod: int) -> str:
    return f"(k % 11 = 0 OR k % {mod} > 0)"


def _map_sql(rows: str) -> str:
    return sql(f"SELECT event_id, m.key, m.value FROM ev, LATERAL {rows} m")


@query("d1_enrich_resource", _map_sql(_own(
    ("service.name", "'unknown-service'", _absent(3)), (KEY("correlation_id"), "'corr-ctx'", _absent(6)),
    (KEY("operation_id"), "'op-ctx'", "true"), (KEY("node_id"), "'node-ctx'", _absent(4)),
    ("tenant_id", "'tenant-ctx'", "true"), (KEY("environment"), "'grid-env'", _absent(5)),
    (KEYS.ingested_at, "ms", _absent(7)))))
def d1(spark: SparkSession, d: str) -> DataFrame:
    return _rows(enrich_resource(_maps(spark, d), CTX, OPTS, "m"))


@query("d1_enrich_resource_no_context", _map_sql(_own(
    ("service.name", "'unknown-service'", _absent(3)), (KEY("environment"), "'prod'", _absent(5)),
    (KEYS.ingested_at, "ms", _absent(7)))))
def d1_plain(spark: SparkSession, d: str) -> DataFrame:
    return _rows(enrich_resource(_maps(spark, d), Context(), OPTS, "m"))


@query("d2_enrich_span", _map_sql(_own(
    (KEY("correlation_id"), "'corr-ctx'", _absent(6)), (KEY("operation_id"), "'op-ctx'", "true"))))
def d2(spark: SparkSession, d: str) -> DataFrame:
    return _rows(enrich_span(_maps(spark, d), CTX, column="m"))


@query("d3_enrich_properties", _map_sql(_own(
    ("service.name", "svc", _absent(3)), (KEY("correlation_id"), "'corr-ctx'", _absent(6)),
    (KEY("operation_id"), "'op-ctx'", "true"), (KEY("environment"), "'prod'", _absent(5)))))
def d3(spark: SparkSession, d: str) -> DataFrame:
    return _rows(enrich_properties(_maps(spark, d), F.col("svc"), CTX, OPTS, "m"))


_REPORT_TAGS = values(
    ("endpoint", "'/api/' || (k % 4)", "true"), ("http.method", "'POST'", "true"),
    ("tenant_id", "coalesce(er_tenant, 'tenant-ctx')", "true"), ("service.name", "source_name", "true"))


@query("d4_enrich_errors", sql(f"""SELECT report_id AS batch_id, coalesce(environment, 'prod') AS environment,
  coalesce(correlation_id, 'corr-ctx') AS correlation_id, coalesce(operation_id, 'op-ctx') AS operation_id,
  coalesce(node_id, 'node-ctx') AS node_id, ms AS ingested_at, cents, m.key, m.value FROM er, LATERAL {_REPORT_TAGS} m"""))
def d4(spark: SparkSession, d: str) -> DataFrame:
    reports, _ = read_error_reports(fx.envelopes(spark, d, ERRORS))
    extra = F.col("extra")
    return enrich_errors(reports, F.col("source_name"), CTX, OPTS).select(
        "batch_id", "environment", "correlation_id", "operation_id", "node_id",
        F.try_variant_get(extra[KEYS.ingested_at], "$", "bigint").alias("ingested_at"),
        F.try_variant_get(extra["cents"], "$", "bigint").alias("cents"), F.explode(nonempty(F.col("tags"))).alias("key", "value"))


@query("d5_enrich_events", sql("""SELECT batch_id, pos, an_source AS node_name, coalesce(environment, 'prod') AS environment,
  coalesce(correlation_id, 'corr-ctx') AS correlation_id, 'op-ctx' AS operation_id,
  coalesce(node_id, 'node-ctx') AS node_id, coalesce(tenant, 'tenant-ctx') AS tenant_id, received_ms AS ingested_at,
  5 AS property_count FROM an"""))
def d5(spark: SparkSession, d: str) -> DataFrame:
    events, _ = read_analytics(fx.envelopes(spark, d, ANALYTICS))
    return enrich_events(events, F.col("source_name"), CTX, OPTS).select(
        "batch_id", F.col("pos").cast("bigint").alias("pos"), "node_name", "environment", "correlation_id", "operation_id",
        "node_id", "tenant_id", F.try_variant_get(F.col("properties")[KEYS.ingested_at], "$", "bigint").alias("ingested_at"),
        F.size("properties").alias("property_count"))


_META = values(("service.name", "source_name", "true"), (KEY("environment"), "'prod'", "true"),
               (KEY("correlation_id"), "'corr-ctx'", "true"), (KEY("operation_id"), "batch_id", "batch_no % 2 = 0"),
               (KEY("node_id"), "header_node_id", "true"), (KEYS.ingested_at, "received_ms", "true"))


@query("d6_ingestion_metadata", sql(f"SELECT batch_id, m.key, m.value FROM hd, LATERAL {_META} m"))
def d6(spark: SparkSession, d: str) -> DataFrame:
    stats = attribute_batches(profile_batches(fx.mixed(spark, d, LOGS), LOGS, records=False))
    even = F.substring("batch_id", 2, 8).cast("int") % 2 == 0
    ctx = Context("corr-ctx", F.when(even, F.col("batch_id")).otherwise(""), F.col("source_node_id"), "")
    return ingestion_metadata(stats, ctx, OPTS).select("batch_id", F.explode(nonempty(F.col("metadata"))).alias("key", "value"))


@query("d8_with_context", sql("""SELECT event_id, kind, coalesce(c, 'x-corr') AS correlation_id, o AS operation_id,
  coalesce(n, 'x-node') AS node_id, coalesce(t, 'x-tenant') AS tenant_id, coalesce(e, 'x-env') AS environment FROM (
    SELECT event_id, kind,
      CASE WHEN kind <> 'node' THEN coalesce(c, 'corr-ctx') ELSE c END AS c,
      CASE WHEN kind = 'operation' THEN 'op-ctx' END AS o,
      CASE WHEN kind <> 'operation' THEN coalesce(n, 'node-ctx') ELSE n END AS n,
      CASE WHEN kind <> 'node' THEN coalesce(t, 'tenant-ctx') ELSE t END AS t,
      CASE WHEN kind <> 'operation' THEN coalesce(e, 'grid-env') ELSE e END AS e
    FROM (SELECT event_id, CASE k % 3 WHEN 0 THEN 'own' WHEN 1 THEN '' END AS c, CASE WHEN k % 2 = 0 THEN 'n' END AS n,
                 tenant AS t, CASE WHEN k % 5 = 0 THEN '' END AS e FROM ev),
         (VALUES ('operation'), ('grid'), ('node')) v(kind))"""))
def d8(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    none = F.lit(None).cast("string")
    events = fx.base(spark, d).select(
        "event_id", F.when(k % 3 == 0, "own").when(k % 3 == 1, "").alias("correlation_id"), none.alias("operation_id"),
        F.when(k % 2 == 0, "n").alias("node_id"), F.col("tenant").alias("tenant_id"), F.when(k % 5 == 0, "").alias("environment"))
    parts = [with_context(events, CTX, kind).withColumn("kind", F.lit(kind)) for kind in ("operation", "grid", "node")]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union.fillna({"correlation_id": "x-corr", "node_id": "x-node", "tenant_id": "x-tenant", "environment": "x-env"})


def _d9(kind: str, *pairs: tuple[str, str, str]) -> str:
    """Own keys that the tags do not replace, then the tags."""
    replaced = [p[0] for p in pairs]
    own = [("host.name", "svc", "k % 11 > 0"), ("Service.Name", "svc", "k % 11 > 0 AND k % 3 = 0"),
           (KEY("node_id").upper(), "'own-' || svc", "k % 11 > 0 AND k % 4 = 0"),
           (KEY("environment"), "'own-env'", "k % 11 > 0 AND k % 5 = 0"),
           (KEY("correlation_id"), "'own-corr'", "k % 11 > 0 AND k % 6 = 0"),
           (KEYS.ingested_at, "12", "k % 11 > 0 AND k % 7 = 0")]
    rows = values(*[o for o in own if o[0] not in replaced], *pairs)
    return f"SELECT event_id, '{kind}' AS kind, m.key, m.value FROM ev, LATERAL {rows} m"


@query("d9_set_span_tags", sql(" UNION ALL ".join([
    _d9("operation", (KEY("correlation_id"), "'c-' || svc", "true"), (KEY("operation_id"), "'op'", "true"),
        ("tenant_id", "tenant", "true")),
    _d9("grid", (KEY("correlation_id"), "'c-' || svc", "true"), (KEY("node_id"), "'node'", "true"),
        (KEY("environment"), "'e'", "true"), ("tenant_id", "tenant", "true")),
    _d9("user", (KEY("user_id"), "svc", "true")),
    _d9("environment", (KEY("environment"), "'e'", "true"), (KEY("version"), "'1.2'", "true")),
    _d9("node", (KEY("node_id"), "'node'", "true"), (KEY("node_name"), "svc", "true")),
    _d9("grid_ids", (KEY("grid_id"), "'g'", "true"), ("tenant_id", "tenant", "true"))])))
def d9(spark: SparkSession, d: str) -> DataFrame:
    maps = _maps(spark, d).join(fx.base(spark, d).select("event_id", "tenant"), "event_id")
    correlation = F.concat(F.lit("c-"), F.col("svc"))
    sets = {
        "operation": {"correlation_id": correlation, "operation_id": "op", "tenant_id": F.col("tenant")},
        "grid": {"correlation_id": correlation, "node_id": "node", "environment": "e", "tenant_id": F.col("tenant")},
        "user": {"user_id": F.col("svc"), "session_id": ""},
        "environment": {"environment": "e", "version": "1.2"},
        "node": {"node_id": "node", "node_name": F.col("svc"), "node_type": None},
        "grid_ids": {"grid_id": "g", "tenant_id": F.col("tenant")},
    }
    out = None
    for kind, tags in sets.items():
        part = _rows(set_span_tags(maps, kind, tags, column="m")).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


_STAMP = values(("host.name", "'host-' || svc", "true"), ("Service.Name", "svc", "event_id % 5 = 0"),
                ("service.name", "'collector'", "true"),
                ("service.namespace", "'acme'", "true"), ("service.version", "'2.0'", "true"),
                ("service.instance.id", "'i-1'", "true"), ("deployment.environment", "'prod'", "true"),
                (KEY("environment"), "'prod'", "true"))


@query("d10_stamp_resource", sql(f"SELECT span_id, m.key, m.value FROM ev, LATERAL {_STAMP} m"))
def d10(spark: SparkSession, d: str) -> DataFrame:
    spans = otlp.decode_spans(fx.envelopes(spark, d, TRACES))
    stamped = stamp_resource(spans, ServiceOptions("collector", "acme", "2.0", "i-1", "prod"))
    return stamped.select("span_id", F.explode(nonempty(F.col("resource_attrs"))).alias("key", "value"))


@query("d11_attribute_batches", sql("""SELECT batch_id, signal, source_name, header_node_id AS source_node_id, batch_tenant
  FROM hd, (VALUES ('logs'), ('traces'), ('metrics')) s(signal)"""))
def d11(spark: SparkSession, d: str) -> DataFrame:
    def one(signal: str) -> DataFrame:
        return attribute_batches(profile_batches(fx.mixed(spark, d, signal), signal, records=False)).select(
            "batch_id", "signal", "source_name", "source_node_id", "batch_tenant")

    return one(LOGS).unionByName(one(TRACES)).unionByName(one(METRICS))


# Protobuf batches, the even ones, also show doubles.
_RAW = ("raw", "regexp_replace(cast(value AS varchar), '\\.0$', '')", "batch_no % 2 = 0")
_SPAN_TAGS = values(
    ("span.name", "CASE WHEN k % 10 = 0 THEN 'overwritten' ELSE 'GET /' || event_type END", "true"),
    ("tenant_id", "coalesce(batch_tenant, 'tenant-ctx')", "true"), ("trace.id", "trace_id", "true"),
    ("span.id", "span_id", "true"), ("service.name", "svc", "true"), ("http.method", "'GET'", "true"),
    ("k", "k", "true"), ("big", "big", "true"), _RAW, (CUT_KEY, "'long'", "true"))


@query("r1_span_errors_to_events", sql(f"""SELECT batch_id, svc AS source_name,
  coalesce(status_message, exc_msg, 'Error in span: GET /' || event_type) AS message, 3 AS severity,
  trace_id AS correlation_id, span_id AS operation_id, 'node-ctx' AS node_id, 'prod' AS environment,
  exc_type AS exception_type, stack, received_ms AS ingested_at, m.key, m.value
  FROM (SELECT sp.*, hd.batch_tenant, hd.received_ms FROM sp JOIN hd USING (batch_id) WHERE is_error) s,
  LATERAL {_SPAN_TAGS} m"""))
def r1(spark: SparkSession, d: str) -> DataFrame:
    stats = attribute_batches(profile_batches(fx.mixed(spark, d, TRACES), TRACES))
    extra = F.col("extra")
    return span_errors_to_events(explode_errors(stats), CTX, OPTS).select(
        "batch_id", "source_name", "message", "severity", "correlation_id", "operation_id", "node_id", "environment",
        text(extra["exception.type"]).alias("exception_type"), text(extra["exception.stacktrace"]).alias("stack"),
        F.try_variant_get(extra[KEYS.ingested_at], "$", "bigint").alias("ingested_at"), F.explode(nonempty(F.col("tags"))).alias("key", "value"))


_LOG_TAGS = values(
    ("tenant_id", "coalesce(batch_tenant, 'tenant-ctx')", "true"), ("trace.id", "trace_id", "true"),
    ("span.id", "span_id", "true"), ("severity.text", "sev_text", "true"), ("severity.number", "sev", "true"),
    ("service.name", "source_name", "true"), ("k", "k", "true"), ("cents", "cents", "true"), ("big", "big", "true"), _RAW,
    ("dup", "'last'", "true"), (CUT_KEY, "'long'", "true"), ("exception.type", "exc_type", "has_exc"),
    ("exception.message", "exc_msg", "has_msg"))


@query("r2_log_errors_to_events", sql(f"""SELECT batch_id, source_name, body AS message,
  CASE WHEN sev >= 21 THEN 4 WHEN sev >= 17 THEN 3 WHEN sev >= 13 THEN 2 WHEN sev >= 9 THEN 1 ELSE 0 END AS severity,
  ms AS ts_ms, trace_id AS correlation_id, span_id AS operation_id, 'node-ctx' AS node_id, 'prod' AS environment,
  exc_type AS exception_type, exc_msg AS exception_message, m.key, m.value
  FROM (SELECT log.*, hd.batch_tenant, hd.source_name FROM log JOIN hd USING (batch_id) WHERE mixed_error) l,
  LATERAL {_LOG_TAGS} m"""))
def r2(spark: SparkSession, d: str) -> DataFrame:
    stats = attribute_batches(profile_batches(fx.mixed(spark, d, LOGS), LOGS))
    extra = F.col("extra")
    return log_errors_to_events(explode_errors(stats), CTX, OPTS).select(
        "batch_id", "source_name", "message", "severity", F.unix_millis("ts").alias("ts_ms"), "correlation_id",
        "operation_id", "node_id", "environment", text(extra["exception.type"]).alias("exception_type"),
        text(extra["exception.message"]).alias("exception_message"), F.explode(nonempty(F.col("tags"))).alias("key", "value"))
