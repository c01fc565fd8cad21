"""OTLP, analytics and error-report envelopes derived from the ``events`` table.

Every row of the table becomes one log record, span, analytics event and so on; four
consecutive events form a batch. Nothing here is literal data: the fixtures grow with the table.
"""

from __future__ import annotations

import json
from base64 import b64decode
from functools import reduce
from typing import Any, Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconry.constants import ANALYTICS, ERRORS, INTERNAL_TENANT, LOGS, METRICS, TRACES
from beaconry.functions.maps import let, record
from beaconry.plans.proto_columns import BARE, messages
from beaconry.sources.envelopes import read_envelopes, store_envelopes
from beaconry.sources.proto import ROOT, message_class, pieces

BATCH_SIZE = 4
LONG_KEY = "attribute.key.of.exactly.forty.characters"[:40]
PIECE = 1024
TASKS_A_SCAN = 4
_PLANS: dict[tuple, DataFrame] = {}


class Stored(str):
    """A data folder whose envelopes ``store`` has written to ``envelopes`` (and, of both formats, to ``mixed``)."""

    envelopes: str
    mixed: str


def store(spark: SparkSession, sf_dir: str, path: str) -> Stored:
    """Write the envelopes of a data folder, for runs that time the operators alone.

    Queries that are given the result read them back; those given the plain folder build them.
    """
    out = Stored(sf_dir)
    out.envelopes, out.mixed = f"{path}/json", f"{path}/mixed"
    parts = [build(spark, sf_dir, s) for s in (LOGS, TRACES, METRICS, ANALYTICS, ERRORS)]
    store_envelopes(reduce(DataFrame.unionByName, parts).repartition(16, "batch_id"), out.envelopes, "overwrite")
    both = [mixed(spark, sf_dir, s) for s in (LOGS, TRACES, METRICS)]
    store_envelopes(reduce(DataFrame.unionByName, both).repartition(16, "batch_id"), out.mixed, "overwrite")
    return out


def micros(df: DataFrame, column: str = "ts") -> Column:
    """Microseconds since the epoch, whatever the session time zone."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")
    return F.unix_micros(F.col(column))


def tenant(n: Column) -> Column:
    return (F.when(n % 4 == 0, INTERNAL_TENANT)
            .when(n % 4 == 1, F.concat(F.lit("01ARZ3NDEKTSV4RRFFQ69G5F"),
                                       F.lpad((n % 100).cast("string"), 2, "0")))
            .when(n % 4 == 2, "tenant-acme"))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the columns all fixtures share."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = micros(ev)
    n = F.floor(F.col("event_id") / BATCH_SIZE)
    svc = F.concat(F.lit("svc-"), (F.col("user_id") % 7).cast("string"))
    return ev.select(
        "event_id", "user_id", "event_type", "value", us.alias("us"),
        F.get_json_object("props", "$.k").cast("int").alias("k"), n.alias("batch_no"),
        F.concat(F.lit("b"), F.lpad(n.cast("string"), 8, "0")).alias("batch_id"),
        F.when(F.col("event_id") % 5 == 0, F.upper(svc)).otherwise(svc).alias("svc"),
        F.floor(F.col("value") * 100).cast("bigint").alias("cents"), tenant(F.col("user_id")).alias("tenant"))


def headers(batch_no: Column) -> list[Column]:
    """Header columns of a batch."""
    t = tenant(batch_no)
    return [
        F.when(batch_no % 4 == 0, F.concat(F.lit("hdr-"), (batch_no % 3).cast("string"))).alias("header_source"),
        F.when(batch_no % 6 == 0, F.concat(F.lit("node-"), (batch_no % 5).cast("string"))).alias("header_node_id"),
        F.when(batch_no % 8 != 1, t).alias("header_tenant"), t.alias("header_tenant_alt"),
    ]


def json_type(batch_no: Column) -> Column:
    return F.when(batch_no % 3 == 1, "APPLICATION/JSON; charset=utf-8").otherwise("application/json")


def _text(v: Column) -> Column:
    return v.cast("string")


def _value(string: Column | None = None, integer: Column | None = None, boolean: Column | None = None,
           double: Column | None = None) -> Column:
    def or_null(c: Column | None, kind: str) -> Column:
        return (F.lit(None) if c is None else c).cast(kind)

    return F.struct(
        or_null(string, "string").alias("stringValue"), or_null(integer, "string").alias("intValue"),
        or_null(boolean, "boolean").alias("boolValue"), or_null(double, "double").alias("doubleValue"))


def _attr(key: str | Column, value: Column) -> Column:
    return F.struct((F.lit(key) if isinstance(key, str) else key).alias("key"), value.alias("value"))


def _attrs(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda a: a.isNotNull())


def bare(v: Column) -> Column:
    """Integer that the finished JSON shows without quotes."""
    return F.concat(F.lit(BARE), _text(v))


def nanos(us: Column, event_id: Column) -> Column:
    """Unix nanos, quoted for even events and bare for odd ones."""
    text = _text(us * 1000)
    return F.when(event_id % 2 == 0, text).otherwise(F.concat(F.lit(BARE), text))


def plain_json(document: Column) -> Column:
    return F.regexp_replace(F.to_json(document), f'"{BARE}([0-9]+)"', "$1")


def _c(name: str) -> Column:
    return F.col(name)


def severity_number() -> Column:
    t = _c("event_type")
    return (F.when(t == "click", 5).when(t == "signup", 13).when(t == "error", F.when(_c("value") >= 200, 21).otherwise(17))
            .otherwise(9))


def severity_text() -> Column:
    t = _c("event_type")
    return (F.when(t == "click", "DEBUG").when(t == "view", "INFO").when(t == "signup", "WARN")
            .when(t == "purchase", F.when(_c("value") >= 250, "Critical").otherwise("INFO"))
            .otherwise(F.when(_c("value") >= 200, "FATAL").otherwise("ERROR")))


def has_exception() -> Column:
    return (_c("event_type") == "error") & (_c("k") % 2 == 0)


def has_message() -> Column:
    return ((_c("event_type") == "error") & (_c("k") % 3 == 0)) | ((_c("event_type") == "view") & (_c("k") == 13))


def trace_id() -> Column:
    return F.md5(_c("batch_id"))


def span_id() -> Column:
    return F.lpad(F.lower(F.hex(_c("event_id"))), 16, "0")


def _exception_type() -> Column:
    return F.concat(F.lit("E"), _text(_c("k") % 5))


def _message() -> Column:
    return F.concat(F.lit("msg "), _text(_c("k")))


def log_record() -> Column:
    attributes = _attrs(
        _attr("k", _value(integer=bare(_c("k")))), _attr("cents", _value(integer=_text(_c("cents")))),
        _attr("big", _value(boolean=_c("value") > 100)), _attr("raw", _value(double=_c("value"))),
        _attr("empty", _value(string=F.lit(""))), _attr("dup", _value(string=F.lit("first"))),
        _attr("dup", _value(string=F.lit("last"))), _attr(LONG_KEY, _value(string=F.lit("long"))),
        F.when(has_exception(), _attr("exception.type", _value(string=_exception_type()))),
        F.when(has_message(), _attr("exception.message", _value(string=_message()))))
    return F.struct(
        nanos(_c("us"), _c("event_id")).alias("timeUnixNano"), severity_number().alias("severityNumber"),
        severity_text().alias("severityText"),
        F.struct(F.concat(_c("event_type"), F.lit(" by "), _text(_c("user_id"))).alias("stringValue")).alias("body"),
        attributes.alias("attributes"), trace_id().alias("traceId"), span_id().alias("spanId"))


def span() -> Column:
    t, v = _c("event_type"), _c("value")
    name = F.when(_c("k") % 2 == 0, F.when(_c("k") % 4 == 0, "Exception").otherwise("exception"))
    first = F.struct(
        nanos(_c("us"), _c("event_id")).alias("timeUnixNano"), name.alias("name"),
        _attrs(_attr("exception.type", _value(string=_exception_type())),
               F.when(_c("k") % 3 == 0, _attr("exception.message", _value(string=_message()))),
               _attr("exception.stacktrace", _value(string=F.concat(F.lit("at line "), _text(_c("k"))))))
        .alias("attributes"))
    second = F.struct(
        nanos(_c("us"), _c("event_id")).alias("timeUnixNano"), F.lit("exception").alias("name"),
        _attrs(_attr("exception.type", _value(string=F.lit("ignored")))).alias("attributes"))
    events = F.when(has_exception(), F.when(_c("k") % 4 == 0, F.array(first, second)).otherwise(F.array(first)))
    code = F.when((t == "error") & (v >= 50), 2).when(t == "purchase", 1)
    message = F.when(_c("k") % 4 == 0, F.concat(F.lit("status "), _text(_c("k"))))
    status = F.when(code.isNotNull() | message.isNotNull(), F.struct(message.alias("message"), code.alias("code")))
    return F.struct(
        trace_id().alias("traceId"), span_id().alias("spanId"),
        F.when(_c("event_id") % BATCH_SIZE > 0, F.lpad(F.lower(F.hex(_c("event_id") - 1)), 16, "0")).alias("parentSpanId"),
        F.concat(F.lit("GET /"), t).alias("name"), F.lit(2).alias("kind"),
        nanos(_c("us"), _c("event_id")).alias("startTimeUnixNano"),
        nanos(_c("us") + _c("cents") * 1000, _c("event_id")).alias("endTimeUnixNano"),
        _attrs(_attr("http.method", _value(string=F.lit("GET"))), _attr("k", _value(integer=bare(_c("k")))),
               _attr("big", _value(boolean=v > 100)), _attr("raw", _value(double=v)),
               _attr("span.name", F.when(_c("k") % 10 == 0, _value(string=F.lit("overwritten")))),
               _attr(LONG_KEY, _value(string=F.lit("long")))).alias("attributes"),
        events.alias("events"), status.alias("status"))


def _resource(svc: Column) -> Column:
    return F.struct(F.array(
        _attr("host.name", _value(string=F.concat(F.lit("host-"), svc))),
        _attr(F.when(svc.startswith("S"), "Service.Name").otherwise("service.name"), _value(string=svc)),
    ).alias("attributes"))


def _tree(spark: SparkSession, sf_dir: str, item: Column, names: tuple[str, str, str]) -> DataFrame:
    """One document per batch: a resource per service in first-seen order, items in event order.

    A group is one batch of four events; services are split row-locally, so this shuffles once.
    """
    resources, scopes, items = names
    ev = base(spark, sf_dir)
    rows = ev.select("batch_id", "batch_no", F.struct("event_id", "svc", "us", item.alias("item")).alias("r"))
    grouped = rows.groupBy("batch_id", "batch_no").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    services = F.array_distinct(F.transform("rs", lambda r: r["svc"]))
    tree = F.transform(services, lambda s: F.struct(
        _resource(s).alias("resource"),
        F.array(F.struct(
            F.struct(F.lit("scope").alias("name")).alias("scope"),
            F.transform(F.filter("rs", lambda r: r["svc"] == s), lambda r: r["item"]).alias(items))).alias(scopes)))
    return grouped.select("batch_id", "batch_no", F.get("rs", F.lit(0))["us"].alias("us"), tree.alias(resources))


def _metrics_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir).select(
        "batch_id", "batch_no", F.struct("event_id", "svc", "us", "value").alias("r"))
    # few bytes of an event make much work here: left to their size, partitions would be merged into a task or two
    tasks = TASKS_A_SCAN * spark.read.parquet(f"{sf_dir}/events.parquet").rdd.getNumPartitions()
    ev = rows.repartition(tasks, "batch_id", "batch_no")
    grouped = ev.groupBy("batch_id", "batch_no").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    services = F.array_distinct(F.transform("rs", lambda r: r["svc"]))
    bounds = (50, 100, 200)

    def of_service(s: Column) -> Column:
        mine = F.filter("rs", lambda r: r["svc"] == s)
        # worked out once: lambdas repeat whatever they name twice
        return let(mine, lambda m: let(record(
            n=F.size(m), last=F.try_element_at(m, F.lit(-1)), values=F.transform(m, lambda r: r["value"])),
            lambda of: of_events(s, of)))

    def of_events(s: Column, of: Column) -> Column:
        values, last = of["values"], of["last"]
        total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)

        def below(lo: int | None, hi: int | None) -> Column:
            def inside(v: Column) -> Column:
                ok = F.lit(True)
                ok = ok if lo is None else ok & (v > lo)
                return ok if hi is None else ok & (v <= hi)
            return F.size(F.filter(values, inside))

        buckets = [below(lo, hi) for lo, hi in zip((None, *bounds), (*bounds, None))]
        time = nanos(last["us"], last["event_id"]).alias("timeUnixNano")

        def metric(name: str, unit: str, **kinds: Column) -> Column:
            kind_types = {
                "sum": "struct<dataPoints:array<struct<timeUnixNano:string,asInt:string>>,"
                       "aggregationTemporality:int,isMonotonic:boolean>",
                "gauge": "struct<dataPoints:array<struct<timeUnixNano:string,asDouble:double>>>",
                "histogram": "struct<dataPoints:array<struct<timeUnixNano:string,count:string,sum:double,"
                             "bucketCounts:array<string>,explicitBounds:array<double>,min:double,max:double>>,"
                             "aggregationTemporality:int>",
            }
            body = [(kinds[k] if k in kinds else F.lit(None)).cast(t).alias(k) for k, t in kind_types.items()]
            return F.struct(F.lit(name).alias("name"), F.lit(f"{name} of a service").alias("description"),
                            F.lit(unit).alias("unit"), *body)

        items = F.array(
            metric("events.total", "1", sum=F.struct(
                F.array(F.struct(time, bare(of["n"]).alias("asInt"))).alias("dataPoints"),
                F.lit(2).alias("aggregationTemporality"), F.lit(True).alias("isMonotonic"))),
            metric("value.last", "usd", gauge=F.struct(
                F.array(F.struct(time, last["value"].alias("asDouble"))).alias("dataPoints"))),
            metric("value.dist", "usd", histogram=F.struct(
                F.array(F.struct(
                    time, _text(of["n"]).alias("count"), total.alias("sum"),
                    F.array(*[_text(b) for b in buckets]).alias("bucketCounts"),
                    F.array(*[F.lit(float(b)) for b in bounds]).alias("explicitBounds"),
                    F.array_min(values).alias("min"), F.array_max(values).alias("max"))).alias("dataPoints"),
                F.lit(1).alias("aggregationTemporality"))))
        return F.struct(_resource(s).alias("resource"), F.array(F.struct(
            F.struct(F.lit("scope").alias("name")).alias("scope"), items.alias("metrics"))).alias("scopeMetrics"))

    return grouped.select("batch_id", "batch_no", F.get("rs", F.lit(0))["us"].alias("us"),
                          F.transform(services, of_service).alias("resourceMetrics"))


def document_tree(spark: SparkSession, sf_dir: str, signal: str) -> tuple[DataFrame, str]:
    if signal == METRICS:
        return _metrics_tree(spark, sf_dir), "resourceMetrics"
    names = {LOGS: ("resourceLogs", "scopeLogs", "logRecords"), TRACES: ("resourceSpans", "scopeSpans", "spans")}[signal]
    return _tree(spark, sf_dir, log_record() if signal == LOGS else span(), names), names[0]


def _envelope(df: DataFrame, signal: str, payload: Column, content_type: Column | None = None,
              kind: str | None = "binary") -> DataFrame:
    n = F.col("batch_no")
    return df.select(
        "batch_id", F.timestamp_millis(F.floor(F.col("us") / 1000)).alias("received_at"), F.lit(signal).alias("signal"),
        (json_type(n) if content_type is None else content_type).alias("content_type"),
        (payload if kind is None else payload.cast(kind)).alias("payload"), *headers(n))


def iso_utc(us: Column) -> Column:
    """ISO text in UTC at milliseconds, whatever the session time zone."""
    moment = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (F.floor(us / 1000).cast("bigint") / 1000).cast("decimal(18,6)"))
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def analytics_item() -> Column:
    m, e = F.col("event_id") % 5, F.col("event_id")
    user = _text(F.col("user_id"))
    nobody = e % 25 == 24
    return F.struct(
        F.col("event_type").alias("eventName"),
        F.when(e % 6 != 5, iso_utc(F.col("us"))).alias("timestamp"),
        F.when(m == 0, F.concat(F.lit("d-"), user)).alias("distinctId"),
        F.when(m.isin(1, 2), F.concat(F.lit("u-"), user)).alias("userId"),
        F.when(m == 3, F.concat(F.lit("s-"), user)).alias("sessionId"),
        F.when((m == 4) & ~nobody, F.concat(F.lit("c-"), user)).alias("correlationId"),
        F.when(e % 3 == 0, F.concat(F.lit("node-"), _text(e % 4))).alias("nodeId"),
        F.col("tenant").alias("tenantId"), F.when(e % 7 == 0, "staging").alias("environment"),
        F.struct(bare(F.col("k")).alias("k"), bare(F.col("cents")).alias("cents"), F.lit("hunter2").alias("password"),
                 F.lit("x").alias("Secret")).alias("properties"))


def _analytics(spark: SparkSession, sf_dir: str, broken: bool) -> DataFrame:
    rows = base(spark, sf_dir).select(
        "batch_id", "batch_no", F.struct("event_id", "us", analytics_item().alias("item")).alias("r"))
    grouped = rows.groupBy("batch_id", "batch_no").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    n = F.col("batch_no")
    doc = F.struct(
        F.when(n % 3 == 0, F.concat(F.lit("app-"), _text(n % 5))).alias("sourceService"),
        F.when(n % 5 == 0, F.concat(F.lit("src-"), _text(n % 3))).alias("sourceNodeId"),
        F.transform("rs", lambda r: r["item"]).alias("events"))
    payload = plain_json(doc)
    if broken:
        payload = (F.when(n % 10 == 6, F.lit('{"events":null}')).when(n % 10 == 7, F.lit('{"events":[]}'))
                   .when(n % 10 == 8, F.repeat(F.lit("{ invalid json "), (n % 7 + 1).cast("int")))
                   .when(n % 10 == 9, F.lit("null")).otherwise(payload))
    with_us = grouped.withColumn("us", F.get("rs", F.lit(0))["us"])
    return _envelope(with_us, ANALYTICS, payload)


def _error_reports(spark: SparkSession, sf_dir: str, broken: bool) -> DataFrame:
    """One report per error event; its batch id is its own."""
    ev = base(spark, sf_dir).filter(F.col("event_type") == "error")
    k, e = F.col("k"), F.col("event_id")
    doc = F.struct(
        F.when(k % 10 != 9, F.concat(F.lit("failure "), _text(k))).alias("message"),
        F.when(k % 2 == 1, bare(k % 5)).alias("severity"), F.concat(F.lit("at "), _text(k)).alias("stackTrace"),
        F.when(e % 3 == 0, trace_id()).alias("correlationId"), F.when(e % 4 == 0, span_id()).alias("operationId"),
        F.when(e % 5 == 0, F.lit("node-err")).alias("nodeId"), F.concat(F.lit("u-"), _text(F.col("user_id"))).alias("userId"),
        F.col("tenant").alias("tenantId"), F.when(e % 7 == 0, "staging").alias("environment"),
        F.struct(F.concat(F.lit("/api/"), _text(k % 4)).alias("endpoint"), F.lit("POST").alias("http.method")).alias("tags"),
        F.struct(bare(F.col("cents")).alias("cents")).alias("extra"))
    payload = plain_json(doc)
    if broken:
        payload = (F.when(k % 10 == 6, F.lit("null")).when(k % 10 == 7, F.concat(F.lit("{ broken "), _text(k)))
                   .otherwise(payload))
    named = ev.withColumn("batch_id", F.concat(F.lit("r"), F.lpad(_text(e), 8, "0")))
    return _envelope(named.withColumn("batch_no", e), ERRORS, payload)


def build(spark: SparkSession, sf_dir: str, signal: str, broken: bool = False) -> DataFrame:
    """JSON envelopes of one signal. The plan is kept per session: planning it takes longer than small runs."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, signal, broken)
    if key not in _PLANS:
        _PLANS[key] = _build(spark, sf_dir, signal, broken)
    return _PLANS[key]


def _build(spark: SparkSession, sf_dir: str, signal: str, broken: bool) -> DataFrame:
    if signal == ANALYTICS:
        return _analytics(spark, sf_dir, broken)
    if signal == ERRORS:
        return _error_reports(spark, sf_dir, broken)
    whole = _documents(spark, sf_dir, signal)
    return whole.withColumn("payload", plain_json(F.col("payload")).cast("binary"))


def _documents(spark: SparkSession, sf_dir: str, signal: str) -> DataFrame:
    """Envelopes of an OTLP signal whose payload is still the document's struct."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, signal)
    if key not in _PLANS:
        tree, root = document_tree(spark, sf_dir, signal)
        _PLANS[key] = _envelope(tree, signal, F.struct(F.col(root)), kind=None)
    return _PLANS[key]


def envelopes(spark: SparkSession, sf_dir: str, signal: str, broken: bool = False) -> DataFrame:
    """JSON envelopes of one signal: built, or read back where ``store`` wrote them."""
    if isinstance(sf_dir, Stored) and not broken:
        return read_envelopes(spark, sf_dir.envelopes, partitioned=True).filter(F.col("signal") == signal)
    return build(spark, sf_dir, signal, broken)


def malformed(spark: SparkSession, sf_dir: str, signal: str) -> DataFrame:
    """Envelopes of which seven in eight batches carry something other than a good document."""
    good = envelopes(spark, sf_dir, signal)
    n = F.substring("batch_id", 2, 8).cast("int")
    text = (F.when(n % 8 == 1, "").when(n % 8 == 2, "{}").when(n % 8 == 3, "[]")
            .when(n % 8 == 4, F.repeat(F.lit("{ invalid json }}} "), n % 97 + 1)))
    zeros = F.unhex(F.repeat(F.lit("00"), n % 997))
    payload = (F.when(n % 8 == 0, F.col("payload")).when(n % 8 == 7, F.lit(None).cast("binary"))
               .when(n % 8 >= 5, zeros).otherwise(text.cast("binary")))
    kind = (F.when(n % 8 == 5, "application/x-protobuf").when(n % 8 == 6, F.lit(None).cast("string"))
            .when(n % 8 == 7, "").otherwise(F.col("content_type")))
    return good.withColumns({"payload": payload, "content_type": kind})


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log envelopes whose bodies are the whole texts of ``documents``, one record per envelope."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    record = F.struct(F.lit(9).alias("severityNumber"), F.struct(F.col("text").alias("stringValue")).alias("body"))
    tree = F.struct(F.array(F.struct(
        _resource(F.col("source")).alias("resource"),
        F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"))
    return docs.select(
        F.concat(F.lit("d"), _text(F.col("doc_id"))).alias("batch_id"), F.timestamp_millis(F.lit(0)).alias("received_at"),
        F.lit(LOGS).alias("signal"), F.lit("application/json").alias("content_type"),
        F.to_json(tree).cast("binary").alias("payload"), *headers(F.col("doc_id")))


def _members(descriptor: Any, made: dict[str, Any]) -> Callable[[dict], dict]:
    """Function from a JSON document to the arguments of its protobuf message; ids are hex text there."""
    if descriptor.full_name in made:
        return made[descriptor.full_name]
    fields: dict[str, tuple[str, Callable | None]] = {}

    def members(document: dict) -> dict:
        out = {}
        for key, value in document.items():
            name, one = fields[key]
            out[name] = value if one is None else one(value)
        return out

    made[descriptor.full_name] = members
    for f in descriptor.fields:
        one: Callable | None = None
        if f.message_type is not None:
            one = _members(f.message_type, made)
        elif f.type == f.TYPE_BYTES:
            one = b64decode if f.name == "bytes_value" else bytes.fromhex
        elif f.cpp_type in (f.CPPTYPE_INT32, f.CPPTYPE_INT64, f.CPPTYPE_UINT32, f.CPPTYPE_UINT64):
            one = int
        fields[f.json_name] = f.name, (
            one if one is None or not f.is_repeated else lambda values, one=one: [one(v) for v in values])
    return members


def proto_envelopes(spark: SparkSession, sf_dir: str, signal: str, broken: bool = False) -> DataFrame:
    """The same documents as protobuf; with ``broken`` every 16th batch is undecodable."""
    stored = isinstance(sf_dir, Stored)
    encoded = as_proto(envelopes(spark, sf_dir, signal), signal) if stored else _encoded(_documents(spark, sf_dir, signal), signal)
    n = F.substring("batch_id", 2, 8).cast("int")
    if broken:
        encoded = encoded.withColumn(
            "payload", F.when(n % 16 == 15, F.lit("{ not protobuf").cast("binary")).otherwise(F.col("payload")))
    return encoded.withColumn("content_type", F.when(n % 2 == 0, "application/x-protobuf"))


def as_proto(src: DataFrame, signal: str) -> DataFrame:
    """JSON envelopes with their payloads as protobuf."""
    root = ROOT[signal]

    def encode(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        cls = message_class(root)
        members = _members(cls.DESCRIPTOR, {})
        for batch in batches:
            at = batch.schema.get_field_index("payload")
            field = batch.schema.field(at)
            for piece in pieces(batch, "payload"):
                out = [cls(**members(json.loads(text))).SerializeToString() for text in piece.column(at).to_pylist()]
                yield piece.set_column(at, field, pa.array(out, type=field.type))

    return src.mapInArrow(encode, src.schema).withColumn("content_type", F.lit("application/x-protobuf"))


def _encoded(documents: DataFrame, signal: str) -> DataFrame:
    """The same payloads as ``as_proto`` over the JSON of ``documents``, from their columns: no text is written nor read."""
    root = ROOT[signal]
    out = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == "payload" else f.dataType) for f in documents.schema])

    def encode(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        whole: Callable | None = None
        for batch in batches:
            at = batch.schema.get_field_index("payload")
            whole = whole or messages(batch.schema.field(at).type, message_class(root).DESCRIPTOR)
            for start in range(0, batch.num_rows, PIECE):
                piece = batch.slice(start, PIECE)
                yield piece.set_column(at, pa.field("payload", pa.binary()), whole(piece.column(at)))

    return documents.mapInArrow(encode, out).withColumn("content_type", F.lit("application/x-protobuf"))


def nested(spark: SparkSession, sf_dir: str, signal: str) -> DataFrame:
    """JSON envelopes whose items carry a list, a key-value list and bytes as attributes, and a key-value list as body."""
    good = envelopes(spark, sf_dir, signal)
    n = F.substring("batch_id", 2, 8).cast("int").cast("string")
    filled = F.replace(F.replace(F.lit(NESTED), F.lit("<n>"), n), F.lit("<bytes>"), F.base64(F.col("batch_id").cast("binary")))
    text = F.col("payload").cast("string")
    if signal == METRICS:
        text = F.replace(text, F.lit('"timeUnixNano":'), F.concat(F.lit('"attributes":['), filled, F.lit('],"timeUnixNano":')))
    else:
        text = F.replace(text, F.lit('"attributes":['), F.concat(F.lit('"attributes":['), filled, F.lit(",")))
    body = F.regexp_replace(
        text, r'"body":\{"stringValue":("[^"]*")\}',
        r'"body":{"kvlistValue":{"values":[{"key":"text","value":{"stringValue":$1}},{"key":"n","value":{"doubleValue":0.25}}]}}')
    return good.withColumn("payload", body.cast("binary"))


NESTED = (
    '{"key":"route","value":{"arrayValue":{"values":[{"stringValue":"hop-<n>"},{"intValue":"<n>"},{"boolValue":true},'
    '{"arrayValue":{"values":[{"doubleValue":0.5}]}}]}}},'
    '{"key":"caller","value":{"kvlistValue":{"values":[{"key":"id","value":{"intValue":"7"}},'
    '{"key":"id","value":{"intValue":"<n>"}},{"key":"tags","value":{"arrayValue":{"values":[{"stringValue":"a, {b}"}]}}}]}}},'
    '{"key":"digest","value":{"bytesValue":"<bytes>"}}')


def mixed(spark: SparkSession, sf_dir: str, signal: str) -> DataFrame:
    """Every other batch as protobuf, the others as JSON."""
    if isinstance(sf_dir, Stored):
        return read_envelopes(spark, sf_dir.mixed, partitioned=True).filter(F.col("signal") == signal)
    text = envelopes(spark, sf_dir, signal)
    even = F.substring("batch_id", 2, 8).cast("int") % 2 == 0
    # only what is kept is encoded: a filter does not move below the encoder
    return text.filter(~even).unionByName(_encoded(_documents(spark, sf_dir, signal).filter(even), signal))


def spaced_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analytics requests with white space around them, and four forms of each without usable events."""
    good = envelopes(spark, sf_dir, ANALYTICS)
    texts = [F.concat(F.lit("\n\t"), F.col("payload").cast("string"), F.lit("\r\n")), F.lit("null\r\n"),
             F.lit('\n{"events":[]}'), F.lit('\t{"events":null}\n'), F.lit('{"events":5}')]
    return _with_texts(good, texts)


def _with_texts(good: DataFrame, texts: list[Column]) -> DataFrame:
    """Each envelope once per text; the form's number from 1 ends its batch id."""
    formed = good.select(*good.columns, F.posexplode(F.array(*texts)).alias("form", "text"))
    return formed.select(*[
        F.concat_ws("-", "batch_id", F.col("form") + 1).alias(c) if c == "batch_id"
        else F.col("text").cast("binary").alias(c) if c == "payload" else F.col(c) for c in good.columns])


def renamed_requests(spark: SparkSession, sf_dir: str, signal: str) -> DataFrame:
    """Analytics requests or error reports with every other top or event field spelled in another case."""
    good = envelopes(spark, sf_dir, signal)
    text = F.col("payload").cast("string")
    upper = F.substring("batch_id", 2, 8).cast("int") % 2 == 0
    for name in ("events", "sourceService", "timestamp", "userId", "tenantId", "properties", "message", "severity", "tags"):
        text = F.replace(text, F.lit(f'"{name}":'), F.when(upper, f'"{name.upper()}":').otherwise(
            f'"{name[0].upper()}{name[1:]}":'))
    return good.withColumn("payload", text.cast("binary"))


#: Requests with one field of a wrong type, or none where it must be; the number 1 form of each is good.
WRONG_EVENTS = (
    '{"eventName":"e","timestamp":"2026-01-02"}', '{"eventName":5}', '{"eventName":"e","timestamp":"soon"}',
    '{"eventName":"e","timestamp":20260102}', '{"eventName":"e","userId":true}', '{"eventName":"e","properties":[1]}',
    '{"distinctId":"d"}', "null", '"e"', '{"eventName":"e","sessionId":{"id":1}}')
WRONG_REPORTS = (
    '"severity":4,"other":[{}]', '"severity":"4"', '"severity":"Fatal"', '"severity":1.5', '"severity":9999999999',
    '"tags":{"a":1}', '"tags":["a"]', '"extra":"x"', '"stackTrace":7', '"tenantId":false')


def wrong_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every good analytics request with one more event, and every good report with one more field, of each form."""
    requests, reports = (envelopes(spark, sf_dir, s) for s in (ANALYTICS, ERRORS))
    text = F.col("payload").cast("string")
    more = [F.replace(text, F.lit('"events":['), F.lit(f'"events":[{e},')) for e in WRONG_EVENTS]
    service = F.concat(F.lit('{"SOURCESERVICE":1,'), F.substring(text, F.lit(2), F.length(text)))
    fields = [F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(f",{f}}}")) for f in WRONG_REPORTS]
    return _with_texts(requests, more + [service]).unionByName(_with_texts(reports, fields))
