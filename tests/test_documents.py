"""Decoding, counting and error extraction on hand-written documents."""

import json

import pytest
from pyspark.sql import functions as F

from beaconry.constants import LOGS, METRICS, TRACES
from beaconry.operators.extract import extract_error_logs, extract_error_spans
from beaconry.operators.stats import (
    batch_service_names, count_logs, count_metrics, count_spans, estimate_items, max_severity, profile_batches,
    profile_json)
from beaconry.sources import otlp
from beaconry.sources.proto import message_class

JSON = "application/json"


def attr(key, **value):
    return {"key": key, "value": value}


def resource(name, key="service.name"):
    return {"attributes": [attr(key, stringValue=name)]}


def traces(*groups):
    return json.dumps({"resourceSpans": [
        {"resource": resource(n), "scopeSpans": [{"spans": spans} for spans in scopes]} for n, scopes in groups]})


def logs(records, name="svc"):
    return json.dumps({"resourceLogs": [{"resource": resource(name), "scopeLogs": [{"logRecords": records}]}]})


def span(name, **more):
    return {"traceId": "aa", "spanId": "bb", "name": name, **more}


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_counts_spans_over_resources_and_scopes(envelope):
    text = traces(("a", [[span("1"), span("2")], [span("3")]]), ("b", [[span("4"), span("5")]]))
    env = envelope(("x", TRACES, text, JSON))
    assert one(count_spans(env)).item_count == 5
    assert one(batch_service_names(env, TRACES)).service_names == ["a", "b"]
    assert otlp.decode_spans(env).count() == 5


def test_counts_metrics_and_logs(envelope):
    text = json.dumps({"resourceMetrics": [{"resource": resource("m"), "scopeMetrics": [{"metrics": [
        {"name": "a", "unit": "1", "sum": {"dataPoints": [{"asInt": "1"}, {"asInt": 2}]}}, {"name": "b"}, {"name": "c"}]}]}]})
    row = one(count_metrics(envelope(("x", METRICS, text, JSON))))
    assert (row.item_count, row.estimated_points, row.exact_points) == (3, 3, 2)
    assert one(count_logs(envelope(("x", LOGS, logs([{}] * 4), JSON)))).item_count == 4


@pytest.mark.parametrize("payload, kind, expected", [
    (b"\0" * 900, "application/x-protobuf", 3), (b"\0" * 900, None, 3), ("", JSON, 0), ("{ invalid json }}}", JSON, 1),
    ("{}", JSON, 1), ("[]", JSON, 1), ("{ bad " * 200, JSON, 4), ('{"resourceSpans":7}' + " " * 700, JSON, 2)])
def test_fallback_counts(envelope, payload, kind, expected):
    assert one(profile_batches(envelope(("x", TRACES, payload, kind)), TRACES)).item_count == expected


def test_size_estimates_per_signal(envelope):
    env = envelope(*[(s, s, b"\0" * 900, None) for s in (TRACES, METRICS, LOGS)])
    got = {r.signal: r.estimated_items for r in estimate_items(env).collect()}
    assert got == {TRACES: 3, METRICS: 9, LOGS: 6}


def test_status_error_span(envelope):
    env = envelope(("x", TRACES, traces(("api", [[span("GET /", status={"code": 2, "message": "failed"}),
                                                   span("ok", status={"code": 1})]])), JSON))
    row = one(extract_error_spans(otlp.decode_spans(env)))
    assert (row.span_name, row.service_name, row.error_message, row.trace_id, row.span_id) == (
        "GET /", "api", "failed", "aa", "bb")


def test_first_exception_event_decides(envelope):
    first = {"name": "Exception", "attributes": [
        attr("exception.type", stringValue="T"), attr("exception.message", stringValue="m"),
        attr("exception.message", stringValue="last"), attr("exception.stacktrace", stringValue="st")]}
    second = {"name": "exception", "attributes": [attr("exception.type", stringValue="ignored")]}
    env = envelope(("x", TRACES, traces(("api", [[span("s", events=[{"name": "other"}, first, second])]])), JSON))
    row = one(extract_error_spans(otlp.decode_spans(env)))
    assert (row.exception_type, row.exception_message, row.stack_trace, row.error_message) == ("T", "last", "st", "last")


def test_attributes_of_an_error_span(envelope):
    attributes = [attr("http.method", stringValue="GET"), attr("status", intValue=500), attr("quoted", intValue="7"),
                  attr("flag", boolValue=True), attr("raw", doubleValue=1.5), attr("list", arrayValue={"values": []}),
                  attr("empty", stringValue=""), {"key": "none"}, attr("http.method", stringValue="PUT")]
    env = envelope(("x", TRACES, traces(("api", [[span("s", status={"code": 2}, attributes=attributes)]])), JSON))
    assert one(extract_error_spans(otlp.decode_spans(env))).attributes == {
        "http.method": "PUT", "status": "500", "quoted": "7", "flag": "True"}


def test_low_severity_log_with_error_text(envelope):
    record = {"timeUnixNano": 1700000000123456789, "severityNumber": 9, "severityText": "critical",
              "body": {"stringValue": "b"}, "attributes": [attr("ok", boolValue=True)]}
    env = envelope(("x", LOGS, logs([record, {"severityNumber": 9, "severityText": "INFO"}]), JSON))
    row = one(extract_error_logs(otlp.decode_logs(env)).withColumn("ms", F.unix_millis("ts")))
    assert (row.message, row.severity_number, row.ms, row.attributes) == ("b", 9, 1700000000123, {"ok": "True"})
    assert one(max_severity(env)).max_severity == 9


def test_service_name_key_in_any_case_and_first_match(envelope):
    text = json.dumps({"resourceLogs": [
        {"resource": {"attributes": [attr("SERVICE.name", intValue=5), attr("service.name", stringValue="late")]},
         "scopeLogs": [{"logRecords": [{"severityNumber": 17}]}]},
        {"resource": resource("Api"), "scopeLogs": []}, {"resource": resource("API"), "scopeLogs": []},
        {"resource": resource(" "), "scopeLogs": []}]})
    env = envelope(("x", LOGS, text, JSON))
    assert one(otlp.decode_logs(env)).service_name == "5"
    assert one(batch_service_names(env, LOGS)).service_names == ["late", "Api"]


def test_names_come_from_any_resource_array(envelope):
    text = json.dumps({"resourceLogs": [{"resource": resource("l")}], "resourceSpans": [{"resource": resource("t")}]})
    assert one(batch_service_names(envelope(("x", TRACES, text, JSON)), TRACES)).service_names == ["t", "l"]


def test_profile_equals_flat_extraction(spark, envelope):
    spans = [span(f"s{i}", status={"code": i % 3}, attributes=[attr("i", intValue=i)]) for i in range(30)]
    env = envelope(("x", TRACES, traces(("api", [spans[:10], spans[10:]])), JSON))
    row = one(profile_json(env, TRACES))
    flat = extract_error_spans(otlp.decode_spans(env)).collect()
    assert row.error_count == len(flat) == 10
    assert [e.span_name for e in row.errors] == [f.span_name for f in flat]
    assert [e.attributes for e in row.errors] == [f.attributes for f in flat]
    assert one(profile_json(env, TRACES, records=False)).error_count == 10


def proto_logs():
    doc = message_class("LogsData")()
    group = doc.resource_logs.add()
    group.resource.attributes.add(key="service.name").value.string_value = "svc"
    records = group.scope_logs.add().log_records
    bad = records.add(severity_number=17, severity_text="ERROR", time_unix_nano=1_700_000_000_000_000_000,
                      trace_id=bytes.fromhex("ab" * 16), span_id=bytes.fromhex("cd" * 8))
    bad.body.string_value = "boom"
    bad.attributes.add(key="attempt").value.int_value = 3
    bad.attributes.add(key="ratio").value.double_value = 2.0
    bad.attributes.add(key="exception.type").value.string_value = "T"
    records.add(severity_number=9, severity_text="CRITICAL")
    blank = records.add(severity_number=9)
    blank.attributes.add(key="exception.message").value.string_value = ""
    return doc.SerializeToString()


def test_protobuf_logs(envelope):
    env = envelope(("x", LOGS, proto_logs(), "application/x-protobuf"), ("y", LOGS, b"{ nonsense", None))
    rows = {r.batch_id: r for r in profile_batches(env, LOGS).collect()}
    x, y = rows["x"], rows["y"]
    assert (x.item_count, x.count_method, x.max_severity, x.error_count, x.service_names) == (3, "exact", 17, 2, ["svc"])
    error = x.errors[0]
    assert (error.message, error.trace_id, error.span_id, error.exception_type) == ("boom", "ab" * 16, "cd" * 8, "T")
    assert error.attributes == {"attempt": "3", "ratio": "2", "exception.type": "T"}
    assert (y.item_count, y.count_method, y.error_count) == (1, "estimated", 0)


def test_protobuf_span_status_message(envelope):
    doc = message_class("TracesData")()
    s = doc.resource_spans.add().scope_spans.add().spans.add(name="charge card")
    s.status.code = 2
    event = s.events.add(name="exception")
    event.attributes.add(key="exception.message").value.string_value = "why"
    env = envelope(("x", TRACES, doc.SerializeToString(), None))
    spans = otlp.decode_spans_proto(env)
    assert one(extract_error_spans(spans)).error_message == "why"
    assert one(extract_error_spans(spans, strict=True)).error_message == ""
    s.status.message = "card declined"
    env = envelope(("x", TRACES, doc.SerializeToString(), None))
    row = one(extract_error_spans(otlp.decode_spans_proto(env)))
    assert (row.span_name, row.error_message) == ("charge card", "card declined")


def test_every_metric_kind_has_points(envelope):
    point = {"timeUnixNano": "1000000", "attributes": [attr("a", stringValue="b")]}
    metrics = [
        {"name": "g", "gauge": {"dataPoints": [{**point, "asDouble": 1.5}]}},
        {"name": "s", "sum": {"dataPoints": [{**point, "asInt": "4"}], "aggregationTemporality": 2, "isMonotonic": True}},
        {"name": "h", "histogram": {"dataPoints": [{**point, "count": "3", "sum": 6.0, "bucketCounts": ["1", "2"],
                                                    "explicitBounds": [2.0]}], "aggregationTemporality": 1}},
        {"name": "e", "exponentialHistogram": {"dataPoints": [{
            **point, "count": 2, "scale": 1, "zeroCount": "1", "positive": {"offset": 3, "bucketCounts": ["1"]}}]}},
        {"name": "q", "summary": {"dataPoints": [{**point, "count": "9", "sum": 1.0,
                                                  "quantileValues": [{"quantile": 0.5, "value": 7.0}]}]}}]
    text = json.dumps({"resourceMetrics": [{"resource": resource("m"), "scopeMetrics": [{"metrics": metrics}]}]})
    points = {r.name: r for r in otlp.metric_points(otlp.decode_metrics(envelope(("x", METRICS, text, JSON)))).collect()}
    assert points["g"].as_double == 1.5 and points["s"].as_int == 4 and points["s"].monotonic
    assert [int(b) for b in points["h"].bucket_counts] == [1, 2] and points["h"].temporality == 1
    assert points["e"].positive_offset == 3 and int(points["e"].zero_count) == 1
    assert points["q"].quantile_values[0].value == 7.0
    assert {p.kind for p in points.values()} == {"gauge", "sum", "histogram", "exponential_histogram", "summary"}
