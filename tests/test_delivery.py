"""Sinks, failure isolation, retry, audit and streams."""

import json

import pytest
from pyspark.sql import functions as F

from beaconry.constants import ANALYTICS, ERRORS, LOGS, TRACES
from beaconry.context import CollectorOptions, Context
from beaconry.operators.analytics import pack_batches
from beaconry.operators.routing import SinkConfig, default_sinks
from beaconry.plans.process import process_analytics, process_errors, process_logs, process_traces
from beaconry.sinks.base import callable_sink, table_sink
from beaconry.sinks.fanout import Ledger, fan_out, failed_sinks, publish_audit
from beaconry.sinks.retry import Rejected, RetryPolicy, analytics_policy, otlp_policy, with_retry
from beaconry.sources.envelopes import read_raw_files
from beaconry.streaming.intake import flush_stream, run_batch

JSON = "application/json"
ONCE = RetryPolicy(1, lambda n, e: 0)


def down(df, epoch):
    raise ConnectionError("down")


def trace_text(code=2):
    return json.dumps({"resourceSpans": [{"resource": {"attributes": [
        {"key": "service.name", "value": {"stringValue": "api"}}]}, "scopeSpans": [{"spans": [
            {"name": "s", "traceId": "t1", "spanId": "s1", "status": {"code": code}}]}]}]})


@pytest.mark.parametrize("failing, status, message", [
    (2, "PartialSuccess", "2 sink(s) failed to export"), (1, "PartialSuccess", "1 sink(s) failed to export"), (0, "Success", None)])
def test_failures_reach_the_audit_event(envelope, spark, tmp_path, failing, status, message):
    env = envelope(("x", TRACES, trace_text(), JSON), source="gateway", node="n1", tenant="acme")
    seen = []
    configs = [SinkConfig(TRACES, n) for n in "abc"]
    done = process_traces(env, Context(), CollectorOptions(environment="test"), configs, json_only=True)
    sinks = [callable_sink(n, down if i < failing else (lambda df, epoch: seen.append(df.count())), "batches", ONCE)
             for i, n in enumerate("abc")]
    outcomes = fan_out({"batches": lambda _n: done.stats}, sinks, 7, Ledger(spark, str(tmp_path / "ledger")))
    assert len(failed_sinks(outcomes)) == failing and len(seen) == 3 - failing
    audit = done.audit(failed_sinks(outcomes)).collect()[0]
    assert (audit.status, audit.error_message, audit.trace_count, audit.source_node_name, audit.source_node_id) == (
        status, message, 1, "gateway", "n1")
    assert audit.metadata.get("collector.sink_failures") == (str(failing) if failing else None)
    assert audit.metadata["telemetry.environment"] == "test" and audit.version == 1


def test_repeated_epoch_skips_delivered_sinks(spark, tmp_path):
    ledger, calls = Ledger(spark, str(tmp_path / "ledger")), []
    good = callable_sink("good", lambda df, epoch: calls.append(epoch), policy=ONCE)
    bad = callable_sink("bad", down, policy=ONCE)
    views = {"payload": lambda _n: spark.range(1)}
    fan_out(views, [good, bad], 1, ledger)
    again = fan_out(views, [good, bad], 1, ledger)
    fan_out(views, [good], 2, ledger)
    assert calls == [1, 2] and again["good"].ok and not again["bad"].ok


def test_audit_failure_is_contained(spark, tmp_path):
    audit = spark.createDataFrame([("a1", None)], "audit_id string, correlation_id string")
    assert publish_audit(audit, callable_sink("topic", down, policy=ONCE), 1, Ledger(spark, str(tmp_path / "l"))) == "transport_publish"


def delays(policy, error):
    slept = []

    def fail():
        raise error

    outcome = with_retry(fail, policy, slept.append)
    assert not outcome.ok and outcome.attempts == policy.attempts
    return [round(s * 1000) for s in slept]


def test_retry_schedules():
    assert delays(otlp_policy(4), ConnectionError("x")) == [200, 400, 800]
    assert delays(otlp_policy(0), ConnectionError("x")) == []
    assert delays(otlp_policy(3), Rejected(500)) == []
    assert delays(analytics_policy(3), ConnectionError("x")) == [100, 200, 400]
    assert delays(analytics_policy(3), Rejected(429)) == [1000, 2000, 4000]
    assert delays(analytics_policy(2), Rejected(429, 30)) == [30, 30]
    assert delays(analytics_policy(3), Rejected(400)) == [100, 200, 400]
    assert delays(analytics_policy(3), Rejected(503)) == []


def test_retry_stops_at_success():
    results = iter([Rejected(503), ConnectionError("x"), "fine"])

    def write():
        value = next(results)
        if isinstance(value, Exception):
            raise value
        return value

    outcome = with_retry(write, otlp_policy(5), lambda s: None)
    assert outcome.ok and outcome.attempts == 3 and outcome.result == "fine"


def test_level_gate_only_touches_its_sink(envelope, spark, tmp_path):
    def text(n):
        return json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [{"severityNumber": n}]}]}]})

    env = envelope(("low", LOGS, text(9), JSON), ("high", LOGS, text(13), JSON))
    got = {}
    sinks = [callable_sink(n, lambda df, e, n=n: got.__setitem__(n, sorted(r.batch_id for r in df.collect())))
             for n in ("log_store", "all_signals")]
    run_batch(env, LOGS, sinks, Ledger(spark, str(tmp_path / "l")), 1)
    assert got == {"log_store": ["high"], "all_signals": ["high", "low"]}


def test_span_error_event(envelope):
    env = envelope(("x", TRACES, trace_text(), JSON), tenant="acme")
    row = process_traces(env, Context(node_id="n9"), CollectorOptions(environment="test")).error_events.collect()[0]
    assert (row.message, row.severity, row.correlation_id, row.operation_id, row.node_id, row.environment) == (
        "Error in span: s", 3, "t1", "s1", "n9", "test")
    assert row.tags == {"span.name": "s", "tenant_id": "acme", "trace.id": "t1", "span.id": "s1", "service.name": "api"}


def test_log_source_prefers_the_header(envelope):
    text = json.dumps({"resourceLogs": [{"resource": {"attributes": [
        {"key": "service.name", "value": {"stringValue": "api"}}]}, "scopeLogs": [{"logRecords": [{"severityNumber": 21}]}]}]})
    row = process_logs(envelope(("x", LOGS, text, JSON), source="gw", tenant_alt="alt")).error_events.collect()[0]
    assert (row.source_name, row.message, row.severity, row.tags["tenant_id"]) == ("gw", "Error log", 4, "alt")


def analytics_text(n=2, tenant=None):
    events = [{"eventName": f"e{i}", "userId": "u", "tenantId": tenant, "properties": {"i": i}} for i in range(n)]
    return json.dumps({"sourceService": "app", "events": events})


def test_request_tenant_reaches_events_and_rejects_have_reasons(envelope):
    env = envelope(("a", ANALYTICS, analytics_text(), JSON), ("b", ANALYTICS, '{"events":[]}', JSON),
                   ("c", ANALYTICS, '{"events":null}', JSON), ("d", ANALYTICS, "{ no", JSON), tenant="acme")
    done = process_analytics(env, opts=CollectorOptions(environment="test"))
    events = done.captured.collect()
    assert len(events) == 2 and all(json.loads(e.json)["properties"]["tenant_id"] == "acme" for e in events)
    assert {r.batch_id: r.reason for r in done.rejects.collect()} == {
        "b": "No events provided", "c": "No events provided", "d": "Invalid JSON format"}
    stats = done.stats.collect()
    assert [(s.batch_id, s.item_count, s.batch_tenant, s.source_name) for s in stats] == [("a", 2, "acme", "app")]


def test_error_report_defaults(envelope):
    env = envelope(("a", ERRORS, '{"message":"m","tags":{"x":"1"}}', JSON), ("b", ERRORS, "null", JSON),
                   ("c", ERRORS, "{}", JSON), ("d", ERRORS, "oops", JSON), tenant="acme")
    done = process_errors(env)
    sent = done.deliveries().collect()
    assert [(s.batch_id, s.severity, s.level, s.tags) for s in sent] == [("a", 3, "error", {"x": "1", "tenant_id": "acme"})]
    assert sorted(r.batch_id for r in done.error_events.collect()) == ["a", "c"]
    assert {r.batch_id: r.reason for r in done.rejects.collect()} == {"b": "Invalid request", "d": "Invalid JSON format"}
    assert done.audit() is None


@pytest.mark.parametrize("mode", ["cap", "threshold"])
def test_packing_keeps_every_event(envelope, mode):
    env = envelope(*[(f"b{i}", ANALYTICS, analytics_text(n), JSON) for i, n in enumerate([1, 7, 3, 12, 2])]).coalesce(1)
    docs = pack_batches(process_analytics(env).captured, 5, mode).collect()
    counts = [len(json.loads(d.document)["batch"]) for d in docs]
    assert sum(counts) == 25 and counts == [d.event_count for d in docs]
    if mode == "cap":
        assert max(counts) <= 5
    else:
        assert all(n >= 5 for n in counts[:-1]) and counts == [8, 15, 2]


def test_failed_flush_keeps_events_pending(envelope, spark, tmp_path):
    path = str(tmp_path)
    envelope(("a", ANALYTICS, analytics_text(3), JSON)).write.parquet(f"{path}/in")
    from beaconry.sources.envelopes import stream_envelopes

    def flush(sink):
        run = flush_stream(stream_envelopes(spark, f"{path}/in"), sink, f"{path}/ledger", f"{path}/cp", interval=None)
        run.awaitTermination()

    with pytest.raises(Exception, match="FlushFailed|down"):
        flush(callable_sink("pa", down, "documents", ONCE))
    flush(table_sink("pa", f"{path}/out", "documents"))
    assert [r.event_count for r in spark.read.parquet(f"{path}/out").collect()] == [3]


def test_raw_files_join_their_headers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one").write_text(trace_text())
    (tmp_path / "in" / "two").write_bytes(b"\0" * 900)
    headers = spark.createDataFrame([("one", TRACES, JSON, "gw"), ("two", TRACES, None, None)],
                                    "file_name string, signal string, content_type string, header_source string")
    env = read_raw_files(spark, str(tmp_path / "in"), headers)
    got = {r.batch_id: (r.item_count, r.source_name) for r in process_traces(env).stats.collect()}
    assert got == {"one": (1, "gw"), "two": (3, None)}


def test_default_matrix():
    pairs = {(c.signal, c.sink) for c in default_sinks()}
    assert len(pairs) == 10 and (LOGS, "error_tracker") in pairs and (ANALYTICS, "product_analytics") in pairs


def test_capture_json_leaves_out_nothing_but_nulls(envelope):
    events = process_analytics(envelope(("a", ANALYTICS, analytics_text(1), JSON))).captured
    body = json.loads(events.first().json)
    assert sorted(body) == ["distinct_id", "event", "properties", "timestamp"]
    assert body["properties"]["i"] == 0 and body["timestamp"] == "2026-01-02T03:04:05.000+00:00"
