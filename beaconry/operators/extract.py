"""Error spans and error logs, from flat tables or inside a parsed document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.constants import EXCEPTION_MESSAGE, EXCEPTION_STACKTRACE, EXCEPTION_TYPE, JSON
from beaconry.functions.columns import (
    attrs_map, body_text, exception_fields, is_error_log, is_error_span, last_attribute, nano_ts)
from beaconry.functions.maps import let, present, record
from beaconry.functions.reuse import reused
from beaconry.sources.otlp import format_of

ERROR_SPAN_FIELDS = (
    "span_name", "service_name", "error_message", "exception_type", "exception_message", "stack_trace",
    "trace_id", "span_id", "attributes")
ERROR_LOG_FIELDS = (
    "message", "severity_number", "severity_text", "ts", "service_name", "trace_id", "span_id",
    "exception_type", "exception_message", "stack_trace", "attributes")


def _status_message(message: Column, fmt: Column | str, strict: bool) -> Column:
    """A protobuf status message is never null; unless ``strict``, an empty one does not mask."""
    if strict:
        return message
    if isinstance(fmt, str):
        return message if fmt == JSON else F.nullif(message, F.lit(""))
    return F.when((fmt != JSON) & (message == ""), F.lit(None)).otherwise(message)


def error_span(
    service: Column, name: Column, status_message: Column, events: Column, attributes: Column,
    trace_id: Column, span_id: Column, fmt: Column | str, strict: bool = False,
) -> Column:
    """Record of one error span."""
    return let(exception_fields(events, fmt), lambda x: record(**{
        "span_name": F.coalesce(name, F.lit("unknown")),
        "service_name": service,
        "error_message": F.coalesce(_status_message(status_message, fmt, strict), x["exception_message"]),
        "exception_type": x["exception_type"],
        "exception_message": x["exception_message"],
        "stack_trace": x["stack_trace"],
        "trace_id": trace_id,
        "span_id": span_id,
        "attributes": attrs_map(attributes, fmt),
    }))


def _log_attribute(attributes: Column, key: str, fmt: Column | str) -> Column:
    """Exception attribute of a log: JSON ignores empty texts, protobuf keeps them."""
    last = last_attribute(attributes, key, fmt)
    filled = last_attribute(
        F.filter(attributes, lambda a: present(F.coalesce(
            a["value"]["stringValue"], a["value"]["intValue"], a["value"]["boolValue"].cast("string")))), key, fmt)
    if isinstance(fmt, str):
        return filled if fmt == JSON else last
    return F.when(fmt == JSON, filled).otherwise(last)


def error_log(
    service: Column, severity: Column, text: Column, body: Column, ts: Column, attributes: Column,
    trace_id: Column, span_id: Column, fmt: Column | str,
) -> Column:
    """Record of one error log."""
    message = _log_attribute(attributes, EXCEPTION_MESSAGE, fmt)
    return record(**{
        "message": F.coalesce(body, message),
        "severity_number": F.coalesce(severity, F.lit(0)),
        "severity_text": text,
        "ts": ts,
        "service_name": service,
        "trace_id": trace_id,
        "span_id": span_id,
        "exception_type": _log_attribute(attributes, EXCEPTION_TYPE, fmt),
        "exception_message": message,
        "stack_trace": _log_attribute(attributes, EXCEPTION_STACKTRACE, fmt),
        "attributes": attrs_map(attributes, fmt),
    })


def _carried(df: DataFrame) -> list[str]:
    return [c for c in ("batch_id", "received_at", "header_source", "header_node_id", "header_tenant",
                        "header_tenant_alt", "source_format", "resource_pos", "scope_pos", "item_pos")
            if c in df.columns]


@reused
def _span_error(fmt: str | None, strict: bool) -> Column:
    c = F.col
    return error_span(c("service_name"), c("name"), c("status_message"), c("events"), c("attributes"),
                      c("trace_id"), c("span_id"), format_of(fmt), strict)


@reused
def _log_error(fmt: str | None) -> Column:
    c = F.col
    return error_log(c("service_name"), c("severity_number"), c("severity_text"), c("body"), c("ts"),
                     c("attributes"), c("trace_id"), c("span_id"), format_of(fmt))


def extract_error_spans(spans: DataFrame, strict: bool = False, fmt: str | None = None) -> DataFrame:
    """Error spans of a flat span table: a filter and a projection.

    ``fmt`` names the payload format where all rows share it; otherwise each row says its own.
    """
    hit = spans.filter(is_error_span(F.col("status_code"), F.col("events")))
    return hit.select(*_carried(spans), _span_error(fmt, strict).alias("e")).select(*_carried(spans), "e.*")


def extract_error_logs(logs: DataFrame, fmt: str | None = None) -> DataFrame:
    """Error logs of a flat log table: a filter and a projection."""
    hit = logs.filter(is_error_log(
        F.col("severity_number"), F.col("severity_text"), F.col("attributes"), format_of(fmt)))
    return hit.select(*_carried(logs), _log_error(fmt).alias("e")).select(*_carried(logs), "e.*")


def span_errors_in(span: Column, fmt: Column | str) -> Column:
    return is_error_span(span["status"]["code"], span["events"])


def log_errors_in(log: Column, fmt: Column | str) -> Column:
    return is_error_log(log["severityNumber"], log["severityText"], log["attributes"], fmt)


def span_record(span: Column, service: Column, arrival: Column, fmt: Column | str, strict: bool) -> Column:
    return error_span(service, span["name"], span["status"]["message"], span["events"], span["attributes"],
                      span["traceId"], span["spanId"], fmt, strict)


def log_record(log: Column, service: Column, arrival: Column, fmt: Column | str, strict: bool) -> Column:
    return error_log(service, log["severityNumber"], log["severityText"], body_text(log["body"]),
                     nano_ts(log["timeUnixNano"], arrival, fmt), log["attributes"],
                     log["traceId"], log["spanId"], fmt)
