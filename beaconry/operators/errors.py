"""Error events: from spans, logs and reports to the error backend."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.constants import (
    EXCEPTION_MESSAGE, EXCEPTION_STACKTRACE, EXCEPTION_TYPE, KEYS, SEVERITY_ERROR, TENANT_ID, TagKeys)
from beaconry.context import CollectorOptions, Context
from beaconry.functions.columns import backend_level, is_deliverable, sampled, severity_level, tag_key
from beaconry.functions.maps import entries, entries_of, entry, merge_last, nonempty, upsert
from beaconry.functions.reuse import reused
from beaconry.operators.enrich import enrich_errors

EVENT_COLUMNS = (
    "batch_id", "pos", "source_name", "received_at", "ts", "message", "severity", "correlation_id",
    "operation_id", "node_id", "user_id", "environment", "tags", "extra")


def _attribute_tags(attributes: Column) -> Column:
    return F.transform(entries_of(attributes), lambda e: entry(tag_key(e["key"]), e["value"]))


@reused
def _span_tags() -> Column:
    e = F.col("e")
    return merge_last(
        F.array(entry("span.name", e["span_name"])),
        entries([(TENANT_ID, F.col("batch_tenant")), ("trace.id", e["trace_id"]), ("span.id", e["span_id"])]),
        _attribute_tags(e["attributes"]))


@reused
def _log_tags() -> Column:
    e = F.col("e")
    return merge_last(
        entries([(TENANT_ID, F.col("batch_tenant")), ("trace.id", e["trace_id"]), ("span.id", e["span_id"]),
                 ("severity.text", e["severity_text"]), ("severity.number", e["severity_number"].cast("string"))]),
        _attribute_tags(e["attributes"]))


@reused
def _extra() -> Column:
    record = F.col("e")
    es = entries([(EXCEPTION_TYPE, record["exception_type"]), (EXCEPTION_MESSAGE, record["exception_message"]),
                  (EXCEPTION_STACKTRACE, record["stack_trace"])])
    return F.map_from_entries(F.transform(es, lambda e: entry(e["key"], e["value"].cast("variant"))))


def explode_errors(profile: DataFrame) -> DataFrame:
    """Error records of batch profiles, one row each, with their batch's attribution."""
    return profile.select(
        "batch_id", "received_at", "source_name", "batch_tenant", F.posexplode(nonempty(F.col("errors"))).alias("pos", "e"))


def _none() -> Column:
    return F.lit(None).cast("string")


def span_errors_to_events(
    errors: DataFrame, ctx: Context = Context(), opts: CollectorOptions = CollectorOptions(),
) -> DataFrame:
    """Error spans (``batch_id, received_at, batch_tenant, pos, e``) as enriched error events."""
    e = F.col("e")
    events = errors.select(
        "batch_id", "pos", e["service_name"].alias("source_name"), "received_at", F.col("received_at").alias("ts"),
        F.coalesce(e["error_message"], e["exception_message"],
                   F.concat(F.lit("Error in span: "), e["span_name"])).alias("message"),
        F.lit(SEVERITY_ERROR).alias("severity"), e["trace_id"].alias("correlation_id"),
        e["span_id"].alias("operation_id"), _none().alias("node_id"), _none().alias("user_id"),
        _none().alias("environment"), _span_tags().alias("tags"), _extra().alias("extra"), "batch_tenant")
    return enrich_errors(events, F.col("source_name"), ctx, opts)


def log_errors_to_events(
    errors: DataFrame, ctx: Context = Context(), opts: CollectorOptions = CollectorOptions(),
) -> DataFrame:
    """Error logs (with ``source_name`` of the batch) as enriched error events."""
    e = F.col("e")
    events = errors.select(
        "batch_id", "pos", F.coalesce(F.col("source_name"), e["service_name"]).alias("source_name"),
        "received_at", e["ts"].alias("ts"), F.coalesce(e["message"], F.lit("Error log")).alias("message"),
        severity_level(e["severity_number"]).alias("severity"),
        F.nullif(e["trace_id"], F.lit("")).alias("correlation_id"),
        F.nullif(e["span_id"], F.lit("")).alias("operation_id"), _none().alias("node_id"),
        _none().alias("user_id"), _none().alias("environment"), _log_tags().alias("tags"), _extra().alias("extra"),
        "batch_tenant")
    return enrich_errors(events, F.col("source_name"), ctx, opts)


def apply_default_tags(df: DataFrame, tags: Mapping[str, str]) -> DataFrame:
    """Configured tags, applied last, so they win."""
    if not tags:
        return df
    added = F.array(*[entry(k, F.lit(v)) for k, v in tags.items()])
    return df.withColumn("tags", merge_last(entries_of(F.col("tags")), added))


def error_delivery(df: DataFrame, keys: TagKeys = KEYS) -> DataFrame:
    """What the error backend gets: id tags first, own tags over them, the user and its level."""
    ids = entries([(keys.of(n), F.col(n)) for n in ("correlation_id", "operation_id", "node_id")])
    return df.withColumns({
        "tags": merge_last(ids, entries_of(F.col("tags"))),
        "user": F.nullif(F.col("user_id"), F.lit("")),
        "level": backend_level(F.col("severity")),
    })


def deliverable(df: DataFrame) -> DataFrame:
    """Drop errors with neither exception nor message."""
    exception = F.col("exception") if "exception" in df.columns else None
    return df.filter(is_deliverable(F.col("message"), exception))


def sample(df: DataFrame, rate: float, key: str | Column) -> DataFrame:
    """Keep a stable share of the rows, decided by their key."""
    if rate >= 1.0:
        return df
    return df.filter(sampled(F.col(key) if isinstance(key, str) else key, rate))


def with_tag(df: DataFrame, key: str, value: Column | str | None, column: str = "tags") -> DataFrame:
    """Set one tag on every error event, overwriting it."""
    col = value if isinstance(value, Column) else F.lit(value).cast("string")
    return df.withColumn(column, upsert(F.col(column), key, col))


