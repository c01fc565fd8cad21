"""Whole processing of each signal, as one set of DataFrames; the same code for batch and stream."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.constants import ANALYTICS, ERRORS, JSON, LOGS, METRICS, TRACES
from beaconry.context import CollectorOptions, Context
from beaconry.operators.analytics import capture_events
from beaconry.operators.audit import failures_in, ingestion_audit
from beaconry.operators.counters import error_type, forwarded_counters, ingest_counters
from beaconry.operators.enrich import attribute_batches, enrich_errors, enrich_events, fill_tenant
from beaconry.operators.errors import (
    apply_default_tags, deliverable, error_delivery, explode_errors, log_errors_to_events, sample, span_errors_to_events)
from beaconry.operators.routing import SinkConfig, decisions, default_sinks, route
from beaconry.operators.stats import profile_batches, profile_json
from beaconry.functions.maps import present
from beaconry.plans.scratch import written
from beaconry.sources.envelopes import header_tenant
from beaconry.sources.requests import accepted, analytics_request, read_analytics, read_error_reports


@dataclass(frozen=True)
class Processed:
    """What becomes of the batches of one signal."""

    signal: str
    stats: DataFrame
    error_events: DataFrame | None = None
    captured: DataFrame | None = None
    rejects: DataFrame | None = None
    ctx: Context = Context()
    opts: CollectorOptions = CollectorOptions()

    def counters(self) -> DataFrame:
        return ingest_counters(self.stats, self.opts.keys)

    def forwarded(self) -> DataFrame | None:
        """Deliverable errors of spans and logs by the tenant of their batch; reports are not counted."""
        if self.error_events is None or self.signal == ERRORS:
            return None
        return forwarded_counters(deliverable(self.error_events), "batch_tenant")

    def deliveries(self) -> DataFrame | None:
        """Error events as the error backend gets them; of the sampled share where that is not all.

        The share is stable: an event is in it or not by its own hash, also when the run is repeated.
        """
        if self.error_events is None:
            return None
        chosen = sample(deliverable(self.error_events), self.opts.error_sample_rate, F.concat_ws("/", "batch_id", "operation_id", "message"))
        tagged = error_delivery(chosen, self.opts.keys)
        return apply_default_tags(tagged, self.opts.default_tags)

    def audit(self, failed: Iterable[str] = (), duration_ms: Column | None = None,
              single: DataFrame | None = None) -> DataFrame | None:
        """Audit events after a fan-out; error reports have none.

        ``failed``: sinks that took nothing; ``single``: (sink, batch_id) that a sink refused alone.
        """
        if self.signal == ERRORS or not self.opts.publish_audit:
            return None
        failed = list(failed)
        counted = self.stats.withColumn("sink_failures", failures_in(F.col("routes"), failed))
        if single is not None:
            alone = single.filter(~F.col("sink").isin(*failed)) if failed else single
            alone = alone.groupBy("batch_id").agg(F.count_distinct("sink").alias("alone"))
            counted = counted.join(alone, "batch_id", "left").withColumn(
                "sink_failures", (F.col("sink_failures") + F.coalesce("alone", F.lit(0))).cast("int")).drop("alone")
        return ingestion_audit(counted, self.ctx, self.opts, duration_ms)


def _otlp(envelopes: DataFrame, signal: str, ctx: Context, opts: CollectorOptions,
          sinks: Sequence[SinkConfig] | None, table: str | None, json_only: bool) -> Processed:
    profile = profile_json(envelopes, signal, opts.strict_parity) if json_only else profile_batches(
        envelopes, signal, opts.strict_parity)
    stats = route(attribute_batches(profile), default_sinks(opts.min_level) if sinks is None else sinks)
    if table is not None:
        stats = written(stats, table)
    if signal == METRICS:
        return Processed(signal, stats, ctx=ctx, opts=opts)
    build = span_errors_to_events if signal == TRACES else log_errors_to_events
    events = build(explode_errors(stats), ctx, opts)
    return Processed(signal, stats, events, ctx=ctx, opts=opts)


def process_traces(envelopes: DataFrame, ctx: Context = Context(), opts: CollectorOptions = CollectorOptions(),
                   sinks: Sequence[SinkConfig] | None = None, table: str | None = None,
                   json_only: bool = False) -> Processed:
    """Traces: counts, names, routes and error events. ``table`` stores the narrow per-batch rows,
    so that several outputs share one parse of the payloads."""
    return _otlp(envelopes, TRACES, ctx, opts, sinks, table, json_only)


def process_metrics(envelopes: DataFrame, ctx: Context = Context(), opts: CollectorOptions = CollectorOptions(),
                    sinks: Sequence[SinkConfig] | None = None, table: str | None = None,
                    json_only: bool = False) -> Processed:
    return _otlp(envelopes, METRICS, ctx, opts, sinks, table, json_only)


def process_logs(envelopes: DataFrame, ctx: Context = Context(), opts: CollectorOptions = CollectorOptions(),
                 sinks: Sequence[SinkConfig] | None = None, table: str | None = None,
                 json_only: bool = False) -> Processed:
    return _otlp(envelopes, LOGS, ctx, opts, sinks, table, json_only)


def analytics_stats(envelopes: DataFrame, sinks: Sequence[SinkConfig]) -> DataFrame:
    """Per-request row of accepted analytics requests, from the request alone (no shuffle).

    The batch tenant is the header's, else the single tenant the events agree on.
    """
    mine = envelopes.filter(F.col("signal") == ANALYTICS)
    requests = accepted(
        mine, analytics_request(), "batch_id", "received_at", "header_source", "header_node_id",
        header_tenant().alias("header_tenant"), F.octet_length("payload").alias("payload_bytes"))
    tenants = F.filter(F.transform("doc.events", lambda e: e["tenantId"]), present)
    folded = F.array_distinct(F.transform(tenants, F.lower))
    single = F.when(F.size(folded) == 1, F.get(tenants, F.lit(0)))
    stats = requests.select(
        "batch_id", "received_at", F.lit(ANALYTICS).alias("signal"),
        F.lit(JSON).alias("source_format"), "payload_bytes",
        F.size("doc.events").cast("bigint").alias("item_count"), F.lit(0).cast("bigint").alias("error_count"),
        F.lit(0).alias("max_severity"), F.coalesce("doc.sourceService", "header_source").alias("source_name"),
        F.coalesce("doc.sourceNodeId", "header_node_id").alias("source_node_id"),
        F.coalesce(F.col("header_tenant"), single).alias("batch_tenant"))
    return route(stats, sinks)


def process_analytics(envelopes: DataFrame, ctx: Context = Context(), opts: CollectorOptions = CollectorOptions(),
                      sinks: Sequence[SinkConfig] | None = None) -> Processed:
    """Analytics requests: accepted events filled, enriched and captured; refused ones with reason."""
    events, rejects = read_analytics(envelopes)
    ready = enrich_events(fill_tenant(events), F.col("source_name"), ctx, opts)
    stats = analytics_stats(envelopes, default_sinks(opts.min_level) if sinks is None else sinks)
    return Processed(ANALYTICS, stats, captured=capture_events(ready, opts), rejects=rejects, ctx=ctx, opts=opts)


def process_errors(envelopes: DataFrame, ctx: Context = Context(), opts: CollectorOptions = CollectorOptions(),
                   sinks: Sequence[SinkConfig] | None = None) -> Processed:
    """Error reports: accepted ones enriched for the error backend; no audit event."""
    reports, rejects = read_error_reports(envelopes)
    events = enrich_errors(reports, F.col("source_name"), ctx, opts)
    configs = default_sinks(opts.min_level) if sinks is None else sinks
    stats = events.select(
        "batch_id", "received_at", F.lit(ERRORS).alias("signal"), "source_name",
        F.col("tags")["tenant_id"].alias("batch_tenant"), F.lit(1).cast("bigint").alias("item_count")).withColumn(
        "routes", decisions(configs, F.col("signal"), F.lit(True), F.lit(0), F.lit(1)))
    return Processed(ERRORS, stats, events, rejects=rejects, ctx=ctx, opts=opts)


def processing_failures(stats: DataFrame, failed: Column) -> DataFrame:
    """Batches whose processing failed, with the error type their signal counts under."""
    return stats.filter(failed).select(error_type(F.col("signal")).alias("error_type"), "batch_tenant")
