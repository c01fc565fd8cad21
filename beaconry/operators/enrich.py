"""Enrichment: map merges and column fills whose precedence is the point.

Context values are literals or columns of the same row, so no operator here joins or shuffles.
"""

from __future__ import annotations

import platform

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.constants import (
    DEFAULT_SERVICE, DEPLOYMENT_ENVIRONMENT, KEYS, SERVICE_INSTANCE_ID, SERVICE_NAME, SERVICE_NAMESPACE,
    SERVICE_VERSION, TENANT_ID, TagKeys)
from beaconry.context import CollectorOptions, Context, ServiceOptions, Value, as_column
from beaconry.functions.columns import valid_resource
from beaconry.functions.maps import (
    VARIANT_ENTRIES, add_if_absent, entries, entries_of, entry, merge_defaults, merge_last, present)


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def _context_entries(ctx: Context, keys: TagKeys, names: tuple[str, ...]) -> Column:
    return entries([(keys.of(n), ctx.col(n)) for n in names])


def enrich_resource(
    df: DataFrame, ctx: Context, opts: CollectorOptions, column: str = "resource_attrs",
    now: str | Column = "received_at",
) -> DataFrame:
    """Add defaults and context to resource attributes; nothing present is overwritten."""
    keys, now = opts.keys, F.col(now) if isinstance(now, str) else now
    defaults = [
        entries([(SERVICE_NAME, F.lit(DEFAULT_SERVICE))]),
        _context_entries(ctx, keys, ("correlation_id", "operation_id", "node_id", "tenant_id", "environment")),
        entries([(keys.ingested_at, epoch_ms(now).cast("string")),
                 (keys.of("environment"), as_column(opts.environment))]),
    ]
    return df.withColumn(column, merge_defaults(entries_of(F.col(column)), *defaults))


def enrich_span(df: DataFrame, ctx: Context, keys: TagKeys = KEYS, column: str = "attributes") -> DataFrame:
    """Add correlation and operation ids to span attributes where absent."""
    extra = _context_entries(ctx, keys, ("correlation_id", "operation_id"))
    return df.withColumn(column, merge_defaults(entries_of(F.col(column)), extra))


def enrich_properties(
    df: DataFrame, service: Value, ctx: Context, opts: CollectorOptions, column: str = "properties",
) -> DataFrame:
    """Add source service, context ids and environment to analytics properties where absent."""
    keys = opts.keys
    extra = F.concat(
        entries([(SERVICE_NAME, as_column(service))]),
        _context_entries(ctx, keys, ("correlation_id", "operation_id")),
        entries([(keys.of("environment"), as_column(opts.environment))]))
    kind = dict(df.dtypes)[column]
    if kind.endswith("variant>"):
        extra = _as_variant(extra)
        return df.withColumn(column, merge_defaults(entries_of(F.col(column), VARIANT_ENTRIES), extra))
    return df.withColumn(column, merge_defaults(entries_of(F.col(column)), extra))


def _as_variant(es: Column) -> Column:
    return F.transform(es, lambda e: entry(e["key"], e["value"].cast("variant")))


def _fill(column: str, value: Column) -> Column:
    return F.when(present(F.col(column)), F.col(column)).otherwise(F.coalesce(value, F.col(column)))


def enrich_errors(df: DataFrame, source: Value, ctx: Context, opts: CollectorOptions,
                  now: str | Column = "received_at") -> DataFrame:
    """Complete error events: service and tenant tags, environment, ids, arrival time; only if unset."""
    keys, now = opts.keys, F.col(now) if isinstance(now, str) else now
    added = entries([(SERVICE_NAME, as_column(source)), (TENANT_ID, ctx.col("tenant_id"))])
    return df.withColumns({
        "tags": merge_defaults(entries_of(F.col("tags")), added, fold=False),
        "environment": _fill("environment", as_column(opts.environment)),
        "correlation_id": _fill("correlation_id", ctx.col("correlation_id")),
        "operation_id": _fill("operation_id", ctx.col("operation_id")),
        "node_id": _fill("node_id", ctx.col("node_id")),
        "extra": add_if_absent(F.col("extra"), keys.ingested_at, epoch_ms(now).cast("variant"), VARIANT_ENTRIES),
    })


def enrich_events(df: DataFrame, source: Value, ctx: Context, opts: CollectorOptions,
                  now: str | Column = "received_at") -> DataFrame:
    """Complete analytics events: node name, environment, ids, arrival time; only if unset."""
    keys, now = opts.keys, F.col(now) if isinstance(now, str) else now
    return df.withColumns({
        "node_name": _fill("node_name", as_column(source)),
        "environment": _fill("environment", as_column(opts.environment)),
        "correlation_id": _fill("correlation_id", ctx.col("correlation_id")),
        "operation_id": _fill("operation_id", ctx.col("operation_id")),
        "node_id": _fill("node_id", ctx.col("node_id")),
        "tenant_id": _fill("tenant_id", ctx.col("tenant_id")),
        "properties": add_if_absent(
            F.col("properties"), keys.ingested_at, epoch_ms(now).cast("variant"), VARIANT_ENTRIES),
    })


def metadata_entries(source: Value, ctx: Context, opts: CollectorOptions, now: Column) -> Column:
    keys = opts.keys
    return F.concat(
        entries([(SERVICE_NAME, as_column(source)), (keys.of("environment"), as_column(opts.environment))]),
        _context_entries(ctx, keys, ("correlation_id", "operation_id", "node_id", "tenant_id")),
        entries([(keys.ingested_at, epoch_ms(now).cast("string"))]))


def ingestion_metadata(df: DataFrame, ctx: Context, opts: CollectorOptions, source: Value = F.col,
                       now: str = "received_at") -> DataFrame:
    """Metadata map of the audit event; empty values are left out."""
    src = F.col("source_name") if source is F.col else as_column(source)
    return df.withColumn("metadata", F.map_from_entries(metadata_entries(src, ctx, opts, F.col(now))))


def fill_tenant(df: DataFrame, header: str = "header_tenant") -> DataFrame:
    """Give events without a tenant the one of the request header."""
    return df.withColumn("tenant_id", F.when(present(F.col("tenant_id")), F.col("tenant_id"))
                         .otherwise(F.col(header)))


# Fields each kind of context fills.
CONTEXT_FIELDS = {
    "operation": ("correlation_id", "operation_id", "tenant_id"),
    "grid": ("correlation_id", "node_id", "tenant_id", "environment"),
    "node": ("node_id", "environment"),
}


def with_context(df: DataFrame, ctx: Context, kind: str) -> DataFrame:
    """Fill null fields from a context; an empty string counts as set."""
    return df.withColumns({n: F.coalesce(F.col(n), ctx.col(n)) for n in CONTEXT_FIELDS[kind]})


# Span tags each kind of enrichment sets as they are, and those it sets if non-empty.
SPAN_TAGS = {
    "operation": (("correlation_id", "operation_id"), ("tenant_id",)),
    "grid": (("correlation_id", "node_id", "environment"), ("tenant_id",)),
    "grid_ids": ((), ("grid_id", "tenant_id")),
    "node": ((), ("node_id", "node_name", "node_type")),
    "user": ((), ("user_id", "session_id")),
    "environment": ((), ("environment", "version")),
}


def set_span_tags(df: DataFrame, kind: str, values: dict[str, Value], keys: TagKeys = KEYS,
                  column: str = "attributes") -> DataFrame:
    """Set context tags on spans, overwriting what is there.

    A null among the tags set "as they are" removes the tag, as a span does with null tag values.
    """
    always, filled = SPAN_TAGS[kind]
    fixed = entries([(keys.of(n), as_column(values.get(n))) for n in always], skip_empty=False)
    extra = entries([(keys.of(n), as_column(values.get(n))) for n in filled])
    merged = merge_last(entries_of(F.col(column)), fixed, extra)
    return df.withColumn(column, F.map_filter(merged, lambda k, v: v.isNotNull()))


def stamp_resource(df: DataFrame, opts: ServiceOptions, keys: TagKeys = KEYS,
                   column: str = "resource_attrs") -> DataFrame:
    """Stamp the service's own identity on its resources; the stamp wins."""
    stamp = entries([
        (SERVICE_NAME, F.lit(opts.name)), (SERVICE_NAMESPACE, as_column(opts.namespace)),
        (SERVICE_VERSION, as_column(opts.version)),
        (SERVICE_INSTANCE_ID, F.lit(opts.instance_id or platform.node())),
        (DEPLOYMENT_ENVIRONMENT, as_column(opts.environment)),
        (keys.of("environment"), as_column(opts.environment))])
    return df.withColumn(column, merge_last(entries_of(F.col(column)), stamp))


def validate_resource(df: DataFrame, column: str = "resource_attrs") -> DataFrame:
    return df.withColumn("resource_valid", valid_resource(F.col(column)))


def attribute_batches(stats: DataFrame) -> DataFrame:
    """Source, node and tenant of a batch: headers first, then the first service name."""
    tenant = F.coalesce("header_tenant", "header_tenant_alt") if "header_tenant_alt" in stats.columns \
        else F.col("header_tenant")
    return stats.withColumns({
        "source_name": F.coalesce(F.col("header_source"), F.get(F.col("service_names"), F.lit(0))),
        "source_node_id": F.col("header_node_id"),
        "batch_tenant": tenant,
    })
