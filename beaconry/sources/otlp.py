"""OTLP documents to flat tables.

A payload is parsed once into a ``doc`` column; ``payload`` itself never travels through an
``explode``. Flattening is a generator, so it needs no shuffle.
"""

from __future__ import annotations

from typing import Callable, Iterable, Mapping, Sequence, Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconry.constants import JSON, LOGS, METRICS, PROTOBUF, TRACES
from beaconry.functions.columns import attrs_map, body_text, nano_ts, service_name
from beaconry.functions.maps import let, nonempty, record
from beaconry.functions.reuse import reused
from beaconry.schemas import ANY_VALUE, FULL_VALUE, HEADER_COLUMNS, POINT, TREE, WHOLE_ITEM, document
from beaconry.sources.envelopes import json_branch, proto_branch
from beaconry.sources.proto import decode_documents


Format = Union[str, None]


def format_of(fmt: Format) -> Column | str:
    """A format known when the plan is built, else the row's own."""
    return F.col("source_format") if fmt is None else fmt


def parse_json(payload: Column, signal: str, item: str | None = None, resources: bool = True) -> Column:
    return F.from_json(payload.cast("string"), document(signal, item, resources))


def decode_json(envelopes: DataFrame, signal: str, item: str | None = None) -> DataFrame:
    """JSON envelopes of one signal with their parsed document.

    ``item``: struct type of what is wanted of an item, None for all of it with attribute values of every kind.
    """
    return json_branch(envelopes, signal).select(
        *[c for c in HEADER_COLUMNS if c in envelopes.columns],
        F.lit(JSON).alias("source_format"), parse_json(F.col("payload"), signal, item or WHOLE_ITEM[signal]).alias("doc"))


def decode_proto(envelopes: DataFrame, signal: str, item: str | None = None, resources: bool = True) -> DataFrame:
    """Protobuf envelopes of one signal with their parsed document (null if undecodable).

    ``item`` and ``resources`` as in ``decode_documents``.
    """
    return decode_documents(proto_branch(envelopes, signal), signal, (), item, resources)


@reused
def _items(signal: str, fmt: Format) -> Column:
    """All items of ``doc`` in one array, each with its resource, scope and position."""
    resources, scopes, items = TREE[signal]
    fmt = format_of(fmt)

    def lined(array: Column, each: Callable[[Column, Column], Column]) -> Column:
        return F.transform(F.coalesce(array, F.array()), each)

    def of_resource(r: Column, i: Column) -> Column:
        shared = record(name=service_name(r["resource"], fmt), attrs=attrs_map(r["resource"]["attributes"], fmt))
        return let(shared, lambda about: F.flatten(lined(r[scopes], lambda s, j: lined(
            s[items], lambda x, k: record(
                resource_pos=i, scope_pos=j, item_pos=k, service_name=about["name"], resource_attrs=about["attrs"],
                scope_name=s["scope"]["name"], x=x)))))

    return F.flatten(lined(F.col("doc")[resources], of_resource))


def flatten(decoded: DataFrame, signal: str, fmt: Format = None) -> DataFrame:
    """One row per item, with its batch, resource, scope and position.

    The tree is lined up inside the row and fans out in a single generator, so nested arrays are
    not copied level by level; names and attributes of a resource are worked out once for it.
    """
    keep = [c for c in decoded.columns if c != "doc"]
    return decoded.select(*keep, F.explode(_items(signal, fmt)).alias("e")).select(*keep, "e.*")


def _common(flat: DataFrame) -> list[str]:
    return [c for c in flat.columns if c != "x"]


Columns = Union[Sequence[str], None]
# Column -> field of the item; a time stamp's default is the arrival.
SPAN_COLUMNS = {
    "trace_id": "traceId", "span_id": "spanId", "parent_span_id": "parentSpanId", "name": "name", "kind": "kind",
    "start_ts": "startTimeUnixNano", "end_ts": "endTimeUnixNano", "status_code": "status", "status_message": "status",
    "attributes": "attributes", "events": "events", "links": "links",
}
LOG_COLUMNS = {
    "time_unix_nano": "timeUnixNano", "ts": "timeUnixNano", "severity_number": "severityNumber",
    "severity_text": "severityText", "body": "body", "body_value": "body", "trace_id": "traceId", "span_id": "spanId",
    "attributes": "attributes",
}


def _wanted(fields: Mapping[str, object], columns: Columns) -> list[str]:
    """The item's columns to make: those named, all of them for None. Columns of the batch are always there."""
    return [c for c in fields if columns is None or c in columns]


def narrowed(struct: str, fields: Iterable[str]) -> str:
    """The struct type with the named fields alone."""
    kept = [f for f in T.DataType.fromDDL(struct).fields if f.name in set(fields)]
    return T.StructType(kept or [T.StructField("_", T.BooleanType())]).simpleString()


def _item(signal: str, fields: Mapping[str, str], columns: Columns) -> str:
    """What must be parsed of an item for these columns."""
    return WHOLE_ITEM[signal] if columns is None else narrowed(WHOLE_ITEM[signal], [fields[c] for c in _wanted(fields, columns)])


def flatten_spans(decoded: DataFrame, fmt: Format = None, columns: Columns = None) -> DataFrame:
    flat, x = flatten(decoded, TRACES, fmt), F.col("x")
    arrival, fmt = F.col("received_at"), format_of(fmt)

    def column(name: str) -> Column:
        value = x[SPAN_COLUMNS[name]]
        if name in ("start_ts", "end_ts"):
            return nano_ts(value, arrival, fmt)
        return value[name.removeprefix("status_")] if name.startswith("status_") else value

    return flat.select(*_common(flat), *[column(c).alias(c) for c in _wanted(SPAN_COLUMNS, columns)])


def flatten_logs(decoded: DataFrame, fmt: Format = None, columns: Columns = None) -> DataFrame:
    flat, x = flatten(decoded, LOGS, fmt), F.col("x")

    def column(name: str) -> Column:
        value = x[LOG_COLUMNS[name]]
        if name == "ts":
            return nano_ts(value, F.col("received_at"), format_of(fmt))
        if name == "severity_number":
            return F.coalesce(value, F.lit(0))
        return body_text(value) if name == "body" else value

    return flat.select(*_common(flat), *[column(c).alias(c) for c in _wanted(LOG_COLUMNS, columns)])


def flatten_metrics(decoded: DataFrame, fmt: Format = None) -> DataFrame:
    flat, x = flatten(decoded, METRICS, fmt), F.col("x")
    kind = F.coalesce(*[F.when(x[f].isNotNull(), k) for f, k in METRIC_KINDS.items()])
    return flat.select(
        *_common(flat), x["name"].alias("name"), x["description"].alias("description"),
        x["unit"].alias("unit"), kind.alias("kind"), *[x[f].alias(f) for f in METRIC_KINDS])


# Metric body field -> kind label.
METRIC_KINDS = {
    "gauge": "gauge",
    "sum": "sum",
    "histogram": "histogram",
    "exponentialHistogram": "exponential_histogram",
    "summary": "summary",
}


def decode_spans(envelopes: DataFrame, columns: Columns = None) -> DataFrame:
    """JSON spans. ``columns`` names the span's columns that are wanted: what they don't need is not parsed."""
    return flatten_spans(decode_json(envelopes, TRACES, _item(TRACES, SPAN_COLUMNS, columns)), JSON, columns)


def decode_metrics(envelopes: DataFrame) -> DataFrame:
    return flatten_metrics(decode_json(envelopes, METRICS), JSON)


def decode_logs(envelopes: DataFrame, columns: Columns = None) -> DataFrame:
    """JSON log records; ``columns`` as in ``decode_spans``."""
    return flatten_logs(decode_json(envelopes, LOGS, _item(LOGS, LOG_COLUMNS, columns)), JSON, columns)


def decode_spans_proto(envelopes: DataFrame, columns: Columns = None) -> DataFrame:
    return flatten_spans(decode_proto(envelopes, TRACES, _item(TRACES, SPAN_COLUMNS, columns)), PROTOBUF, columns)


def decode_metrics_proto(envelopes: DataFrame) -> DataFrame:
    return flatten_metrics(decode_proto(envelopes, METRICS, WHOLE_ITEM[METRICS]), PROTOBUF)


def decode_logs_proto(envelopes: DataFrame, columns: Columns = None) -> DataFrame:
    return flatten_logs(decode_proto(envelopes, LOGS, _item(LOGS, LOG_COLUMNS, columns)), PROTOBUF, columns)


# Point column -> (document field, type).
POINT_COLUMNS = {
    "start_time_unix_nano": ("startTimeUnixNano", None), "time_unix_nano": ("timeUnixNano", None),
    "attributes": ("attributes", None), "as_double": ("asDouble", None), "as_int": ("asInt", "bigint"),
    "count": ("count", "decimal(20,0)"), "sum": ("sum", None), "min": ("min", None), "max": ("max", None),
    "bucket_counts": ("bucketCounts", "array<decimal(20,0)>"), "explicit_bounds": ("explicitBounds", None),
    "scale": ("scale", None), "zero_count": ("zeroCount", "decimal(20,0)"), "zero_threshold": ("zeroThreshold", None),
    "quantile_values": ("quantileValues", None), "exemplars": ("exemplars", None), "flags": ("flags", None),
}
_SIDES = ("positive", "negative")
_BUCKET_COLUMNS = {"offset": ("offset", None), "counts": ("bucketCounts", "array<decimal(20,0)>")}


def _points_item(columns: Columns) -> str:
    """Metrics whose points hold only what these columns need."""
    if columns is None:
        return WHOLE_ITEM[METRICS]
    fields = [field for name, (field, _) in POINT_COLUMNS.items() if name in columns]
    fields += [side for side in _SIDES for name in _BUCKET_COLUMNS if f"{side}_{name}" in columns]
    whole = POINT.replace(ANY_VALUE, FULL_VALUE)
    return WHOLE_ITEM[METRICS].replace(whole, narrowed(whole, fields + ["timeUnixNano"]))


def decode_points(envelopes: DataFrame, columns: Columns = None) -> DataFrame:
    """JSON data points of every kind; ``columns`` names the point's columns that are wanted, as in ``decode_spans``."""
    return metric_points(flatten_metrics(decode_json(envelopes, METRICS, _points_item(columns)), JSON), columns)


def decode_points_proto(envelopes: DataFrame, columns: Columns = None) -> DataFrame:
    return metric_points(flatten_metrics(decode_proto(envelopes, METRICS, _points_item(columns)), PROTOBUF), columns)


def metric_points(metrics: DataFrame, columns: Columns = None) -> DataFrame:
    """One row per data point of every kind, in one pass: the kinds share one point layout."""
    keep = [c for c in metrics.columns if c not in METRIC_KINDS]
    temporality = F.coalesce(*[F.col(f)["aggregationTemporality"] for f in ("sum", "histogram", "exponentialHistogram")])
    points = F.coalesce(*[F.col(f)["dataPoints"] for f in METRIC_KINDS])
    exploded = metrics.select(
        *keep, temporality.alias("temporality"), F.col("sum")["isMonotonic"].alias("monotonic"),
        F.posexplode(nonempty(points)).alias("point_pos", "p"))
    p = F.col("p")

    def value(struct: Column, field: str, kind: str | None) -> Column:
        return struct[field] if kind is None else struct[field].try_cast(kind)

    made = [value(p, *POINT_COLUMNS[name]).alias(name) for name in _wanted(POINT_COLUMNS, columns)]
    made += [value(p[side], field, kind).alias(f"{side}_{name}")
             for side in _SIDES for name, (field, kind) in _BUCKET_COLUMNS.items() if columns is None or f"{side}_{name}" in columns]
    return exploded.select(
        *keep, "temporality", "monotonic", "point_pos", *made,
        nano_ts(p["timeUnixNano"], F.col("received_at"), F.col("source_format")).alias("ts"))
