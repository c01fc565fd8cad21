"""Row schemas. OTLP documents use the JSON field names; 64-bit integers stay text."""

from __future__ import annotations

from beaconry.constants import LOGS, METRICS, TRACES

ENVELOPE = (
    "batch_id string, received_at timestamp, signal string, content_type string, payload binary, "
    "header_source string, header_node_id string, header_tenant string, header_tenant_alt string"
)
HEADER_COLUMNS = (
    "batch_id", "received_at", "header_source", "header_node_id", "header_tenant", "header_tenant_alt")

ANY_VALUE = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double>"
ATTRIBUTES = f"array<struct<key:string,value:{ANY_VALUE}>>"
# The value with its nested and binary kinds too: lists and key-value lists as their JSON text, bytes as base64.
FULL_VALUE = f"{ANY_VALUE[:-1]},arrayValue:string,kvlistValue:string,bytesValue:string>"
RESOURCE = f"struct<attributes:{ATTRIBUTES}>"
SCOPE = "struct<name:string,version:string>"

SPAN = (
    "struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,"
    f"startTimeUnixNano:string,endTimeUnixNano:string,attributes:{ATTRIBUTES},"
    f"events:array<struct<timeUnixNano:string,name:string,attributes:{ATTRIBUTES}>>,"
    f"links:array<struct<traceId:string,spanId:string,attributes:{ATTRIBUTES}>>,"
    "status:struct<message:string,code:int>>"
)

EXEMPLAR = (
    f"struct<filteredAttributes:{ATTRIBUTES},timeUnixNano:string,asDouble:double,asInt:string,"
    "spanId:string,traceId:string>"
)
_BUCKETS = "struct<offset:int,bucketCounts:array<string>>"
# One layout for the points of every metric kind: their field names do not clash, so a point is
# read in its final shape and kinds need no conversion into each other.
POINT = (
    f"struct<attributes:{ATTRIBUTES},startTimeUnixNano:string,timeUnixNano:string,asDouble:double,asInt:string,"
    "count:string,sum:double,min:double,max:double,bucketCounts:array<string>,explicitBounds:array<double>,"
    f"scale:int,zeroCount:string,positive:{_BUCKETS},negative:{_BUCKETS},zeroThreshold:double,"
    f"quantileValues:array<struct<quantile:double,value:double>>,exemplars:array<{EXEMPLAR}>,flags:int>"
)
METRIC = (
    "struct<name:string,description:string,unit:string,"
    f"gauge:struct<dataPoints:array<{POINT}>>,"
    f"sum:struct<dataPoints:array<{POINT}>,aggregationTemporality:int,isMonotonic:boolean>,"
    f"histogram:struct<dataPoints:array<{POINT}>,aggregationTemporality:int>,"
    f"exponentialHistogram:struct<dataPoints:array<{POINT}>,aggregationTemporality:int>,"
    f"summary:struct<dataPoints:array<{POINT}>>>"
)
METRIC_BODIES = ("gauge", "sum", "histogram", "exponentialHistogram", "summary")
# What counting needs of a metric.
METRIC_SIZES = "struct<" + ",".join(
    f"{k}:struct<dataPoints:array<struct<flags:int>>>" for k in METRIC_BODIES) + ">"
LOG_RECORD = (
    "struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,"
    f"body:{ANY_VALUE},attributes:{ATTRIBUTES},flags:int,traceId:string,spanId:string>"
)

# signal -> (resource array, scope array, item array)
TREE = {
    TRACES: ("resourceSpans", "scopeSpans", "spans"),
    METRICS: ("resourceMetrics", "scopeMetrics", "metrics"),
    LOGS: ("resourceLogs", "scopeLogs", "logRecords"),
}
ITEM = {TRACES: SPAN, METRICS: METRIC, LOGS: LOG_RECORD}
# Items with every kind of attribute value, and a log body of any kind.
WHOLE_ITEM = {s: item.replace(ANY_VALUE, FULL_VALUE) for s, item in ITEM.items()}
# What tells an error apart from other items.
ERROR_SIGNS = {
    TRACES: "struct<events:array<struct<name:string>>,status:struct<code:int>>",
    LOGS: f"struct<severityNumber:int,severityText:string,attributes:{ATTRIBUTES}>",
}


def document(signal: str, item: str | None = None, resources: bool = True) -> str:
    """Struct type of one OTLP document.

    The signal's own tree is complete; the two other resource arrays keep only their
    attributes, because service names are taken from whichever arrays are present. Without ``resources`` there is the
    signal's own tree and no resource in it.
    """
    parts = []
    for sig, (arrays, scopes, items) in TREE.items():
        scope = f"array<struct<scope:{SCOPE},{items}:array<{item or ITEM[sig]}>>>" if resources else \
            f"array<struct<{items}:array<{item or ITEM[sig]}>>>"
        own = f"resource:{RESOURCE},{scopes}:{scope}" if resources else f"{scopes}:{scope}"
        if resources or sig == signal:
            parts.append(f"{arrays}:array<struct<{own if sig == signal else f'resource:{RESOURCE}'}>>")
    return f"struct<{','.join(parts)}>"
