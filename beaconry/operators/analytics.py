"""Product-analytics events: identity, properties, capture documents and packing."""

from __future__ import annotations

import sys
from typing import Any, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.constants import KEYS, TagKeys
from beaconry.context import CollectorOptions
from beaconry.functions.columns import distinct_id, filter_map
from beaconry.functions.maps import VARIANT_ENTRIES, entries, entries_of, entry, merge_last, present, upsert

_JSON_TIME = {"timeZone": "UTC", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSxxx"}

# Context fields of the tag projection, and of the capture properties (no user id).
TAG_FIELDS = ("node_id", "node_name", "correlation_id", "operation_id", "grid_id", "tenant_id", "user_id",
              "session_id", "environment")
CAPTURE_FIELDS = ("correlation_id", "operation_id", "node_id", "node_name", "grid_id", "tenant_id",
                  "session_id", "environment")


def event_distinct_id() -> Column:
    key = F.concat_ws("/", F.col("batch_id"), F.col("pos").cast("string"))
    return distinct_id(F.col("distinct_id"), F.col("user_id"), F.col("session_id"), F.col("correlation_id"), key)


def _ids(fields: tuple[str, ...], keys: TagKeys) -> Column:
    es = entries([(keys.of(n), F.col(n)) for n in fields])
    return F.transform(es, lambda e: entry(e["key"], e["value"].cast("variant")))


def tag_map(keys: TagKeys = KEYS) -> Column:
    """Context ids plus the event's own properties; own properties win."""
    return merge_last(_ids(TAG_FIELDS, keys), entries_of(F.col("properties"), VARIANT_ENTRIES))


def filter_properties(df: DataFrame, excluded: tuple[str, ...] = (), approved: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumn("properties", filter_map(F.col("properties"), excluded, approved))


def capture_properties(opts: CollectorOptions = CollectorOptions()) -> Column:
    """Context ids, overwritten by the own properties that pass the property filter."""
    own = filter_map(F.col("properties"), opts.excluded_properties, opts.approved_properties)
    return merge_last(_ids(CAPTURE_FIELDS, opts.keys), entries_of(own, VARIANT_ENTRIES))


def capture_events(events: DataFrame, opts: CollectorOptions = CollectorOptions()) -> DataFrame:
    """Events as the analytics backend takes them, with their snake-case JSON."""
    carried = [c for c in ("batch_id", "pos", "received_at") if c in events.columns]
    out = events.select(
        *carried, F.col("event_name").alias("event"), event_distinct_id().alias("distinct_id"),
        F.col("ts").alias("timestamp"), capture_properties(opts).alias("properties"))
    return out.withColumn("json", F.to_json(F.struct("event", "distinct_id", "timestamp", "properties"), _JSON_TIME))


def to_analytics_request(events: DataFrame, service: str | None, max_events: int | None = None) -> DataFrame:
    """Events back to request documents; operation, node name and grid are dropped.

    One request per batch. A caller who has to bound documents gives ``max_events``: numbered parts
    by the event's position, so no group grows with the batch.
    """
    item = F.struct(
        F.col("event_name").alias("eventName"), F.col("ts").alias("timestamp"),
        F.col("distinct_id").alias("distinctId"), F.col("user_id").alias("userId"),
        F.col("session_id").alias("sessionId"), F.col("correlation_id").alias("correlationId"),
        F.col("node_id").alias("nodeId"), F.col("tenant_id").alias("tenantId"), "environment", "properties")
    texts = events.select(
        "batch_id", (F.floor(F.col("pos") / max_events) if max_events else F.lit(0).cast("bigint")).alias("part"), "pos", F.to_json(item, _JSON_TIME).alias("item"))
    grouped = texts.groupBy("batch_id", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("items"))
    listed = F.array_join(F.transform("items", lambda i: i["item"]), ",")
    source = F.to_json(F.struct(F.lit(service).cast("string").alias("sourceService")))
    tail = F.when(F.length(source) > 2, F.concat(F.lit(","), F.substring(source, F.lit(2), F.length(source)))).otherwise("}")
    return grouped.select("batch_id", "part", F.concat(F.lit('{"events":['), listed, F.lit("]"), tail).alias("request"))


def with_property(df: DataFrame, key: str, value: Column | str | None) -> DataFrame:
    """Set one property on every event, overwriting it; null is a value."""
    col = value if isinstance(value, Column) else F.lit(value).cast("string")
    return df.withColumn("properties", upsert(F.col("properties"), key, col.cast("variant"), VARIANT_ENTRIES))


def with_field(df: DataFrame, name: str, value: Column | str) -> DataFrame:
    """Set event name, distinct id or correlation id on every event."""
    return df.withColumn(name, value if isinstance(value, Column) else F.lit(value))


def batch_tenant(events: DataFrame) -> DataFrame:
    """The single tenant of a batch's events, any case, first spelling; null if none or several.

    One partial aggregate per batch: a batch has one tenant exactly when the smallest and the
    largest folded tenant agree, so no set of tenants is ever built.
    """
    usable = F.when(present(F.col("tenant_id")), F.col("tenant_id"))
    agg = events.groupBy("batch_id").agg(
        F.min(F.lower(usable)).alias("lo"), F.max(F.lower(usable)).alias("hi"),
        F.min_by(usable, F.when(usable.isNotNull(), F.col("pos"))).alias("first"))
    return agg.select("batch_id", F.when(F.col("lo") == F.col("hi"), F.col("first")).alias("batch_tenant"))


def pack_batches(captured: DataFrame, size: int, mode: str = "cap", limit: int | None = None) -> DataFrame:
    """Capture documents ``{"batch": [...]}`` with the number of events in each.

    ``cap``: at most ``size`` events of one request each. The document number comes from the
    event's position in its request, so no window sorts a whole batch in one task and no group
    exceeds ``size``.

    ``threshold``: whole requests pile up and everything pending goes out once ``size`` is met.
    Each partition keeps its own pile, as each collector process does, so nothing is shuffled. A
    request goes out whole unless the caller gives a ``limit`` for its events.
    """
    if mode == "cap":
        grouped = captured.groupBy("batch_id", F.floor(F.col("pos") / size).alias("doc_no")).agg(
            F.array_sort(F.collect_list(F.struct("pos", "json"))).alias("events"))
        joined = F.array_join(F.transform("events", lambda e: e["json"]), ",")
        return grouped.select(
            "batch_id", "doc_no", F.size("events").cast("bigint").alias("event_count"),
            F.concat(F.lit('{"batch":['), joined, F.lit("]}")).alias("document"))
    if mode != "threshold":
        raise ValueError(f"unknown packing mode: {mode}")
    schema = "batch_id string, doc_no bigint, event_count bigint, document string"
    return captured.select("batch_id", "json").mapInArrow(_threshold_packer(size, max(size, limit or sys.maxsize)), schema)


def _threshold_packer(size: int, limit: int):
    def pack(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        pending: list[str] = []
        last, number = None, 0

        def document() -> Any:
            return pa.RecordBatch.from_pydict({
                "batch_id": [last], "doc_no": [number], "event_count": [len(pending)],
                "document": ['{"batch":[' + ",".join(pending) + "]}"]})

        for batch in batches:
            for batch_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(pending) >= limit or batch_id != last and len(pending) >= size:
                    yield document()
                    pending, number = [], number + 1
                pending.append(text)
                last = batch_id
        if pending:
            yield document()

    return pack
