"""Per-batch statistics.

One envelope row is one batch, so every per-batch number is an expression over the parsed
document: a projection, with no shuffle whatever the number or size of the batches. A document
is parsed once; counts, names, maximum severity and error records all come from that parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.constants import BYTES_PER_ITEM, JSON, LOGS, METRICS, PROTOBUF, TRACES
from beaconry.functions.columns import service_name, service_names
from beaconry.functions.reuse import reused
from beaconry.operators.extract import log_errors_in, log_record, span_errors_in, span_record
from beaconry.schemas import ERROR_SIGNS, HEADER_COLUMNS, METRIC_BODIES, METRIC_SIZES, TREE
from beaconry.sources.envelopes import estimated_items, is_json_object, json_branch
from beaconry.sources.otlp import decode_proto, parse_json


def _long(n: int = 0) -> Column:
    return F.lit(n).cast("bigint")


def sum_items(doc: Column, signal: str, measure) -> Column:
    """Sum of ``measure(items array)`` over all scopes of a document."""
    resources, scopes, items = TREE[signal]
    return F.aggregate(
        F.coalesce(doc[resources], F.array()), _long(),
        lambda acc, r: acc + F.aggregate(
            F.coalesce(r[scopes], F.array()), _long(),
            lambda inner, s: inner + F.coalesce(measure(s[items]), F.lit(0)).cast("bigint")))


def item_count(doc: Column, signal: str) -> Column:
    return sum_items(doc, signal, F.array_size)


def point_count(doc: Column) -> Column:
    """Exact number of data points of a metrics document."""

    def of_metric(m: Column) -> Column:
        return F.coalesce(*[F.array_size(m[k]["dataPoints"]) for k in METRIC_BODIES], F.lit(0)).cast("bigint")

    return sum_items(doc, METRICS, lambda ms: F.aggregate(ms, _long(), lambda a, m: a + of_metric(m)))


def max_severity_of(doc: Column) -> Column:
    """Largest severity number of a logs document, 0 if none."""
    return F.aggregate(
        F.coalesce(doc["resourceLogs"], F.array()), F.lit(0),
        lambda acc, r: F.greatest(acc, F.aggregate(
            F.coalesce(r["scopeLogs"], F.array()), F.lit(0),
            lambda inner, s: F.greatest(inner, F.coalesce(
                F.array_max(F.transform(s["logRecords"], lambda x: x["severityNumber"])), F.lit(0))))))


_ERROR = {TRACES: (span_errors_in, span_record), LOGS: (log_errors_in, log_record)}


def error_count(doc: Column, signal: str, fmt: Column | str) -> Column:
    if signal not in _ERROR:
        return _long()
    test = _ERROR[signal][0]
    return sum_items(doc, signal, lambda xs: F.array_size(F.filter(xs, lambda x: test(x, fmt))))


def error_records(doc: Column, signal: str, fmt: Column | str, arrival: Column, strict: bool = False) -> Column:
    """Error records of a document in order. Only errors are built, the rest never fans out."""
    resources, scopes, items = TREE[signal]
    test, record = _ERROR[signal]

    def of_resource(r: Column) -> Column:
        return F.flatten(F.transform(
            F.coalesce(r[scopes], F.array()),
            lambda s: F.transform(
                F.filter(F.coalesce(s[items], F.array()), lambda x: test(x, fmt)),
                lambda x: record(x, service_name(r["resource"], fmt), arrival, fmt, strict))))

    return F.flatten(F.transform(F.coalesce(doc[resources], F.array()), of_resource))


#: What rating and counting need of an item; a struct has one field at least.
RATED = "struct<severityNumber:int>"
COUNTED = {TRACES: "struct<kind:int>", METRICS: METRIC_SIZES, LOGS: "struct<flags:int>"}


def _parsed(envelopes: DataFrame, signal: str, item: str | None = None, resources: bool = True) -> DataFrame:
    """JSON envelopes with document, size and text (the text only serves bad documents)."""
    keep = [c for c in HEADER_COLUMNS if c in envelopes.columns]
    return json_branch(envelopes, signal).select(
        *keep, F.lit(JSON).alias("source_format"), F.octet_length("payload").alias("payload_bytes"),
        F.col("payload"), parse_json(F.col("payload"), signal, item, resources).alias("doc"))


@reused
def _malformed(signal: str) -> Column:
    """Not a JSON object, or its resource array is not an array. Parsed again only if suspicious."""
    resources = TREE[signal][0]
    text = F.col("payload").cast("string")
    return F.when(
        F.col(f"doc.{resources}").isNull(),
        ~is_json_object(text) | F.get_json_object(text, f"$.{resources}").isNotNull()).otherwise(False)


@reused
def _json_count(signal: str) -> Column:
    """Exact count, at least one; the size estimate for malformed text; none for an empty body."""
    exact = F.greatest(_long(1), item_count(F.col("doc"), signal))
    return (F.when(F.coalesce(F.col("payload_bytes"), F.lit(0)) == 0, _long())
            .when(_malformed(signal), estimated_items(F.col("payload"), signal)).otherwise(exact))


@reused
def _proto_count(signal: str) -> Column:
    """Exact count of a document that decodes, else the size estimate; none for an empty body."""
    return F.when(F.col("doc").isNotNull(), item_count(F.col("doc"), signal)).otherwise(
        estimated_from_size(F.col("payload_bytes"), signal))


def count_items(envelopes: DataFrame, signal: str) -> DataFrame:
    """Items per batch, JSON or protobuf, from parses that step over what is in the items and resources."""
    parsed = _parsed(envelopes, signal, COUNTED[signal], False)
    return parsed.select("batch_id", _json_count(signal).alias("item_count")).unionByName(
        decode_proto(envelopes, signal, COUNTED[signal], False).select("batch_id", _proto_count(signal).alias("item_count")))


def count_spans(envelopes: DataFrame) -> DataFrame:
    return count_items(envelopes, TRACES)


def count_logs(envelopes: DataFrame) -> DataFrame:
    return count_items(envelopes, LOGS)


def count_metrics(envelopes: DataFrame) -> DataFrame:
    """Metrics per batch, the 1:1 point estimate and the exact number of points."""
    def counted(documents: DataFrame, count: Column) -> DataFrame:
        return documents.select("batch_id", count.alias("item_count"), point_count(F.col("doc")).alias("exact_points"))

    both = counted(_parsed(envelopes, METRICS, METRIC_SIZES, False), _json_count(METRICS)).unionByName(
        counted(decode_proto(envelopes, METRICS, METRIC_SIZES, False), _proto_count(METRICS)))
    return both.select("batch_id", "item_count", F.col("item_count").alias("estimated_points"), "exact_points")


def estimate_items(envelopes: DataFrame) -> DataFrame:
    """Size-based item estimate of every envelope, decoded or not."""
    return envelopes.select(
        "batch_id", "signal", estimated_items(F.col("payload"), F.col("signal")).alias("estimated_items"))


def batch_service_names(envelopes: DataFrame, signal: str) -> DataFrame:
    """Distinct service names per batch: any case, first spelling, first-seen order."""
    def named(documents: DataFrame, fmt: str) -> DataFrame:
        return documents.select("batch_id", service_names(F.col("doc"), fmt).alias("service_names"))

    return named(_parsed(envelopes, signal, COUNTED[signal]), JSON).unionByName(
        named(decode_proto(envelopes, signal, COUNTED[signal]), PROTOBUF))


def max_severity(envelopes: DataFrame) -> DataFrame:
    """Largest severity number per batch of logs, 0 if there is none or the payload can't be read."""
    documents = _parsed(envelopes, LOGS, RATED, False), decode_proto(envelopes, LOGS, RATED, False)
    one, other = (d.select("batch_id", max_severity_of(F.col("doc")).alias("max_severity")) for d in documents)
    return one.unionByName(other)


@reused
def _names(fmt: str) -> Column:
    return service_names(F.col("doc"), fmt)


@reused
def _records(signal: str, fmt: str, strict: bool) -> Column:
    return error_records(F.col("doc"), signal, fmt, F.col("received_at"), strict)


@reused
def _points() -> Column:
    return point_count(F.col("doc"))


@reused
def _severity() -> Column:
    return max_severity_of(F.col("doc"))


@reused
def _errors(signal: str, fmt: str) -> Column:
    return error_count(F.col("doc"), signal, fmt)


def _profile(decoded: DataFrame, signal: str, fmt: str, count: Column, method: Column, strict: bool,
             records: bool) -> DataFrame:
    keep = [c for c in HEADER_COLUMNS if c in decoded.columns]
    cols = [
        *keep, F.lit(signal).alias("signal"), "source_format", "payload_bytes",
        count.alias("item_count"), method.alias("count_method"),
        (count if signal == METRICS else _long()).alias("data_point_count"),
        (_points() if signal == METRICS else _long()).alias("exact_points"),
        (_severity() if signal == LOGS else F.lit(0)).alias("max_severity"),
        _names(fmt).alias("service_names"),
    ]
    if signal not in _ERROR or not records:
        return decoded.select(*cols, _errors(signal, fmt).alias("error_count"))
    out = decoded.select(*cols, _records(signal, fmt, strict).alias("errors"))
    return out.withColumn("error_count", F.coalesce(F.size("errors"), F.lit(0)).cast("bigint"))


def profiled(signal: str, records: bool) -> str | None:
    """What a profile needs of an item: everything for error records, else what tells errors apart."""
    if signal == METRICS:
        return METRIC_SIZES
    return None if records else ERROR_SIGNS[signal]


def profile_batches(envelopes: DataFrame, signal: str, strict: bool = False, exact_proto: bool = True,
                    records: bool = True) -> DataFrame:
    """One row per batch with all its statistics and, for traces and logs, its error records.

    Everything downstream (routing, audit, counters, error events) reads this narrow table, so a
    payload is parsed once however many of those are wanted. ``exact_proto=False`` keeps the
    size estimate for protobuf batches; ``records=False`` counts errors without building them.
    """
    j = profile_json(envelopes, signal, strict, records)
    decoded = decode_proto(envelopes, signal, profiled(signal, records))
    readable = F.col("doc").isNotNull() & F.lit(exact_proto)
    per = estimated_from_size(F.col("payload_bytes"), signal)
    p = _profile(decoded, signal, PROTOBUF, F.when(readable, item_count(F.col("doc"), signal)).otherwise(per),
                 F.when(readable, "exact").otherwise("estimated"), strict, records)
    return j.unionByName(p)


def profile_json(envelopes: DataFrame, signal: str, strict: bool = False, records: bool = True) -> DataFrame:
    """``profile_batches`` for input known to hold JSON only: no Python worker in the plan."""
    parsed = _parsed(envelopes, signal, profiled(signal, records))
    return _profile(parsed, signal, JSON, _json_count(signal),
                    F.when(_malformed(signal), "estimated").otherwise("exact"), strict, records)


def estimated_from_size(size: Column, signal: str) -> Column:
    return F.when(F.coalesce(size, F.lit(0)) == 0, _long()).otherwise(
        F.greatest(_long(1), F.floor(size / BYTES_PER_ITEM[signal])))


def batch_stats(profile: DataFrame) -> DataFrame:
    """The per-batch row: counts, errors, severity and names."""
    return profile.select(
        "batch_id", "signal", "item_count", "data_point_count", "error_count", "max_severity", "service_names")
