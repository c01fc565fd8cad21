"""Product-analytics requests and error reports: scans, field types, defaults and rejects.

A request is read as names with VARIANT values, so a field's own JSON type decides: names match in any case, of
several spellings the last one in the text counts at the top and the last in name order below it, a text field takes
a string or null, and one field of a wrong type, in any of its spellings, refuses the whole request. Names that the request does not know are
ignored. A name spelled the same twice inside an event or a map refuses the request.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.constants import ANALYTICS, ERRORS, SEVERITY_ERROR, TENANT_ID
from beaconry.functions.maps import keep_last, let, nonempty, present, record, upsert
from beaconry.functions.reuse import reused
from beaconry.sources.envelopes import JSON_SPACE, header_tenant

NO_EVENTS, INVALID_JSON, INVALID_REQUEST = "No events provided", "Invalid JSON format", "Invalid request"
VARIANT_MAP = "map<string,variant>"
STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
EVENT_TEXTS = ("eventName", "distinctId", "userId", "sessionId", "correlationId", "nodeId", "tenantId", "environment")
REQUEST_TEXTS = ("sourceService", "sourceNodeId")
REPORT_TEXTS = ("message", "stackTrace", "correlationId", "operationId", "nodeId", "userId", "tenantId", "environment")
#: A date, or a date and time with or without zone.
MOMENT = r"\A\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d{1,16})?)?(Z|[+-]\d{2}(:\d{2})?)?)?\z"


def _empty(value: str) -> Column:
    return F.map_from_entries(F.array().cast(f"array<struct<key:string,value:{value}>>"))


def _folded(fields: Column) -> Column:
    """The fields by lower-case name."""
    return F.map_from_entries(keep_last(F.transform(
        F.map_entries(fields), lambda e: record(key=F.lower(e["key"]), value=e["value"]))))


def _texts(value: Column) -> Column:
    """The value is a string, JSON null or missing."""
    return F.coalesce(F.schema_of_variant(value).isin("STRING", "VOID"), F.lit(True))


def _text_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _missing(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def _moment(value: Column) -> Column:
    """A time stamp's text as time, digits below the microsecond cut; null unless it is one in ISO form."""
    text = _text_of(value)
    return F.when(text.rlike(MOMENT), F.regexp_replace(text, r"(\.\d{6})\d+", "$1").try_cast("timestamp"))


def _typed(fields: Column, texts: tuple[str, ...], rules: dict[str, Callable[[Column], Column]]) -> Column:
    """Every field named in ``texts`` or ``rules`` has its type, in each spelling that occurs."""

    def fits(e: Column) -> Column:
        name, value = F.lower(e["key"]), e["value"]
        out = F.when(name.isin(*[n.lower() for n in texts]), _texts(value))
        for field, rule in rules.items():
            out = out.when(name == field, _missing(value) | rule(value))
        return F.coalesce(out, F.lit(True))

    return F.forall(F.map_entries(fields), fits)


def _a_moment(value: Column) -> Column:
    return _texts(value) & _moment(value).isNotNull()


def _values(value: Column) -> Column:
    return F.try_variant_get(value, "$", VARIANT_MAP)


def _an_object(value: Column) -> Column:
    return _values(value).isNotNull()


def _text_values(value: Column) -> Column:
    return F.coalesce(F.forall(F.map_values(_values(value)), _texts), F.lit(False))


def _an_int(value: Column) -> Column:
    return (F.schema_of_variant(value) == "BIGINT") & F.try_variant_get(value, "$", "int").isNotNull()


def _event(fields: Column) -> Column:
    """One event of a request; ``ok`` says whether every field has its type. The name must be there, if only as null."""

    def read(f: Column) -> Column:
        ok = f["eventname"].isNotNull() & _typed(
            fields, EVENT_TEXTS, {"timestamp": _a_moment, "properties": _an_object})
        return record(ok=F.coalesce(ok, F.lit(False)), **{n: _text_of(f[n.lower()]) for n in EVENT_TEXTS},
                      timestamp=_moment(f["timestamp"]), properties=_values(f["properties"]))

    return let(_folded(fields), read)


def _request(body: Callable[[Column, Column], Column]) -> Column:
    """``body(document, folded document)`` of the payload; both null where it holds no JSON object."""
    doc = F.from_json(F.col("payload").cast("string"), VARIANT_MAP, STRICT_JSON)
    return let(doc, lambda d: let(record(d=d, f=_folded(d)), lambda b: body(b["d"], b["f"])))


def _is_null_text() -> Column:
    return F.coalesce(F.trim(F.col("payload").cast("string"), F.lit(JSON_SPACE)) == "null", F.lit(False))


def _items(events: Column) -> Column:
    return F.try_variant_get(events, "$", f"array<{VARIANT_MAP}>")


@reused
def analytics_request() -> Column:
    """``payload`` as a request: its events and source, or ``reason`` why it is refused."""

    def read(d: Column, f: Column) -> Column:
        def judged(es: Column) -> Column:
            typed = _typed(d, REQUEST_TEXTS, {"events": lambda v: _items(v).isNotNull()}) & F.coalesce(
                F.forall(es, lambda e: e["ok"]), F.lit(True))
            reason = (F.when(d.isNull(), F.when(_is_null_text(), NO_EVENTS).otherwise(INVALID_JSON))
                      .when(~typed, INVALID_JSON).when(F.coalesce(F.size(es), F.lit(0)) <= 0, NO_EVENTS))
            return record(reason=reason, events=es, **{n: _text_of(f[n.lower()]) for n in REQUEST_TEXTS})

        return let(F.transform(_items(f["events"]), _event), judged)

    return _request(read)


@reused
def error_report() -> Column:
    """``payload`` as an error report, or ``reason`` why it is refused. The severity is a whole number; missing: Error."""

    def read(d: Column, f: Column) -> Column:
        severity, tags = F.try_variant_get(f["severity"], "$", "int"), _values(f["tags"])
        typed = _typed(d, REPORT_TEXTS, {"severity": _an_int, "tags": _text_values, "extra": _an_object})
        reason = (F.when(d.isNull(), F.when(_is_null_text(), INVALID_REQUEST).otherwise(INVALID_JSON))
                  .when(~typed, INVALID_JSON))
        return record(reason=reason, severity=F.coalesce(severity, F.lit(SEVERITY_ERROR)),
                      tags=F.transform_values(tags, lambda _k, v: _text_of(v)), extra=_values(f["extra"]),
                      **{n: _text_of(f[n.lower()]) for n in REPORT_TEXTS})

    return _request(read)


def accepted(envelopes: DataFrame, request: Column, *columns: Column | str) -> DataFrame:
    """Accepted requests as ``doc``, next to ``columns``.

    A generator, not a filter: a filter would be pushed below the parse and repeat it.
    """
    parsed = envelopes.select(*columns, request.alias("doc"))
    keep = [c for c in parsed.columns if c != "doc"]
    return parsed.select(*keep, F.explode(F.when(F.col("doc.reason").isNull(), F.array("doc"))).alias("doc"))


def classify_rejects(envelopes: DataFrame) -> DataFrame:
    """Refused requests with their reason, nothing else."""
    reason = F.when(F.col("signal") == ANALYTICS, analytics_request()["reason"]).otherwise(error_report()["reason"])
    judged = envelopes.filter(F.col("signal").isin(ANALYTICS, ERRORS)).select(
        "batch_id", "received_at", "signal", reason.alias("why"))
    return judged.select("batch_id", "received_at", "signal", F.explode(
        F.when(F.col("why").isNotNull(), F.array("why"))).alias("reason"))


def read_analytics(envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Analytics events, one row each, and the refused requests."""
    mine = envelopes.filter(F.col("signal") == ANALYTICS)
    parsed = mine.select(
        "batch_id", "received_at", "header_source", "header_node_id", header_tenant().alias("header_tenant"),
        analytics_request().alias("doc"))
    exploded = parsed.select(
        "batch_id", "received_at", "header_tenant",
        F.coalesce("doc.sourceService", "header_source").alias("source_name"),
        F.coalesce("doc.sourceNodeId", "header_node_id").alias("source_node_id"),
        F.posexplode(F.when(F.col("doc.reason").isNull(), nonempty(F.col("doc.events")))).alias("pos", "e"))
    e = F.col("e")
    missing = F.lit(None).cast("string")
    events = exploded.select(
        "batch_id", "pos", "received_at", "header_tenant", "source_name", "source_node_id",
        e["eventName"].alias("event_name"), F.coalesce(e["timestamp"], F.col("received_at")).alias("ts"),
        e["distinctId"].alias("distinct_id"), e["userId"].alias("user_id"), e["sessionId"].alias("session_id"),
        e["correlationId"].alias("correlation_id"), missing.alias("operation_id"), e["nodeId"].alias("node_id"),
        missing.alias("node_name"), missing.alias("grid_id"), e["tenantId"].alias("tenant_id"),
        e["environment"].alias("environment"),
        F.coalesce(e["properties"], _empty("variant")).alias("properties"))
    return events, classify_rejects(mine)


def read_error_reports(envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Error reports as error events, and the refused requests."""
    mine = envelopes.filter(F.col("signal") == ERRORS)
    reports = accepted(mine, error_report(), "batch_id", "received_at", "header_source",
                       header_tenant().alias("header_tenant"))
    d = F.col("doc")
    tenant = F.coalesce(d["tenantId"], F.col("header_tenant"))
    tags = F.coalesce(d["tags"], _empty("string"))
    errors = reports.select(
        "batch_id", F.lit(0).alias("pos"), F.col("header_source").alias("source_name"), "received_at",
        F.col("received_at").alias("ts"), d["message"].alias("message"), d["severity"].alias("severity"),
        d["correlationId"].alias("correlation_id"), d["operationId"].alias("operation_id"),
        d["nodeId"].alias("node_id"), d["userId"].alias("user_id"), d["environment"].alias("environment"),
        F.when(present(tenant), upsert(tags, TENANT_ID, tenant)).otherwise(tags).alias("tags"),
        F.coalesce(d["extra"], _empty("variant")).alias("extra"), d["stackTrace"].alias("stack_trace"))
    return errors, classify_rejects(mine)
