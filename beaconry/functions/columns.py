"""Scalar functions over OTLP values, severities, tenants and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from beaconry.constants import (
    ERROR_SEVERITY_NUMBER, ERROR_SEVERITY_TEXTS, EXCEPTION_KEYS, EXCEPTION_MESSAGE, EXCEPTION_STACKTRACE,
    EXCEPTION_TYPE, INTERNAL_TENANT, JSON, LEVEL_MIN_SEVERITY, PROTOBUF, SERVICE_NAME, SEVERITY_NAMES,
    TAG_KEY_LENGTH)
from beaconry.functions.maps import distinct_fold, entry, keep_last, let, present, record


def payload_format(content_type: Column) -> Column:
    """``json`` where the content type mentions it, else ``protobuf`` (also for null)."""
    return F.when(F.lower(content_type).contains(JSON), F.lit(JSON)).otherwise(F.lit(PROTOBUF))


def double_text(value: Column) -> Column:
    """Shortest decimal text of a double, plain from 1e-4 up to 1e15, else scientific."""
    raw = value.cast("string")
    plain = F.regexp_replace(
        F.regexp_replace(value.try_cast("decimal(38,22)").cast("string"),
                         "0+$", ""), "\\.$", "")
    mantissa = F.regexp_replace(F.substring_index(raw, "E", 1), "\\.0$", "")
    exponent = F.substring_index(raw, "E", -1)
    digits = F.lpad(F.abs(exponent.try_cast("int")).cast("string"),
                    F.greatest(F.lit(2), F.length(F.regexp_replace(exponent, "-", ""))), F.lit("0"))
    scientific = F.concat(
        mantissa, F.lit("E"), F.when(exponent.startswith("-"), F.lit("-")).otherwise(F.lit("+")), digits)
    size = F.abs(value)
    return (F.when(value == 0, F.regexp_replace(raw, "\\.0$", ""))
            .when((size >= 1e-4) & (size < 1e15), plain)
            .when(raw.contains("E"), scientific)
            .otherwise(F.regexp_replace(raw, "\\.0$", "")))


def _is(fmt: Column | str, name: str) -> Column | bool:
    return fmt == name


def any_value_text(value: Column, fmt: Column | str) -> Column:
    """Text of an attribute value.

    JSON knows strings, integers and booleans; protobuf also doubles. Arrays, key-value
    lists and bytes have no text.
    """
    known = F.coalesce(value["stringValue"], value["intValue"], F.initcap(value["boolValue"].cast("string")))
    if isinstance(fmt, str):
        return known if fmt == JSON else F.coalesce(known, double_text(value["doubleValue"]))
    return F.coalesce(known, F.when(fmt == PROTOBUF, double_text(value["doubleValue"])))


def body_text(body: Column) -> Column:
    """Log body text: only a string body has one."""
    return body["stringValue"]


def hex_id(value: Column) -> Column:
    """Binary id as lower-case hex; empty becomes null."""
    return F.nullif(F.lower(F.hex(value)), F.lit(""))


def nano_millis(nanos: Column) -> Column:
    """Unix-nano decimal text as whole milliseconds; null where it is not an unsigned integer."""
    text = nanos.cast("string")
    digits = (F.length(text) > 0) & (F.length(F.translate(text, "0123456789", "")) == 0)
    millis = F.when(F.length(text) <= 6, F.lit(0).cast("bigint")).otherwise(
        F.substring(text, F.lit(1), F.greatest(F.length(text) - 6, F.lit(1))).try_cast("bigint"))
    return F.when(digits, millis)


def nano_ts(nanos: Column, default: Column, fmt: Column | str = PROTOBUF) -> Column:
    """Unix-nano to a timestamp cut to milliseconds, else ``default``.

    In protobuf zero means "not set"; in JSON an explicit zero is the epoch.
    """
    ms = nano_millis(nanos)
    if isinstance(fmt, str):
        usable = ms if fmt == JSON else F.when(nanos.cast("string") != "0", ms)
    else:
        usable = F.when((fmt == JSON) | (nanos.cast("string") != "0"), ms)
    return F.coalesce(F.timestamp_millis(usable), default)


def attribute_entries(attributes: Column, fmt: Column | str) -> Column:
    """Attribute list as text entries, those without key or value dropped."""
    es = F.transform(attributes, lambda a: entry(a["key"], any_value_text(a["value"], fmt)))
    return F.filter(es, lambda e: present(e["key"]) & present(e["value"]))


def attrs_map(attributes: Column, fmt: Column | str) -> Column:
    """Attribute list as a map, the last duplicate wins; a missing list is an empty map."""
    m = F.map_from_entries(keep_last(attribute_entries(attributes, fmt)))
    return F.coalesce(m, F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")))


def last_attribute(attributes: Column, key: str, fmt: Column | str) -> Column:
    """Text of the last attribute with this key, empty text included."""
    hit = F.try_element_at(F.filter(attributes, lambda a: a["key"] == key), F.lit(-1))
    return any_value_text(hit["value"], fmt)


def service_name(resource: Column, fmt: Column | str) -> Column:
    """``service.name`` of a resource: key in any case, first match only."""
    hit = F.get(F.filter(resource["attributes"], lambda a: F.lower(a["key"]) == SERVICE_NAME), F.lit(0))
    text, only_string = any_value_text(hit["value"], JSON), F.nullif(hit["value"]["stringValue"], F.lit(""))
    if isinstance(fmt, str):
        return text if fmt == JSON else only_string
    return F.when(fmt == JSON, text).otherwise(only_string)


def resource_names(resources: Column, fmt: Column | str) -> Column:
    """Candidate service names of a resource array, in order.

    JSON takes every non-blank string ``service.name``; protobuf the first one per resource.
    """

    def matches(r: Column) -> Column:
        hits = F.filter(F.coalesce(r["resource"]["attributes"], F.array()),
                        lambda a: F.lower(a["key"]) == SERVICE_NAME)
        usable = (lambda hs: F.filter(hs, lambda a: F.trim(a["value"]["stringValue"]) != ""))
        first = (lambda hs: F.filter(F.slice(hs, 1, 1), lambda a: a["value"]["stringValue"] != ""))
        if isinstance(fmt, str):
            kept = usable(hits) if fmt == JSON else first(hits)
        else:
            kept = F.when(fmt == JSON, usable(hits)).otherwise(first(hits))
        return F.transform(kept, lambda a: a["value"]["stringValue"])

    return F.coalesce(F.flatten(F.transform(resources, matches)), F.array().cast("array<string>"))


def service_names(document: Column, fmt: Column | str) -> Column:
    """Distinct service names of a document, any case, first spelling, first-seen order."""
    arrays = [resource_names(document[a], fmt) for a in ("resourceSpans", "resourceMetrics", "resourceLogs")]
    return distinct_fold(F.concat(*arrays))


def severity_level(number: Column) -> Column:
    """OTLP severity number to the five-level enum; text is never looked at."""
    return (F.when(number >= 21, 4).when(number >= 17, 3).when(number >= 13, 2)
            .when(number >= 9, 1).otherwise(0))


def severity_name(level: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(n) for n in SEVERITY_NAMES]), level + 1)


def min_severity(level: Column | str) -> Column:
    """Log level name to the lowest OTLP severity number it admits (unknown: 0)."""
    col = F.lit(level) if isinstance(level, str) else level
    out = F.lit(0)
    for name, number in LEVEL_MIN_SEVERITY.items():
        out = F.when(col == name, F.lit(number)).otherwise(out)
    return out


def backend_level(severity: Column) -> Column:
    """Severity enum to the error backend's level name; unknown becomes ``error``."""
    return (F.when(severity == 0, "debug").when(severity == 1, "info").when(severity == 2, "warning")
            .when(severity == 3, "error").when(severity == 4, "fatal").otherwise("error"))


def tag_key(key: Column) -> Column:
    return F.substring(key, 1, TAG_KEY_LENGTH)


def distinct_id(
    distinct: Column, user: Column, session: Column, correlation: Column, fallback: Column,
) -> Column:
    """Who an event belongs to. ``fallback`` identifies the event, so reruns agree."""
    empty = F.lit("")
    return F.coalesce(
        F.nullif(distinct, empty), F.nullif(user, empty),
        F.concat(F.lit("session:"), F.nullif(session, empty)),
        F.concat(F.lit("anon:"), F.nullif(correlation, empty)),
        F.concat(F.lit("anon:"), F.md5(fallback)))


def event_name(prefix: str, category: Column, action: Column) -> Column:
    return F.concat_ws(".", F.lit(prefix), category, action)


def source_name(prefix: str, service: Column) -> Column:
    return F.concat_ws(".", F.lit(prefix), service)


def meter_name(prefix: str, service: Column) -> Column:
    return F.concat_ws(".", F.lit(prefix), service, F.lit("Metrics"))


def first_exception(events: Column) -> Column:
    """The first span event named ``exception`` in any case, or null."""
    return F.get(F.filter(events, lambda e: F.lower(e["name"]) == "exception"), F.lit(0))


def exception_fields(events: Column, fmt: Column | str) -> Column:
    """Type, message and stack trace of the first exception event."""
    return let(first_exception(events), lambda ev: record(
        exception_type=last_attribute(ev["attributes"], EXCEPTION_TYPE, fmt),
        exception_message=last_attribute(ev["attributes"], EXCEPTION_MESSAGE, fmt),
        stack_trace=last_attribute(ev["attributes"], EXCEPTION_STACKTRACE, fmt)))


def is_error_span(status_code: Column, events: Column) -> Column:
    """Error status, or any exception event."""
    named = F.exists(events, lambda e: F.lower(e["name"]) == "exception")
    return F.coalesce(status_code == 2, F.lit(False)) | F.coalesce(named, F.lit(False))


def is_error_log(severity: Column, text: Column, attributes: Column, fmt: Column | str) -> Column:
    """Error severity or an ``exception.*`` attribute; JSON also looks at the severity text.

    In JSON an exception attribute counts only if it has a non-empty text, in protobuf always.
    """
    severe = F.coalesce(severity >= ERROR_SEVERITY_NUMBER, F.lit(False))
    by_text = F.coalesce(F.upper(text).isin(*ERROR_SEVERITY_TEXTS), F.lit(False))
    filled = F.coalesce(F.exists(attributes, lambda a: a["key"].isin(*EXCEPTION_KEYS)
                                 & present(any_value_text(a["value"], JSON))), F.lit(False))
    named = F.coalesce(F.exists(attributes, lambda a: a["key"].isin(*EXCEPTION_KEYS)), F.lit(False))
    if isinstance(fmt, str):
        return severe | by_text | filled if fmt == JSON else severe | named
    return severe | F.when(fmt == JSON, by_text | filled).otherwise(named)


def is_safe_tenant(tenant: Column) -> Column:
    """26 Crockford base-32 characters and not the all-zero internal tenant."""
    pattern = r"\A[0-9A-HJKMNP-TV-Za-hjkmnp-tv-z]{26}\z"
    return F.coalesce(tenant.rlike(pattern) & (tenant != INTERNAL_TENANT), F.lit(False))


def safe_tenant(tenant: Column) -> Column:
    return F.when(is_safe_tenant(tenant), tenant)


def filter_map(properties: Column, excluded: tuple[str, ...] = (), approved: tuple[str, ...] = ()) -> Column:
    """Drop excluded keys, then keep approved keys if any are named; case is ignored."""
    deny, allow = [k.lower() for k in excluded], [k.lower() for k in approved]
    if not deny and not allow:
        return properties

    def keep(k: Column, _v: Column) -> Column:
        ok = F.lit(True)
        if deny:
            ok = ok & ~F.lower(k).isin(*deny)
        if allow:
            ok = ok & F.lower(k).isin(*allow)
        return ok

    return F.map_filter(properties, keep)


def valid_resource(attributes: Column) -> Column:
    """A resource map is valid when non-empty and it names its service."""
    has = F.exists(F.map_keys(attributes), lambda k: k == SERVICE_NAME)
    return F.coalesce((F.size(attributes) > 0) & has, F.lit(False))


def is_deliverable(message: Column, exception: Column | None = None) -> Column:
    """An error is sent only with an exception or a non-empty message."""
    ok = F.coalesce(message != "", F.lit(False))
    return ok if exception is None else exception.isNotNull() | ok


def sampled(key: Column, rate: float) -> Column:
    """Stable sampling: the same key always gets the same answer at the same rate."""
    bucket = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")
    return bucket < F.lit(int(rate * 2**32)).cast("bigint")
