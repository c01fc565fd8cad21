"""Nested and binary attribute values, the same from both formats and at any depth."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from beaconry.constants import LOGS
from beaconry.functions.values import any_value, attribute, bytes_value, kvlist_values, list_values
from beaconry.plans.fixtures import as_proto
from beaconry.sources import otlp

JSON = "application/json"


def log(attributes, body=None):
    record = {"attributes": [{"key": k, "value": v} for k, v in attributes]}
    if body is not None:
        record["body"] = body
    return json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [record]}]}]})


def items(*values):
    return {"arrayValue": {"values": list(values)}}


def kv(**members):
    return {"kvlistValue": {"values": [{"key": k, "value": v} for k, v in members.items()]}}


def decoded(envelope, text, proto):
    env = envelope(("x", LOGS, text, JSON))
    return otlp.decode_logs_proto(as_proto(env, LOGS)) if proto else otlp.decode_logs(env)


both = pytest.mark.parametrize("proto", [False, True])


@both
def test_kinds(envelope, proto):
    raw = bytes(range(256))
    text = log([("l", items({"stringValue": "é\"{]"}, {"intValue": "-9223372036854775808"}, {}, {"boolValue": False})),
                ("k", kv(a={"doubleValue": 1.5}, b=items(), c=kv())), ("b", {"bytesValue": base64.b64encode(raw).decode()}),
                ("s", {"stringValue": ""}), ("none", {}), ("e", items()), ("ek", kv())], kv(z={"stringValue": "body"}))
    at = lambda key: attribute(F.col("attributes"), key)
    row = decoded(envelope, text, proto).select(
        list_values(at("l")).alias("l"), kvlist_values(at("k")).alias("k"), bytes_value(at("b")).alias("b"),
        list_values(at("e")).alias("e"), kvlist_values(at("ek")).alias("ek"),
        list_values(kvlist_values(at("k"))["b"]).alias("kb"), kvlist_values(kvlist_values(at("k"))["c"]).alias("kc"),
        F.array(*[list_values(at(k)).isNull() & bytes_value(at(k)).isNull() for k in ("s", "none", "absent", "k")]).alias("nulls"),
        F.array(*[any_value(at(k)).isNull() for k in ("s", "none", "absent")]).alias("variants"),
        F.variant_get(any_value(at("k")), "$.values[0].value.doubleValue", "double").alias("path"),
        "body", kvlist_values(F.col("body_value")).alias("body_values"), F.size("attributes").alias("n")).collect()[0]
    assert [(v.stringValue, v.intValue, v.boolValue) for v in row.l] == [
        ("é\"{]", None, None), (None, "-9223372036854775808", None), (None, None, None), (None, None, False)]
    assert row.k["a"].doubleValue == 1.5 and set(row.k) == {"a", "b", "c"} and bytes(row.b) == raw
    assert row.e == row.kb == [] and row.ek == row.kc == {}
    assert row.nulls == [True] * 4 and row.variants == [False, True, True] and row.path == 1.5
    assert row.body is None and row.body_values["z"].stringValue == "body" and row.n == 7


@both
def test_depth(envelope, proto):
    """Forty lists in each other open level by level; nothing is lost below a fixed depth."""
    value = {"stringValue": "core"}
    for _ in range(20 if proto else 40):
        value = items(value)
    df = decoded(envelope, log([("d", value)]), proto).select(attribute(F.col("attributes"), "d").alias("v"))
    for _ in range(20 if proto else 40):
        df = df.select(F.explode(list_values(F.col("v"))).alias("v"))
    assert [r.text for r in df.select(F.col("v.stringValue").alias("text")).collect()] == ["core"]


def test_long_lists_stay_whole(envelope):
    value = items(*[{"intValue": str(i)} for i in range(50_000)])
    row = decoded(envelope, log([("l", value)]), False).select(
        F.aggregate(list_values(attribute(F.col("attributes"), "l")), F.lit(0).cast("bigint"),
                    lambda a, v: a + v["intValue"].cast("bigint")).alias("s")).collect()
    assert [r.s for r in row] == [49_999 * 25_000]


def test_wrong_forms_have_no_value(envelope):
    text = log([("l", {"arrayValue": "x"}), ("b", {"bytesValue": "%%%"}), ("k", {"kvlistValue": {"values": [{"key": "a"}]}}),
                ("two", {"kvlistValue": {"values": [{"key": "a", "value": {"intValue": 1}}, {"key": "a", "value": {"intValue": 2}}]}})])
    at = lambda key: attribute(F.col("attributes"), key)
    row = decoded(envelope, text, False).select(
        list_values(at("l")).alias("l"), bytes_value(at("b")).alias("b"), kvlist_values(at("k")).alias("k"),
        kvlist_values(at("two"))["a"]["intValue"].alias("last")).collect()[0]
    assert (row.l, row.b, row.k, row["last"]) == ([], None, {"a": None}, "2")
