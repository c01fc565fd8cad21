"""Attribute values of every kind: lists, key-value lists, bytes.

A nested value is kept as the JSON text of its wire form, so a value of any depth has one column type. ``list_values``
and ``kvlist_values`` open one level; what they yield are values again. ``any_value`` gives the same as VARIANT.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from beaconry.functions.maps import entry, keep_last
from beaconry.schemas import FULL_VALUE


def list_values(value: Column) -> Column:
    """The members of a list value; null for another kind."""
    members = F.from_json(value["arrayValue"], f"struct<values:array<{FULL_VALUE}>>")
    return F.when(value["arrayValue"].isNotNull(), F.coalesce(members["values"], F.array().cast(f"array<{FULL_VALUE}>")))


def kvlist_values(value: Column) -> Column:
    """The members of a key-value list by key, the last duplicate wins; null for another kind."""
    kind = f"array<struct<key:string,value:{FULL_VALUE}>>"
    members = F.from_json(value["kvlistValue"], f"struct<values:{kind}>")["values"]
    named = F.transform(F.coalesce(members, F.array().cast(kind)),
                        lambda m: entry(F.coalesce(m["key"], F.lit("")), m["value"]))
    return F.when(value["kvlistValue"].isNotNull(), F.map_from_entries(keep_last(named)))


def bytes_value(value: Column) -> Column:
    """The bytes of a binary value; null for another kind or text that is not base64."""
    return F.try_to_binary(value["bytesValue"], F.lit("base64"))


def any_value(value: Column) -> Column:
    """The value as VARIANT. Nested kinds keep their wire form: ``$.values[0].stringValue``, ``$.values[0].key``."""
    return F.coalesce(
        value["stringValue"].cast("variant"), value["intValue"].try_cast("bigint").cast("variant"),
        value["boolValue"].cast("variant"), value["doubleValue"].cast("variant"),
        F.try_parse_json(F.coalesce(value["arrayValue"], value["kvlistValue"])), bytes_value(value).cast("variant"))


def attribute(attributes: Column, key: str) -> Column:
    """The value of the last attribute with this key."""
    return F.try_element_at(F.filter(attributes, lambda a: a["key"] == key), F.lit(-1))["value"]
