"""Map building with an explicit rule for duplicate keys.

``map_from_entries`` rejects duplicates, so every precedence rule of the library is an
ordered list of entries plus one of the two rules below.
"""

from __future__ import annotations

from typing import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTRIES = "array<struct<key:string,value:string>>"
VARIANT_ENTRIES = "array<struct<key:string,value:variant>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nonempty(array: Column) -> Column:
    """The array, or null if it has no element: the form to hand to ``explode``.

    Exploding a plain column makes the optimizer filter on the column's size first, and that
    filter moves below the projection that computes the column, which is then computed twice.
    """
    return F.when(F.size(array) > 0, array)


def record(**fields: Column) -> Column:
    """Struct with explicit names: aliases inside lambdas are not kept reliably."""
    return F.named_struct(*[part for name, value in fields.items() for part in (F.lit(name), value)])


def entry(key: Column | str, value: Column) -> Column:
    return record(key=key if isinstance(key, Column) else F.lit(key), value=value)


def present(value: Column) -> Column:
    """Neither null nor empty."""
    return value.isNotNull() & (value != "")


def entries(pairs: Mapping[str, Column] | list[tuple[str, Column]], skip_empty: bool = True) -> Column:
    """Array of entries from (key, text column) pairs, without the empty values."""
    items = list(pairs.items()) if isinstance(pairs, Mapping) else pairs
    if not items:
        return F.array().cast(ENTRIES)
    arr = F.array(*[entry(k, v) for k, v in items])
    return F.filter(arr, lambda e: present(e["value"])) if skip_empty else arr


def entries_of(map_column: Column, kind: str = ENTRIES) -> Column:
    """Entries of a map; a null map has none."""
    return F.coalesce(F.map_entries(map_column), F.array().cast(kind))


def _keys(es: Column, fold: bool) -> Column:
    return F.transform(es, lambda e: F.lower(e["key"]) if fold else e["key"])


def _bind(es: Column, fold: bool, body: Callable[[Column], Column]) -> Column:
    keyed = let(es, lambda e: record(es=e, ks=_keys(e, fold)))
    return let(keyed, body)


def _distinct(b: Column) -> Column:
    return F.size(F.array_distinct(b["ks"])) == F.size(b["ks"])


def keep_last(es: Column) -> Column:
    """Entries whose key does not occur again later. Linear unless there are duplicates."""

    def slow(b: Column) -> Column:
        tail = F.reverse(b["ks"])
        n = F.size(b["ks"])
        return F.filter(b["es"], lambda e, i: F.array_position(tail, e["key"]) == n - i)

    return _bind(es, False, lambda b: F.when(_distinct(b), b["es"]).otherwise(slow(b)))


def keep_first(es: Column, fold: bool = False) -> Column:
    """Entries whose key did not occur earlier, with or without regard to case."""

    def slow(b: Column) -> Column:
        return F.filter(
            b["es"],
            lambda e, i: F.array_position(b["ks"], F.lower(e["key"]) if fold else e["key"]) == i + 1)

    return _bind(es, fold, lambda b: F.when(_distinct(b), b["es"]).otherwise(slow(b)))


def _fold_existing(es: Column) -> Column:
    """Case-insensitive dictionary load: first spelling of the key, last value."""

    def slow(b: Column) -> Column:
        tail = F.reverse(F.transform(b["es"], lambda e: record(ks=F.lower(e["key"]), es=e)))
        kept = F.filter(b["es"], lambda e, i: F.array_position(b["ks"], F.lower(e["key"])) == i + 1)
        return F.transform(
            kept,
            lambda e: entry(
                e["key"],
                F.get(F.filter(tail, lambda t: t["ks"] == F.lower(e["key"])), F.lit(0))["es"]["value"]))

    return _bind(es, True, lambda b: F.when(_distinct(b), b["es"]).otherwise(slow(b)))


def merge_last(*parts: Column) -> Column:
    """Map in which later parts overwrite earlier ones (keys compared exactly)."""
    es = parts[0] if len(parts) == 1 else F.concat(*parts)
    return F.map_from_entries(keep_last(es))


def merge_defaults(existing: Column, *defaults: Column, fold: bool = True) -> Column:
    """Map in which defaults are added only where their key is absent."""
    base = _fold_existing(existing) if fold else existing
    return F.map_from_entries(keep_first(F.concat(base, *defaults), fold))


def upsert(map_column: Column, key: str, value: Column, kind: str = ENTRIES) -> Column:
    """Set one key, overwriting it; a null value is stored as null."""
    rest = F.filter(entries_of(map_column, kind), lambda e: e["key"] != key)
    return F.map_from_entries(F.concat(rest, F.array(entry(key, value))))


def add_if_absent(map_column: Column, key: str, value: Column, kind: str = ENTRIES) -> Column:
    """Set one key unless the map already holds it."""
    return F.map_from_entries(keep_first(F.concat(entries_of(map_column, kind), F.array(entry(key, value)))))


def distinct_fold(names: Column) -> Column:
    """Distinct texts regardless of case: first spelling, first-seen order, nulls dropped."""

    def body(b: Column) -> Column:
        return F.filter(b["es"], lambda n, i: F.array_position(b["ks"], F.lower(n)) == i + 1)

    clean = F.filter(names, lambda n: n.isNotNull())
    keyed = let(clean, lambda e: record(es=e, ks=F.transform(e, F.lower)))
    return let(keyed, body)
