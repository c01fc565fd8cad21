"""Map rules and scalar functions, with properties checked against plain Python."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from beaconry.functions import columns as c
from beaconry.functions.maps import distinct_fold, entries_of, merge_defaults, merge_last

QUICK = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
PAIRS = st.lists(st.tuples(st.sampled_from(["a", "A", "b", "B", "c"]), st.sampled_from("xyz")), max_size=8)
SCHEMA = "i int, es array<struct<key:string,value:string>>, ds array<struct<key:string,value:string>>"


@QUICK
@given(st.lists(st.tuples(PAIRS, PAIRS), min_size=5, max_size=20))
def test_merge_rules(spark, cases):
    rows = [(i, a, b) for i, (a, b) in enumerate(cases)]
    got = spark.createDataFrame(rows, SCHEMA).select(
        "i", merge_last(F.col("es"), F.col("ds")).alias("last"),
        merge_defaults(F.col("es"), F.col("ds")).alias("fold")).collect()
    for row in got:
        existing, defaults = cases[row.i]
        assert row.last == dict(existing + defaults)
        want = {}
        for k, v in existing:
            spelled = next((x for x in want if x.lower() == k.lower()), k)
            want[spelled] = v
        for k, v in defaults:
            if k.lower() not in {x.lower() for x in want}:
                want[k] = v
        assert row.fold == want


@QUICK
@given(st.lists(st.lists(st.sampled_from(["a", "A", "b", "Bb", "bB"]), max_size=8), min_size=5, max_size=20))
def test_distinct_fold(spark, cases):
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, names array<string>").select(
        "i", distinct_fold(F.col("names")).alias("out")).collect()
    for row in rows:
        seen = {}
        for n in cases[row.i]:
            seen.setdefault(n.lower(), n)
        assert row.out == list(seen.values())


@pytest.mark.parametrize("value, text", [
    (0.0, "0"), (2.0, "2"), (12.31, "12.31"), (-0.5, "-0.5"), (12345678.9, "12345678.9"), (0.0001, "0.0001"),
    (0.00001, "1E-05"), (1e15, "1E+15"), (123456789012345.0, "123456789012345"), (1.25e20, "1.25E+20"), (1e-100, "1E-100")])
def test_double_text(spark, value, text):
    assert spark.createDataFrame([(value,)], "v double").select(c.double_text(F.col("v"))).first()[0] == text


@pytest.mark.parametrize("text, millis", [
    ("1700000000123456789", 1700000000123), ("18446744073709551615", 18446744073709), ("999999", 0), ("0", 0),
    ("", None), ("1.5e18", None), ("-5", None), (None, None)])
def test_nano_millis(spark, text, millis):
    assert spark.createDataFrame([(text,)], "v string").select(c.nano_millis(F.col("v"))).first()[0] == millis


@pytest.mark.parametrize("tenant, safe", [
    ("0" * 26, False), ("01ARZ3NDEKTSV4RRFFQ69G5FAV", True), ("01arz3ndektsv4rrffq69g5fav", True), ("tenant-acme", False),
    ("01ARZ3NDEKTSV4RRFFQ69G5FAI", False), ("01ARZ3NDEKTSV4RRFFQ69G5FAVV", False), (None, False),
    ("01ARZ3NDEKTSV4RRFFQ69G5FAV\n", False)])
def test_safe_tenant(spark, tenant, safe):
    assert spark.createDataFrame([(tenant,)], "v string").select(c.is_safe_tenant(F.col("v"))).first()[0] is safe


@pytest.mark.parametrize("ids, want", [
    (("d", "u", "s", "c"), "d"), ((None, "u", "s", "c"), "u"), (("", "", "s", "c"), "session:s"), ((None, None, None, "c"), "anon:c")])
def test_distinct_id(spark, ids, want):
    df = spark.createDataFrame([ids], "d string, u string, s string, c string")
    col = c.distinct_id(F.col("d"), F.col("u"), F.col("s"), F.col("c"), F.lit("k"))
    assert df.select(col).first()[0] == want


def test_anonymous_id_is_stable(spark):
    none = F.lit(None).cast("string")
    ids = [spark.range(1).select(c.distinct_id(none, none, none, none, F.lit("b/0"))).first()[0] for _ in range(2)]
    assert ids[0] == ids[1] and ids[0].startswith("anon:")


def test_sampling_nests_and_is_stable(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    small = {r.k for r in keys.filter(c.sampled(F.col("k"), 0.1)).collect()}
    large = {r.k for r in keys.filter(c.sampled(F.col("k"), 0.3)).collect()}
    assert small < large and 250 < len(small) < 550 and 1000 < len(large) < 1400
    assert keys.filter(c.sampled(F.col("k"), 1.0)).count() == 4000


def test_property_filter(spark):
    m = F.create_map(F.lit("Password"), F.lit("1"), F.lit("Keep"), F.lit("2"), F.lit("other"), F.lit("3"))
    row = spark.range(1).select(
        c.filter_map(m, ("PASSWORD",)).alias("deny"), c.filter_map(m, ("password",), ("keep", "password")).alias("both"),
        c.filter_map(m).alias("none")).first()
    assert row.deny == {"Keep": "2", "other": "3"} and row.both == {"Keep": "2"} and len(row.none) == 3


def test_null_map_has_no_entries(spark):
    assert spark.range(1).select(F.size(entries_of(F.lit(None).cast("map<string,string>")))).first()[0] == 0
