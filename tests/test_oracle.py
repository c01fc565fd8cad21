"""Registered queries against their SQL. A quick selection by default, all with ``ALL_QUERIES=1``."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from beaconry.plans import registry
from check_oracle import TABLES, compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUICK = ("a3", "a5", "a6", "a11", "a12", "a13", "c2", "c5", "c13", "c15", "d1_enrich_resource", "d4", "d9", "g1", "g5",
         "p5_extract_error_logs", "p6", "r1", "r7", "r12", "r13_pack_batches", "g12", "x1", "x2")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def names():
    all_names = list(registry.load()[1])
    return all_names if os.environ.get("ALL_QUERIES") else [
        n for n in all_names if n in QUICK or n.split("_")[0] in QUICK]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, con, name):
    result = compare(spark, con, name, SF)
    assert result.startswith("ok"), result


def test_every_query_has_an_oracle():
    queries, oracle = registry.load()
    assert set(queries) - set(oracle) == {"g4_estimate_items"}


def test_every_batch_has_an_estimate(spark):
    """The size of good documents is the encoder's: held against the payloads."""
    from beaconry.constants import LOGS, METRICS, TRACES
    from beaconry.plans import fixtures as fx

    want, good = [], 0
    for signal, per in ((TRACES, 300), (METRICS, 100), (LOGS, 150)):
        for r in fx.malformed(spark, SF, signal).select("batch_id", "payload").collect():
            size = len(r.payload or b"")
            want.append((r.batch_id, signal, size and max(1, size // per)))
            good += int(r.batch_id[1:9]) % 8 == 0
    got = [(r.batch_id, r.signal, r.estimated_items) for r in entry.queries()["g4_estimate_items"](spark, SF).collect()]
    assert good > 0 and sorted(got) == sorted(want)


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["service_name", "severity_number", "errors", "with_exception"] and df.count() > 0


def test_parse_happens_once_and_nothing_shuffles(spark, tmp_path):
    """Stored payloads to error events: one parse per payload, no exchange, no Python."""
    from beaconry.constants import LOGS, TRACES
    from beaconry.plans import fixtures as fx
    from beaconry.plans.process import process_logs, process_traces
    from beaconry.sources.envelopes import read_envelopes

    path = str(tmp_path / "env")
    fx.build(spark, SF, LOGS).write.parquet(path)
    env = read_envelopes(spark, path)
    for done in (process_logs(env, json_only=True), process_traces(env, json_only=True)):
        for df in (done.deliveries(), done.audit(["log_store"]), done.stats):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("from_json(StructField") == 1
            assert "Exchange" not in plan and "Arrow" not in plan
            assert "PushedFilters: [IsNotNull(signal), EqualTo(signal," in plan


def test_formats_are_pruned_at_the_scan(spark, tmp_path, capsys):
    """Stored by format, neither decoder reads the other's payloads."""
    from beaconry.constants import LOGS
    from beaconry.operators.stats import profile_batches
    from beaconry.plans import fixtures as fx
    from beaconry.sources.envelopes import read_envelopes, store_envelopes

    path = str(tmp_path / "env")
    both = fx.build(spark, SF, LOGS).unionByName(fx.proto_envelopes(spark, SF, LOGS))
    store_envelopes(both, path)
    stats = profile_batches(read_envelopes(spark, path, partitioned=True), LOGS)
    stats.explain("formatted")
    plan = capsys.readouterr().out
    for fmt in ("json", "protobuf"):
        assert re.search(rf"PartitionFilters: \[.*source_format#\d+ = {fmt}\)", plan)
    assert "Exchange" not in plan
    rows = stats.groupBy("source_format").agg({"item_count": "sum", "max_severity": "max"}).collect()
    assert len(rows) == 2 and rows[0][1:] == rows[1][1:]
