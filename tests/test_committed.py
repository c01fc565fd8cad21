"""Writes that commit, and payloads written once for several sinks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from beaconry.constants import LOGS
from beaconry.operators import routing
from beaconry.operators.routing import SinkConfig, StoredPayloads, routed_payloads
from beaconry.sinks.base import callable_sink
from beaconry.sinks.committed import FORMAT, CommittedParquet, committed_sink, read_committed
from beaconry.sinks.fanout import Ledger
from beaconry.streaming import intake
from beaconry.streaming.intake import run_batch

JSON = "application/json"


def files(path):
    return {f"files/{f}" for f in os.listdir(f"{path}/files")} if os.path.isdir(f"{path}/files") else set()


def named(path):
    return {f for m in os.listdir(f"{path}/_manifests") for f in json.load(open(f"{path}/_manifests/{m}"))["files"]}


def test_a_failed_write_shows_nothing(spark, tmp_path):
    path, sink = str(tmp_path / "t"), committed_sink("s", str(tmp_path / "t"))
    good = spark.range(1000).repartition(4)
    torn = good.withColumn("id", F.when(F.col("id") == 777, F.raise_error("torn").cast("bigint")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="torn"):
        sink.write(torn, 1)
    with pytest.raises(FileNotFoundError):
        read_committed(spark, path)
    for epoch in (1, 1, 2):  # the first epoch twice
        sink.write(good, epoch)
    assert sorted(r.id for r in read_committed(spark, path).collect()) == sorted([*range(1000)] * 2)
    assert named(path) <= files(path) and len(os.listdir(f"{path}/_manifests")) == 2


def test_runs_and_signals_stay_apart(spark, tmp_path):
    sink = committed_sink("s", str(tmp_path))
    for scope in ("sink_run=a/sink_signal=logs", "sink_run=a/sink_signal=traces", "sink_run=b/sink_signal=logs"):
        sink.scoped(scope)(spark.range(3), 1)
    assert read_committed(spark, str(tmp_path)).count() == 9


@pytest.mark.parametrize("where", ["{}", "file://{}"])
def test_nulls_nested_and_no_rows(spark, tmp_path, where):
    path = where.format(tmp_path)
    schema = "a string, b array<struct<x:int,y:map<string,binary>>>, ts timestamp"
    sink = committed_sink("s", path)
    sink.write(spark.createDataFrame([], schema), 1)
    assert read_committed(spark, path).collect() == []
    rows = [(None, None, None), ("", [], None), ("é", [(1, {"k": bytearray(b"\0")}), None], None)]
    sink.write(spark.createDataFrame(rows, schema), 2)
    back = read_committed(spark, path)
    assert back.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    assert sorted((r.a is None, r.a, r.b) for r in back.collect()) == sorted(
        (r.a is None, r.a, r.b) for r in spark.createDataFrame(rows, schema).collect())


def test_a_stream_commits_each_batch_once(spark, tmp_path):
    spark.dataSource.register(CommittedParquet)
    source, path = str(tmp_path / "in"), str(tmp_path / "out")

    def run(checkpoint):
        query = (spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(source).writeStream
                 .format(FORMAT).option("write_id", "s").option("checkpointLocation", str(tmp_path / checkpoint))
                 .trigger(availableNow=True).start(path))
        query.awaitTermination()

    spark.range(100).coalesce(1).write.parquet(source)
    run("one")
    spark.range(100, 200).coalesce(1).write.mode("append").parquet(source)
    run("one")  # goes on after the first file
    assert sorted(r.id for r in read_committed(spark, path).collect()) == list(range(200))
    run("two")  # the checkpoint is lost: the same batches replace themselves
    assert sorted(r.id for r in read_committed(spark, path).collect()) == list(range(200))


def log(severity):
    return json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [{"severityNumber": severity}]}]}]})


CONFIGS = [SinkConfig(LOGS, "loud", min_level="Warning"), SinkConfig(LOGS, "all"), SinkConfig(LOGS, "off", enabled=False),
           SinkConfig(LOGS, "a,b/c.1", min_level="Critical")]


def test_payloads_are_decided_and_written_once(envelope, spark, tmp_path, monkeypatch):
    calls = []
    monkeypatch.setattr(intake, "routed_payloads", lambda *a: calls.append(1) or routing.routed_payloads(*a))
    env = envelope(*[(f"b{s}", LOGS, log(s), JSON) for s in (1, 13, 21)], ("none", LOGS, None, JSON))
    got, plans = {}, []

    def sink(name):
        def write(df, epoch):
            got[name] = sorted(r.batch_id for r in df.collect())
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return callable_sink(name, write)

    run_batch(env, LOGS, [sink(c.sink) for c in CONFIGS], Ledger(spark, str(tmp_path / "l")), 1, configs=CONFIGS,
              table=str(tmp_path / "t"), payloads=str(tmp_path / "p"))
    assert got == {"loud": ["b13", "b21"], "all": ["b1", "b13", "b21"], "off": [], "a,b/c.1": ["b21"]}
    assert len(calls) == 1
    for plan in plans:
        assert "from_json" not in plan and "Arrow" not in plan and "Exchange" not in plan and "PartitionFilters: [Contains" in plan
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3  # each payload once, none that nobody takes


def test_stored_payloads_are_whole(envelope, tmp_path):
    env = envelope(*[(f"b{i}", LOGS, log(9 + 4 * (i % 3)) + " " * i, JSON) for i in range(50)])
    stored = StoredPayloads(routed_payloads(env, LOGS, CONFIGS), CONFIGS, str(tmp_path / "p"))
    assert {(r.batch_id, bytes(r.payload)) for r in stored.of("all").collect()} == {
        (r.batch_id, bytes(r.payload)) for r in env.collect()}
    assert stored.of("unknown").count() == 0
