"""Streams whose state outlives a micro-batch."""

import json
import time

from pyspark.sql import functions as F

from beaconry.sinks.base import Sink
from beaconry.sinks.fanout import Ledger
from beaconry.sources.envelopes import stream_envelopes
from beaconry.streaming.pending import DOCUMENT, buffered_flush, send
from beaconry.streaming.redelivery import first_deliveries


def request(n, events=2):
    return (f"q{n}", "analytics", json.dumps({"events": [{"eventName": f"e{n}-{i}", "userId": "u"} for i in range(events)]}),
            "application/json")


def names(rows):
    return sorted(e["event"] for r in rows for e in json.loads(r.document)["batch"])


def until(done, seconds=120):
    end = time.monotonic() + seconds
    while not done() and time.monotonic() < end:
        time.sleep(0.2)
    assert done()


def test_pending_events_survive_a_restart(envelope, spark, tmp_path):
    """Five events wait below the size; the next run of the checkpoint sends them with what comes then."""
    sent = []

    def write(df, epoch):
        sent.extend(df.collect())

    def run(interval_ms):
        return buffered_flush(stream_envelopes(spark, f"{tmp_path}/in"), Sink("backend", write, "documents"), f"{tmp_path}/pending",
                              f"{tmp_path}/cp", size=6, interval_ms=interval_ms, shards=1, trigger="500 milliseconds")

    envelope(request(1, 5)).write.parquet(f"{tmp_path}/in")
    query = run(3_600_000)
    until(lambda: any(p["numInputRows"] for p in query.recentProgress))
    query.stop()
    assert sent == []
    envelope(request(2, 3)).write.mode("append").parquet(f"{tmp_path}/in")
    query = run(3_600_000)
    until(lambda: sent)
    query.stop()
    assert [r.event_count for r in sent] == [8] and names(sent) == sorted([f"e1-{i}" for i in range(5)] + [f"e2-{i}" for i in range(3)])


def test_timer_flushes_what_is_left(envelope, spark, tmp_path):
    sent = []
    envelope(request(1, 3)).write.parquet(f"{tmp_path}/in")
    query = buffered_flush(stream_envelopes(spark, f"{tmp_path}/in"), Sink("backend", lambda df, epoch: sent.extend(df.collect()), "documents"),
                           f"{tmp_path}/pending", f"{tmp_path}/cp", size=100, interval_ms=500, shards=1, trigger="500 milliseconds")
    until(lambda: sent)
    query.stop()
    assert [r.event_count for r in sent] == [3]


def test_refused_documents_wait_for_the_next_epoch(spark, tmp_path):
    """Document 2 is refused alone, then all are: each arrives once; a repeated epoch sends nothing again."""
    sent, calls = [], []

    def write(df, epoch):
        calls.append(epoch)
        if epoch == 1:
            raise ConnectionError("down")
        refused = df.filter(F.col("batch_id") == "0-2") if epoch == 0 else df.limit(0)
        sent.extend(r.batch_id for r in df.join(refused.select("batch_id"), "batch_id", "left_anti").collect())
        return refused.select("batch_id", F.lit("refused").alias("error"))

    from beaconry.sinks.retry import analytics_policy

    sink = Sink("backend", write, "documents", analytics_policy(0))
    ledger = Ledger(spark, f"{tmp_path}/ledger")
    docs = lambda *ns: spark.createDataFrame([(f"0-{n}", 0, n, 1, "{}") for n in ns], DOCUMENT)
    folder = f"{tmp_path}/pending"
    assert send(docs(1, 2), sink, folder, 0, ledger)
    assert send(docs(1, 2), sink, folder, 0, ledger)
    assert sent == ["0-1"] and calls == [0]
    assert not send(docs(3), sink, folder, 1, ledger)
    assert send(docs(), sink, folder, 2, ledger)
    assert sorted(sent) == ["0-1", "0-2", "0-3"]
    assert send(docs(), sink, folder, 3, ledger) and calls == [0, 1, 2]


def test_copies_within_one_micro_batch(envelope, spark, tmp_path):
    envelope(request(1), request(1), request(2)).write.parquet(f"{tmp_path}/in")
    query = (first_deliveries(stream_envelopes(spark, f"{tmp_path}/in"), "1 hour").select("batch_id").writeStream.format("parquet")
             .option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start())
    query.awaitTermination()
    assert sorted(r.batch_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["q1", "q2"]


def test_waves_are_written_by_many_tasks(spark, tmp_path):
    """A wave of envelopes is one micro-batch, but no single task writes or reads it."""
    from beaconry.plans.queries_streams import _in_turn

    seen = []
    waves = [spark.range(start, start + 100, 1, 4) for start in (0, 100)]
    _in_turn(f"{tmp_path}/in", lambda: seen.append(len(spark.read.parquet(f"{tmp_path}/in").inputFiles())), *waves)
    assert seen == [4, 8]


def test_a_stream_without_pauses_is_stopped(spark, tmp_path):
    """Micro-batches outlast the trigger, so the stream is never seen idle; it ends all the same, alive until then."""
    from beaconry.plans.queries_streams import stop_when

    epochs = []

    def slow(df, epoch):
        time.sleep(1)
        epochs.append(epoch)

    rows = spark.readStream.format("rate").option("rowsPerSecond", 100).load()
    run = rows.writeStream.foreachBatch(slow).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="100 milliseconds").start()
    began = time.monotonic()
    assert stop_when(run, lambda: len(epochs) >= 2, patience=5)
    assert not run.isActive and time.monotonic() - began < 60
