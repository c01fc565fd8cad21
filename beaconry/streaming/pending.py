"""Pending analytics events that outlive a micro-batch.

Events wait in keyed state until ``size`` of them have piled up or the oldest has waited for the interval; they leave as
documents of whole requests. Documents that the backend refuses go to the front of the next flush, so an outage
neither ends the stream nor loses or doubles an event.
"""

from __future__ import annotations

from contextlib import contextmanager
from typing import Any, Iterator, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from beaconry.constants import ANALYTICS
from beaconry.context import CollectorOptions, Context
from beaconry.operators.routing import SinkConfig
from beaconry.plans.process import process_analytics
from beaconry.sinks.base import Sink
from beaconry.sinks.fanout import Ledger, fan_out
from beaconry.streaming.intake import run_of, unless_disabled

DOCUMENT = "batch_id string, shard int, doc_no bigint, event_count bigint, document string"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PendingEvents(StatefulProcessor):
    """The pile of one shard: a list of events, their number, the next document's number and whether a timer runs."""

    def __init__(self, size: int, interval_ms: int):
        self.size, self.interval_ms = size, interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "json string")
        self.meta = handle.getValueState("meta", "pending bigint, doc_no bigint, timed boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        pending, doc_no, timed = self.meta.get() or (0, 0, False)
        held = pending > 0
        new: list[str] = []
        last = None
        for batch_id, _, text in sorted((r.batch_id, r.pos, r.json) for r in rows):
            if batch_id != last and pending >= self.size:
                yield self._document(key, doc_no, self._stored(held) + new)
                pending, doc_no, held, new = 0, doc_no + 1, False, []
            new.append(text)
            pending, last = pending + 1, batch_id
        if pending >= self.size:
            yield self._document(key, doc_no, self._stored(held) + new)
            pending, doc_no, new = 0, doc_no + 1, []
        if new:
            self.events.appendList([(text,) for text in new])
        if pending and not timed:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.interval_ms)
            timed = True
        self.meta.update((pending, doc_no, timed))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        pending, doc_no, _ = self.meta.get() or (0, 0, False)
        if pending:
            yield self._document(key, doc_no, self._stored(True))
            doc_no += 1
        self.meta.update((0, doc_no, False))

    def close(self) -> None:
        pass

    def _stored(self, held: bool) -> list[str]:
        if not held:
            return []
        out = [row[0] for row in self.events.get()]
        self.events.clear()
        return out

    def _document(self, key: Any, doc_no: int, texts: list[str]) -> Row:
        return Row(batch_id=f"{key[0]}-{doc_no}", shard=key[0], doc_no=doc_no, event_count=len(texts),
                   document='{"batch":[' + ",".join(texts) + "]}")


@contextmanager
def _rocks(spark: SparkSession):
    """Streams started within keep their state in RocksDB, which arbitrary state needs."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def pending_documents(captured: DataFrame, size: int, interval_ms: int, shards: int) -> DataFrame:
    """Documents as they leave the piles. ``shards`` piles work side by side; a request stays in one."""
    keyed = captured.select(F.pmod(F.xxhash64("batch_id"), F.lit(shards)).cast("int").alias("shard"), "batch_id", "pos", "json")
    return keyed.groupBy("shard").transformWithState(
        PendingEvents(size, interval_ms), DOCUMENT, "Append", "ProcessingTime")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(DOCUMENT).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], DOCUMENT)


def send(new: DataFrame, sink: Sink, folder: str, epoch: int, ledger: Ledger) -> bool:
    """Send what was refused before and what is new; what is refused now waits in ``folder`` for the next epoch.

    A repeated epoch has the same documents; if its sink has been served already, nothing is sent again.
    """
    spark = new.sparkSession
    new.write.mode("overwrite").parquet(f"{folder}/new/epoch={epoch}")
    todo = _stored(spark, f"{folder}/refused/epoch={epoch - 1}").unionByName(_stored(spark, f"{folder}/new/epoch={epoch}"))
    if todo.isEmpty():
        return True
    outcome = fan_out({sink.takes: lambda _n: todo}, [sink], epoch, ledger)[sink.name]
    refused = todo
    if outcome.ok:
        refused = todo.join(ledger.failed_batches(epoch).select("batch_id").distinct(), "batch_id", "left_semi").select(todo.columns)
    refused.write.mode("overwrite").parquet(f"{folder}/refused/epoch={epoch}")
    return outcome.ok


def buffered_flush(envelopes: DataFrame, sink: Sink, folder: str, checkpoint: str, size: int = 100, interval_ms: int = 30_000,
                   shards: int | None = None, trigger: str | None = None, ctx: Context = Context(),
                   opts: CollectorOptions = CollectorOptions(), configs: Sequence[SinkConfig] = ()) -> StreamingQuery:
    """Flush analytics events at ``size`` pending events or after ``interval_ms``, whichever comes first.

    State grows with what is pending; a micro-batch's share of a shard is sorted in memory, so bound
    micro-batches by ``stream_envelopes(max_files=...)`` and raise ``shards`` with the rate. A refused flush is tried again at
    each trigger, in front of newer events. ``folder`` holds the ledger and the documents of each epoch.
    """
    spark = envelopes.sparkSession
    run = run_of(checkpoint)
    captured = unless_disabled(process_analytics(envelopes, ctx, opts).captured, configs, sink.name, ANALYTICS)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def each(batch: DataFrame, epoch: int) -> None:
        send(batch, sink, f"{folder}/{run}", epoch, Ledger(spark, f"{folder}/ledger", run, ANALYTICS))

    documents = pending_documents(captured, size, interval_ms, shards)
    with _rocks(spark):
        return documents.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(
            processingTime=trigger or f"{max(1, interval_ms // 2)} milliseconds").start()
