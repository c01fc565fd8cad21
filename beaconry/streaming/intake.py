"""Continuous processing: each micro-batch goes through the batch code, then to its sinks."""

from __future__ import annotations

import hashlib
import time
from functools import reduce
from typing import Any, Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from beaconry.constants import ANALYTICS, ERRORS, LOGS, METRICS, PROCESSING_ERROR_TYPES, TRACES
from beaconry.context import CollectorOptions, Context
from beaconry.operators.analytics import pack_batches
from beaconry.operators.counters import forwarded_counters, run_metrics
from beaconry.operators.errors import deliverable
from beaconry.operators.routing import SinkConfig, StoredPayloads, default_sinks, delivered_to, routed_payloads
from beaconry.plans.process import (
    Processed, process_analytics, process_errors, process_logs, process_metrics, process_traces)
from beaconry.sinks.base import Sink
from beaconry.sinks.fanout import Ledger, fan_out, failed_sinks, publish_audit
from beaconry.sinks.retry import Attempted

PROCESS = {
    TRACES: process_traces, METRICS: process_metrics, LOGS: process_logs,
    ANALYTICS: process_analytics, ERRORS: process_errors,
}


def unless_disabled(rows: DataFrame, configs: Sequence[SinkConfig], sink: str, signal: str) -> DataFrame:
    """Nothing for a sink that the configuration names but has disabled for this signal."""
    named = [c.enabled for c in configs if c.sink == sink and c.signal == signal]
    return rows if not named or any(named) else rows.filter(F.lit(False))


def sink_views(envelopes: DataFrame, done: Processed, configs: Sequence[SinkConfig],
               json_only: bool = False, payloads: str | None = None) -> Mapping[str, Callable[[str], DataFrame]]:
    """What a sink may ask for: routed payloads, error events, capture documents or batch rows.

    ``payloads``: where the routed payloads are written, once, before the first sink that takes any; without it
    each such sink decides its own from the envelopes.
    """
    stored: list[StoredPayloads] = []

    def payload(sink: str) -> DataFrame:
        if payloads is not None and not stored:
            mine = [c for c in configs if c.signal == done.signal]
            stored.append(StoredPayloads(routed_payloads(envelopes, done.signal, configs, json_only), mine, payloads))
        if stored:
            return stored[0].of(sink)
        return delivered_to(routed_payloads(envelopes, done.signal, configs, json_only), sink).drop("routes")

    return {
        "payload": payload,
        "error_events": lambda sink: unless_disabled(done.deliveries(), configs, sink, done.signal),
        "documents": lambda sink: pack_batches(unless_disabled(done.captured, configs, sink, done.signal), done.opts.pack_size, "threshold"),
        "batches": lambda sink: delivered_to(done.stats, sink),
    }


def forwarded_by(done: Processed, sinks: Sequence[Sink], outcomes: Mapping[str, Attempted], refused: DataFrame) -> DataFrame | None:
    """Errors that an error sink took, by source and tenant of their batch; None where no such sink took any.

    ``refused``: (sink, batch_id) of batches that a sink refused alone.
    """
    took = [s.name for s in sinks if s.takes == "error_events" and outcomes[s.name].ok]
    events = done.error_events
    if events is None or done.signal == ERRORS or not took:
        return None
    sent = deliverable(events).select("batch_id", "source_name", "batch_tenant")
    parts = [sent.join(refused.filter(F.col("sink") == name).select("batch_id").distinct(), "batch_id", "left_anti") for name in took]
    return forwarded_counters(reduce(DataFrame.unionByName, parts), "batch_tenant")


def run_batch(envelopes: DataFrame, signal: str, sinks: Sequence[Sink], ledger: Ledger, epoch: int,
              ctx: Context = Context(), opts: CollectorOptions = CollectorOptions(),
              configs: Sequence[SinkConfig] | None = None, audit_sink: Sink | None = None,
              table: str | None = None, metrics: str | None = None, payloads: str | None = None, **kwargs: Any) -> Processed:
    """Process one batch of envelopes, deliver it, then publish its audit events with the time that took.

    With ``table`` and ``payloads`` the statistics and the routed payloads are written once and every sink reads those.

    ``metrics`` names the table that the run's own counters go to, one folder per run, signal and epoch: items ingested, errors
    forwarded, processing time and errors by type, among them an audit transport that failed. If processing fails, that
    is counted there and raised.
    """
    began = time.monotonic()
    configs = default_sinks(opts.min_level) if configs is None else configs
    if signal in (TRACES, METRICS, LOGS):
        kwargs = {"table": table, **kwargs}
    ledger = ledger.scoped(signal=signal)
    spark = envelopes.sparkSession
    try:
        done = PROCESS[signal](envelopes, ctx, opts, configs, **kwargs)
        outcomes = fan_out(
            sink_views(envelopes, done, configs, kwargs.get("json_only", False), payloads), sinks, epoch, ledger)
        single = ledger.failed_batches(epoch)
        took = int(1000 * (time.monotonic() - began))
        audit = done.audit(failed_sinks(outcomes), F.lit(took), None if single.isEmpty() else single)
    except Exception:
        if metrics is not None:
            nothing = spark.createDataFrame([], "signal string, item_count bigint, source_name string, batch_tenant string")
            _record(run_metrics(nothing, None, {PROCESSING_ERROR_TYPES[signal]: 1}, 0, opts.duration_bounds, opts.keys), metrics, ledger, epoch)
        raise
    errors: dict[str, int] = {}
    if audit is not None and audit_sink is not None:
        failure = publish_audit(audit, audit_sink, epoch, ledger)
        if failure is not None:
            errors[failure] = 1
    if metrics is not None:
        counted = run_metrics(done.stats, forwarded_by(done, sinks, outcomes, single), errors, took, opts.duration_bounds, opts.keys)
        _record(counted, metrics, ledger, epoch)
    return done


def _record(counted: DataFrame, path: str, ledger: Ledger, epoch: int) -> None:
    """Counters are few rows; writing an epoch again replaces its own."""
    counted.coalesce(1).write.mode("overwrite").parquet(f"{path}/{ledger.scope}/epoch={epoch}")


def run_of(checkpoint: str) -> str:
    """A stream's name in ledgers and sink folders: another checkpoint is another run."""
    return hashlib.md5(checkpoint.encode()).hexdigest()[:12]


def process_stream(envelopes: DataFrame, signal: str, sinks: Sequence[Sink], ledger_path: str, checkpoint: str,
                   ctx: Context = Context(), opts: CollectorOptions = CollectorOptions(),
                   configs: Sequence[SinkConfig] | None = None, audit_sink: Sink | None = None,
                   table_root: str | None = None, trigger: Mapping[str, Any] | None = None,
                   metrics: str | None = None, payload_root: str | None = None, **kwargs: Any) -> StreamingQuery:
    """Run a signal continuously.

    ``foreachBatch`` is at least once; the ledger and per-epoch tables make a repeated epoch write
    the same rows again, not twice.
    """
    spark = envelopes.sparkSession

    def each(batch: DataFrame, epoch: int) -> None:
        ledger = Ledger(spark, ledger_path, run_of(checkpoint))
        table = f"{table_root}/epoch={epoch}" if table_root else None
        payloads = f"{payload_root}/epoch={epoch}" if payload_root else None
        run_batch(batch, signal, sinks, ledger, epoch, ctx, opts, configs, audit_sink, table, metrics, payloads, **kwargs)

    writer = envelopes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "30 seconds"})).start()


class FlushFailed(RuntimeError):
    """A flush did not reach its backend; the micro-batch stays pending in the checkpoint."""


def flush_stream(envelopes: DataFrame, sink: Sink, ledger_path: str, checkpoint: str, size: int = 100,
                 interval: str | None = "30 seconds", ctx: Context = Context(),
                 opts: CollectorOptions = CollectorOptions()) -> StreamingQuery:
    """Buffered flush of analytics events.

    What arrives within ``interval`` is pending; it leaves in documents of whole requests once
    ``size`` events have piled up, the rest at the end of the interval. A failed flush fails the
    micro-batch, so its events are read again at the next start. ``interval=None`` drains what is
    there and stops.
    """
    spark = envelopes.sparkSession

    def each(batch: DataFrame, epoch: int) -> None:
        done = process_analytics(batch, ctx, opts)
        documents = pack_batches(done.captured, size, "threshold")
        outcome = fan_out({sink.takes: lambda _n: documents}, [sink], epoch, Ledger(spark, ledger_path, run_of(checkpoint), ANALYTICS))[sink.name]
        if not outcome.ok:
            raise FlushFailed(outcome.error)

    writer = envelopes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return writer.trigger(**trigger).start()
