"""Routing: which sink gets which batch, and why not.

The sink configuration is a short Python list, so it becomes a literal array on each row:
routing joins nothing, broadcasts nothing and shuffles nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.constants import ANALYTICS, ERRORS, LOGS, METRICS, TRACES
from beaconry.functions.columns import min_severity
from beaconry.functions.maps import let, nonempty, record
from beaconry.functions.reuse import reused
from beaconry.operators.stats import RATED, max_severity_of
from beaconry.schemas import HEADER_COLUMNS
from beaconry.sources.envelopes import json_branch, proto_branch
from beaconry.sources.otlp import parse_json
from beaconry.sources.proto import decode_documents

DELIVERED, SKIPPED = "delivered", "skipped"
DISABLED, NO_PAYLOAD, BELOW_LEVEL, NO_ENDPOINT = "disabled", "no payload", "below level", "endpoint missing"

PAYLOAD, ERROR_EVENTS = "payload", "error_events"


@dataclass(frozen=True)
class SinkConfig:
    """One sink's interest in one signal."""

    signal: str
    sink: str
    enabled: bool = True
    endpoint_ok: bool = True
    min_level: str | None = None
    takes: str = PAYLOAD


TRACE_STORE, METRIC_STORE, LOG_STORE = "trace_store", "metric_store", "log_store"
ALL_SIGNALS, ERROR_TRACKER, PRODUCT_ANALYTICS, AUDIT_TOPIC = (
    "all_signals", "error_tracker", "product_analytics", "audit_topic")


def all_signal_sink(enabled: bool = True, endpoint_ok: bool = True, traces: bool = True, metrics: bool = True,
                    logs: bool = True, name: str = ALL_SIGNALS) -> list[SinkConfig]:
    """Configuration rows of a sink that takes several signals, each with its own switch."""
    switches = {TRACES: traces, METRICS: metrics, LOGS: logs}
    return [SinkConfig(s, name, enabled and on, endpoint_ok) for s, on in switches.items()]


def default_sinks(log_level: str = "Warning") -> list[SinkConfig]:
    """The routing matrix with every sink on."""
    return [
        SinkConfig(TRACES, TRACE_STORE),
        SinkConfig(METRICS, METRIC_STORE),
        SinkConfig(LOGS, LOG_STORE, min_level=log_level),
        *all_signal_sink(),
        SinkConfig(TRACES, ERROR_TRACKER, takes=ERROR_EVENTS),
        SinkConfig(LOGS, ERROR_TRACKER, takes=ERROR_EVENTS),
        SinkConfig(ANALYTICS, PRODUCT_ANALYTICS),
        SinkConfig(ERRORS, ERROR_TRACKER),
    ]


def _decision(c: SinkConfig, has_payload: Column, severity: Column) -> Column:
    """Reason for leaving a batch out; null when it is delivered. Settled cases fold to literals."""
    if not c.enabled:
        return F.lit(DISABLED)
    reason = F.lit(None).cast("string") if c.endpoint_ok else F.lit(NO_ENDPOINT)
    if c.takes == PAYLOAD and c.signal not in (ANALYTICS, ERRORS):
        if c.min_level is not None:
            reason = F.when(severity < min_severity(c.min_level), BELOW_LEVEL).otherwise(reason)
        reason = F.when(~has_payload, NO_PAYLOAD).otherwise(reason)
    return reason


def decisions(sinks: Sequence[SinkConfig], signal: Column, has_payload: Column, severity: Column,
              errors: Column) -> Column:
    """Array of (sink, decision, reason) for a row. Error sinks appear only where there are errors."""

    def one(c: SinkConfig) -> Column:
        applies = signal == c.signal
        if c.takes == ERROR_EVENTS:
            applies = applies & (errors > 0)
        return let(_decision(c, has_payload, severity), lambda reason: F.when(applies, record(
            sink=F.lit(c.sink), decision=F.when(reason.isNull(), DELIVERED).otherwise(SKIPPED),
            reason=F.coalesce(reason, F.lit(DELIVERED)))))

    return F.filter(F.array(*[one(c) for c in sinks]), lambda r: r.isNotNull())


@reused
def _routes(sinks: tuple[SinkConfig, ...]) -> Column:
    return decisions(
        sinks, F.col("signal"), F.col("payload_bytes").isNotNull(), F.col("max_severity"), F.col("error_count"))


def route(stats: DataFrame, sinks: Sequence[SinkConfig]) -> DataFrame:
    """Add the ``routes`` array to batch statistics."""
    return stats.withColumn("routes", _routes(tuple(sinks)))


def route_decisions(routed: DataFrame) -> DataFrame:
    """One row per batch and sink with the decision and its reason."""
    return routed.select("batch_id", "signal", F.explode(nonempty(F.col("routes"))).alias("r")).select("batch_id", "signal", "r.*")


def delivered_to(routed: DataFrame, sink: str) -> DataFrame:
    """Rows of a routed table that one sink gets."""
    return routed.filter(F.exists("routes", lambda r: (r["sink"] == sink) & (r["decision"] == DELIVERED)))


def filter_batches_by_level(envelopes: DataFrame, level: str) -> DataFrame:
    """Log envelopes whose maximum severity reaches the level, payload untouched.

    The severity is computed from the row's own payload, so no statistics are joined in and the
    payload is never shuffled.
    """
    text = json_branch(envelopes, LOGS).withColumn(
        "doc", parse_json(F.col("payload"), LOGS, RATED, False))
    binary = decode_documents(
        proto_branch(envelopes, LOGS), LOGS, [c for c in envelopes.columns if c not in HEADER_COLUMNS], RATED, False)

    def reaching(documents: DataFrame) -> DataFrame:
        rated = documents.withColumn("severity", max_severity_of(F.col("doc")))
        # A generator instead of a filter keeps it at one parse: a filter would repeat the column below it.
        reached = F.when(F.col("severity") >= min_severity(level), F.array("severity"))
        return rated.select(*envelopes.columns, F.explode(reached).alias("max_severity"))

    return reaching(text).unionByName(reaching(binary))


def routed_payloads(envelopes: DataFrame, signal: str, sinks: Sequence[SinkConfig],
                    json_only: bool = False) -> DataFrame:
    """Envelopes with their payload and the ``routes`` of the payload sinks.

    Decided from the row itself: a payload is never joined or shuffled. It is parsed only where a
    log sink has a minimum level, and then for the severity numbers alone.
    """
    wanted = [c for c in sinks if c.signal == signal and c.takes == PAYLOAD]
    columns = ["batch_id", "received_at", "signal", "content_type", "payload"]

    def decided(df: DataFrame, severity: Column) -> DataFrame:
        return df.select(*columns, decisions(
            wanted, F.col("signal"), F.col("payload").isNotNull(), severity, F.lit(0)).alias("routes"))

    if signal != LOGS or not any(c.enabled and c.min_level for c in wanted):
        return decided(envelopes.filter(F.col("signal") == signal), F.lit(0))
    parsed = json_branch(envelopes, LOGS).withColumn(
        "doc", parse_json(F.col("payload"), LOGS, RATED, False))
    routed = decided(parsed, max_severity_of(F.col("doc")))
    if json_only:
        return routed
    binary = decode_documents(proto_branch(envelopes, LOGS), LOGS, ("signal", "content_type", "payload"), RATED, False)
    return routed.unionByName(decided(binary, max_severity_of(F.col("doc"))))


ROUTED = "batch_id string, received_at timestamp, signal string, content_type string, payload binary"


class StoredPayloads:
    """Routed payloads written once for several sinks, each payload once, below the set of sinks that take it.

    The set is the partition, so a sink's scan reads its own payloads and decides nothing again. Payloads that no sink
    takes are not written. Writing again replaces what was there.
    """

    def __init__(self, routed: DataFrame, sinks: Sequence[SinkConfig], path: str):
        self.spark, self.path = routed.sparkSession, path
        self.names = sorted({c.sink for c in sinks if c.takes == PAYLOAD})
        names = F.array(*[F.lit(n) for n in self.names])
        places = F.array_sort(F.transform(
            F.filter("routes", lambda r: r["decision"] == DELIVERED), lambda r: F.array_position(names, r["sink"])))
        marked = routed.withColumn("places", places).drop("routes")
        taken = F.array_join(F.transform("places", lambda n: n.cast("string")), ".")
        kept = marked.select(*[c for c in marked.columns if c != "places"], F.explode(
            F.when(F.size("places") > 0, F.array(taken))).alias("taken"))
        kept.write.mode("overwrite").partitionBy("taken").parquet(path)

    def of(self, sink: str) -> DataFrame:
        """What one sink gets."""
        stored = self.spark.read.schema(f"{ROUTED}, taken string").parquet(self.path)
        place = self.names.index(sink) + 1 if sink in self.names else 0
        return stored.filter(F.concat(F.lit("."), "taken", F.lit(".")).contains(f".{place}.")).drop("taken")
