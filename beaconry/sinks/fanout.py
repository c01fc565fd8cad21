"""Fan-out to several sinks with failure isolation and a ledger of what was delivered."""

from __future__ import annotations

from typing import Callable, Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.constants import TRANSPORT_PUBLISH
from beaconry.operators.audit import publishable
from beaconry.operators.routing import DELIVERED
from beaconry.sinks.base import Sink
from beaconry.sinks.retry import Attempted, with_retry

LEDGER = "epoch bigint, sink string, ok boolean, attempts int, error string"
FAILED_BATCHES = "epoch bigint, sink string, batch_id string, error string"


class Ledger:
    """Record of outcomes by run, signal, epoch and sink, and of single batches that failed.

    Both tables are partitioned by those four: recording again replaces, a rerun of an epoch skips
    what was delivered, and looking up an epoch reads that epoch alone, however old the stream is.
    Two signals, or two streams, may share one ledger; ``scoped`` tells them apart.
    """

    def __init__(self, spark: SparkSession, path: str, run: str = "main", signal: str = "any"):
        self.spark, self.path, self.run, self.signal = spark, path, run, signal

    def scoped(self, run: str | None = None, signal: str | None = None) -> "Ledger":
        return Ledger(self.spark, self.path, run or self.run, signal or self.signal)

    @property
    def scope(self) -> str:
        return f"sink_run={self.run}/sink_signal={self.signal}"

    def _read(self, table: str, schema: str, epoch: int) -> DataFrame:
        root = f"{self.path}/{table}/{self.scope}"
        try:
            return self.spark.read.schema(schema).option("basePath", root).parquet(f"{root}/epoch={epoch}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _write(self, table: str, epoch: int, sink: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/{self.scope}/epoch={epoch}/sink={sink}")

    def outcomes(self, epoch: int) -> DataFrame:
        return self._read("outcomes", LEDGER, epoch)

    def failed_batches(self, epoch: int) -> DataFrame:
        return self._read("failed_batches", FAILED_BATCHES, epoch)

    def delivered(self, epoch: int) -> set[str]:
        """Sinks already served in an epoch: at most one row per sink."""
        return {r["sink"] for r in self.outcomes(epoch).filter("ok").select("sink").collect()}

    def record(self, epoch: int, sink: str, outcome: Attempted) -> None:
        row = [(outcome.ok, outcome.attempts, outcome.error)]
        self._write("outcomes", epoch, sink,
                    self.spark.createDataFrame(row, "ok boolean, attempts int, error string").coalesce(1))

    def record_batches(self, epoch: int, sink: str, failed: DataFrame) -> None:
        self._write("failed_batches", epoch, sink, failed.select("batch_id", "error"))


def fan_out(views: Mapping[str, Callable[[str], DataFrame]], sinks: Iterable[Sink], epoch: int,
            ledger: Ledger) -> dict[str, Attempted]:
    """Give every sink its view of the data; one sink's failure never touches another.

    ``views[takes](sink name)`` yields the rows for a sink. Writes run one after the other, each a
    distributed job; the driver only sees outcomes.
    """
    done = ledger.delivered(epoch)
    outcomes: dict[str, Attempted] = {}
    for sink in sinks:
        if sink.name in done:
            outcomes[sink.name] = Attempted(True, 0)
            continue
        writer = sink.write if sink.scoped is None else sink.scoped(ledger.scope)
        outcome = with_retry(lambda s=sink, w=writer: w(views[s.takes](s.name), epoch), sink.policy)
        if outcome.ok and isinstance(outcome.result, DataFrame):
            outcome = with_retry(
                lambda s=sink, o=outcome: ledger.record_batches(epoch, s.name, o.result), sink.policy)
        ledger.record(epoch, sink.name, outcome)
        outcomes[sink.name] = outcome
    return outcomes


def failed_sinks(outcomes: Mapping[str, Attempted]) -> list[str]:
    return [name for name, o in outcomes.items() if not o.ok]


def sink_delivery(decisions: DataFrame, ledger: Ledger, epoch: int) -> DataFrame:
    """Delivery table (``batch_id, sink, ok, attempts, error``) of one epoch.

    The ledger side has one row per sink, which bounds the broadcast; batches that failed alone
    are joined by key.
    """
    mine = decisions.filter(F.col("decision") == DELIVERED).select("batch_id", "signal", "sink")
    whole = ledger.outcomes(epoch).drop("epoch")
    single = ledger.failed_batches(epoch).select("sink", "batch_id", F.col("error").alias("batch_error"))
    return (mine.join(F.broadcast(whole), "sink").join(single, ["sink", "batch_id"], "left").select(
        "batch_id", "signal", "sink", (F.col("ok") & F.col("batch_error").isNull()).alias("ok"), "attempts",
        F.coalesce("batch_error", "error").alias("error")))


def publish_audit(audit: DataFrame, sink: Sink, epoch: int, ledger: Ledger) -> str | None:
    """Publish audit events; a failure is returned as an error type and never raised."""
    outcome = fan_out({sink.takes: lambda _n: publishable(audit)}, [sink], epoch, ledger)[sink.name]
    return None if outcome.ok else TRANSPORT_PUBLISH


def write_payloads(routed: DataFrame, path: str, sinks: Iterable[str], epoch: int = 0, run: str = "main") -> None:
    """Pass-through payloads to one table partitioned by sink, signal, run and epoch, in one job.

    Writing an epoch again replaces its own partitions; what other signals, runs and epochs wrote stays.
    """
    names = list(sinks)
    kept = routed.select(
        "batch_id", "received_at", "signal", "content_type", "payload",
        F.explode(F.filter("routes", lambda r: (r["decision"] == DELIVERED) & r["sink"].isin(*names))).alias("r"))
    keyed = kept.select("*", F.col("r.sink").alias("sink"), F.lit(run).alias("run"), F.lit(epoch).alias("epoch")).drop("r")
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "sink", "signal", "run", "epoch").parquet(path)
