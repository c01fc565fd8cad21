"""Sinks: a name and a callable that writes a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Protocol

from pyspark.sql import DataFrame

from beaconry.sinks.retry import RetryPolicy, otlp_policy


class SinkWriter(Protocol):
    """Writes the rows meant for one sink.

    Raise to fail the whole write. To fail single batches, return a DataFrame
    ``(batch_id string, error string)`` of them; everything else counts as delivered.
    """

    def __call__(self, df: DataFrame, epoch: int) -> DataFrame | None: ...


@dataclass(frozen=True)
class Sink:
    """A named writer with its retry policy and the view of the data it wants."""

    name: str
    write: SinkWriter
    takes: str = "payload"
    policy: RetryPolicy = field(default_factory=otlp_policy)
    #: for sinks that keep runs and signals apart: the writer for a scope ``sink_run=.../sink_signal=...``
    scoped: Callable[[str], SinkWriter] | None = None


def table_sink(name: str, path: str, takes: str = "payload", fmt: str = "parquet", policy: RetryPolicy | None = None) -> Sink:
    """Write to ``path/sink_run=R/sink_signal=S/epoch=N``; replacing that folder makes a repeated epoch harmless."""

    def scoped(scope: str) -> SinkWriter:
        def write(df: DataFrame, epoch: int) -> None:
            df.write.mode("overwrite").format(fmt).save(f"{path}/{scope}/epoch={epoch}")

        return write

    return Sink(name, scoped("sink_run=main/sink_signal=any"), takes, policy or otlp_policy(), scoped)


def callable_sink(name: str, write: Callable[[DataFrame, int], DataFrame | None], takes: str = "payload",
                  policy: RetryPolicy | None = None) -> Sink:
    return Sink(name, write, takes, policy or otlp_policy())
