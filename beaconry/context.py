"""Call context and collector options, passed to operators as plain values or columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Mapping, Union

from pyspark.sql import Column
from pyspark.sql import functions as F

from beaconry.constants import KEYS, TagKeys

Value = Union[Column, str, None]


def as_column(value: Value) -> Column:
    """A column as it is, a Python string as a literal, None as a null string."""
    if isinstance(value, Column):
        return value
    return F.lit(value).cast("string")


@dataclass(frozen=True)
class Context:
    """Operation, grid and node ids in force for a batch; any field may be a column."""

    correlation_id: Value = None
    operation_id: Value = None
    node_id: Value = None
    tenant_id: Value = None
    environment: Value = None

    def col(self, name: str) -> Column:
        return as_column(getattr(self, name))


@dataclass(frozen=True)
class ServiceOptions:
    """Identity of the service whose telemetry is stamped."""

    name: str = "UnknownService"
    namespace: str | None = None
    version: str | None = None
    instance_id: str | None = None
    environment: str | None = None


@dataclass(frozen=True)
class CollectorOptions:
    """Collector-wide switches. ``now`` is the arrival time used for stamping."""

    environment: str | None = None
    keys: TagKeys = KEYS
    min_level: str = "Warning"
    excluded_properties: tuple[str, ...] = ()
    approved_properties: tuple[str, ...] = ()
    default_tags: Mapping[str, str] = field(default_factory=dict)
    pack_size: int = 100
    publish_audit: bool = True
    strict_parity: bool = False
    #: bucket bounds of the processing time, milliseconds
    duration_bounds: tuple[float, ...] = (10, 50, 100, 500, 1000, 5000, 30_000)
    #: share of error events that are delivered; 1 delivers all
    error_sample_rate: float = 1.0
