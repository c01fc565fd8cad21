"""What the operators of this folder share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from beaconry.plans.scratch import shared_folder, written
from beaconry.plans.shipping import ship_package

__all__ = ["KEPT", "batches", "cut", "parts", "prepare", "release", "shared_folder", "table", "texts_of"]

#: What a worker keeps for later tasks of the same kind; tasks of another kind drop it.
KEPT: dict[str, object] = {}
#: Bytes of one Arrow batch on its way to a worker; one longer row still goes whole.
BATCH_BYTES = 6 << 20


def prepare(spark: SparkSession) -> None:
    """Ship the package and, for stages that follow each other in one application, keep Arrow batches small, so memory
    in JVM and worker follows the longest text."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a written table in the shared folder; lost executors cost no recomputation."""
    return written(df)


def parts(spark: SparkSession) -> int:
    """Tasks for an exchange that has to name its number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(column: pa.Array) -> list[str]:
    """Whole texts, null as the empty text."""
    return [t or "" for t in column.to_pylist()]


def release() -> None:
    """Give what a worker has freed back to the system: workers stay for the tasks of other operators."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        ctypes.CDLL(None).malloc_trim(0)


def batches(source: Iterator[pa.RecordBatch], column: str, rows: int = 512, size: int = 2 << 20,
            keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Smaller batches: at most ``rows`` rows, and few long texts together, so memory follows the longest text.

    ``keep``: the task uses what its worker has kept.
    """
    if not keep and KEPT:
        KEPT.clear()
        release()
    for batch in source:
        at, n = 0, batch.num_rows
        if not n:
            continue
        lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0))
        ends = np.cumsum(lengths, dtype=np.int64)
        while at < n:
            base = ends[at - 1] if at else 0
            stop = int(np.searchsorted(ends, base + size, side="right"))
            stop = min(n, at + rows, max(stop, at + 1))
            yield batch.slice(at, stop - at)
            at = stop
    release()
