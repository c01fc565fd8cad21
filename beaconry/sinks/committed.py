"""A sink whose writes commit: a data source writer, for batches and streams.

Tasks write Parquet files of their own; the driver then names the files of all finished tasks in one manifest, and
``read_committed`` reads what manifests name. A task that fails, is lost or runs twice leaves at most a file that no
manifest names. A manifest is one small object under the name of its write, so writing an epoch again replaces it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from typing import Any, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage)
from pyspark.sql.types import StructType

from beaconry.sinks.base import Sink, SinkWriter
from beaconry.sinks.retry import RetryPolicy, otlp_policy

FORMAT = "committed_parquet"
MANIFESTS, FILES = "_manifests", "files"


def _file_system(path: str) -> tuple[Any, str]:
    """Arrow's file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """A finished task's file, empty if it had no rows."""

    file: str
    rows: int


class _Files:
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.write_id, self.schema = options["path"].rstrip("/"), options.get("write_id", "0"), schema

    def write(self, batches: Iterator[Any]) -> Written:
        import pyarrow.parquet as pq

        system, root = _file_system(self.path)
        name, rows, writer = f"{FILES}/{uuid.uuid4().hex}.parquet", 0, None
        for batch in batches:
            if writer is None:
                system.create_dir(f"{root}/{FILES}", recursive=True)
                writer = pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=system)
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is not None:
            writer.close()
        return Written(name if writer is not None else "", rows)

    def _commit(self, write_id: str, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None and m.file]
        text = json.dumps({"files": [m.file for m in done], "rows": sum(m.rows for m in done), "schema": self.schema.json()})
        system, root = _file_system(self.path)
        system.create_dir(f"{root}/{MANIFESTS}", recursive=True)
        target = f"{root}/{MANIFESTS}/{write_id}.json"
        # An object store shows an object once it is whole; elsewhere a whole file is moved into place.
        draft = f"{target}.{uuid.uuid4().hex}" if system.type_name in ("local", "hdfs") else target
        with system.open_output_stream(draft) as out:
            out.write(text.encode())
        if draft != target:
            system.move(draft, target)

    def _abort(self, messages: list[Written | None]) -> None:
        system, root = _file_system(self.path)
        for m in messages:
            if m is not None and m.file:
                system.delete_file(f"{root}/{m.file}")


class CommittedWriter(_Files, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._commit(self.write_id, messages)

    def abort(self, messages: list[Written | None]) -> None:
        self._abort(messages)


class CommittedStreamWriter(_Files, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self._commit(f"{self.write_id}-{batchId}", messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._abort(messages)


class CommittedParquet(DataSource):
    """Options: ``path``, and ``write_id``, the name of the write."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> CommittedWriter:
        return CommittedWriter(self.options, schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> CommittedStreamWriter:
        return CommittedStreamWriter(self.options, schema)


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all committed writes. The driver holds the names of the files, as with any listing."""
    from pyarrow import fs

    path = path.rstrip("/")
    system, root = _file_system(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True))
    manifests = []
    for info in found:
        if info.path.endswith(".json"):
            with system.open_input_stream(info.path) as text:
                manifests.append(json.loads(text.read()))
    files = [f"{path}/{name}" for m in manifests for name in m["files"]]
    if not manifests:
        raise FileNotFoundError(f"nothing is committed below {path}")
    schema = StructType.fromJson(json.loads(manifests[0]["schema"]))
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def committed_sink(name: str, path: str, takes: str = "payload", policy: RetryPolicy | None = None) -> Sink:
    """A sink that writes each run, signal and epoch under a name of its own; a retry or a rerun replaces it."""

    def scoped(scope: str) -> SinkWriter:
        def write(df: DataFrame, epoch: int) -> None:
            df.sparkSession.dataSource.register(CommittedParquet)
            write_id = f"{scope}/epoch={epoch}".replace("/", ",")
            df.write.format(FORMAT).mode("append").option("write_id", write_id).save(path)

        return write

    return Sink(name, scoped("sink_run=main/sink_signal=any"), takes, policy or otlp_policy(), scoped)
