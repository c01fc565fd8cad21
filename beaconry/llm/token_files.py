"""Token-ID files: Parquet lists of ids with delta encoding, small row groups and page indexes.

A folder holds one file per shard; documents ascend by id within a file and from file to file. ``n_tokens``,
``shard`` and ``shard_start`` are columns of their own, so metadata is read without the ids, and a filter on
``doc_id`` skips files, row groups and pages by their statistics.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beaconry.llm.common import batches, parts, shared_folder, table, texts_of
from beaconry.llm.encoding import encoder

END_ID = 2
FORMAT = "doc_id long, n_tokens long, tokens array<int>, shard int, shard_start long"


def layout(row_group_bytes: int = 16 << 20, page_bytes: int = 128 << 10, page_rows: int = 2000) -> dict[str, str]:
    """Writer options: ids delta-encoded (no dictionary) in data pages of version 2, whose indexes go to the footer."""
    return {
        "parquet.writer.version": "v2", "parquet.enable.dictionary#tokens.list.element": "false",
        "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows), "compression": "zstd",
    }


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text",
                      vocabulary: str | None = None, end_id: int = END_ID, shards: int | None = None,
                      **options: int) -> None:
    """Encode every whole text and write it with the end id.

    A null or empty text has the end id only. Rows that share an id stay apart, in the order of a hash of their
    text; null ids come first. Other columns are not read. An empty table gives a folder without documents.
    The range exchange moves texts, which are smaller than their ids; a hot id spreads by the hash.
    """
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, at = encoder(vocabulary), np.array([end_id], dtype="<u4").tobytes(), 0
        shard = TaskContext.get().partitionId()
        for b in batches(source, "text", keep=True):
            ids = [x + end for x in enc.encode(texts_of(b.column("text")))]
            n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            ends = np.cumsum(n)
            tokens = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n), tokens, pa.array(np.full(len(n), shard, dtype=np.int32)),
                 pa.array(at + ends - n)], names=["doc_id", "n_tokens", "tokens", "shard", "shard_start"])
            at += int(ends[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(shards or parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    ranged.mapInArrow(run, FORMAT).write.mode("overwrite").options(**layout(**options)).parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(FORMAT).parquet(folder)


def shard_offsets(files: DataFrame) -> DataFrame:
    """(shard, offset): ids before a shard. One row per file, read from the metadata columns alone."""
    sums = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def digests(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            tokens = b.column("tokens")
            offsets = tokens.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
            crc = [zlib.crc32(raw[4 * i:4 * j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("shard"), b.column("shard_start"),
                 pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, type=pa.int64())],
                names=["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])

    out = files.select("doc_id", "shard", "shard_start", "tokens").mapInArrow(
        run, "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long")
    # one row per file of a known number of files
    return out.join(F.broadcast(shard_offsets(files)), "shard").select(
        "doc_id", (F.col("offset") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    write_token_files(table(spark, sf_dir, "documents"), folder)
    return digests(read_token_files(spark, folder))
