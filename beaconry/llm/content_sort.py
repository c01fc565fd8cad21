"""Exact de-duplication by sorting content.

Sampled splitters range-partition the normalised texts, tasks sort theirs externally, and each row is compared in full with
its neighbour. The order is: the first ``PREFIX`` characters, the digest, the whole normalised text, then the row that stays
first. Prefix and digest are what the splitters hold, so the driver's sample stays small however long texts are, and rows
of one text follow each other in that order with the ids as last key, so a hot text is split over many tasks. Only the
first and the last run of a task can go on elsewhere; those, at most two rows a task, are merged by their full texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.llm.common import batches, cut, parts, prepare, table

SPACE = " \t\n\v\f\r"
PREFIX = 32
RUNS = "doc_id long, keep_id long, group_size long, first boolean, digest binary, n_chars long, run long, norm string"


def _starts(norm: pa.Array, last: pa.Scalar | None) -> np.ndarray:
    """Where a row's text differs from the one before; ``last`` is the text before the batch."""
    out = np.ones(len(norm), dtype=bool)
    if len(norm) > 1:
        out[1:] = pc.not_equal(norm.slice(1), norm.slice(0, len(norm) - 1)).to_numpy(zero_copy_only=False)
    if last is not None and last.equals(norm[0]):
        out[0] = False
    return out


class _Run:
    """Rows of one text met so far: numbers only."""

    def __init__(self, norm: pa.Scalar, digest: bytes):
        self.norm, self.digest = norm, digest
        self.ids: list[pa.Array] = []
        self.chars: list[pa.Array] = []

    def add(self, ids: pa.Array, chars: pa.Array) -> None:
        self.ids.append(ids)
        self.chars.append(chars)

    def rows(self, run: int | None) -> pa.RecordBatch:
        ids, chars = pa.concat_arrays(self.ids), pa.concat_arrays(self.chars)
        n = len(ids)
        first = np.zeros(n, dtype=bool)
        first[0] = True
        return _out(ids, [ids[0].as_py()] * n, [n] * n, first, [self.digest] * n, chars, [run] * n,
                    [None if run is None else self.norm.as_py()] + [None] * (n - 1))


def _out(ids, keep, size, first, digest, chars, run, norm) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(keep, pa.int64()), pa.array(size, pa.int64()), pa.array(first), pa.array(digest, pa.binary()), chars,
         pa.array(run, pa.int64()), pa.array(norm, pa.string())],
        names=["doc_id", "keep_id", "group_size", "first", "digest", "n_chars", "run", "norm"])


def runs(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted task with their run's keeper and size; the task's first and last run carry a number and their text."""
    task = TaskContext.get().partitionId()
    held: _Run | None = None
    opened = False  # the task's first run is behind us
    for b in batches(source, "norm", rows=4096, size=4 << 20):
        ids, norm, digest, chars = (b.column(c) for c in ("doc_id", "norm", "digest", "n_chars"))
        at = np.flatnonzero(_starts(norm, held.norm if held else None))
        n = len(norm)
        head = int(at[0]) if len(at) else n
        if head:
            held.add(ids.slice(0, head), chars.slice(0, head))
        if not len(at):
            continue
        if held:
            yield held.rows(None if opened else 2 * task)
            opened = True
        size = np.diff(at)
        done = int(at[-1])  # runs that start and end in this batch
        if not opened and len(size):
            first = _Run(norm[int(at[0])], digest[int(at[0])].as_py())
            first.add(ids.slice(int(at[0]), int(size[0])), chars.slice(int(at[0]), int(size[0])))
            yield first.rows(2 * task)
            opened, at, size = True, at[1:], size[1:]
        if len(size):
            lo = int(at[0])
            keep = np.repeat(at[:-1], size)
            first = np.zeros(done - lo, dtype=bool)
            first[at[:-1] - lo] = True
            yield _out(ids.slice(lo, done - lo), ids.take(pa.array(keep)), np.repeat(size, size), first,
                       digest.slice(lo, done - lo), chars.slice(lo, done - lo), pa.nulls(done - lo, pa.int64()),
                       pa.nulls(done - lo, pa.string()))
        held = _Run(norm[done], digest[done].as_py())
        held.add(ids.slice(done), chars.slice(done))
    if held:
        yield held.rows(2 * task + 1 if opened else 2 * task)


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Texts are equal when they are after white space is deleted; null counts as empty, and empty or blank texts equal each
    other. The row with the most code points in its whole text stays, then the smallest id, null ids last. Of rows that share the
    keeper's id and length just one is kept. Other columns are not read. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    norm = F.translate(text, SPACE, "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm"), F.char_length(text).cast("long").alias("n_chars"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("norm", 256)))
    stays = [F.col("n_chars").desc(), F.col("doc_id").asc_nulls_last()]
    coarse = [F.substring("norm", 1, PREFIX), F.col("digest")]
    spark = docs.sparkSession
    ranged = rows.repartitionByRange(parts(spark), *coarse, *stays).sortWithinPartitions(*coarse, F.col("norm"), *stays)
    found = cut(ranged.select("doc_id", "norm", "digest", "n_chars").mapInArrow(runs, RUNS))
    # Two rows a task: the runs that meet at task borders, merged by their full texts.
    merged = found.filter("norm IS NOT NULL").groupBy("norm").agg(
        F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"), "run")).alias("best"),
        F.sum("group_size").alias("all"), F.collect_list("run").alias("runs"))
    edges = merged.select(F.explode("runs").alias("run"), F.col("best.doc_id").alias("best_id"), F.col("best.run").alias("best_run"), "all")
    out = found.drop("norm").join(F.broadcast(edges), "run", "left")
    edge = F.col("best_run").isNotNull()
    return out.select(
        "doc_id", F.when(edge, F.col("best_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("all", "group_size").alias("group_size"),
        (F.col("first") & (~edge | (F.col("best_run") == F.col("run")))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def op13_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT *, row_number() OVER w AS n, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
      FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(body) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, n = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
