"""Exact top-k inner products: candidates by descending length, rotated partial sums, Cauchy-Schwarz bounds.

The best scores among the longest candidates give every query a first threshold. Blocks of queries meet blocks of
candidates in tasks; a query goes only to blocks whose longest vector can reach its threshold. Within a task the
first components after a rotation, plus the product of the lengths of the rest, bound a score from above, and only
pairs whose bound reaches the threshold get their exact integer score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beaconry.llm.common import cut, table
from beaconry.llm.vectors import matrices, raw, sampled, stack

TOP, SCALE, EVERY = 5, 256, 50
#: Longest candidates that every query sees first; vectors the rotation is fitted on; rows of a block.
HEADS, SAMPLE, CANDIDATES, QUERIES = 2_048, 10_000, 8_192, 2_048
CHUNK = 1_024
RESULT = "query_id long, rank int, vec_id long, score long"


def _integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, d, norm, v): the integer components of the vectors that take part, as doubles."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for rows, x in matrices(b.column("v")):
                x = np.floor(scale * x)
                rows, x = rows[keep := np.isfinite(x).all(axis=1)], x[keep]
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id").take(pa.array(rows)), pa.array(np.full(len(rows), x.shape[1], dtype=np.int32)),
                     pa.array(np.linalg.norm(x, axis=1)), pa.array(raw(x), pa.binary())], names=["vec_id", "d", "norm", "v"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.filter("vec_id is not null").mapInArrow(run, "vec_id long, d int, norm double, v binary")


def padded(rows: list[bytes], d: int) -> np.ndarray:
    """A matrix of ``d`` columns; a shorter vector's missing components are 0."""
    out = np.zeros((len(rows), d))
    for i, r in enumerate(rows):
        x = np.frombuffer(r, dtype=np.float64)
        out[i, :len(x)] = x
    return out


def one_per_id(ids: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Places by descending length, then id; of rows sharing an id the longest."""
    order = np.lexsort((ids, -norm))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)]


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of (query, id, score) triples the ``k`` best of every query, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    return query[keep], ids[keep], score[keep]


def search(q: np.ndarray, q_ids: np.ndarray, least: np.ndarray, c: np.ndarray, c_ids: np.ndarray, rotation: np.ndarray, k: int,
           chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score) of each query's ``k`` best of these candidates that reach ``least``.

    Candidates come by descending length. ``least`` is lowered to nothing: it only rises as better ones are found.
    """
    h = max(1, q.shape[1] // 4)
    qr, cr = q @ rotation, c @ rotation
    q_len, c_len = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    q_tail, c_tail = np.linalg.norm(qr[:, h:], axis=1), np.linalg.norm(cr[:, h:], axis=1)
    slack = lambda bound, size: bound + 1e-9 * size + 1e-6  # noqa: E731  rounding of the bounds
    least = least.copy()
    found = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
    for a in range(0, len(c), chunk):
        b = slice(a, a + chunk)
        size = q_len * c_len[a]
        active = np.flatnonzero(slack(size, size) >= least)
        if not len(active):
            break
        bound = qr[active, :h] @ cr[b, :h].T + q_tail[active, None] * c_tail[None, b]
        row, col = np.nonzero(slack(bound, size[active, None]) >= least[active, None])
        if len(row) > bound.size // 8:
            scores = q[active] @ c[b].T
            row, col = np.nonzero(scores >= least[active, None])
            score = scores[row, col]
        else:
            score = np.empty(len(row))
            for s in range(0, len(row), 1 << 16):
                t = slice(s, s + (1 << 16))
                score[t] = np.einsum("ij,ij->i", q[active[row[t]]], c[a + col[t]])
        row = active[row]
        keep = (score >= least[row]) & (q_ids[row] != c_ids[a + col])
        row, col, score = row[keep], col[keep], score[keep]
        found = best(*(np.concatenate(x) for x in zip(found, (row, c_ids[a + col], score))), k)
        full = np.bincount(found[0], minlength=len(q)) == k
        lowest = np.full(len(q), np.inf)
        np.minimum.at(lowest, found[0], found[2])
        least[full] = np.maximum(least[full], lowest[full])
    return found


def top_products(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = TOP,
                 scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the ``k`` largest inner products with the other rows.

    Components are floor(scale * x). Vectors that are null or hold null or non-finite components, and rows without an
    id, take no part; a missing component of a shorter vector is 0. Rows sharing an id are one, with the longest of
    their vectors; a query isn't its own candidate. Ties go to the smaller id; with fewer than ``k`` candidates all
    come. Other columns are not read; an empty table gives no rows. Scores are exact while they stay below 2**53.

    ``is_query``: a condition on ``vec_id``. The thresholds need the HEADS longest vectors, the rotation a bounded
    sample, and both are broadcast; queries and candidates meet in blocks of bounded size.
    """
    spark = vectors.sparkSession
    rows = cut(_integers(vectors, id_col, vec_col, scale))
    stats = rows.agg(F.count("*"), F.max("d"), F.sum(is_query.cast("long"))).first()
    n, d, n_queries = stats[0], max(1, stats[1] or 0), stats[2] or 0
    if not n or not n_queries:
        return spark.createDataFrame([], RESULT)
    sample = padded([r[0] for r in rows.orderBy(sampled(F.col("vec_id")), "vec_id").limit(SAMPLE).select("v").collect()], d)
    rotation = np.linalg.eigh(sample.T @ sample)[1][:, ::-1].copy()
    top = rows.orderBy(F.desc("norm"), "vec_id").limit(HEADS).select("vec_id", "v", "norm").collect()
    place = one_per_id(np.array([r[0] for r in top]), np.array([r[2] for r in top]))
    heads = (padded([top[i][1] for i in place], d), np.array([top[i][0] for i in place]))

    # candidates in blocks by descending length; the hash splits equal lengths
    blocks = math.ceil(n / CANDIDATES)

    def number(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        for b in source:
            yield b.append_column("block", pa.array(np.full(b.num_rows, block, dtype=np.int32)))

    ranged = rows.repartitionByRange(blocks, F.desc("norm"), F.xxhash64("vec_id"))
    candidates = cut(ranged.mapInArrow(number, "vec_id long, d int, norm double, v binary, block int"))
    longest = {r[0]: r[1] for r in candidates.groupBy("block").agg(F.max("norm")).collect()}  # one row per block
    q_blocks = math.ceil(n_queries / QUERIES)
    shared = spark.sparkContext.broadcast((heads, rotation, longest))

    def open_(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (c, c_ids), turn, longest = shared.value
        blocks = sorted(longest)
        reach = np.array([longest[b] for b in blocks])
        for b in source:
            q, ids = padded(b.column("v").to_pylist(), d), b.column("vec_id").to_numpy()
            least = np.full(len(q), -np.inf)
            row, _, score = search(q, ids, least, c, c_ids, turn, k)
            full = np.flatnonzero(np.bincount(row, minlength=len(q)) == k)
            low = np.full(len(q), np.inf)
            np.minimum.at(low, row, score)
            least[full] = low[full]
            size = b.column("norm").to_numpy()[:, None] * reach[None, :]
            row, col = np.nonzero(size * (1 + 1e-9) + 1e-6 >= least[:, None])
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(at), b.column("v").take(at), pa.array(np.array(blocks, dtype=np.int32)[col]), pa.array(least[row])],
                names=["vec_id", "v", "block", "least"])

    q_block = F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int").alias("q_block")
    queries = rows.filter(is_query).mapInArrow(open_, "vec_id long, v binary, block int, least double").select("*", q_block)
    each = candidates.select("vec_id", "v", "block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q_block"))

    def meet(key: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
        turn = shared.value[1]
        q_ids, c_ids = q.column("vec_id").to_numpy(), c.column("vec_id").to_numpy()
        qm, cm = padded(q.column("v").to_pylist(), d), padded(c.column("v").to_pylist(), d)
        qp = one_per_id(q_ids, np.linalg.norm(qm, axis=1))
        cp = one_per_id(c_ids, np.linalg.norm(cm, axis=1))
        row, ids, score = search(qm[qp], q_ids[qp], q.column("least").to_numpy()[qp], cm[cp], c_ids[cp], turn, k)
        bound = float(1 << 62)
        return pa.table({"query_id": pa.array(q_ids[qp][row], pa.int64()), "vec_id": pa.array(ids, pa.int64()),
                         "score": pa.array(np.clip(score, -bound, bound).astype(np.int64))})

    met = queries.groupBy("q_block", "block").cogroup(each.groupBy("q_block", "block")).applyInArrow(
        meet, "query_id long, vec_id long, score long")
    best_of = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best_of.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
