"""Whitening of embeddings: exact sums and centred products in tasks, components by FEAST (``feast.py``).

Entries become integers x = floor(scale * c), the fit list is each distinct x once. Tasks add up x, then
products of centred x by rows of the covariance; sums of one covariance row meet in one task, as many numbers as there were
tasks. What the driver holds is one matrix of dimension squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.llm.common import cut, prepare, table
from beaconry.llm.feast import leading

OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
SAFE = float(2 ** 62)


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, x array<long>) of the usable rows."""
    x = F.transform(F.col(vector_col), lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long"))
    bad = F.exists(vector_col, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    some = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector_col).filter(
        F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(False)) & (F.size(vector_col) > 0))
    return some.select("vec_id", x.alias("x"))


def _rows(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in source:
        if b.num_rows:
            x = b.column("x")
            values = x.values.slice(x.offsets[0].as_py(), x.offsets[-1].as_py() - x.offsets[0].as_py())
            yield b, values.to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def column_sums(fit: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """(rows, exact sum per dimension). Tasks add high and low halves apart, neither of which can overflow."""
    def local(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, dtype=np.int64), np.zeros(d, dtype=np.int64)
        for _, x in _rows(source):
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d), pa.array(high), pa.array(low)],
                                         names=["i", "n", "high", "low"])

    whole = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    lines = fit.select("x").mapInArrow(local, "i int, n long, high long, low long").groupBy("i").agg(
        F.sum("n").alias("n"), whole("high"), whole("low")).collect()  # d rows
    sums = {r.i: (int(r.high) << 32) + int(r.low) for r in lines}
    return lines[0].n, np.array([sums[i] for i in range(d)], dtype=object)


def products(fit: DataFrame, project, d: int) -> np.ndarray:
    """Sums of outer products of ``project(x)``, a matrix of d columns, over all rows."""
    def local(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for _, x in _rows(source):
            y = project(x)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    def add(rows: pa.Table) -> pa.Table:
        line = np.stack(sorted(rows.column("row").to_pylist())).sum(axis=0)
        return pa.table({"i": rows.column("i").slice(0, 1), "row": pa.array([line.tolist()], pa.list_(pa.float64()))})

    schema = "i int, row array<double>"
    lines = fit.select("x").mapInArrow(local, schema).groupBy("i").applyInArrow(add, schema).collect()  # d rows of d numbers
    out = np.zeros((d, d))
    for r in lines:
        out[r.i] = r.row
    return out


def products_mean(fit: DataFrame, project, d: int, n: int) -> np.ndarray:
    """The mean of ``project(x)`` over all rows."""
    def local(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d)
        for _, x in _rows(source):
            total += project(x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total)], names=["i", "v"])

    sums = {r.i: r.v for r in fit.select("x").mapInArrow(local, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    return np.array([sums[i] for i in range(d)]) / n


def centred(s: np.ndarray, n: int):
    """x - S/n in double, S/n rounded once."""
    whole = np.array([int(v) // n for v in s], dtype=np.int64)
    part = np.array([(int(v) % n) / n for v in s])
    return lambda x: (x - whole) - part


def deviations(x: np.ndarray, s: np.ndarray, n: int) -> list[int | None]:
    """Sums of (n * x - S) ** 2, exact; null beyond a long."""
    top = max((abs(int(v)) for v in s), default=0)
    if (float(n) * float(np.abs(x).max(initial=0)) + top) ** 2 * max(x.shape[1], 1) < SAFE:
        y = n * x - s.astype(np.int64)
        return (y * y).sum(axis=1).tolist()
    y = (x.astype(object) * n - s[None, :]) ** 2
    return [v if v < 2 ** 63 else None for v in map(int, y.sum(axis=1))]


def whiten(vectors: DataFrame, k: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of usable rows and components 1 to ``k``.

    Left out are rows whose vector is null, empty or holds null or non-finite entries. Vectors of another length than the most
    frequent one (the longer of equals) are left out too: they have no covariance with it. Repeated rows and ids stay rows
    of their own and count once in the fit. Components of zero variance can't be scaled to one and are left out, so one
    distinct vector or an empty table gives no rows. Components whose eigenvalues are equal may be any basis of their space.
    A deviation beyond a long is null. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, id_col, vector_col, scale)
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], OUT)
    d = sizes["d"]
    rows = cut(rows.filter(F.size("x") == d))
    fit = cut(rows.select("x").distinct())
    n, s = column_sums(fit, d)
    centre = centred(s, n)
    v = products(fit, centre, d) / n
    e, w = leading((v + v.T) / 2, k)
    if not len(e):
        return spark.createDataFrame([], OUT)
    directions = w / np.sqrt(e)
    mean = products_mean(fit, lambda x: centre(x) @ directions, len(e), n)
    spread = products(fit, lambda x: centre(x) @ directions - mean, len(e)) / n
    error = float(np.abs(spread - np.eye(len(e))).max())
    share = e / np.trace(v)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(e)
        for b, x in _rows(source):
            z = centre(x) @ directions
            dev = deviations(x, s, n)
            many = len(x) * m
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), m))), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                pa.array(np.full(many, n)), pa.array([v for v in dev for _ in range(m)], pa.int64()), pa.array(z.reshape(-1)),
                pa.array(np.tile(share, len(x))), pa.array(np.full(many, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, OUT)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return whiten(table(spark, sf_dir, "embeddings"))
