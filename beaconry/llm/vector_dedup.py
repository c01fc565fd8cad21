"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one kept per group.

A vector is at home in the cell of its nearest centroid and a guest in every later cell where a partner may be at
home: unit vectors x, y with cosine s are at most sqrt(2 - 2 s) apart, so y is a guest of cell c only if
y.(c_home - c) <= sqrt(2 - 2 s) |c_home - c|. Every linked pair of a label therefore meets exactly once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.llm.common import cut, table
from beaconry.llm.graph import components, hinted
from beaconry.llm.vectors import matrices, raw, sampled, stack

SIMILARITY = 0.98
#: Vectors that the centroids are fitted on, and vectors a cell is meant for; at most so many cells.
SAMPLE, PER_CELL, MOST_CELLS = 20_000, 8_192, 1_024
#: Vectors of a block; a task compares two blocks.
BLOCK = 2_048


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 42) -> np.ndarray:
    """Unit centroids of unit vectors; a centroid that loses its vectors restarts at the worst served one."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        dots = x @ c.T
        own = dots.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1)
        lost = np.flatnonzero(norm < 1e-12)
        if len(lost):
            sums[lost] = x[np.argsort(dots.max(axis=1), kind="stable")[:len(lost)]]
            norm[lost] = np.linalg.norm(sums[lost], axis=1)
        c = sums / norm[:, None]
    return c


def centroids(rows: DataFrame, k: int, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Centroids by dimension, from at most ``sample`` vectors: those with the smallest hashes of their id."""
    some = rows.orderBy(sampled(F.col("vec_id")), "vec_id").limit(sample).collect()  # the bounded sample
    by: dict[int, list[np.ndarray]] = {}
    for r in some:
        x = np.frombuffer(r["unit"], dtype=np.float64)
        by.setdefault(len(x), []).append(x)
    return {d: spherical_kmeans(np.array(x), k) for d, x in by.items() if d}


def _units(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, d, key, unit) of the vectors that may link; key: 128 bits of label and vector."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for rows, x in matrices(b.column("v")):
                norm = np.linalg.norm(x / np.maximum(np.abs(x).max(axis=1, initial=0), 1e-300)[:, None], axis=1)
                some = norm > 0
                rows, x = rows[some], x[some]
                scaled = x / np.abs(x).max(axis=1, initial=1e-300)[:, None]
                unit = scaled / np.linalg.norm(scaled, axis=1)[:, None]
                at = pa.array(rows)
                label = b.column("label").take(at)
                key = [hashlib.md5(f"{y}:".encode() + r).digest() for y, r in zip(label.to_pylist(), raw(x + 0.0))]
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id").take(at), label, pa.array(np.full(len(rows), x.shape[1], dtype=np.int32)),
                     pa.array(key, pa.binary()), pa.array(raw(unit), pa.binary())], names=["vec_id", "label", "d", "key", "unit"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vec_col).cast("array<double>").alias("v")).filter("vec_id is not null and label is not null")
    return rows.mapInArrow(run, "vec_id long, label string, d int, key binary, unit binary")


def _dealt(units: DataFrame, cells: dict[int, np.ndarray], similarity: float) -> DataFrame:
    """(vec_id, w, cell, guest, unit): each vector at home and as guest; a cell's name holds label and dimension."""
    shared = units.sparkSession.sparkContext.broadcast(cells)
    reach = math.sqrt(max(0.0, 2 - 2 * similarity)) + 1e-9

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps = {d: np.sqrt(np.maximum(0.0, ((c[:, None] - c[None]) ** 2).sum(axis=2))) if len(c) < 65 else None
                for d, c in shared.value.items()}
        for b in source:
            d = b.column("d").to_numpy()
            for size in np.unique(d).tolist():
                at = np.flatnonzero(d == size)
                x = stack(b.column("unit").take(pa.array(at)))
                c = shared.value.get(size)
                if c is None:
                    row, cell, guest = np.arange(len(at)), np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int32)
                else:
                    dots = x @ c.T
                    home = dots.argmax(axis=1)
                    gap = gaps[size][home] if gaps[size] is not None else np.sqrt(np.maximum(0.0, 2 - 2 * (c[home] @ c.T)))
                    near = dots[np.arange(len(at)), home][:, None] - dots <= reach * gap + 1e-9
                    near &= np.arange(len(c))[None, :] > home[:, None]
                    row, cell = np.nonzero(near)
                    guest = np.concatenate([np.zeros(len(at), dtype=np.int32), np.ones(len(row), dtype=np.int32)])
                    row, cell = np.concatenate([np.arange(len(at)), row]), np.concatenate([home, cell])
                take = pa.array(at[row])
                names = [f"{y}/{size}/{k}" for y, k in zip(b.column("label").take(take).to_pylist(), cell.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id").take(take), b.column("w").take(take), pa.array(names, pa.string()),
                     pa.array(guest.astype(np.int32)), b.column("unit").take(take)], names=["vec_id", "w", "cell", "guest", "unit"])

    return units.mapInArrow(run, "vec_id long, w long, cell string, guest int, unit binary")


def _tasks(dealt: DataFrame, block: int) -> DataFrame:
    """(task, side, vec_id, w, unit): pairs of home blocks, and of home and guest blocks, of every cell."""
    counts = cut(dealt.groupBy("cell").agg(F.sum(1 - F.col("guest")).alias("home"), F.sum("guest").alias("guests")))
    blocks = counts.filter("home > 0").select("cell", *(F.ceil(F.col(c) / block).cast("int").alias(q) for c, q in (("home", "qh"), ("guests", "qg"))))
    rows = dealt.join(blocks, "cell").withColumn("h", F.pmod(F.xxhash64("vec_id"), F.when(F.col("guest") == 0, F.col("qh")).otherwise(F.col("qg"))).cast("int"))
    home = """concat(
        transform(sequence(0, qh - 1), x -> named_struct('task', concat_ws('/', cell, 'h', least(h, x), greatest(h, x)), 'side', if(x < h, 1, 0))),
        if(qg = 0, array(), transform(sequence(0, greatest(qg - 1, 0)), x -> named_struct('task', concat_ws('/', cell, 'g', h, x), 'side', 0))))"""
    guest = "transform(sequence(0, qh - 1), x -> named_struct('task', concat_ws('/', cell, 'g', x, h), 'side', 1))"
    return rows.withColumn("t", F.explode(F.expr(f"if(guest = 0, {home}, {guest})"))).select("t.task", "t.side", "vec_id", "w", "unit")


def linked(x: np.ndarray, y: np.ndarray | None, similarity: float, rows: int = 512) -> np.ndarray:
    """Which vectors link, as a matrix; within ``x`` alone every pair but a vector with itself."""
    other = x if y is None else y
    out = np.empty((len(x), len(other)), dtype=bool)
    for a in range(0, len(x), rows):
        out[a:a + rows] = x[a:a + rows] @ other.T >= similarity
    if y is None:
        np.fill_diagonal(out, False)
    return out


def hooks(link: np.ndarray, square: bool) -> np.ndarray:
    """The smallest place reachable from each place; of two sides, places of the second follow those of the first."""
    m, n = link.shape
    label = np.arange(m if square else m + n)
    left, right = (label, label) if square else (label[:m], label[m:])
    while True:
        before = label.copy()
        for i in np.flatnonzero(link.any(axis=1)).tolist():
            low = min(left[i], right[link[i]].min())
            left[i] = low
            right[link[i]] = np.minimum(right[link[i]], low)
        label[:] = label[label]
        if (label == before).all():
            return label


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    similarity: float = SIMILARITY) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: vectors of a label link from ``similarity`` cosine on.

    A row whose vector is null, empty, zero, or holds null or non-finite components, or whose label is null, links
    with nothing; so do vectors of different dimensions. Equal vectors of a label become one class first, so a group
    of copies costs as one vector; repeated rows are copies. A null id links with nothing and keeps a null component.
    Other columns are not read. The centroids are fitted on a bounded sample; every vector is compared.
    """
    units = _units(vectors, id_col, vec_col, label_col)
    keys = cut(units.select("vec_id", "key"))
    classes = cut(keys.groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("w")))
    total = classes.count()
    reps = cut(units.join(hinted(classes.select("key", "vec_id", "w")), ["key", "vec_id"]).dropDuplicates(["key"]))
    cells = centroids(reps, min(MOST_CELLS, max(1, math.ceil(total / PER_CELL))))
    tasks = _tasks(cut(_dealt(reps, cells, similarity)), BLOCK)

    def solve(key: tuple, t: pa.Table) -> pa.Table:
        side, ids, w = (t.column(c).to_numpy() for c in ("side", "vec_id", "w"))
        x = stack(t.column("unit"))
        l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        square = not len(r) and "/h/" in key[0].as_py()
        if not len(l) or not square and not len(r):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        link = linked(x[l], None if square else x[r], similarity)
        both = l if square else np.concatenate([l, r])
        n = link @ w[l] if square else np.concatenate([link @ w[r], link.T @ w[l]])
        label = hooks(link, square)
        some, hooked = np.flatnonzero(n > 0), np.flatnonzero(label != np.arange(len(label)))
        return pa.table({
            "a": pa.array(np.concatenate([ids[both[some]], ids[both[hooked]]]), pa.int64()),
            "b": pa.array([None] * len(some) + ids[both[label[hooked]]].tolist(), pa.int64()),
            "n": pa.array(np.concatenate([n[some], np.zeros(len(hooked), dtype=np.int64)]), pa.int64())})

    found = cut(tasks.groupBy("task").applyInArrow(solve, "a long, b long, n long"))
    links = found.filter("b is null").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n"))
    groups = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "vec_id")
    named = cut(classes.join(links, "vec_id", "left").join(groups, "vec_id", "left").select(
        "key", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "vec_id").alias("component")))
    valid = keys.join(named, "key").select("vec_id", "n", "component")
    # rows that share an id have one result: the ids of the whole table get theirs, others link with nothing
    best = cut(valid.groupBy("vec_id").agg(F.max("n").alias("n"), F.min("component").alias("component")))
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id")).join(best, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
