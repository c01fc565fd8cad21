"""Mixing sources to target weights: counts by exact length, bounded-knapsack fitting, seeded selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beaconry.llm.common import cut, table
from beaconry.llm.graph import hinted

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Documents of one source and length are chosen through so many hash buckets, so no task ranks them all.
BUCKETS = 256


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target): shares of all words by weight, none above ``most`` times its source.

    Sources in code-point order, null last, take the weights in turn. What a limit cuts off goes to the others by
    weight until none is above. One row per source, a dimension of the corpus, meets in one task here.
    """
    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pd.concat(list(frames), ignore_index=True)
        named = p[p["source"].notna()]
        # code-point order is that of UTF-8 bytes
        order = [*named.index[np.argsort(named["source"].map(lambda s: s.encode()).to_numpy(), kind="stable")],
                 *p.index[p["source"].isna()]]
        p = p.loc[order].reset_index(drop=True)
        weight = np.array([weights[i % len(weights)] for i in range(len(p))], dtype=float)
        size = p["source_size"].to_numpy(dtype=float)
        limit, total = most * size, float(size.sum())
        out, free = np.zeros(len(p)), np.ones(len(p), dtype=bool)
        while free.any():
            share = max(0.0, total - out[~free].sum()) * weight / weight[free].sum()
            over = free & (share > limit)
            if not over.any():
                out[free] = share[free]
                break
            out[over], free = limit[over], free & ~over
        yield p.assign(target=out)

    return sizes.coalesce(1).mapInPandas(fill, "source string, source_size long, target double")


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to ``budget`` as can be from below.

    Every length first gives its proportional part; single documents, longest first, follow while more than the
    window of four longest documents is open; a bounded-knapsack program over that window finds the best rest.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    left = budget - int((lengths * take).sum())
    window = 4 * int(lengths.max())
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if left <= window:
            break
        n = min(int(counts[i] - take[i]), max(0, (left - window) // int(lengths[i])))
        take[i] += n
        left -= n * int(lengths[i])
    # reachable sums up to `left` as bits; powers of two of each length's remaining documents are the items
    reach, steps = 1, []
    mask = (1 << (left + 1)) - 1
    for i in order:
        more, size = min(int(counts[i] - take[i]), left // int(lengths[i])), 1
        while more > 0 and not reach >> left & 1:
            n = min(size, more)
            steps.append((int(i), n, reach))
            reach |= reach << n * int(lengths[i]) & mask
            more, size = more - n, size * 2
    at = reach.bit_length() - 1
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            take[i] += n
            at -= n * int(lengths[i])
    return take


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, seed: int = 42) -> DataFrame:
    """A row per document: doc_id, size, source, source_size, target, copies, taken.

    A source whose target is above its size takes every document whole times, and the rest of the budget by length:
    how many documents of each length is fitted, and those with the smallest seeded hashes of their id are taken.
    A text without words has size 0. Rows sharing an id count each. Null sources are one source. Other columns are
    not read; an empty table mixes nothing. A source's plan has a row per distinct length.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       word_count(F.col(text_col)).alias("size"))
    base = cut(base.withColumn("pick", F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)))))
    lengths = cut(base.groupBy("source", "size").agg(F.count("*").alias("n")))
    goal = cut(targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")),
                       weights, most))

    def fitted(p: pd.DataFrame) -> pd.DataFrame:
        whole = int(p["source_size"].iloc[0])
        target = int(round(float(p["target"].iloc[0])))
        every = target // whole if whole else 0
        some = p["size"].to_numpy() > 0
        extra = np.zeros(len(p), dtype=np.int64)
        q = p[some].sort_values("size")
        if len(q):
            extra_q = fit(q["size"].to_numpy(dtype=np.int64), q["n"].to_numpy(dtype=np.int64), target - every * whole)
            extra = pd.Series(0, index=p.index).where(~some, 0)
            extra.loc[q.index] = extra_q
        return p.assign(every=every, extra=np.asarray(extra, dtype=np.int64))[
            ["source", "size", "source_size", "target", "every", "extra"]]

    same = lambda a, b, *keys: [a[k].eqNullSafe(b[k]) for k in keys]
    per = lengths.alias("l").join(goal.alias("g"), F.col("l.source").eqNullSafe(F.col("g.source"))).select(
        "l.source", "l.size", "l.n", "g.source_size", "g.target")
    plan = cut(per.groupBy("source").applyInPandas(
        fitted, "source string, size long, source_size long, target double, every long, extra long"))

    # which buckets of a (source, length) are taken whole, and how many of the one at the boundary
    bucket = F.pmod("pick", F.lit(BUCKETS)).cast("int")
    hashed = base.withColumn("bucket", bucket)
    filled = hashed.groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    quota = cut(filled.join(plan, same(filled, plan, "source", "size")).select(
        filled["source"], filled["size"], "bucket", "source_size", "target", "every",
        F.greatest(F.lit(0), F.least("n", F.col("extra") - F.col("before"))).alias("quota"), "n"))
    rows = hashed.join(quota, [*same(hashed, quota, "source", "size"), hashed["bucket"] == quota["bucket"]]).select(
        "doc_id", hashed["size"], hashed["source"], "pick", hashed["bucket"], "source_size", "target", "every", "quota", "n")
    nth = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("pick", "doc_id"))
    edge = (F.col("quota") > 0) & (F.col("quota") < F.col("n"))
    ranked = rows.filter(edge).withColumn("more", (nth <= F.col("quota")).cast("long"))
    plain = rows.filter(~edge).withColumn("more", (F.col("quota") > 0).cast("long"))
    out = plain.unionByName(ranked).withColumn("copies", F.col("every") + F.col("more"))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, each as often as the mix takes it.

    A row's copies are those of its ``doc_id``; rows that share an id (or have none) take the largest number of theirs.
    """
    own = lambda name: name if name.lower() not in {c.lower() for c in docs.columns} else own(name + "_")
    key, times, nth = own("mix_doc_id"), own("mix_copies"), own("mix_nth")
    copies = cut(mix(docs, **options).groupBy("doc_id").agg(F.max("copies").cast("int").alias(times))
                 .filter(F.col(times) > 0).withColumnRenamed("doc_id", key))
    rows = docs.join(hinted(copies), F.col("doc_id").cast("long").eqNullSafe(F.col(key)))
    return rows.withColumn(nth, F.explode(F.array_repeat(F.lit(0), F.col(times)))).select(docs.columns)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
