"""Connected components by contraction, and joins against small sides of a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import cut

#: Ids are broadcast up to this many rows (about 50 MB); beyond it the same join shuffles.
BROADCAST_ROWS = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b); the component is its smallest node.

    Each round hooks every node to its smallest neighbour and contracts the edges, which shrinks a component of m
    nodes in about log m rounds. Rounds are written tables; hubs are only aggregated, or joined from written tables,
    whose large partitions Spark splits.
    """
    rounds: list[DataFrame] = []
    while True:
        edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
        if edges.isEmpty():
            break
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select("b", "a"))
        hooks = cut(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root")))
        rounds.append(hooks)
        left, right = (hooks.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b"))
        edges = edges.join(left, "a").join(right, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = rounds.pop()
    while rounds:
        later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        out = rounds.pop().join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return cut(out.select("node", F.col("root").alias("component")))


def hinted(ids: DataFrame) -> DataFrame:
    """``ids`` (a written table), to be broadcast if its counted rows allow."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
