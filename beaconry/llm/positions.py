"""Dense positions of rows in a global order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.llm.common import cut, parts

#: monotonically_increasing_id() holds the task above this bit and the row within the task below it
TASK_BIT = 33


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``: their position from 0 in ``order``, as a written table.

    Sampled splitters range-partition the rows, tasks sort and number their own, and the counts of the tasks before are
    added: one row per task, which is broadcast. Rows that ``order`` can't tell apart must be alike: a task that runs
    again may swap them.
    """
    at = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    held = cut(ranged.select("*", F.shiftright(at, TASK_BIT).alias("_task"), at.bitwiseAND((1 << TASK_BIT) - 1).alias(name)))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.groupBy("_task").agg(F.count("*").alias("_n")).select(
        "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return held.join(F.broadcast(offsets), "_task").withColumn(name, F.col(name) + F.col("_offset")).drop("_task", "_offset")
