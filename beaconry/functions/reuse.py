"""Column expressions built once and used again."""

from __future__ import annotations

from functools import wraps
from typing import Callable, Hashable

from pyspark.sql import Column, SparkSession


def reused(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the expression per application and arguments.

    Columns are immutable and bind to a DataFrame by name, so one object serves every plan. A
    stream plans each micro-batch anew; without this it would rebuild thousands of nodes each time.
    """
    kept: dict[Hashable, Column] = {}

    @wraps(build)
    def get(*args: Hashable) -> Column:
        key = (SparkSession.active().sparkContext.applicationId, *args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return get
