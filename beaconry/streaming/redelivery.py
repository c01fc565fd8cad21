"""Redelivered requests: producers retry, so a batch may arrive more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def first_deliveries(envelopes: DataFrame, bound: str, key: str = "batch_id", at: str = "received_at") -> DataFrame:
    """The stream without batches that have arrived within ``bound`` before.

    A key is kept in the state store until the watermark, ``bound`` behind the newest arrival, has passed its first arrival by
    ``bound``, so state grows with the rate and the bound and not with the stream's age. A batch that
    comes back later counts as a new one; one older than the watermark is dropped. Batches without a key or an arrival time
    can't be told apart: nulls equal each other.
    """
    return envelopes.withWatermark(at, bound).dropDuplicatesWithinWatermark([key])
