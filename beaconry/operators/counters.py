"""Self-metrics: counters and histograms, tagged by source and safe tenant.

All are grouped sums with partial aggregation, so a source or tenant with a large share of
the rows reaches the shuffle as one row per task.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.constants import (
    DURATION_METRIC, ERRORS_METRIC, FORWARDED_METRIC, INGEST_METRICS, KEYS, PROCESSING_ERROR_TYPES, TagKeys)
from beaconry.functions.columns import event_name, safe_tenant


def metric_name(signal: Column, keys: TagKeys = KEYS) -> Column:
    out = F.lit(None).cast("string")
    for name, metric in INGEST_METRICS.items():
        out = F.when(signal == name, F.lit(keys.metric(metric))).otherwise(out)
    return out


def error_type(signal: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, kind in PROCESSING_ERROR_TYPES.items():
        out = F.when(signal == name, F.lit(kind)).otherwise(out)
    return out


def _tags(source: str | None, tenant: str) -> list[Column]:
    tags = [] if source is None else [F.nullif(F.col(source), F.lit("")).alias("source_name")]
    return tags + [safe_tenant(F.col(tenant)).alias("tenant_id")]


def counted(stats: DataFrame, keys: TagKeys = KEYS, *more: Column) -> DataFrame:
    """Batches of countable signals with metric name and tags."""
    named = stats.select(metric_name(F.col("signal"), keys).alias("metric"), *_tags("source_name", "batch_tenant"), "item_count", *more)
    return named.filter(F.col("metric").isNotNull())


def ingest_counters(stats: DataFrame, keys: TagKeys = KEYS) -> DataFrame:
    """Items ingested per signal, source and safe tenant."""
    return counted(stats, keys).groupBy("metric", "source_name", "tenant_id").agg(F.sum("item_count").alias("value"))


def error_counters(failures: DataFrame) -> DataFrame:
    """Processing errors per error type and safe tenant."""
    return failures.select("error_type", *_tags(None, "batch_tenant")).groupBy("error_type", "tenant_id").agg(
        F.count("*").alias("value"))


def forwarded_counters(events: DataFrame, tenant: str = "batch_tenant") -> DataFrame:
    """Errors forwarded per source and safe tenant."""
    return events.select(*_tags("source_name", tenant)).groupBy("source_name", "tenant_id").agg(
        F.count("*").alias("value"))


def collector_metrics(ingested: DataFrame, errors: DataFrame, forwarded: DataFrame,
                      keys: TagKeys = KEYS) -> DataFrame:
    """The counters in one long table (``metric, source_name, tenant_id, error_type, value``)."""
    named = [ingested,
             errors.withColumn("metric", F.lit(keys.metric(ERRORS_METRIC))),
             forwarded.withColumn("metric", F.lit(keys.metric(FORWARDED_METRIC)))]
    union = named[0]
    for df in named[1:]:
        union = union.unionByName(df, allowMissingColumns=True)
    return union.select("metric", "source_name", "tenant_id", "error_type", "value")


METRIC_ROWS = ("metric string, source_name string, tenant_id string, error_type string, value bigint, "
               "sum double, min double, max double, bucket int")


def run_metrics(stats: DataFrame, forwarded: DataFrame | None, errors: Mapping[str, int], duration_ms: float,
                bounds: Sequence[float], keys: TagKeys = KEYS) -> DataFrame:
    """What one run counted, in one long table of few rows.

    Items ingested and the run's duration for each of its sources and tenants, errors that were
    forwarded, and errors of the run by type. ``stats`` and ``forwarded`` are rows of the run; both are summed within tasks first.
    """
    spark = stats.sparkSession
    wide = lambda df: df.selectExpr("metric", "source_name", "tenant_id", "cast(null AS string) AS error_type", "value")
    rows = wide(ingest_counters(stats, keys))
    if forwarded is not None:
        rows = rows.unionByName(wide(forwarded.withColumn("metric", F.lit(keys.metric(FORWARDED_METRIC)))))
    broken = [(keys.metric(ERRORS_METRIC), None, None, kind, n) for kind, n in errors.items() if n]
    if broken:
        rows = rows.unionByName(spark.createDataFrame(
            broken, "metric string, source_name string, tenant_id string, error_type string, value bigint"))
    ms = F.lit(float(duration_ms))
    spent = stats.select(*_tags("source_name", "batch_tenant")).groupBy("source_name", "tenant_id").agg(F.count("*").alias("value"))
    spent = spent.select(F.lit(keys.metric(DURATION_METRIC)).alias("metric"), "source_name", "tenant_id", "value",
                         (F.col("value") * ms).alias("sum"), ms.alias("min"), ms.alias("max"), bucket(ms, bounds).alias("bucket"))
    out = rows.unionByName(spent, allowMissingColumns=True)
    return out.select(*[c.split(" ")[0] for c in METRIC_ROWS.split(", ")])


def bucket(value: Column, bounds: Sequence[float]) -> Column:
    """Index of the first bound that is not below the value; one more than the last for the rest."""
    out = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        out = F.when(value <= bounds[i], F.lit(i)).otherwise(out)
    return out


def histogram(df: DataFrame, value: str, bounds: Sequence[float], by: Sequence[Column | str],
              quantiles: Sequence[float] = ()) -> DataFrame:
    """Bucket counts with sum, minimum and maximum per group and bucket.

    Grouping by bucket keeps the partial aggregates tiny; quantiles, if asked for, are the
    mergeable approximate kind.
    """
    aggs = [F.count("*").alias("value"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max")]
    if quantiles:
        aggs.append(F.percentile_approx(value, list(quantiles)).alias("quantiles"))
    return df.groupBy(*by, bucket(F.col(value), bounds).alias("bucket")).agg(*aggs)


def duration_histogram(audit: DataFrame, bounds: Sequence[float], quantiles: Sequence[float] = ()) -> DataFrame:
    """Processing durations by source and safe tenant."""
    tagged = audit.select(*_tags("source_name", "batch_tenant"), "processing_duration_ms")
    return histogram(tagged, "processing_duration_ms", bounds, ["source_name", "tenant_id"], quantiles)


def job_metrics(jobs: DataFrame, bounds: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """Jobs processed by status, and the job duration histogram (``status, duration_ms``)."""
    return (jobs.groupBy("status").agg(F.count("*").alias("value")),
            histogram(jobs, "duration_ms", bounds, ["status"]))


def job_events(jobs: DataFrame, prefix: str) -> DataFrame:
    """One analytics event per completed job."""
    done = jobs.filter(F.col("status") == "success")
    properties = F.map_from_entries(F.array(
        F.struct(F.lit("job_id").alias("key"), F.col("job_id").cast("variant").alias("value")),
        F.struct(F.lit("duration_ms").alias("key"), F.col("duration_ms").cast("variant").alias("value"))))
    return done.select("job_id", event_name(prefix, F.lit("Worker"), F.lit("JobCompleted")).alias("event_name"),
                       properties.alias("properties"))
