"""Streams with state: redelivered batches, windowed counters, pending events."""

from __future__ import annotations

import time
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from beaconry.constants import ANALYTICS, LOGS
from beaconry.context import CollectorOptions, Context
from beaconry.plans import fixtures as fx
from beaconry.plans.registry import query
from beaconry.plans.scratch import shared_folder
from beaconry.plans.sql import safe, sql
from beaconry.sinks.base import Sink
from beaconry.sources.envelopes import stream_envelopes
from beaconry.streaming.pending import buffered_flush
from beaconry.streaming.redelivery import first_deliveries
from beaconry.streaming.windows import LateBatches, count_stream, late_batches

MINUTE = 60


def batch_number() -> Column:
    return F.substring("batch_id", 2, 8).cast("int")


def arriving(envelopes: DataFrame, seconds: Column) -> DataFrame:
    """Envelopes that arrive so many seconds after a fixed moment."""
    return envelopes.withColumn("received_at", F.timestamp_seconds(F.lit(1_800_000_000) + seconds))


def _in_turn(path: str, run: Callable[[], None], *waves: DataFrame) -> None:
    """Waves of envelopes, each of as many files as it has tasks; ``run`` takes in what is there as one micro-batch."""
    for wave in waves:
        wave.write.mode("append").parquet(path)
        run()


def stop_when(run: StreamingQuery, done: Callable[[], bool], patience: float = 30) -> bool:
    """Stop a stream once ``done``; whether it lived until then.

    A stream whose micro-batches outlast its trigger has no pause between two, so this waits for the end of the present one,
    not for a pause, and after ``patience`` seconds for neither.
    """
    while run.isActive and not done():
        time.sleep(0.2)
    alive, last, until = run.isActive, run.lastProgress, time.monotonic() + patience
    while run.isActive and run.status["isTriggerActive"] and run.lastProgress == last and time.monotonic() < until:
        time.sleep(0.02)
    run.stop()
    return alive


AGAIN = """SELECT batch_id, 1 + (batch_no % 3 = 1)::int AS deliveries FROM bt UNION ALL
  SELECT batch_id || '-later', 1 FROM bt WHERE batch_no % 5 = 0 UNION ALL SELECT batch_id || '-last', 1 FROM bt WHERE batch_no % 5 = 0"""


@query("x2_first_deliveries", sql(AGAIN))
def x2(spark: SparkSession, d: str) -> DataFrame:
    """Every third batch comes again within the hour and is dropped; every third, hours later, counts as new."""
    path, n = shared_folder(spark), batch_number()
    env = fx.envelopes(spark, d, LOGS)
    new = env.filter(n % 5 == 0)
    renamed = lambda rows, tail: rows.withColumn("batch_id", F.concat("batch_id", F.lit(tail)))

    def run() -> None:
        seen = first_deliveries(stream_envelopes(spark, f"{path}/in", None), "60 minutes")
        (seen.select("batch_id").writeStream.format("parquet").option("path", f"{path}/out")
         .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination())

    _in_turn(f"{path}/in", run, arriving(env, n % (10 * MINUTE)), arriving(env.filter(n % 3 == 0), n % (10 * MINUTE) + 20 * MINUTE),
             renamed(arriving(new, F.lit(150 * MINUTE)), "-later"), renamed(arriving(new, F.lit(152 * MINUTE)), "-last"),
             arriving(env.filter(n % 3 == 1), n % (10 * MINUTE) + 180 * MINUTE))
    return spark.read.parquet(f"{path}/out").groupBy("batch_id").agg(F.count("*").cast("int").alias("deliveries"))


#: seconds after the first arrival: the base wave spreads over four hours, in half-hour steps the last ones stay open
_SPREAD, _STEP, _LATENESS = 240 * MINUTE, 30 * MINUTE, 60 * MINUTE
X1_SQL = f"""SELECT 'window' AS kind, slot * {_STEP} AS starts, source_name, {safe('batch_tenant')} AS tenant_id, cast(sum(n) AS bigint) AS value FROM (
    SELECT *, (1800000000 + batch_no * 7 % {_SPREAD}) // {_STEP} AS slot FROM hd)
  WHERE (slot + 1) * {_STEP} <= (SELECT max(1800000000 + batch_no * 7 % {_SPREAD}) + 7200 - {_LATENESS} FROM hd) GROUP BY ALL
  UNION ALL SELECT 'late', NULL, NULL, NULL, count(*) FROM hd WHERE batch_no % 4 = 2 HAVING count(*) > 0"""


@query("x1_windowed_counters", sql(X1_SQL))
def x1(spark: SparkSession, d: str) -> DataFrame:
    """Counters by half hour from runs of one checkpoint: batches, each twice, then one two hours after, then others too late."""
    path, n = shared_folder(spark), batch_number()
    env = fx.envelopes(spark, d, LOGS)
    base = arriving(env, (n.cast("bigint") * 7) % _SPREAD)
    last = base.agg(F.max("received_at").alias("newest"))
    marker = env.orderBy("batch_id").limit(1).crossJoin(F.broadcast(last)).withColumns({
        "batch_id": F.lit("b99999999-end"), "received_at": F.expr("newest + interval 2 hours")}).drop("newest")
    late = arriving(env.filter(n % 4 == 2).withColumn("batch_id", F.concat("batch_id", F.lit("-late"))), F.lit(-48 * 60 * MINUTE))
    name = f"counters {path}"
    listener = LateBatches(spark, f"{path}/late", name)
    spark.streams.addListener(listener)

    def run(max_files: int | None = None) -> None:
        count_stream(stream_envelopes(spark, f"{path}/in", max_files), LOGS, f"{path}/out", f"{path}/checkpoint", "30 minutes", "60 minutes",
                     name=name, trigger={"availableNow": True}).awaitTermination()
        listener.ended.wait(60)

    try:
        files = 0
        for _ in range(2):  # two micro-batches of one run: both waves have the same files
            base.write.mode("append").parquet(f"{path}/in")
            files = files or len(spark.read.parquet(f"{path}/in").inputFiles())
        run(files)
        _in_turn(f"{path}/in", run, marker, late)
        rows = spark.read.parquet(f"{path}/out").select(
            F.lit("window").alias("kind"), F.unix_seconds("window_start").alias("starts"), "source_name", "tenant_id", "value")
        dropped = late_batches(spark, f"{path}/late").agg(F.sum("late_batches").alias("value"))
        return rows.unionByName(dropped.withColumn("kind", F.lit("late")), allowMissingColumns=True)
    finally:
        spark.streams.removeListener(listener)


@query("r12_buffered_flush", sql("""SELECT event_type AS event, count(*) AS events, cast(sum(k) AS bigint) AS k_sum, 2 AS refused_flushes
  FROM an GROUP BY event_type"""))
def r12_buffered(spark: SparkSession, d: str) -> DataFrame:
    """A backend that refuses two flushes: every event arrives once, and the stream lives on."""
    path = shared_folder(spark)
    env = fx.envelopes(spark, d, ANALYTICS)
    env.repartition(6).write.parquet(f"{path}/in")
    wanted = fx.base(spark, d).count()
    refused = arrived = 0
    sent = lambda folder: spark.read.schema("event_count bigint, document string").parquet(f"{path}/out{folder}")

    def write(df: DataFrame, epoch: int) -> None:
        nonlocal refused, arrived
        if refused < 2:
            refused += 1
            raise ConnectionError("backend is down")
        df.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")
        arrived += sent(f"/epoch={epoch}").agg(F.sum("event_count")).first()[0]

    run = buffered_flush(stream_envelopes(spark, f"{path}/in", 2), Sink("product_analytics", write, "documents"), f"{path}/pending",
                         f"{path}/checkpoint", size=100, interval_ms=2000, trigger="1 second", ctx=Context(),
                         opts=CollectorOptions())
    alive = stop_when(run, lambda: arrived >= wanted)
    if not alive:
        raise run.exception() or RuntimeError("the stream ended")
    parsed = F.from_json("document", "struct<batch:array<struct<event:string,properties:struct<k:int>>>>")["batch"]
    return sent("").select(F.explode(parsed).alias("e")).groupBy(F.col("e.event").alias("event")).agg(
        F.count("*").alias("events"), F.sum("e.properties.k").alias("k_sum")).withColumn("refused_flushes", F.lit(refused))
