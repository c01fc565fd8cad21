"""Routing, delivery, audit and self-metrics."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.constants import ANALYTICS, ERRORS, KEYS, LOGS, METRICS, TRACES
from beaconry.context import CollectorOptions, Context
from beaconry.operators.audit import batch_status, ingestion_audit, publishable, with_failures
from beaconry.operators.counters import (
    METRIC_ROWS, collector_metrics, duration_histogram, error_counters, forwarded_counters, ingest_counters, job_events, job_metrics)
from beaconry.operators.enrich import attribute_batches
from beaconry.operators.routing import (
    ALL_SIGNALS, AUDIT_TOPIC, ERROR_TRACKER, LOG_STORE, METRIC_STORE, TRACE_STORE, SinkConfig, all_signal_sink,
    default_sinks, filter_batches_by_level, route, route_decisions, routed_payloads)
from beaconry.operators.stats import profile_batches
from beaconry.plans import fixtures as fx
from beaconry.plans.process import (
    process_analytics, process_errors, process_logs, process_metrics, process_traces, processing_failures)
from beaconry.plans.registry import query
from beaconry.plans.scratch import shared_folder, written
from beaconry.plans.sql import safe, sql
from beaconry.sinks.base import callable_sink, table_sink
from beaconry.sinks.committed import committed_sink, read_committed
from beaconry.sinks.fanout import Ledger, fan_out, publish_audit, sink_delivery, write_payloads
from beaconry.sinks.retry import Rejected, analytics_policy
from beaconry.sources.envelopes import stream_envelopes
from beaconry.streaming.intake import flush_stream, process_stream, run_batch, sink_views

CTX = Context("corr-ctx", "op-ctx", "node-ctx", "tenant-ctx", "grid-env")
OPTS = CollectorOptions(environment="prod")
SINKS = [
    SinkConfig(TRACES, TRACE_STORE), SinkConfig(METRICS, METRIC_STORE, enabled=False),
    SinkConfig(LOGS, LOG_STORE, min_level="Warning"), SinkConfig(LOGS, "archive", endpoint_ok=False),
    *all_signal_sink(metrics=False), SinkConfig(TRACES, ERROR_TRACKER, takes="error_events"),
    SinkConfig(LOGS, ERROR_TRACKER, takes="error_events"),
]
ORDINAL = {TRACE_STORE: 0, METRIC_STORE: 1, LOG_STORE: 2, ALL_SIGNALS: 3, ERROR_TRACKER: 4, "archive": 5}

_SIG = """sig AS (
  SELECT hd.batch_no, batch_id, 'logs' AS signal, count(*) AS n, count_if(mixed_error) AS errors, any_value(max_sev) AS max_sev
  FROM log JOIN hd USING (batch_id) GROUP BY hd.batch_no, batch_id
  UNION ALL SELECT batch_no, batch_id, 'traces', count(*), count_if(is_error), 0 FROM sp GROUP BY batch_no, batch_id
  UNION ALL SELECT batch_no, batch_id, 'metrics', 3 * count(DISTINCT svc), 0, 0 FROM ev GROUP BY batch_no, batch_id),
rt AS (
  SELECT s.*, c.sink, c.ord, CASE WHEN NOT c.enabled THEN 'disabled' WHEN s.max_sev < c.min_sev THEN 'below level'
    WHEN NOT c.endpoint THEN 'endpoint missing' ELSE 'delivered' END AS reason
  FROM sig s JOIN (VALUES ('traces', 'trace_store', 0, true, true, 0, false), ('metrics', 'metric_store', 1, false, true, 0, false),
    ('logs', 'log_store', 2, true, true, 13, false), ('logs', 'archive', 5, true, false, 0, false),
    ('traces', 'all_signals', 3, true, true, 0, false), ('metrics', 'all_signals', 3, false, true, 0, false),
    ('logs', 'all_signals', 3, true, true, 0, false), ('traces', 'error_tracker', 4, true, true, 0, true),
    ('logs', 'error_tracker', 4, true, true, 0, true)) c(signal, sink, ord, enabled, endpoint, min_sev, errs)
  ON s.signal = c.signal AND (NOT c.errs OR s.errors > 0)),
dl AS (SELECT *, (batch_no + ord) % 7 <> 3 AS ok FROM rt WHERE reason = 'delivered')"""


def rsql(body: str) -> str:
    return sql("").rstrip() + ",\n" + _SIG + "\n" + body


def _stats(spark: SparkSession, d: str) -> DataFrame:
    """Attributed and routed statistics of the three OTLP signals."""
    def one(signal: str) -> DataFrame:
        stats = attribute_batches(profile_batches(fx.mixed(spark, d, signal), signal, records=False))
        return route(stats, SINKS)

    return one(LOGS).unionByName(one(TRACES)).unionByName(one(METRICS))


def _delivery(stats: DataFrame) -> DataFrame:
    """Delivery table of a run in which sinks fail for some batches."""
    decided = route_decisions(stats).filter(F.col("decision") == "delivered")
    ordinal = F.lit(-1)
    for sink, n in ORDINAL.items():
        ordinal = F.when(F.col("sink") == sink, n).otherwise(ordinal)
    n = F.substring("batch_id", 2, 8).cast("int")
    return decided.select(F.concat_ws("/", "signal", "batch_id").alias("batch_id"), "sink", ((n + ordinal) % 7 != 3).alias("ok"))


@query("p6_filter_batches_by_level", sql("SELECT batch_id, max_sev AS max_severity FROM bt WHERE max_sev >= 13"))
def p6(spark: SparkSession, d: str) -> DataFrame:
    return filter_batches_by_level(fx.mixed(spark, d, LOGS), "Warning").select("batch_id", "max_severity")


@query("r3_route", rsql("SELECT batch_id, signal, sink FROM rt WHERE reason = 'delivered'"))
def r3(spark: SparkSession, d: str) -> DataFrame:
    decided = route_decisions(_stats(spark, d))
    return decided.filter(F.col("decision") == "delivered").select("batch_id", "signal", "sink")


@query("r4_route_decisions", rsql("""SELECT batch_id, signal, sink, reason,
  CASE WHEN reason = 'delivered' THEN 'delivered' ELSE 'skipped' END AS decision FROM rt"""))
def r4(spark: SparkSession, d: str) -> DataFrame:
    return route_decisions(_stats(spark, d))


@query("r4_route_without_payload", sql("""SELECT batch_id, 'trace_store' AS sink,
  CASE WHEN batch_no % 8 = 7 THEN 'no payload' ELSE 'delivered' END AS reason FROM bt"""))
def r4_payload(spark: SparkSession, d: str) -> DataFrame:
    routed = routed_payloads(fx.malformed(spark, d, TRACES), TRACES, [SinkConfig(TRACES, TRACE_STORE)])
    return route_decisions(routed).select("batch_id", "sink", "reason")


@query("r5_route_all_signals", rsql("""SELECT signal, count(*) AS batches, count_if(signal <> 'metrics') AS delivered
  FROM sig GROUP BY signal"""))
def r5(spark: SparkSession, d: str) -> DataFrame:
    decided = route_decisions(_stats(spark, d)).filter(F.col("sink") == ALL_SIGNALS)
    return decided.groupBy("signal").agg(
        F.count("*").alias("batches"), F.count_if(F.col("decision") == "delivered").alias("delivered"))


@query("r6_write_sink", sql("""SELECT batch_id, sink, true AS intact FROM bt,
  (VALUES ('log_store', 13), ('all_signals', 0)) s(sink, low) WHERE max_sev >= low"""))
def r6(spark: SparkSession, d: str) -> DataFrame:
    env = written(fx.mixed(spark, d, LOGS))
    path = shared_folder(spark)
    write_payloads(routed_payloads(env, LOGS, SINKS), path, [LOG_STORE, ALL_SIGNALS])
    back = spark.read.parquet(path).select("batch_id", "sink", F.md5("payload").alias("got"))
    return back.join(env.select("batch_id", F.md5("payload").alias("want")), "batch_id").select(
        "batch_id", "sink", (F.col("got") == F.col("want")).alias("intact"))


@query("r14_one_pass", sql("""SELECT batch_id, sink, true AS intact FROM bt,
  (VALUES ('log_store', 13), ('all_signals', 0)) s(sink, low) WHERE max_sev >= low"""))
def r14_one_pass(spark: SparkSession, d: str) -> DataFrame:
    """Statistics and routed payloads are written once; four sinks read those."""
    env, path = written(fx.mixed(spark, d, LOGS)), shared_folder(spark)
    sinks = [table_sink(LOG_STORE, f"{path}/log_store"), table_sink(ALL_SIGNALS, f"{path}/all_signals"),
             table_sink(ERROR_TRACKER, f"{path}/errors", "error_events"), table_sink("batches", f"{path}/batches", "batches")]
    run_batch(env, LOGS, sinks, Ledger(spark, f"{path}/ledger"), 1, CTX, OPTS, SINKS, table=f"{path}/stats",
              payloads=f"{path}/payloads")
    back = [spark.read.parquet(f"{path}/{name}").select("batch_id", F.lit(name).alias("sink"), F.md5("payload").alias("got"))
            for name in (LOG_STORE, ALL_SIGNALS)]
    return back[0].unionByName(back[1]).join(env.select("batch_id", F.md5("payload").alias("want")), "batch_id").select(
        "batch_id", "sink", (F.col("got") == F.col("want")).alias("intact"))


@query("r15_committed_sink", rsql("""SELECT batch_id, sig.n AS items, errors FROM sig WHERE signal = 'logs'"""))
def r15_committed(spark: SparkSession, d: str) -> DataFrame:
    """A sink that commits: the first delivery fails midway, its retry and a second run of the epoch leave one copy."""
    path, tries = shared_folder(spark), []
    whole = committed_sink("mine", path, "batches")

    def write(df: DataFrame, epoch: int) -> None:
        tries.append(epoch)
        rows = df.select("batch_id", F.col("item_count").alias("items"), F.col("error_count").alias("errors"))
        if len(tries) == 1:
            torn = F.when(F.substring("batch_id", 2, 8).cast("int") % 64 == 63, F.raise_error("torn write")).otherwise(F.col("items"))
            rows = rows.withColumn("items", torn.cast("bigint"))
        whole.write(rows, epoch)

    env = written(fx.mixed(spark, d, LOGS))
    for _ in range(2):
        run_batch(env, LOGS, [callable_sink("mine", write, "batches", analytics_policy(1))], Ledger(spark, shared_folder(spark)),
                  1, configs=[SinkConfig(LOGS, "mine")])
    return read_committed(spark, path)


@query("r6_write_twice", sql("""SELECT signal, count(*) AS payloads FROM (
  SELECT 'logs' AS signal FROM bt UNION ALL SELECT 'traces' FROM bt) GROUP BY signal"""))
def r6_twice(spark: SparkSession, d: str) -> DataFrame:
    """Two signals written one after the other, one of them twice: both are there, once."""
    path = shared_folder(spark)
    for signal in (LOGS, TRACES, LOGS):
        write_payloads(routed_payloads(fx.envelopes(spark, d, signal), signal, SINKS), path, [ALL_SIGNALS])
    return spark.read.parquet(path).groupBy("signal").agg(F.count("*").alias("payloads"))


@query("r7_two_signals_one_ledger", sql("""SELECT signal, count(*) AS batches FROM (
  SELECT 'logs' AS signal FROM bt UNION ALL SELECT 'traces' FROM bt) GROUP BY signal"""))
def r7_two_signals(spark: SparkSession, d: str) -> DataFrame:
    """Logs, then traces, then logs again with one ledger and one epoch number: both arrive, once."""
    path, ledger = shared_folder(spark), Ledger(spark, shared_folder(spark))
    for signal in (LOGS, TRACES, LOGS):
        run_batch(fx.envelopes(spark, d, signal), signal, [table_sink(ALL_SIGNALS, path)], ledger, 1, CTX, OPTS, SINKS)
    return spark.read.parquet(path).groupBy("signal").agg(F.count("*").alias("batches"))


@query("r14_audit_after_partial_failure", sql("""SELECT CASE WHEN batch_no % 4 = 1 THEN 'PartialSuccess' ELSE 'Success' END AS status,
  count(*) AS batches FROM bt GROUP BY 1"""))
def r14_partial(spark: SparkSession, d: str) -> DataFrame:
    """A sink refuses some batches alone: their audit events, and no others, say so."""
    path, env = shared_folder(spark), fx.envelopes(spark, d, LOGS)
    refused = F.regexp_extract("batch_id", r"(\d+)$", 1).cast("int") % 4 == 1

    def some(df: DataFrame, epoch: int) -> DataFrame:
        return df.filter(refused).select("batch_id", F.lit("refused").alias("error"))

    run_batch(env, LOGS, [callable_sink(ALL_SIGNALS, some)], Ledger(spark, shared_folder(spark)), 1, CTX, OPTS, SINKS,
              audit_sink=table_sink(AUDIT_TOPIC, path, "audit"))
    return spark.read.parquet(path).groupBy("status").agg(F.count("*").alias("batches"))


@query("r14_disabled_sinks", sql("SELECT 'error_tracker' AS sink, 0 AS events, count(*) AS batches FROM bt"))
def r14_disabled(spark: SparkSession, d: str) -> DataFrame:
    """A disabled error tracker gets no error event, whatever the logs hold; the payload sink gets every batch."""
    path = shared_folder(spark)
    configs = [SinkConfig(LOGS, ALL_SIGNALS), SinkConfig(LOGS, ERROR_TRACKER, enabled=False)]
    run_batch(fx.envelopes(spark, d, LOGS), LOGS, [
        table_sink(ERROR_TRACKER, f"{path}/errors", "error_events"), table_sink(ALL_SIGNALS, f"{path}/all")],
        Ledger(spark, shared_folder(spark)), 1, CTX, OPTS, configs)
    errors = spark.read.parquet(f"{path}/errors").agg(F.count("*").alias("events"))
    batches = spark.read.parquet(f"{path}/all").agg(F.count("*").alias("batches"))
    return errors.crossJoin(batches).select(F.lit(ERROR_TRACKER).alias("sink"), "events", "batches")


def _failing(ordinal: int):
    """A sink that takes the rows it is given but reports some batches as failed."""

    def write(df: DataFrame, epoch: int) -> DataFrame:
        n = F.substring("batch_id", 2, 8).cast("int")
        return df.filter((n + ordinal) % 7 == 3).select("batch_id", F.lit("refused").alias("error"))

    return write


def _down(df: DataFrame, epoch: int) -> None:
    raise ConnectionError("backend is down")


def _fanned_out(spark: SparkSession, d: str) -> DataFrame:
    env = written(fx.mixed(spark, d, TRACES))
    done = process_traces(env, CTX, OPTS, SINKS, table=shared_folder(spark))
    ledger = Ledger(spark, shared_folder(spark))
    sinks = [callable_sink(TRACE_STORE, _failing(0)), callable_sink(ALL_SIGNALS, _down, policy=analytics_policy(0)),
             table_sink(ERROR_TRACKER, shared_folder(spark), "error_events")]
    fan_out(sink_views(env, done, SINKS), sinks, 1, ledger)
    return sink_delivery(route_decisions(done.stats), ledger, 1)


@query("r7_fan_out", rsql("""SELECT batch_id, sink, ok, error FROM (SELECT batch_id, sink,
  CASE sink WHEN 'trace_store' THEN batch_no % 7 <> 3 WHEN 'all_signals' THEN false ELSE true END AS ok,
  CASE WHEN sink = 'trace_store' AND batch_no % 7 = 3 THEN 'refused'
       WHEN sink = 'all_signals' THEN 'ConnectionError: backend is down' END AS error
  FROM rt WHERE signal = 'traces' AND reason = 'delivered')"""))
def r7(spark: SparkSession, d: str) -> DataFrame:
    return _fanned_out(spark, d).select("batch_id", "sink", "ok", "error")


@query("r8_with_retry", rsql("""SELECT sink, attempts, ok, batches FROM (SELECT 'flaky' AS sink, 3 AS attempts, true AS ok,
  count(*) AS batches FROM bt UNION ALL SELECT 'limited', 4, false, count(*) FROM bt)"""))
def r8(spark: SparkSession, d: str) -> DataFrame:
    """A sink that recovers at its third try and one that stays rate limited."""
    env = written(fx.mixed(spark, d, TRACES))
    tries = {"flaky": 0}

    def flaky(df: DataFrame, epoch: int) -> None:
        tries["flaky"] += 1
        if tries["flaky"] < 3:
            raise Rejected(503)
        df.write.format("noop").mode("overwrite").save()

    def limited(df: DataFrame, epoch: int) -> None:
        raise Rejected(429, retry_after_ms=1)

    ledger = Ledger(spark, shared_folder(spark))
    configs = [SinkConfig(TRACES, "flaky"), SinkConfig(TRACES, "limited")]
    done = process_traces(env, CTX, OPTS, configs, table=shared_folder(spark))
    sinks = [callable_sink("flaky", flaky), callable_sink("limited", limited, policy=analytics_policy(3))]
    fan_out(sink_views(env, done, configs), sinks, 1, ledger)
    delivery = sink_delivery(route_decisions(done.stats), ledger, 1)
    return delivery.groupBy("sink", "attempts", "ok").agg(F.count("*").alias("batches"))


@query("r9_batch_status", rsql("""SELECT signal || '/' || batch_id AS batch_id, count_if(NOT ok) AS sink_failures,
  CASE WHEN count_if(NOT ok) > 0 THEN 'PartialSuccess' ELSE 'Success' END AS status,
  CASE WHEN count_if(NOT ok) > 0 THEN count_if(NOT ok) || ' sink(s) failed to export' END AS error_message
  FROM dl GROUP BY signal, batch_id"""))
def r9(spark: SparkSession, d: str) -> DataFrame:
    return batch_status(_delivery(_stats(spark, d)))


_AUDIT_META = f"""CASE WHEN failures > 0 THEN cast(failures AS varchar) END AS failures_meta, source_name AS service_meta,
  'prod' AS environment_meta, cast(received_ms AS varchar) AS ingested_meta"""


@query("r10_ingestion_audit", rsql(f"""SELECT 1 AS version, received_ms AS ingestion_ms, md5(signal || '/' || key) AS audit_id, key AS batch_id,
  source_name AS source_node_name, header_node_id AS source_node_id,
  CASE WHEN signal = 'traces' THEN n ELSE 0 END AS trace_count, CASE WHEN signal = 'metrics' THEN n ELSE 0 END AS metric_count,
  CASE WHEN signal = 'logs' THEN n ELSE 0 END AS log_count, 0 AS analytics_event_count,
  CASE WHEN failures > 0 THEN 'PartialSuccess' ELSE 'Success' END AS status,
  CASE WHEN failures > 0 THEN failures || ' sink(s) failed to export' END AS error_message, n * 3 AS duration, {_AUDIT_META}
  FROM (SELECT f.*, f.signal || '/' || f.batch_id AS key, hd.received_ms, hd.source_name, hd.header_node_id FROM (
        SELECT signal, batch_id, any_value(n) AS n, count_if(reason = 'delivered' AND (batch_no + ord) % 7 = 3) AS failures
        FROM rt GROUP BY signal, batch_id) f JOIN hd USING (batch_id))"""))
def r10(spark: SparkSession, d: str) -> DataFrame:
    parsed = written(_stats(spark, d))
    stats = parsed.withColumn("batch_id", F.concat_ws("/", "signal", "batch_id"))
    audit = ingestion_audit(with_failures(stats, _delivery(parsed)), Context(), OPTS, F.col("item_count") * 3)
    m = F.col("metadata")
    return audit.select(
        "version", F.unix_millis("ingestion_timestamp").alias("ingestion_ms"), "audit_id", "batch_id", "source_node_name",
        "source_node_id", "trace_count", "metric_count", "log_count", "analytics_event_count", "status", "error_message",
        F.col("processing_duration_ms").alias("duration"), m[KEYS.sink_failures].alias("failures_meta"),
        m["service.name"].alias("service_meta"), m[KEYS.of("environment")].alias("environment_meta"),
        m[KEYS.ingested_at].alias("ingested_meta"))


@query("r11_publish_audit", sql("""SELECT batch_id, md5(md5('logs/' || batch_id)) AS correlation_id, 'ok' AS topic FROM bt
  UNION ALL SELECT NULL, NULL, 'transport_publish'"""))
def r11(spark: SparkSession, d: str) -> DataFrame:
    """One topic takes the audit events, the other is down: that is a counted error, nothing more."""
    audit = process_logs(fx.mixed(spark, d, LOGS), Context(), OPTS, SINKS).audit()
    ledger, path = Ledger(spark, shared_folder(spark)), shared_folder(spark)
    good = publish_audit(audit, table_sink(AUDIT_TOPIC, path, "audit"), 1, ledger)
    bad = publish_audit(audit, callable_sink("audit_mirror", _down, policy=analytics_policy(0)), 1, ledger)
    rows = spark.read.parquet(path).select("batch_id", "correlation_id", F.lit(good or "ok").alias("topic"))
    failure = spark.range(1).select(F.lit(None).cast("string").alias("batch_id"), F.lit(None).cast("string").alias("correlation_id"),
                                    F.lit(bad).alias("topic"))
    return rows.unionByName(failure)


@query("r12_flush_stream", sql("SELECT event_type AS event, count(*) AS events, cast(sum(k) AS bigint) AS k_sum FROM an GROUP BY event_type"))
def r12(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark)
    fx.envelopes(spark, d, ANALYTICS).write.parquet(f"{path}/in")
    run = flush_stream(stream_envelopes(spark, f"{path}/in", 2), table_sink("product_analytics", f"{path}/out", "documents"),
                       f"{path}/ledger", f"{path}/checkpoint", size=100, interval=None)
    run.awaitTermination()
    parsed = F.from_json("document", "struct<batch:array<struct<event:string,properties:struct<k:int>>>>")["batch"]
    sent = spark.read.parquet(f"{path}/out").select(F.explode(parsed).alias("e"))
    return sent.groupBy(F.col("e.event").alias("event")).agg(
        F.count("*").alias("events"), F.sum("e.properties.k").alias("k_sum"))


def _audit_rows(audit: DataFrame) -> DataFrame:
    return audit.select("batch_id", "source_node_name", "trace_count", "metric_count", "log_count",
                        "analytics_event_count", "status", "error_message")


def _audit_sql(signal: str, count: str, failures: str, source: str, name: str = "source_name") -> str:
    counts = ", ".join(f"{count if s == signal else '0'} AS {c}" for s, c in (
        ("traces", "trace_count"), ("metrics", "metric_count"), ("logs", "log_count"), ("analytics", "analytics_event_count")))
    return rsql(f"""SELECT batch_id, {name} AS source_node_name, {counts},
      CASE WHEN {failures} > 0 THEN 'PartialSuccess' ELSE 'Success' END AS status,
      CASE WHEN {failures} > 0 THEN ({failures}) || ' sink(s) failed to export' END AS error_message FROM {source}""")


@query("r14_process_traces", _audit_sql("traces", "sig.n", "1 + (errors > 0)::int",
                                        "sig JOIN hd USING (batch_id) WHERE signal = 'traces'"))
def r14_traces(spark: SparkSession, d: str) -> DataFrame:
    done = process_traces(fx.mixed(spark, d, TRACES), CTX, OPTS)
    return _audit_rows(done.audit([ALL_SIGNALS, ERROR_TRACKER]))


@query("r14_process_metrics", _audit_sql("metrics", "sig.n", "0", "sig JOIN hd USING (batch_id) WHERE signal = 'metrics'"))
def r14_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _audit_rows(process_metrics(fx.mixed(spark, d, METRICS), CTX, OPTS).audit())


@query("r14_process_logs", _audit_sql("logs", "sig.n", "(sig.max_sev >= 13)::int",
                                      "sig JOIN hd USING (batch_id) WHERE signal = 'logs'"))
def r14_logs(spark: SparkSession, d: str) -> DataFrame:
    done = process_logs(fx.mixed(spark, d, LOGS), CTX, OPTS)
    return _audit_rows(done.audit([LOG_STORE]))


@query("r14_process_logs_stream", _audit_sql("logs", "sig.n", "0", "sig JOIN hd USING (batch_id) WHERE signal = 'logs'"))
def r14_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same processing as a stream of several micro-batches, audit events read back from their topic."""
    path = shared_folder(spark)
    fx.mixed(spark, d, LOGS).repartition(4).write.parquet(f"{path}/in")
    run = process_stream(
        stream_envelopes(spark, f"{path}/in", 2), LOGS,
        [table_sink(LOG_STORE, f"{path}/log_store"), table_sink(ERROR_TRACKER, f"{path}/errors", "error_events")],
        f"{path}/ledger", f"{path}/checkpoint", CTX, OPTS, audit_sink=table_sink(AUDIT_TOPIC, f"{path}/audit", "audit"),
        table_root=f"{path}/stats", trigger={"availableNow": True})
    run.awaitTermination()
    return _audit_rows(spark.read.parquet(f"{path}/audit"))


@query("r14_process_analytics", _audit_sql("analytics", "n", "0", "hd", """coalesce(
  CASE WHEN batch_no % 3 = 0 THEN 'app-' || (batch_no % 5) END, header_source)"""))
def r14_analytics(spark: SparkSession, d: str) -> DataFrame:
    return _audit_rows(process_analytics(fx.envelopes(spark, d, ANALYTICS), CTX, OPTS).audit())


@query("r14_process_errors", sql("""SELECT report_id AS batch_id, message, severity, 'eu' AS region,
  coalesce(er_tenant, 'tenant-ctx') AS tenant_tag, coalesce(environment, 'prod') AS environment
  FROM er WHERE message IS NOT NULL"""))
def r14_errors(spark: SparkSession, d: str) -> DataFrame:
    opts = CollectorOptions(environment="prod", default_tags={"region": "eu"})
    done = process_errors(fx.envelopes(spark, d, ERRORS), CTX, opts)
    tags = F.col("tags")
    return done.deliveries().select("batch_id", "message", "severity", tags["region"].alias("region"),
                                    tags["tenant_id"].alias("tenant_tag"), "environment")


@query("r15_custom_sink", rsql("""SELECT batch_id, cast(sum(n) AS bigint) AS items, cast(sum(errors) AS bigint) AS errors FROM sig
  WHERE signal = 'logs' GROUP BY batch_id"""))
def r15(spark: SparkSession, d: str) -> DataFrame:
    """A user's own sink: any callable that takes a DataFrame."""
    path = shared_folder(spark)

    def mine(df: DataFrame, epoch: int) -> None:
        df.groupBy("batch_id").agg(F.sum("item_count").alias("items"), F.sum("error_count").alias("errors")).write.mode(
            "overwrite").orc(path)

    configs = [SinkConfig(LOGS, "mine")]
    run_batch(fx.mixed(spark, d, LOGS), LOGS, [callable_sink("mine", mine, "batches")], Ledger(spark, shared_folder(spark)),
              1, configs=configs)
    return spark.read.orc(path)


_SAFE = safe("batch_tenant")


@query("g8_ingest_counters", rsql(f"""SELECT 'collector.' || signal || '.ingested' AS metric, source_name, {_SAFE} AS tenant_id, cast(sum(sig.n) AS bigint) AS value
  FROM sig JOIN hd USING (batch_id) GROUP BY ALL UNION ALL
  SELECT 'collector.analytics_events.ingested', coalesce(CASE WHEN batch_no % 3 = 0 THEN 'app-' || (batch_no % 5) END, header_source),
  {safe('t')} AS tenant_id, cast(sum(n) AS bigint) FROM (SELECT hd.batch_no, any_value(header_source) AS header_source, any_value(n) AS n,
    coalesce(any_value(batch_tenant), CASE WHEN count(DISTINCT lower(tenant)) = 1 THEN min(tenant) END) AS t
    FROM hd JOIN ev USING (batch_id) GROUP BY hd.batch_no) GROUP BY ALL"""))
def g8(spark: SparkSession, d: str) -> DataFrame:
    columns = ["signal", "item_count", "source_name", "batch_tenant"]
    analytics = process_analytics(fx.envelopes(spark, d, ANALYTICS), CTX, OPTS).stats
    return ingest_counters(_stats(spark, d).select(*columns).unionByName(analytics.select(*columns)))


@query("g9_error_counters", rsql(f"""SELECT CASE signal WHEN 'traces' THEN 'trace_processing' WHEN 'logs' THEN 'log_processing'
  ELSE 'metric_processing' END AS error_type, {_SAFE} AS tenant_id, count(*) AS value
  FROM sig JOIN hd USING (batch_id) WHERE hd.batch_no % 7 = 3 GROUP BY ALL"""))
def g9(spark: SparkSession, d: str) -> DataFrame:
    broke = F.substring("batch_id", 2, 8).cast("int") % 7 == 3
    return error_counters(processing_failures(_stats(spark, d), broke))


@query("g10_forwarded_counters", rsql(f"""SELECT source_name, {_SAFE} AS tenant_id, count(*) AS value FROM (
  SELECT log.svc, hd.source_name, hd.batch_tenant FROM log JOIN hd USING (batch_id) WHERE mixed_error UNION ALL
  SELECT sp.svc, sp.svc, hd.batch_tenant FROM sp JOIN hd USING (batch_id) WHERE is_error) GROUP BY ALL"""))
def g10(spark: SparkSession, d: str) -> DataFrame:
    logs = process_logs(fx.mixed(spark, d, LOGS), CTX, OPTS).error_events
    spans = process_traces(fx.mixed(spark, d, TRACES), CTX, OPTS).error_events
    columns = ["source_name", "batch_tenant"]
    return forwarded_counters(logs.select(*columns).unionByName(spans.select(*columns)))


@query("g9_collector_metrics", rsql(f"""SELECT 'collector.' || signal || '.ingested' AS metric, source_name,
  {_SAFE} AS tenant_id, NULL AS error_type, cast(sum(sig.n) AS bigint) AS value FROM sig JOIN hd USING (batch_id)
  WHERE signal = 'logs' GROUP BY ALL UNION ALL
  SELECT 'collector.errors', NULL, {_SAFE} AS t, 'log_processing', count(*) FROM hd WHERE batch_no % 7 = 3 GROUP BY ALL
  UNION ALL SELECT 'collector.errors.forwarded', source_name, {_SAFE} AS t, NULL, count(*)
  FROM log JOIN hd USING (batch_id) WHERE mixed_error GROUP BY ALL"""))
def g9_all(spark: SparkSession, d: str) -> DataFrame:
    done = process_logs(fx.mixed(spark, d, LOGS), Context(), OPTS, table=shared_folder(spark))
    broke = F.substring("batch_id", 2, 8).cast("int") % 7 == 3
    return collector_metrics(done.counters(), error_counters(processing_failures(done.stats, broke)), done.forwarded())


@query("g11_duration_histogram", rsql(f"""SELECT source_name, {_SAFE} AS tenant_id,
  CASE WHEN ms <= 10 THEN 0 WHEN ms <= 50 THEN 1 WHEN ms <= 200 THEN 2 ELSE 3 END AS bucket, count(*) AS value,
  cast(sum(ms) AS bigint) AS sum, min(ms) AS min, max(ms) AS max FROM (
    SELECT hd.*, (hd.batch_no * 37) % 311 AS ms FROM hd) GROUP BY ALL"""))
def g11(spark: SparkSession, d: str) -> DataFrame:
    stats = attribute_batches(profile_batches(fx.mixed(spark, d, LOGS), LOGS, records=False))
    n = F.substring("batch_id", 2, 8).cast("bigint")
    return duration_histogram(stats.withColumn("processing_duration_ms", n * 37 % 311), (10, 50, 200))


_JOBS = "(SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, cents % 500 AS ms FROM ev)"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").otherwise("success")
    return fx.base(spark, d).select(F.col("event_id").alias("job_id"), status.alias("status"), (F.col("cents") % 500).alias("duration_ms"))


@query("r16_job_metrics", sql(f"""SELECT status, CASE WHEN ms <= 100 THEN 0 WHEN ms <= 250 THEN 1 ELSE 2 END AS bucket,
  count(*) AS value, cast(sum(ms) AS bigint) AS sum, min(ms) AS min, max(ms) AS max FROM {_JOBS} GROUP BY ALL UNION ALL
  SELECT status, NULL, count(*), NULL, NULL, NULL FROM {_JOBS} GROUP BY status"""))
def r16(spark: SparkSession, d: str) -> DataFrame:
    processed, durations = job_metrics(_jobs(spark, d), (100, 250))
    return durations.unionByName(processed, allowMissingColumns=True)


@query("r16_job_events", sql(f"""SELECT event_id AS job_id, 'Acme.Worker.JobCompleted' AS event_name, ms AS duration_ms
  FROM {_JOBS} WHERE status = 'success'"""))
def r16_events(spark: SparkSession, d: str) -> DataFrame:
    return job_events(_jobs(spark, d), "Acme").select(
        "job_id", "event_name", F.try_variant_get(F.col("properties")["duration_ms"], "$", "bigint").alias("duration_ms"))


@query("r14_sampled_deliveries", rsql("""SELECT 'all' AS kind, count(*) AS events FROM log WHERE mixed_error
  UNION ALL SELECT 'none', 0 UNION ALL SELECT 'half is a part, the same again', 1"""))
def r14_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries at a rate of one, none and a half; half of the events, twice, are the same between a third and two thirds."""
    env = written(fx.mixed(spark, d, LOGS))

    def sent(rate: float) -> DataFrame:
        opts = CollectorOptions(environment="prod", error_sample_rate=rate)
        return process_logs(env, CTX, opts).deliveries().select("batch_id", "operation_id", "message")

    whole, half = written(sent(1.0)), written(sent(0.5))
    n = lambda df: df.agg(F.count("*").alias("events"))
    same = n(half.join(sent(0.5), ["batch_id", "operation_id", "message"])).crossJoin(
        n(half).withColumnRenamed("events", "half")).crossJoin(n(whole).withColumnRenamed("events", "whole")).select(
        ((F.col("events") == F.col("half")) & (F.col("half") * 3).between(F.col("whole"), F.col("whole") * 2)).cast("bigint").alias("events"))
    parts = [(n(whole), "all"), (n(sent(0.0)), "none"), (same, "half is a part, the same again")]
    rows = [df.select(F.lit(kind).alias("kind"), "events") for df, kind in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("g8_run_metrics", rsql(f"""SELECT 'collector.logs.ingested' AS metric, source_name, {_SAFE} AS tenant_id, NULL AS error_type, cast(sum(sig.n) AS bigint) AS value
  FROM sig JOIN hd USING (batch_id) WHERE signal = 'logs' GROUP BY ALL
  UNION ALL SELECT 'collector.errors.forwarded', source_name, {_SAFE} AS t, NULL, count(*)
  FROM log JOIN hd USING (batch_id) WHERE mixed_error AND log.batch_no % 5 <> 2 GROUP BY ALL
  UNION ALL SELECT 'collector.errors', NULL, NULL, 'transport_publish', 1
  UNION ALL SELECT 'collector.errors', NULL, NULL, 'trace_processing', 1
  UNION ALL SELECT 'collector.processing.duration', source_name, {_SAFE} AS t, NULL, count(*) FROM hd GROUP BY ALL"""))
def g8_run(spark: SparkSession, d: str) -> DataFrame:
    """Counters as one run wrote them: some batches refused by the error sink, the audit topic down; another run fails."""
    path, env = shared_folder(spark), written(fx.mixed(spark, d, LOGS))
    ledger = Ledger(spark, f"{path}/ledger")

    def some(df: DataFrame, epoch: int) -> DataFrame:
        n = F.substring("batch_id", 2, 8).cast("int")
        return df.filter(n % 5 == 2).select("batch_id", F.lit("refused").alias("error"))

    run_batch(env, LOGS, [callable_sink(ERROR_TRACKER, some, "error_events"), table_sink(ALL_SIGNALS, f"{path}/all")], ledger, 1,
              CTX, OPTS, SINKS, callable_sink(AUDIT_TOPIC, _down, "audit", analytics_policy(0)), f"{path}/stats", f"{path}/metrics")
    try:
        run_batch(env.drop("payload"), TRACES, [], ledger, 1, CTX, OPTS, SINKS, metrics=f"{path}/metrics")
        raise AssertionError("envelopes without payload were processed")
    except AnalysisException:
        pass
    return spark.read.schema(METRIC_ROWS).option("recursiveFileLookup", "true").parquet(f"{path}/metrics").select(
        "metric", "source_name", "tenant_id", "error_type", "value")
