"""Oracle SQL building blocks: the fixtures' meaning straight from ``events``, payload-free."""

from __future__ import annotations


def _tenant(n: str) -> str:
    return (f"CASE WHEN {n} % 4 = 0 THEN repeat('0', 26) "
            f"WHEN {n} % 4 = 1 THEN '01ARZ3NDEKTSV4RRFFQ69G5F' || lpad(cast({n} % 100 AS varchar), 2, '0') "
            f"WHEN {n} % 4 = 2 THEN 'tenant-acme' END")


def safe(t: str) -> str:
    return (f"CASE WHEN regexp_full_match({t}, '[0-9A-HJKMNP-TV-Za-hjkmnp-tv-z]{{26}}') "
            f"AND {t} <> repeat('0', 26) THEN {t} END")


LONG_KEY = "attribute.key.of.exactly.forty.character"
CUT_KEY = LONG_KEY[:32]

EV = f"""raw AS (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS ms,
         cast(json_extract_string(props, '$.k') AS int) AS k, event_id // 4 AS batch_no, event_id % 4 AS pos,
         'b' || lpad(cast(event_id // 4 AS varchar), 8, '0') AS batch_id,
         CASE WHEN event_id % 5 = 0 THEN upper('svc-' || (user_id % 7)) ELSE 'svc-' || (user_id % 7) END AS svc,
         cast(floor(value * 100) AS bigint) AS cents, {_tenant('user_id')} AS tenant
  FROM events),
ev AS (
  SELECT *, md5(batch_id) AS trace_id, lpad(lower(to_hex(event_id)), 16, '0') AS span_id,
         CASE WHEN event_id % 4 > 0 THEN lpad(lower(to_hex(event_id - 1)), 16, '0') END AS parent_span_id,
         CASE event_type WHEN 'click' THEN 5 WHEN 'signup' THEN 13
              WHEN 'error' THEN CASE WHEN value >= 200 THEN 21 ELSE 17 END ELSE 9 END AS sev,
         CASE event_type WHEN 'click' THEN 'DEBUG' WHEN 'view' THEN 'INFO' WHEN 'signup' THEN 'WARN'
              WHEN 'purchase' THEN CASE WHEN value >= 250 THEN 'Critical' ELSE 'INFO' END
              ELSE CASE WHEN value >= 200 THEN 'FATAL' ELSE 'ERROR' END END AS sev_text,
         event_type || ' by ' || user_id AS body,
         CASE WHEN value > 100 THEN 'True' ELSE 'False' END AS big,
         (event_type = 'error' AND k % 2 = 0) AS has_exc,
         ((event_type = 'error' AND k % 3 = 0) OR (event_type = 'view' AND k = 13)) AS has_msg,
         CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'E' || (k % 5) END AS exc_type,
         'msg ' || k AS msg,
         CASE WHEN event_type = 'error' AND value >= 50 THEN 2 WHEN event_type = 'purchase' THEN 1 END AS status_code,
         CASE WHEN k % 4 = 0 THEN 'status ' || k END AS status_message
  FROM raw),
log AS (
  SELECT *, CASE WHEN has_msg THEN msg END AS exc_msg,
         (sev >= 17 OR upper(sev_text) IN ('ERROR', 'FATAL', 'CRITICAL') OR has_exc OR has_msg) AS json_error,
         (sev >= 17 OR has_exc OR has_msg) AS proto_error,
         CASE WHEN batch_no % 2 = 0 THEN proto_error ELSE json_error END AS mixed_error FROM ev),
sp AS (
  SELECT *, CASE WHEN has_exc AND k % 3 = 0 THEN msg END AS exc_msg,
         CASE WHEN has_exc THEN 'at line ' || k END AS stack,
         (coalesce(status_code = 2, false) OR has_exc) AS is_error FROM ev),
bt AS (
  SELECT batch_no, batch_id, count(*) AS n, min(us) AS first_us, arg_min(ms, event_id) AS received_ms,
         arg_min(svc, event_id) AS first_svc, max(sev) AS max_sev,
         CASE WHEN batch_no % 3 = 1 THEN 'APPLICATION/JSON; charset=utf-8' ELSE 'application/json' END AS content_type,
         CASE WHEN batch_no % 4 = 0 THEN 'hdr-' || (batch_no % 3) END AS header_source,
         CASE WHEN batch_no % 6 = 0 THEN 'node-' || (batch_no % 5) END AS header_node_id,
         CASE WHEN batch_no % 8 <> 1 THEN {_tenant('batch_no')} END AS header_tenant,
         {_tenant('batch_no')} AS header_tenant_alt
  FROM ev GROUP BY batch_no, batch_id),
hd AS (
  SELECT *, coalesce(header_source, first_svc) AS source_name,
         coalesce(header_tenant, header_tenant_alt) AS batch_tenant FROM bt),
an AS (
  SELECT ev.*, CASE WHEN event_id % 6 <> 5 THEN ms ELSE hd.received_ms END AS ts_ms, received_ms,
         CASE WHEN event_id % 5 = 0 THEN 'd-' || user_id END AS distinct_id,
         CASE WHEN event_id % 5 IN (1, 2) THEN 'u-' || user_id END AS uid,
         CASE WHEN event_id % 5 = 3 THEN 's-' || user_id END AS session_id,
         CASE WHEN event_id % 5 = 4 AND event_id % 25 <> 24 THEN 'c-' || user_id END AS correlation_id,
         CASE WHEN event_id % 3 = 0 THEN 'node-' || (event_id % 4) END AS node_id,
         CASE WHEN event_id % 7 = 0 THEN 'staging' END AS environment,
         coalesce(CASE WHEN batch_no % 3 = 0 THEN 'app-' || (batch_no % 5) END, header_source) AS an_source,
         coalesce(CASE WHEN batch_no % 5 = 0 THEN 'src-' || (batch_no % 3) END, header_node_id) AS an_node,
         batch_tenant AS an_header_tenant
  FROM ev JOIN hd USING (batch_no, batch_id)),
er AS (
  SELECT ev.*, 'r' || lpad(cast(event_id AS varchar), 8, '0') AS report_id,
         CASE WHEN k % 10 <> 9 THEN 'failure ' || k END AS message,
         CASE WHEN k % 2 = 1 THEN k % 5 ELSE 3 END AS severity, 'at ' || k AS stack,
         CASE WHEN event_id % 3 = 0 THEN md5('r' || lpad(cast(event_id AS varchar), 8, '0')) END AS correlation_id,
         CASE WHEN event_id % 4 = 0 THEN span_id END AS operation_id,
         CASE WHEN event_id % 5 = 0 THEN 'node-err' END AS node_id, 'u-' || user_id AS uid,
         CASE WHEN event_id % 7 = 0 THEN 'staging' END AS environment,
         CASE WHEN event_id % 4 = 0 THEN 'hdr-' || (event_id % 3) END AS source_name,
         coalesce(tenant, {_tenant('event_id')}) AS er_tenant
  FROM ev WHERE event_type = 'error')"""


def sql(body: str) -> str:
    return f"WITH {EV}\n{body}"


def values(*pairs: tuple[str, str, str]) -> str:
    """Lateral list of (key, value, condition) rows, conditions applied."""
    rows = ", ".join(f"('{k}', cast({v} AS varchar), {c})" for k, v, c in pairs)
    return f"(SELECT a AS key, b AS value FROM (VALUES {rows}) t(a, b, c) WHERE c AND b IS NOT NULL)"
