"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# SQL fragments shared by the checks: the test tables as domain tables.
EV = """ev AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, 'GPU-' || user_id AS gpu_uuid,
    'node-' || CAST(floor(user_id / 8) AS BIGINT) AS hostname, epoch_us(ts) AS ts_us, ts, value AS score,
    CASE
      WHEN event_type = 'error' AND (user_id % 10 = 0 OR event_id % 40 = 0) THEN 'probe_fail'
      WHEN event_type = 'error' AND event_id % 40 = 1 THEN 'probe_error'
      WHEN event_type = 'click' AND event_id % 25 = 0 THEN 'inference_anomaly'
      WHEN event_type = 'click' AND event_id % 25 = 1 THEN 'training_anomaly'
      WHEN event_type = 'click' AND event_id % 25 = 2 THEN 'invariant_violation'
      WHEN event_type = 'signup' AND event_id % 12 = 0 THEN 'thermal_spike'
      WHEN event_type = 'signup' AND event_id % 12 = 1 THEN 'power_anomaly'
      WHEN event_type = 'signup' AND event_id % 12 = 2 THEN 'ecc_error'
      ELSE 'probe_pass' END AS event_type,
    CAST(event_id % 16 AS INTEGER) AS sm_raw, event_id AS eid
  FROM events),
evn AS (
  SELECT event_id, gpu_uuid, hostname, ts, ts_us, score, event_type,
    CASE WHEN event_type LIKE 'probe_%' THEN sm_raw END AS sm_id,
    CAST(CASE WHEN event_type = 'probe_pass' THEN 1 WHEN event_type = 'probe_fail' THEN 4
      WHEN event_type IN ('probe_error', 'ecc_error') THEN 3
      WHEN event_type IN ('thermal_spike', 'power_anomaly') THEN 2
      ELSE 2 + eid % 3 END AS INTEGER) AS severity
  FROM ev)"""

GPUS = """gpus AS (
  SELECT DISTINCT 'GPU-' || user_id AS gpu_uuid, 'node-' || CAST(floor(user_id / 8) AS BIGINT) AS hostname,
    'model-' || (user_id % 3) AS model, 'driver-' || (user_id % 2) AS driver_version,
    'fw-' || (user_id % 5) AS firmware_version, CAST(user_id % 8 AS INTEGER) AS device_index
  FROM events)"""

_TIER = """CASE WHEN {s} < 0.95 THEN {c} WHEN {s} < 0.99 THEN {q} WHEN {s} < 0.995 THEN {u}
  WHEN {s} < 0.999 THEN {i} ELSE {h} END"""


def tier_sql(score: str) -> str:
    return _TIER.format(s=score, c="'CONDEMN'", q="'QUARANTINE'", u="'SUSPECT'", i="'INCREASED_PROBING'", h="'HEALTHY'")


def rank_sql(score: str) -> str:
    return _TIER.format(s=score, c=4, q=3, u=2, i=1, h=0)


BELIEF = f"""belief AS (
  SELECT *, alpha / (alpha + beta) AS reliability,
    alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)) AS variance,
    {tier_sql('(alpha / (alpha + beta))')} AS tier
  FROM (SELECT gpu_uuid, count(*) FILTER (event_type = 'probe_pass') AS probe_passes,
      count(*) FILTER (event_type = 'probe_fail') AS probe_failures,
      count(*) FILTER (event_type IN ('inference_anomaly','training_anomaly','invariant_violation','probe_error')) AS anomalies,
      200.0 + count(*) FILTER (event_type = 'probe_pass') AS alpha,
      CAST(0.1 AS DOUBLE) + count(*) FILTER (event_type = 'probe_fail') * CAST(1.0 AS DOUBLE)
        + count(*) FILTER (event_type IN ('inference_anomaly','training_anomaly','invariant_violation','probe_error')) * CAST(0.3 AS DOUBLE) AS beta,
      max(ts_us) AS last_updated_us
    FROM evn WHERE event_type NOT IN ('thermal_spike','power_anomaly','ecc_error') GROUP BY 1))"""

TRAJ = f"""traj AS (
  SELECT *, {rank_sql('reliability')} AS tier_rank FROM (
    SELECT *, (200.0 + p) / (200.0 + p + CAST(0.1 AS DOUBLE) + f * CAST(1.0 AS DOUBLE) + a * CAST(0.3 AS DOUBLE)) AS reliability FROM (
      SELECT gpu_uuid, event_id, ts_us, event_type,
        count(*) FILTER (event_type = 'probe_pass') OVER w AS p,
        count(*) FILTER (event_type = 'probe_fail') OVER w AS f,
        count(*) FILTER (event_type IN ('inference_anomaly','training_anomaly','invariant_violation','probe_error')) OVER w AS a
      FROM evn WINDOW w AS (PARTITION BY gpu_uuid ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING))))"""


def with_(*parts: str) -> str:
    recursive = any("RECURSIVE " in p for p in parts)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(p.replace("RECURSIVE ", "") for p in parts) + "\n"


def r6(col: str, alias: str | None = None) -> str:
    return f"round(CAST({col} AS DOUBLE), 6) AS {alias or col}"
