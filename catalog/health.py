"""Health views, listings and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.core import AS_OF, AUTO, CFG, STATES, WIN, W_US, ev, rounded, traj
from catalog.core import match_patterns as _patterns
from catalog.core import quarantine_auto as _auto
from catalog.core import FRAME, PATT
from catalog.registry import BELIEF, EV, GPUS, TRAJ, query, r6, tier_sql, with_
from fleetwatch.config import TelemetryConfig, WindowConfig
from fleetwatch.functions.labels import EVENT_TYPES, format_duration, format_percent, format_quantity
from fleetwatch.functions import labels as L
from fleetwatch.operators import beliefs as B
from fleetwatch.operators import health as H
from fleetwatch.operators import quarantine as Q
from fleetwatch.operators import telemetry as TM
from fleetwatch.sources import adapters as A

RATE_S = 7 * 86_400
_ANOM = "('inference_anomaly', 'training_anomaly', 'invariant_violation')"

HEALTH = f"""hv AS (SELECT g.*, b.alpha, b.beta, b.reliability, b.tier, coalesce(s.state, 'HEALTHY') AS state, s.state_since_us,
    coalesce(r.f, 0) AS failures_per_hour, coalesce(r.a, 0) AS anomalies_per_hour, l.last_probe_us, l.last_anomaly_us
  FROM gpus g LEFT JOIN belief b USING (gpu_uuid) LEFT JOIN states s USING (gpu_uuid)
  LEFT JOIN (SELECT gpu_uuid, count(*) FILTER (event_type = 'probe_fail') / 168.0::DOUBLE AS f, count(*) FILTER (event_type IN {_ANOM}) / 168.0::DOUBLE AS a
    FROM evn WHERE ts_us BETWEEN {AS_OF} - {RATE_S}::BIGINT * 1000000 AND {AS_OF} GROUP BY 1) r USING (gpu_uuid)
  LEFT JOIN (SELECT gpu_uuid, max(ts_us) FILTER (event_type LIKE 'probe_%') AS last_probe_us, max(ts_us) FILTER (event_type IN {_ANOM}) AS last_anomaly_us FROM evn GROUP BY 1) l USING (gpu_uuid))"""
HV = with_(EV, TRAJ, GPUS, AUTO, STATES, BELIEF, HEALTH)


def states(spark, d):
    return Q.current_states(Q.quarantine_auto(traj(spark, d), WIN), A.gpus(spark, d))


def hv(spark, d):
    e = ev(spark, d)
    return H.health_view(
        A.gpus(spark, d), B.gpu_beliefs(e, CFG), states(spark, d), H.rates_as_of(e, AS_OF, RATE_S), H.last_seen(e),
        A.telemetry(spark, d), B.sm_beliefs(e, CFG),
    )


@query(HV + f"""SELECT hv.* EXCLUDE (alpha, beta, reliability, failures_per_hour, anomalies_per_hour), {r6('reliability')}, {r6('failures_per_hour')}, {r6('anomalies_per_hour')},
    {r6('t.temperature_c', 'temperature_c')}, {r6('t.power_w', 'power_w')}, s.n AS sm_count
  FROM hv LEFT JOIN (SELECT 'GPU-' || user_id AS gpu_uuid, arg_max(40 + value % 60, ts) AS temperature_c, arg_max(200 + value, ts) AS power_w FROM events GROUP BY 1) t USING (gpu_uuid)
  LEFT JOIN (SELECT gpu_uuid, count(DISTINCT sm_id) AS n FROM evn WHERE event_type IN ('probe_pass', 'probe_fail') GROUP BY 1) s USING (gpu_uuid)""")
def health_view(spark, d):
    v = hv(spark, d).withColumn("sm_count", F.size("sms").cast("long")).drop("sms", "alpha", "beta")
    return rounded(v, "reliability", "failures_per_hour", "anomalies_per_hour", "temperature_c", "power_w")


@query(HV + f"""SELECT count(*) AS total, count(*) FILTER (state = 'HEALTHY') AS healthy, count(*) FILTER (state = 'SUSPECT') AS suspect, count(*) FILTER (state = 'QUARANTINED') AS quarantined,
  count(*) FILTER (state = 'DEEP_TEST') AS deep_test, count(*) FILTER (state = 'CONDEMNED') AS condemned, {r6('avg(reliability)', 'mean_reliability')} FROM hv""")
def fleet_health(spark, d):
    return rounded(H.fleet_health(hv(spark, d)), "mean_reliability")


@query(HV + f"""SELECT count(*) AS total, {r6('avg(reliability)', 'mean_reliability')}, {r6('min(reliability)', 'min_reliability')}, {r6('avg(failures_per_hour)', 'sdc_rate')},
  count(DISTINCT hostname) AS active_agents FROM hv""")
def fleet_summary(spark, d):
    return rounded(H.fleet_summary(hv(spark, d)), "mean_reliability", "min_reliability", "sdc_rate")


@query(HV + " UNION ALL ".join(
    f"SELECT '{c}' AS attribute, {c} AS cohort, count(*) AS gpus, {r6('avg(reliability)', 'mean_reliability')}, count(*) FILTER (state <> 'HEALTHY') AS unhealthy, {r6('avg(failures_per_hour)', 'mean_failure_rate')} FROM hv GROUP BY {c}"
    for c in ("model", "firmware_version", "hostname")))
def cohorts(spark, d):
    return rounded(H.cohorts(hv(spark, d)), "mean_reliability", "mean_failure_rate")


@query(with_(EV) + "SELECT gpu_uuid, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in EVENT_TYPES) + " FROM evn GROUP BY 1")
def event_type_counts(spark, d):
    return H.event_type_counts(ev(spark, d))


@query(with_(EV) + f"""SELECT gpu_uuid, event_id, ts_us, {r6("count(*) FILTER (event_type = 'probe_fail') OVER w / 72.0::DOUBLE", 'failures_per_hour')},
  {r6(f"count(*) FILTER (event_type IN {_ANOM}) OVER w / 72.0::DOUBLE", 'anomalies_per_hour')} FROM evn
  WINDOW w AS (PARTITION BY gpu_uuid ORDER BY ts_us RANGE BETWEEN {W_US} PRECEDING AND CURRENT ROW)""")
def rolling_rates(spark, d):
    return rounded(H.rolling_rates(ev(spark, d), WIN), "failures_per_hour", "anomalies_per_hour")


@query(with_(EV) + "SELECT gpu_uuid, min(ts_us) AS first_seen_us, max(ts_us) AS last_seen_us, count(*) AS events FROM evn GROUP BY 1")
def asset_inventory(spark, d):
    return H.asset_inventory(ev(spark, d))


@query(with_(EV) + f"""SELECT ts_us // 1800000000 * 1800000000 AS bin_us, count(*) FILTER (event_type LIKE 'probe_%') AS probes,
  {r6("coalesce(count(*) FILTER (event_type = 'probe_fail') / nullif(count(*) FILTER (event_type LIKE 'probe_%'), 0), 0)", 'failure_rate')},
  {r6(f"coalesce(count(*) FILTER (event_type = 'probe_fail' OR event_type IN {_ANOM}) / nullif(count(*) FILTER (event_type LIKE 'probe_%'), 0), 0)", 'sdc_rate')}
  FROM evn GROUP BY 1""")
def failure_rate_series(spark, d):
    return rounded(H.failure_rate_series(ev(spark, d)), "failure_rate", "sdc_rate")


@query(with_(EV) + f"""SELECT count(*) FILTER (event_type LIKE 'probe_%') AS total_probes_24h, count(*) FILTER (event_type IN {_ANOM}) AS anomalies_24h
  FROM evn WHERE ts_us BETWEEN {AS_OF} - 86400000000 AND {AS_OF}""")
def activity_24h(spark, d):
    return H.activity_24h(ev(spark, d), AS_OF)


@query(with_(EV, TRAJ, AUTO, FRAME, PATT) + """SELECT 'events' AS counter, event_type AS label, count(*) AS value FROM evn GROUP BY 2
  UNION ALL SELECT 'patterns', pattern, count(*) FROM patterns GROUP BY 2 UNION ALL SELECT 'actions', action, count(*) FROM auto GROUP BY 2""")
def ingest_counters(spark, d):
    return H.ingest_counters(ev(spark, d), _patterns(spark, d), _auto(spark, d))


START, END = 1_704_758_400_000_000, 1_705_622_400_000_000  # 2024-01-09 .. 2024-01-19


@query(with_(EV) + f"SELECT event_id, gpu_uuid, event_type, ts_us FROM evn WHERE ts_us BETWEEN {START} AND {END} ORDER BY ts_us, event_id LIMIT 500")
def query_events(spark, d):
    return H.query_events(ev(spark, d), None, START, END, 500).select("event_id", "gpu_uuid", "event_type", "ts_us")


@query(with_(EV) + "SELECT event_id, gpu_uuid, ts_us FROM evn WHERE event_type = 'probe_fail'")
def events_of_type(spark, d):
    return H.events_of_type(ev(spark, d), "probe_fail").select("event_id", "gpu_uuid", "ts_us")


@query(with_(EV) + "SELECT event_id, gpu_uuid, ts_us FROM evn WHERE hostname = 'node-3'")
def events_on_host(spark, d):
    return H.events_on_host(ev(spark, d), "node-3").select("event_id", "gpu_uuid", "ts_us")


@query(HV + f"""SELECT gpu_uuid, hostname, model, state, {r6('reliability')}, count(*) OVER () AS total_matching, count(*) OVER () > 20 AS truncated FROM hv
  WHERE hostname LIKE 'node-1%' AND model = 'model-1' AND state IN ('HEALTHY', 'SUSPECT') ORDER BY gpu_uuid LIMIT 20""")
def filter_fleet(spark, d):
    f = H.filter_fleet(hv(spark, d), "node-1", "model-1", ("HEALTHY", "SUSPECT"), 20)
    return rounded(f.select("gpu_uuid", "hostname", "model", "state", "reliability", "total_matching", "truncated"), "reliability")


@query(with_(EV) + "SELECT event_id, gpu_uuid, hostname, event_type FROM evn WHERE contains(lower(gpu_uuid), 'gpu-12') OR contains(lower(hostname), 'gpu-12') OR contains(lower(event_type), 'gpu-12')")
def text_search(spark, d):
    return H.text_search(ev(spark, d), ["gpu_uuid", "hostname", "event_type"], "GPU-12").select("event_id", "gpu_uuid", "hostname", "event_type")


@query("SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')")
def text_search_documents(spark, d):
    return H.text_search(A.documents(spark, d), ["text", "source"], "LICENSE").select("doc_id", "lang", "source")


@query(HV + f"""SELECT hv.gpu_uuid, state, state_since_us, hv.tier, {r6('hv.reliability', 'reliability')}, w.action AS reason, w.event_id AS reason_event, b.probe_failures, b.anomalies
  FROM hv LEFT JOIN (SELECT * FROM auto QUALIFY row_number() OVER (PARTITION BY gpu_uuid ORDER BY ts_us DESC, event_id DESC) = 1) w ON w.gpu_uuid = hv.gpu_uuid
  LEFT JOIN belief b ON b.gpu_uuid = hv.gpu_uuid WHERE state <> 'HEALTHY'""")
def quarantine_queue(spark, d):
    queue = Q.quarantine_queue(hv(spark, d)).select("gpu_uuid", "state", "state_since_us", "tier", "reliability")
    return rounded(Q.queue_reasons(queue, _auto(spark, d), B.gpu_beliefs(ev(spark, d), CFG)), "reliability")


@query(HV + "SELECT gpu_uuid FROM states WHERE state = 'HEALTHY'")
def available_gpus(spark, d):
    return H.available_gpus(states(spark, d))


@query(with_(EV) + "SELECT event_id, severity FROM evn WHERE severity BETWEEN 2 AND 3")
def severity_band(spark, d):
    return H.severity_band(ev(spark, d), 2, 3).select("event_id", "severity")


@query(with_(EV) + "SELECT event_id, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS timestamp, severity, score FROM evn")
def event_summary(spark, d):
    return H.event_summary(ev(spark, d))


@query(with_(EV, BELIEF) + f"SELECT gpu_uuid, {r6('reliability')}, tier FROM belief ORDER BY reliability, gpu_uuid LIMIT 25")
def worst_gpus(spark, d):
    return rounded(H.worst_gpus(B.gpu_beliefs(ev(spark, d), CFG), 25).select("gpu_uuid", "reliability", "tier"), "reliability")


@query(with_(EV, BELIEF) + f"SELECT gpu_uuid, {r6('reliability')}, rank() OVER (ORDER BY reliability)::INTEGER AS rank, dense_rank() OVER (ORDER BY reliability)::INTEGER AS dense_rank FROM belief ORDER BY reliability, gpu_uuid LIMIT 25")
def rank_worst(spark, d):
    return rounded(H.rank_worst(B.gpu_beliefs(ev(spark, d), CFG), 25), "reliability")


@query(with_(EV) + "SELECT gpu_uuid, event_id, ts_us FROM evn QUALIFY row_number() OVER (PARTITION BY gpu_uuid ORDER BY ts_us DESC, event_id) <= 10")
def ring_buffer(spark, d):
    return H.ring_buffer(ev(spark, d), 10, WIN).select("gpu_uuid", "event_id", "ts_us")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 200")
def page_after(spark, d):
    return H.page(A.table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 500, 200)


@query("SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders) AS total_count FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 200")
def page_with_total(spark, d):
    return H.page_with_total(A.table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 500, 200)


@query(with_(EV) + "SELECT gpu_uuid, event_id, score FROM evn WHERE event_type LIKE 'probe_%' ORDER BY score DESC, event_id")
def sort_probes(spark, d):
    p = ev(spark, d).filter(F.col("event_type").startswith("probe_")).select("gpu_uuid", "event_id", "score")
    return H.sort_by(p, "score", True, "event_id")


@query(with_(EV) + f"SELECT event_id, ts_us FROM evn WHERE ts_us BETWEEN {AS_OF} - {W_US} AND {AS_OF} ORDER BY ts_us, event_id")
def all_recent_events(spark, d):
    return H.all_recent_events(ev(spark, d), AS_OF, WIN).select("event_id", "ts_us")


@query(with_(EV) + "SELECT DISTINCT gpu_uuid FROM evn")
def active_gpus(spark, d):
    return H.active_gpus(ev(spark, d))


@query(with_(EV, GPUS) + "SELECT e.event_id, e.gpu_uuid, g.model, g.firmware_version, g.device_index FROM evn e LEFT JOIN gpus g USING (gpu_uuid)")
def enrich_identity(spark, d):
    e = ev(spark, d).select("event_id", "gpu_uuid")
    return H.enrich_identity(e, A.gpus(spark, d)).select("event_id", "gpu_uuid", "model", "firmware_version", "device_index")


@query(with_(EV, TRAJ, AUTO, FRAME, PATT) + f"""SELECT * FROM (
  SELECT 'transition' AS kind, event_id, ts_us, action AS label FROM auto WHERE gpu_uuid = 'GPU-10'
  UNION ALL SELECT 'correlation', event_id, ts_us, pattern FROM patterns WHERE gpu_uuid = 'GPU-10'
  UNION ALL SELECT 'reliability', NULL, ts_us, NULL FROM traj WHERE gpu_uuid = 'GPU-10') WHERE ts_us BETWEEN {START} AND {END}""")
def gpu_history(spark, d):
    t = traj(spark, d)
    h = H.gpu_history("GPU-10", START, END, _auto(spark, d), _patterns(spark, d), t)
    a = h["transitions"].select(F.lit("transition").alias("kind"), "event_id", "ts_us", F.col("action").alias("label"))
    b = h["correlations"].select(F.lit("correlation").alias("kind"), "event_id", "ts_us", F.col("pattern").alias("label"))
    null = F.lit(None).cast("string")
    c = h["reliability"].select(F.lit("reliability").alias("kind"), null.alias("event_id"), "ts_us", null.alias("label"))
    return a.unionByName(b).unionByName(c)


@query(with_(EV, BELIEF) + """SELECT gpu_uuid, printf('%.2f%%', reliability * 100) AS percent,
  CASE WHEN last_updated_us >= 1000000 THEN printf('%.2fM', last_updated_us / 1e6) ELSE '' END AS quantity,
  CASE WHEN ms // 1000 < 60 THEN printf('%ds', ms // 1000) WHEN ms // 60000 < 60 THEN printf('%dm %ds', ms // 60000, ms // 1000 % 60)
    WHEN ms // 3600000 < 24 THEN printf('%dh %dm', ms // 3600000, ms // 60000 % 60) ELSE printf('%dd %dh', ms // 86400000, ms // 3600000 % 24) END AS age
  FROM (SELECT *, (1706659200000000 - last_updated_us) // 1000 AS ms FROM belief)""")
def display_strings(spark, d):
    b = B.gpu_beliefs(ev(spark, d), CFG)
    ms = F.floor((F.lit(AS_OF) - F.col("last_updated_us")) / 1000)
    return b.select("gpu_uuid", format_percent(F.col("reliability")).alias("percent"),
                    format_quantity(F.col("last_updated_us")).alias("quantity"), format_duration(ms).alias("age"))


@query(with_(EV) + """SELECT event_id, CASE severity WHEN 1 THEN 'INFO' WHEN 2 THEN 'WARNING' WHEN 3 THEN 'HIGH' WHEN 4 THEN 'CRITICAL' ELSE 'UNSPECIFIED' END AS severity_label,
  strftime(ts, '%Y_%m') AS month, CAST(date_trunc('month', ts) + INTERVAL 1 MONTH AS DATE)::VARCHAR AS next_month, sha256(concat_ws(':', event_id, gpu_uuid, event_type)) AS event_key, ts_us // 1000 AS ts_ms FROM evn""")
def labels_and_dates(spark, d):
    return ev(spark, d).select(
        "event_id", L.severity_label(F.col("severity")).alias("severity_label"), L.month_key(F.col("ts")).alias("month"),
        L.next_month_start(F.col("ts")).cast("string").alias("next_month"),
        L.event_key(F.col("event_id"), F.col("gpu_uuid"), F.col("event_type")).alias("event_key"),
        F.unix_millis("ts").alias("ts_ms"),
    )


# --- telemetry ---------------------------------------------------------------------

TCFG = TelemetryConfig(rolling_seconds=3 * 86_400, rate_seconds=86_400)
CH = WIN.chunk_us
TEL = """tel AS (SELECT CAST(event_id AS VARCHAR) AS event_id, 'GPU-' || user_id AS gpu_uuid, epoch_us(ts) AS ts_us, 40 + value % 60 AS temperature_c, event_id % 97 = 0 AS throttle_active,
    200 + value AS power_w, 700.0::DOUBLE AS power_limit_w, event_id % 89 = 0 AS power_throttle_active, CAST(floor(value / 200) AS BIGINT) AS dram_uncorrected, CAST(floor(value / 10) AS BIGINT) AS dram_corrected FROM events)"""
_TW = f"WINDOW w AS (PARTITION BY gpu_uuid ORDER BY ts_us RANGE BETWEEN {3 * 86_400_000_000} PRECEDING AND CURRENT ROW), u AS (PARTITION BY gpu_uuid ORDER BY ts_us ROWS UNBOUNDED PRECEDING)"


@query(with_(TEL) + f"""SELECT gpu_uuid, event_id, ts_us, {r6('temperature_c')}, {r6('max(temperature_c) OVER u', 'max_temp_c')}, {r6('avg(temperature_c) OVER w', 'avg_temp_c')},
  temperature_c >= 85 AS warning, temperature_c >= 95 AS critical, temperature_c >= 80 OR throttle_active AS backoff FROM tel {_TW}""")
def thermal_state(spark, d):
    return rounded(TM.thermal_state(A.telemetry(spark, d), TCFG, CH), "temperature_c", "max_temp_c", "avg_temp_c")


@query(with_(TEL) + """SELECT a.gpu_uuid, a.event_id, a.ts_us, round(coalesce((any_value(a.temperature_c) - arg_max(b.temperature_c, b.ts_us)) / ((a.ts_us - max(b.ts_us)) // 1000 / 1000.0::DOUBLE), 0), 9) AS temp_rate
  FROM tel a LEFT JOIN tel b ON b.gpu_uuid = a.gpu_uuid AND b.ts_us <= a.ts_us - 86400000000 AND b.ts_us >= a.ts_us - 259200000000 GROUP BY 1, 2, 3""")
def temp_rate(spark, d):
    return TM.temp_rate(A.telemetry(spark, d), TCFG, CH).withColumn("temp_rate", F.round("temp_rate", 9))


@query(with_(TEL) + f"""SELECT gpu_uuid, event_id, ts_us, {r6('power_w')}, {r6('max(power_w) OVER u', 'max_power_w')}, {r6('avg(power_w) OVER w', 'avg_power_w')}, {r6('power_limit_w - power_w', 'headroom_w')},
  power_w >= power_limit_w * 0.9::DOUBLE OR power_throttle_active AS stressed FROM tel {_TW}""")
def power_state(spark, d):
    return rounded(TM.power_state(A.telemetry(spark, d), TCFG, CH), "power_w", "max_power_w", "avg_power_w", "headroom_w")


@query(with_(TEL, "lagged AS (SELECT *, lag(dram_corrected) OVER (PARTITION BY gpu_uuid ORDER BY ts_us, event_id) AS before FROM tel)") + f"""
  SELECT gpu_uuid, event_id, ts_us, 'thermal_spike' AS event_type, CASE WHEN temperature_c >= 95 OR throttle_active THEN 4 ELSE 2 END AS severity, {r6('temperature_c', 'score')} FROM lagged WHERE temperature_c >= 85 OR throttle_active
  UNION ALL SELECT gpu_uuid, event_id, ts_us, 'power_anomaly', 2, {r6('power_w', 'score')} FROM lagged WHERE power_w >= power_limit_w * 0.9::DOUBLE OR power_throttle_active
  UNION ALL SELECT gpu_uuid, event_id, ts_us, 'ecc_error', CASE WHEN dram_uncorrected > 0 THEN 4 ELSE 2 END, dram_uncorrected FROM lagged WHERE dram_uncorrected > 0 OR dram_corrected > before""")
def telemetry_events(spark, d):
    return rounded(TM.telemetry_events(A.telemetry(spark, d), TCFG, CH), "score")


@query(with_(EV, TEL) + f"""SELECT p.event_id, p.gpu_uuid, p.ts_us, t.ts_us AS reading_us, {r6('t.temperature_c', 'temperature_c')}, t.throttle_active
  FROM (SELECT event_id, gpu_uuid, ts_us - 3600000000 AS ts_us FROM evn WHERE event_type LIKE 'probe_%') p ASOF LEFT JOIN tel t ON p.gpu_uuid = t.gpu_uuid AND p.ts_us >= t.ts_us""")
def telemetry_asof(spark, d):
    p = ev(spark, d).filter(F.col("event_type").startswith("probe_"))
    p = p.select("event_id", "gpu_uuid", (F.col("ts_us") - 3_600_000_000).alias("ts_us"))
    return rounded(TM.telemetry_asof(p, A.telemetry(spark, d), CH), "temperature_c")
