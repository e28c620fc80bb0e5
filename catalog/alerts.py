"""Alerts and evaluation."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from catalog.core import AUTO, CFG, FRAME, PATT, WIN, W_US, ev, rounded
from catalog.core import match_patterns as _patterns
from catalog.core import quarantine_auto as _auto
from catalog.health import TEL
from catalog.registry import EV, GPUS, TRAJ, query, r6, with_
from fleetwatch.operators import alerts as AL
from fleetwatch.operators import evaluation as EVAL
from fleetwatch.plans.cut import cut, shared_path
from fleetwatch.sources import adapters as A
from fleetwatch.sources import readers as R

_ARMS = []


def _arm(src, where, oid, rule, severity, cooldown, group="gpu_uuid", host="hostname"):
    _ARMS.append(f"""SELECT '{rule}' AS rule, '{severity}' AS severity, {cooldown} AS cooldown_seconds, {oid} AS observation_id, ts_us, gpu_uuid, {host} AS hostname,
      '{rule}:' || coalesce({group}, 'all') AS dedup_key FROM {src} WHERE {where}""")


_arm("probes", "event_type = 'probe_fail'", "event_id", "probe_single_failure", "WARNING", 300)
_arm("probes", "event_type = 'probe_fail' AND streak >= 3", "event_id", "probe_consecutive_failures", "HIGH", 60)
_arm("probes", "event_type = 'probe_fail' AND sms >= 3", "event_id", "probe_multi_sm_failure", "CRITICAL", 0)
_arm("evn", "event_type = 'inference_anomaly' AND severity = 2", "event_id", "inference_anomaly_warning", "WARNING", 600)
_arm("evn", "event_type = 'inference_anomaly' AND severity = 3", "event_id", "inference_anomaly_high", "HIGH", 120)
_arm("evn", "event_type = 'inference_anomaly' AND severity >= 4", "event_id", "inference_anomaly_critical", "CRITICAL", 0)
_arm("evn", "event_type = 'invariant_violation'", "event_id", "invariant_violation", "CRITICAL", 0)
_arm("auto", "action = 'quarantine'", "gpu_uuid || ':' || event_id || ':' || action", "gpu_quarantined", "HIGH", 0, host="NULL::VARCHAR")
_arm("auto", "action = 'condemn'", "gpu_uuid || ':' || event_id || ':' || action", "gpu_condemned", "CRITICAL", 0, host="NULL::VARCHAR")
_arm("patterns", "confidence >= 0.8", "concat_ws(':', event_id, pattern, sm_id)", "high_confidence_correlation", "HIGH", 120, host="NULL::VARCHAR")
_arm("telx", "throttle_active", "'t' || event_id", "gpu_thermal_throttle", "WARNING", 600, host="NULL::VARCHAR")
_arm("telx", "dram_uncorrected > 0", "'t' || event_id", "gpu_ecc_uncorrected", "CRITICAL", 0, host="NULL::VARCHAR")
_arm("telx", "retired", "'t' || event_id", "gpu_retired_pages", "HIGH", 3600, host="NULL::VARCHAR")

PROBES = f"""isl AS (SELECT *, count(*) FILTER (event_type <> 'probe_fail') OVER (PARTITION BY gpu_uuid ORDER BY ts_us, event_id) AS island FROM evn WHERE event_type LIKE 'probe_%'),
stk AS (SELECT *, count(*) FILTER (event_type = 'probe_fail') OVER (PARTITION BY gpu_uuid, island ORDER BY ts_us, event_id) AS streak FROM isl),
smc AS (SELECT event_id, len(list_distinct(list(sm_id) OVER (PARTITION BY gpu_uuid ORDER BY ts_us RANGE BETWEEN {W_US} PRECEDING AND CURRENT ROW))) AS sms FROM evn WHERE event_type = 'probe_fail'),
probes AS (SELECT stk.*, smc.sms FROM stk LEFT JOIN smc USING (event_id)),
telx AS (SELECT tel.*, CAST(event_id AS BIGINT) % 500 = 0 AS retired FROM tel)"""
ALERTS = "alerts AS (SELECT *, sha256(dedup_key || ':' || observation_id) AS alert_id FROM (" + "\n UNION ALL ".join(_ARMS) + "))"
ALL = with_(EV, TRAJ, AUTO, FRAME, PATT, TEL, PROBES, ALERTS)


def observations(spark, d):
    e = ev(spark, d)
    parts = [
        AL.probe_observations(e, WIN, WIN.window_seconds), AL.anomaly_observations(e), AL.quarantine_observations(_auto(spark, d)),
        AL.correlation_observations(_patterns(spark, d)), AL.telemetry_observations(A.telemetry(spark, d)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fired(spark, d):
    return cut(AL.alert_rules(observations(spark, d)))


@query(ALL + "SELECT rule, severity, cooldown_seconds, observation_id, ts_us, gpu_uuid, hostname, dedup_key, alert_id FROM alerts")
def alert_rules(spark, d):
    return fired(spark, d).drop("channels")


# Rules as a settings document, with nested conditions and channels of other names.
_DOCUMENT = {
    "global": {"default_cooldown_seconds": 300},
    "rules": [
        {"name": "probe_consecutive_failures", "condition": {"event_type": "probe_result", "result": "FAIL", "consecutive_count": 3},
         "severity": "HIGH", "channels": ["talk", "pager"], "cooldown_seconds": 60},
        {"name": "inference_anomaly_high", "condition": {"event_type": "anomaly", "source": "INFERENCE_MONITOR", "min_severity": "HIGH", "max_severity": "HIGH"},
         "severity": "HIGH", "channels": ["talk"], "cooldown_seconds": 120, "group_by": "gpu_uuid"},
        {"name": "gpu_condemned", "condition": {"event_type": "quarantine", "action": "CONDEMN"}, "severity": "CRITICAL", "channels": ["email"], "cooldown_seconds": 0},
        {"name": "high_confidence_correlation", "condition": {"event_type": "correlation", "min_confidence": 0.8}, "severity": "HIGH", "cooldown_seconds": 120},
        {"name": "gpu_thermal_throttle", "condition": {"event_type": "telemetry", "thermal_throttle": True}, "severity": "WARNING", "cooldown_seconds": 600},
        {"name": "gpu_ecc_uncorrected", "condition": {"event_type": "telemetry", "ecc_uncorrected_gt": 0}, "severity": "CRITICAL", "cooldown_seconds": 0},
        {"name": "probe_single_failure", "condition": {"event_type": "probe_result", "result": ["FAIL"], "window_seconds": 600}, "severity": "WARNING"},
    ],
}
_NAMED = ", ".join(f"'{r['name']}'" for r in _DOCUMENT["rules"])


@query(ALL + f"""SELECT rule, severity, cooldown_seconds, observation_id, ts_us, gpu_uuid, dedup_key, alert_id,
  CASE rule WHEN 'probe_consecutive_failures' THEN 'chat,pager' WHEN 'inference_anomaly_high' THEN 'chat' WHEN 'gpu_condemned' THEN 'email' ELSE '' END AS channels
  FROM alerts WHERE rule IN ({_NAMED})""")
def rules_from_document(spark, d):
    path = shared_path(spark, "rules")
    spark.createDataFrame([(json.dumps(_DOCUMENT),)], "value string").coalesce(1).write.text(path)
    rules = R.read_rules(spark, path, {"talk": "chat"})
    return AL.alert_rules(observations(spark, d), rules).drop("hostname").withColumn("channels", F.array_join("channels", ","))


# Coarser cooldowns than the rules' own, so that suppression happens in the test tables.
_SLOW = "slow AS (SELECT *, cooldown_seconds * 1000::BIGINT AS cool FROM alerts)"
DEDUP = """num AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY ts_us, alert_id) AS n FROM slow WHERE cool > 0),
RECURSIVE walk AS (SELECT dedup_key, n, alert_id, true AS sent, ts_us AS last FROM num WHERE n = 1
  UNION ALL SELECT m.dedup_key, m.n, m.alert_id, m.ts_us - w.last >= m.cool * 1000000, CASE WHEN m.ts_us - w.last >= m.cool * 1000000 THEN m.ts_us ELSE w.last END
  FROM walk w JOIN num m ON m.dedup_key = w.dedup_key AND m.n = w.n + 1),
sent AS (SELECT alert_id FROM walk WHERE sent UNION ALL SELECT alert_id FROM slow WHERE cool = 0)"""
DED = with_(EV, TRAJ, AUTO, FRAME, PATT, TEL, PROBES, ALERTS, _SLOW, DEDUP)


def deduped(spark, d):
    return AL.dedup_alerts(fired(spark, d).withColumn("cooldown_seconds", F.col("cooldown_seconds") * 1000), 10 * 86_400_000_000)


@query(DED + "SELECT * FROM sent")
def dedup_alerts(spark, d):
    return deduped(spark, d).select("alert_id")


@query(ALL + "SELECT alert_id, ts_us FROM alerts QUALIFY row_number() OVER (PARTITION BY ts_us // 60000000 ORDER BY ts_us, alert_id) <= 2")
def cap_alerts(spark, d):
    return AL.cap_alerts(fired(spark, d), 2).select("alert_id", "ts_us")


@query(ALL + "SELECT rule, dedup_key, count(*) AS alerts, min(ts_us) AS first_us, max(ts_us) AS last_us FROM alerts GROUP BY rule, dedup_key, ts_us // 86400000000")
def aggregate_similar(spark, d):
    return AL.aggregate_similar(fired(spark, d), 86_400)


@query(with_(EV, TRAJ, AUTO, FRAME, PATT, TEL, PROBES, ALERTS) + """SELECT rule, dedup_key, count(*) AS alerts, min(ts_us) AS first_us, max(ts_us) AS last_us FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY rule, dedup_key ORDER BY ts_us, alert_id) AS session FROM (
    SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY rule, dedup_key ORDER BY ts_us, alert_id) < 86400000000 THEN 0 ELSE 1 END AS fresh FROM alerts)) GROUP BY rule, dedup_key, session""")
def aggregate_sessions(spark, d):
    return AL.aggregate_similar(fired(spark, d), 86_400, session=True)


AT = 1_706_659_200_000_000


@query(with_(EV) + f"""SELECT hostname, last_us, ts_us AS back_us FROM (SELECT hostname, ts_us, lag(ts_us) OVER (PARTITION BY hostname ORDER BY ts_us, event_id) AS last_us FROM evn) WHERE ts_us - last_us > 14400000000
  UNION ALL SELECT hostname, max(ts_us), NULL FROM evn GROUP BY 1 HAVING {AT} - max(ts_us) > 14400000000""")
def heartbeat_lost(spark, d):
    return AL.heartbeat_lost(ev(spark, d), 14_400, AT, WIN.chunk_us)


@query(with_(EV, GPUS) + f"SELECT DISTINCT hostname FROM gpus EXCEPT SELECT hostname FROM evn WHERE ts_us BETWEEN {AT} - 1800000000 AND {AT}")
def silent_hosts(spark, d):
    return AL.silent_hosts(A.gpus(spark, d), ev(spark, d), AT, 1_800)


@query(ALL + """SELECT alert_id, severity, channel, dedup_key FROM alerts, (VALUES ('chat'), ('webhook'), ('pager')) c(channel) WHERE channel <> 'pager' OR severity IN ('HIGH', 'CRITICAL')""")
def route_alerts(spark, d):
    f = fired(spark, d)
    r = AL.route_alerts(f)
    return r.join(f.select("alert_id", "dedup_key"), "alert_id").select("alert_id", "severity", "channel", "dedup_key")


# --- evaluation --------------------------------------------------------------------

GOLD = """act AS (SELECT l_orderkey AS run, l_partkey AS idx, l_linenumber AS line, CAST(CAST(CAST(900 + l_partkey / 10 AS FLOAT) AS DOUBLE) + CASE WHEN l_returnflag = 'R' THEN l_linenumber % 4 ELSE 0 END * pow(2, -14) AS FLOAT) AS a FROM lineitem),
cmp AS (SELECT *, CASE WHEN probe_type = 'TRANSCENDENTAL' THEN ulps <= 1 ELSE a = e END AS ok FROM (SELECT run, idx, line, a, e, probe_type, CAST(abs(a::DOUBLE - e::DOUBLE) / pow(2, floor(log2(least(a, e)::DOUBLE)) - 23) AS BIGINT) AS ulps
  FROM act JOIN (SELECT p_partkey, CAST(900 + p_partkey / 10 AS FLOAT) AS e, CASE WHEN p_type = 'ECONOMY' THEN 'TRANSCENDENTAL' WHEN p_type = 'SMALL' THEN 'FMA' ELSE 'TENSOR_CORE' END AS probe_type FROM part) ON idx = p_partkey))"""


def compared(spark, d):
    li = A.table(spark, d, "lineitem")
    off = F.when(F.col("l_returnflag") == "R", F.col("l_linenumber") % 4).otherwise(0) * F.lit(2.0**-14)
    price = lambda c: (900 + F.col(c) / 10).cast("float")
    actual = li.select(
        F.col("l_orderkey").alias("run"), F.col("l_partkey").alias("index"), F.col("l_linenumber").alias("line"),
        (price("l_partkey").cast("double") + off).cast("float").alias("actual_result"),
    )
    kind = F.when(F.col("p_type") == "ECONOMY", "TRANSCENDENTAL").when(F.col("p_type") == "SMALL", "FMA").otherwise("TENSOR_CORE")
    golden = A.table(spark, d, "part").select(F.col("p_partkey").alias("index"), kind.alias("probe_type"), price("p_partkey").alias("expected_result"))
    return EVAL.golden_compare(actual, golden, ["index"])


@query(with_(GOLD) + "SELECT run, idx, line, probe_type, ulps, ok FROM cmp")
def golden_compare(spark, d):
    return compared(spark, d).select("run", F.col("index").alias("idx"), "line", "probe_type", "ulps", "ok")


@query(with_(GOLD) + "SELECT probe_type, count(*) AS total, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (NOT ok) = 0 AS ok FROM cmp GROUP BY 1")
def golden_report(spark, d):
    return EVAL.golden_report(compared(spark, d))


@query(with_(GOLD) + "SELECT probe_type, count(*) AS details FROM (SELECT * FROM cmp WHERE NOT ok QUALIFY row_number() OVER (PARTITION BY probe_type ORDER BY idx, line) <= 64) GROUP BY 1")
def mismatch_details(spark, d):
    m = EVAL.mismatch_details(compared(spark, d), ["probe_type"], 64)
    return m.groupBy("probe_type").agg(F.count("*").alias("details"))


INJ = """inj AS (SELECT 'order-' || o_orderkey AS scenario, o_custkey % 50 AS gpu_index, epoch_us(o_orderdate) AS injected_us, CASE WHEN o_orderkey % 2 = 0 THEN 'probe' ELSE 'inference' END AS expected_layer, 8640000.0::DOUBLE AS expected_time_s FROM orders),
det AS (SELECT l_suppkey % 50 AS gpu_index, epoch_us(l_shipdate) AS ts_us, CASE WHEN l_returnflag = 'R' THEN 'probe' WHEN l_returnflag = 'A' THEN 'inference' ELSE 'training' END AS layer, l_discount AS confidence FROM lineitem WHERE l_suppkey % 50 < 45 OR l_shipdate < TIMESTAMP '1996-01-01'),
scd AS (SELECT i.*, coalesce(d.n, 0) > 0 AS detected, d.t FROM inj i LEFT JOIN (SELECT i.scenario, count(*) AS n, min(d.ts_us) FILTER (d.layer = i.expected_layer) AS t FROM inj i JOIN det d ON d.gpu_index = i.gpu_index AND d.ts_us >= i.injected_us GROUP BY 1) d USING (scenario)),
res AS (SELECT scenario, gpu_index, injected_us, expected_layer, expected_time_s, detected, (t - injected_us) / 1e6 AS latency_s, t IS NOT NULL AS layer_match, coalesce((t - injected_us) / 1e6 <= expected_time_s, false) AS within_budget FROM scd)"""


def scored(spark, d):
    o, li = A.table(spark, d, "orders"), A.table(spark, d, "lineitem")
    inj = o.select(
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("scenario"), (F.col("o_custkey") % 50).alias("gpu_index"),
        A.micros(F.col("o_orderdate")).alias("injected_us"), F.when(F.col("o_orderkey") % 2 == 0, "probe").otherwise("inference").alias("expected_layer"),
        F.lit(8_640_000.0).alias("expected_time_s"),
    )
    det = li.filter("l_suppkey % 50 < 45 OR l_shipdate < '1996-01-01'").select(
        (F.col("l_suppkey") % 50).alias("gpu_index"), A.micros(F.col("l_shipdate")).alias("ts_us"),
        F.when(F.col("l_returnflag") == "R", "probe").when(F.col("l_returnflag") == "A", "inference").otherwise("training").alias("layer"),
        F.col("l_discount").alias("confidence"),
    )
    return EVAL.score_detections(inj, det, 365 * 86_400_000_000)


@query(with_(INJ) + "SELECT scenario, gpu_index, injected_us, expected_layer, detected, round(latency_s, 3) AS latency_s, layer_match, within_budget, detected AND layer_match AND within_budget AS passed FROM res")
def score_detections(spark, d):
    s = scored(spark, d).drop("confidence", "expected_time_s")
    return s.withColumn("latency_s", F.round("latency_s", 3))


@query(with_(INJ) + "SELECT count(*) AS total, count(*) FILTER (detected AND layer_match AND within_budget) AS passed, count(*) FILTER (NOT (detected AND layer_match AND within_budget)) AS failed FROM res")
def detection_report(spark, d):
    return EVAL.detection_report(scored(spark, d))


@query(f"""WITH s AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, any_value(n) AS n, max(v) FILTER (i = floor(n * 0.5)) AS p50, max(v) FILTER (i = floor(n * 0.95)) AS p95, max(v) FILTER (i = floor(n * 0.99)) AS p99, {r6('avg(v)', 'mean')} FROM s GROUP BY 1""")
def latency_percentiles(spark, d):
    return rounded(EVAL.latency_percentiles(A.table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice"), "mean")
