"""Beliefs, state history, patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import BELIEF, EV, GPUS, TRAJ, query, r6, tier_sql, with_
from fleetwatch.config import BeliefConfig, WindowConfig
from fleetwatch.operators import beliefs as B
from fleetwatch.operators import patterns as P
from fleetwatch.operators import quarantine as Q
from fleetwatch.operators import trust as TR
from fleetwatch.sources import adapters as A

CFG = BeliefConfig(**A.PRIOR)
WIN = WindowConfig(window_seconds=3 * 86_400, chunk_seconds=2 * 86_400)
W_US = WIN.window_us


def rounded(df, *cols):
    return df.select(*[F.round(F.col(c).cast("double"), 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def ev(spark, d):
    return A.events_norm(spark, d)


def traj(spark, d):
    return B.belief_trajectory(ev(spark, d), CFG, WIN)


@query(with_(EV) + "SELECT event_id, gpu_uuid, hostname, event_type, ts_us, score, sm_id, severity FROM evn")
def events_normalized(spark, d):
    return ev(spark, d).drop("ts", "metadata")


@query(with_(EV, BELIEF) + f"""SELECT gpu_uuid, probe_passes, probe_failures, anomalies, last_updated_us,
  {r6('alpha')}, {r6('beta')}, {r6('reliability')}, round(variance, 9) AS variance, tier FROM belief""")
def gpu_beliefs(spark, d):
    b = B.gpu_beliefs(ev(spark, d), CFG)
    return rounded(b, "alpha", "beta", "reliability").withColumn("variance", F.round("variance", 9))


@query(with_(EV) + f"""SELECT gpu_uuid, sm_id, probe_passes, probe_failures, {r6('s', 'reliability')}, {tier_sql('s')} AS tier FROM (
  SELECT *, (200.0 + probe_passes) / (200.0 + probe_passes + CAST(0.1 AS DOUBLE) + probe_failures) AS s FROM (
  SELECT gpu_uuid, sm_id, count(*) FILTER (event_type = 'probe_pass') AS probe_passes,
    count(*) FILTER (event_type = 'probe_fail') AS probe_failures
  FROM evn WHERE event_type IN ('probe_pass', 'probe_fail') AND sm_id IS NOT NULL GROUP BY 1, 2))""")
def sm_beliefs(spark, d):
    b = B.sm_beliefs(ev(spark, d), CFG)
    return rounded(b.select("gpu_uuid", "sm_id", "probe_passes", "probe_failures", "reliability", "tier"), "reliability")


@query()
def credible_bounds(spark, d):
    b = B.credible_bounds(B.gpu_beliefs(ev(spark, d), CFG), 0.95)
    return rounded(b.select("gpu_uuid", "alpha", "beta", "reliability", "lower_bound"), "lower_bound", "reliability")


AS_OF = 1_706_659_200_000_000  # 2024-01-31


@query(with_(EV) + f"""SELECT gpu_uuid, {r6('alpha')}, {r6('beta')}, {r6('alpha / (alpha + beta)', 'reliability')} FROM (
  SELECT gpu_uuid,
    200.0 + sum(CASE WHEN event_type = 'probe_pass' THEN w ELSE 0 END) AS alpha,
    CAST(0.1 AS DOUBLE) + sum(w * CASE WHEN event_type = 'probe_fail' THEN 1.0
      WHEN event_type IN ('inference_anomaly','training_anomaly','invariant_violation','probe_error') THEN CAST(0.3 AS DOUBLE) ELSE 0 END) AS beta
  FROM (SELECT *, pow(CAST(0.5 AS DOUBLE), ({AS_OF} - ts_us) / 3.6e9 / 168.0) AS w FROM evn WHERE ts_us <= {AS_OF}) GROUP BY 1)""")
def decayed_beliefs(spark, d):
    b = B.decayed_beliefs(ev(spark, d), AS_OF, 168.0, CFG)
    return rounded(b.drop("tier"), "alpha", "beta", "reliability")


@query(with_(EV, f"""votes AS (SELECT l_orderkey AS canary_id, max(l_returnflag) FILTER (l_linenumber = 1) AS a, max(l_returnflag) FILTER (l_linenumber = 2) AS b, max(l_returnflag) FILTER (l_linenumber = 3) AS c,
    max('GPU-' || l_suppkey) FILTER (l_linenumber = 1) AS g1, max('GPU-' || l_suppkey) FILTER (l_linenumber = 2) AS g2, max('GPU-' || l_suppkey) FILTER (l_linenumber = 3) AS g3
  FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY sha256(l_returnflag), 'GPU-' || l_suppkey) = 1) GROUP BY 1)""",
  f"""dissent AS (SELECT CASE WHEN b = c AND a <> b THEN g1 WHEN a = c AND a <> b THEN g2 WHEN a = b AND a <> c THEN g3 END AS gpu_uuid, {AS_OF} - canary_id % 700 * 3600000000 AS ts_us FROM votes)""",
  f"""every AS (SELECT gpu_uuid, event_type, ts_us FROM evn UNION ALL SELECT gpu_uuid, 'tmr_dissent', ts_us FROM dissent WHERE gpu_uuid IS NOT NULL)""") + f"""SELECT gpu_uuid, {r6('alpha')}, {r6('beta')}, {r6('alpha / (alpha + beta)', 'reliability')} FROM (
  SELECT gpu_uuid, 200.0 + sum(CASE WHEN event_type = 'probe_pass' THEN w ELSE 0 END) AS alpha,
    CAST(0.1 AS DOUBLE) + sum(w * CASE WHEN event_type = 'probe_fail' THEN 1.0 WHEN event_type = 'tmr_dissent' THEN 2.0
      WHEN event_type IN ('inference_anomaly','training_anomaly','invariant_violation','probe_error') THEN CAST(0.3 AS DOUBLE) ELSE 0 END) AS beta
  FROM (SELECT *, pow(CAST(0.5 AS DOUBLE), ({AS_OF} - ts_us) / 3.6e9 / 168.0) AS w FROM every WHERE ts_us <= {AS_OF}) GROUP BY 1)""")
def decayed_beliefs_tmr(spark, d):
    """Dissents of canaries counted as evidence beside the events."""
    votes = TR.majority_vote(A.tmr_results(spark, d)).withColumn("ts_us", F.lit(AS_OF) - F.col("canary_id") % 700 * 3_600_000_000)
    e = ev(spark, d).select("gpu_uuid", "event_type", "ts_us").unionByName(B.dissent_events(votes))
    return rounded(B.decayed_beliefs(e, AS_OF, 168.0, CFG).drop("tier"), "alpha", "beta", "reliability")


@query(with_(EV) + f"""SELECT e.gpu_uuid,
    count(*) FILTER (e.event_type = 'probe_pass' AND ok) AS probe_passes,
    count(*) FILTER (e.event_type = 'probe_fail' AND ok) AS probe_failures,
    count(*) FILTER (e.event_type IN ('inference_anomaly','training_anomaly','invariant_violation','probe_error') AND ok) AS anomalies
  FROM (SELECT evn.*, r.t IS NULL OR ts_us > r.t AS ok FROM evn LEFT JOIN (
      SELECT 'GPU-' || user_id AS g, max(epoch_us(ts)) AS t FROM events
      WHERE event_type = 'purchase' AND event_id % 40 BETWEEN 9 AND 20 GROUP BY 1) r ON r.g = evn.gpu_uuid) e
  WHERE NOT ok OR event_type NOT IN ('thermal_spike','power_anomaly','ecc_error') GROUP BY 1""")
def reset_beliefs(spark, d):
    resets = A.operator_actions(spark, d).filter("action = 'reinstate'")
    return B.reset_beliefs(ev(spark, d), resets, CFG).select("gpu_uuid", "probe_passes", "probe_failures", "anomalies")


@query(with_(EV, TRAJ) + f"SELECT gpu_uuid, event_id, ts_us, p AS probe_passes, f AS probe_failures, a AS anomalies, {r6('reliability')}, tier_rank FROM traj")
def belief_trajectory(spark, d):
    t = traj(spark, d).select("gpu_uuid", "event_id", "ts_us", "probe_passes", "probe_failures", "anomalies", "reliability", "tier_rank")
    return rounded(t, "reliability")


_ST = "CASE {r} WHEN 2 THEN 'SUSPECT' WHEN 3 THEN 'QUARANTINED' WHEN 4 THEN 'CONDEMNED' ELSE 'HEALTHY' END"
AUTO = f"""auto AS (SELECT gpu_uuid, event_id, ts_us, reliability, {_ST.format(r='before')} AS from_state, {_ST.format(r='tier_rank')} AS to_state,
    CASE tier_rank WHEN 2 THEN 'mark_suspect' WHEN 3 THEN 'quarantine' ELSE 'condemn' END AS action
  FROM (SELECT *, coalesce(max(tier_rank) OVER (PARTITION BY gpu_uuid ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM traj)
  WHERE tier_rank >= 2 AND tier_rank > before)"""
STATES = """states AS (SELECT g.gpu_uuid, coalesce(arg_max(a.to_state, a.ts_us), 'HEALTHY') AS state, max(a.ts_us) AS state_since_us
  FROM gpus g LEFT JOIN auto a USING (gpu_uuid) GROUP BY 1)"""


@query(with_(EV, TRAJ, AUTO) + f"SELECT gpu_uuid, event_id, ts_us, {r6('reliability')}, from_state, to_state, action FROM auto")
def quarantine_auto(spark, d):
    return rounded(Q.quarantine_auto(traj(spark, d), WIN), "reliability")


@query(with_(EV, TRAJ, GPUS, AUTO, STATES) + "SELECT * FROM states")
def current_states(spark, d):
    return Q.current_states(Q.quarantine_auto(traj(spark, d), WIN), A.gpus(spark, d))


@query(with_(EV, TRAJ, GPUS, AUTO, STATES) + """SELECT s.state, count(t.gpu_uuid) AS gpus
  FROM (VALUES ('HEALTHY'), ('SUSPECT'), ('QUARANTINED'), ('DEEP_TEST'), ('CONDEMNED')) s(state)
  LEFT JOIN states t ON t.state = s.state GROUP BY 1""")
def state_counts(spark, d):
    return Q.state_counts(current_states(spark, d))


PASSES = 5  # deep-test passes that reinstate, small enough to occur in the test tables

# The check applies every row in order, one step per row; nothing is skipped.
_FSM = with_(EV, TRAJ, f"""acts AS (SELECT 'GPU-' || user_id AS gpu_uuid, epoch_us(ts) AS ts_us, CAST(event_id AS VARCHAR) AS row_id,
    CASE WHEN event_id % 40 = 0 THEN 'condemn' WHEN event_id % 40 <= 8 THEN 'schedule_deep_test' WHEN event_id % 40 <= 20 THEN 'reinstate'
      WHEN event_id % 40 <= 28 THEN 'clear_suspect' WHEN event_id % 40 <= 34 THEN 'mark_suspect' ELSE 'quarantine' END AS action
  FROM events WHERE event_type = 'purchase'),
steps AS (
  SELECT gpu_uuid, ts_us, 0 AS k, event_id AS row_id, 'deep_test' AS source, 'reinstate' AS action, event_type = 'probe_pass' AS passed FROM traj WHERE event_type = 'probe_pass'
  UNION ALL SELECT gpu_uuid, ts_us, 1, event_id, 'tier', CASE tier_rank WHEN 2 THEN 'mark_suspect' WHEN 3 THEN 'quarantine' ELSE 'condemn' END, false FROM traj WHERE tier_rank >= 2
  UNION ALL SELECT gpu_uuid, ts_us, 2, row_id, 'operator', action, false FROM acts),
num AS (SELECT *, row_number() OVER (PARTITION BY gpu_uuid ORDER BY ts_us, CASE WHEN k = 2 THEN 1 ELSE 0 END, row_id, k) AS rn FROM steps),
RECURSIVE run AS (
  SELECT gpu_uuid, CAST(0 AS BIGINT) AS rn, 'HEALTHY' AS state, 0 AS passes, CAST(NULL AS BIGINT) AS ts_us, CAST(NULL AS VARCHAR) AS source,
    CAST(NULL AS VARCHAR) AS row_id, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS from_state, CAST(NULL AS VARCHAR) AS to_state, false AS applied, false AS logged
  FROM (SELECT DISTINCT gpu_uuid FROM num)
  UNION ALL
  SELECT gpu_uuid, rn, coalesce(nxt, state), CASE WHEN coalesce(nxt, state) = 'DEEP_TEST' AND nxt IS NULL AND k <> 2 THEN passes + (k = 0)::INTEGER
      WHEN nxt IS NULL AND state = 'DEEP_TEST' THEN passes ELSE 0 END,
    ts_us, source, row_id, action, state, coalesce(nxt, state), nxt IS NOT NULL, nxt IS NOT NULL OR k = 2
  FROM (SELECT n.gpu_uuid, n.rn, n.k, n.ts_us, n.source, n.row_id, n.action, r.state, r.passes,
      CASE
        WHEN n.k = 0 THEN CASE WHEN r.state = 'DEEP_TEST' AND r.passes + 1 >= {PASSES} THEN 'HEALTHY' END
        WHEN n.k = 1 AND r.state = 'DEEP_TEST' AND n.action <> 'condemn' THEN NULL
        WHEN r.state || '|' || n.action IN ('HEALTHY|mark_suspect') THEN 'SUSPECT'
        WHEN r.state || '|' || n.action IN ('HEALTHY|quarantine', 'SUSPECT|quarantine') THEN 'QUARANTINED'
        WHEN n.action = 'condemn' AND r.state <> 'CONDEMNED' THEN 'CONDEMNED'
        WHEN r.state || '|' || n.action IN ('SUSPECT|clear_suspect', 'SUSPECT|reinstate', 'QUARANTINED|reinstate', 'DEEP_TEST|reinstate') THEN 'HEALTHY'
        WHEN r.state || '|' || n.action = 'QUARANTINED|schedule_deep_test' THEN 'DEEP_TEST' END AS nxt
    FROM run r JOIN num n ON n.gpu_uuid = r.gpu_uuid AND n.rn = r.rn + 1))""")


@query(_FSM + "SELECT gpu_uuid, ts_us, source, row_id, action, from_state, to_state, applied FROM run WHERE logged")
def quarantine_fsm(spark, d):
    return Q.quarantine_fsm(traj(spark, d), A.operator_actions(spark, d), PASSES, WIN)


@query(_FSM + """, starts AS (SELECT gpu_uuid, ts_us AS started_us FROM run WHERE applied AND to_state = 'DEEP_TEST'),
spans AS (SELECT s.gpu_uuid, s.started_us, (SELECT min(r.ts_us) FROM run r WHERE r.gpu_uuid = s.gpu_uuid AND r.applied AND r.from_state = 'DEEP_TEST' AND r.ts_us >= s.started_us) AS ended_us FROM starts s)
SELECT s.gpu_uuid, s.started_us, s.ended_us, (SELECT count(*) FROM evn e WHERE e.gpu_uuid = s.gpu_uuid AND e.event_type = 'probe_pass' AND e.ts_us > s.started_us AND (s.ended_us IS NULL OR e.ts_us <= s.ended_us)) AS passes FROM spans s""")
def deep_test_progress(spark, d):
    return Q.deep_test_progress(quarantine_fsm(spark, d), ev(spark, d), WIN)


@query(with_(EV, TRAJ, GPUS, AUTO) + "SELECT a.gpu_uuid, a.event_id, a.ts_us, a.action, g.hostname FROM auto a JOIN gpus g USING (gpu_uuid) WHERE action = 'quarantine'")
def filter_directives(spark, d):
    t = Q.quarantine_auto(traj(spark, d), WIN)
    return Q.filter_directives(t, A.gpus(spark, d), action="quarantine").select("gpu_uuid", "event_id", "ts_us", "action", "hostname")


def _cnt(t, w="w"):
    return f"count(*) FILTER (event_type = '{t}') OVER {w}"


FRAME = f"""frame AS (SELECT gpu_uuid, event_id, ts_us, {_cnt('probe_fail')} AS n_fail, {_cnt('inference_anomaly')} AS n_inference,
    {_cnt('training_anomaly')} AS n_training, {_cnt('invariant_violation')} AS n_invariant, {_cnt('thermal_spike')} AS n_thermal,
    {_cnt('power_anomaly')} AS n_power, {_cnt('ecc_error')} AS n_ecc,
    first(CASE WHEN event_type = 'probe_fail' THEN sm_id END IGNORE NULLS) OVER w AS first_sm
  FROM evn WINDOW w AS (PARTITION BY gpu_uuid ORDER BY ts_us RANGE BETWEEN {W_US} PRECEDING AND CURRENT ROW))"""
PATT = f"""single AS (
  SELECT gpu_uuid, event_id, ts_us, 'probe_and_anomaly' AS pattern, 0.95 AS confidence, 4 AS severity, first_sm AS sm_id, n_fail + n_inference + n_training + n_invariant AS contributing FROM frame WHERE n_fail > 0 AND n_inference + n_training + n_invariant > 0
  UNION ALL SELECT gpu_uuid, event_id, ts_us, 'thermal_correlated', 0.7, 2, NULL, n_fail + n_thermal FROM frame WHERE n_fail > 0 AND n_thermal > 0
  UNION ALL SELECT gpu_uuid, event_id, ts_us, 'anomaly_without_probe', 0.4, 2, NULL, n_inference + n_training + n_invariant FROM frame WHERE n_fail = 0 AND n_inference + n_training + n_invariant > 0
  UNION ALL SELECT gpu_uuid, event_id, ts_us, 'multi_signal', 0.9, 4, NULL, n_fail + n_inference + n_training + n_invariant + n_ecc FROM frame
    WHERE (n_fail > 0)::INT + (n_inference > 0)::INT + (n_training > 0)::INT + (n_invariant > 0)::INT + (n_ecc > 0)::INT >= 2
  UNION ALL SELECT gpu_uuid, event_id, ts_us, 'power_correlated', 0.65, 2, NULL, n_fail + n_power FROM frame WHERE n_fail > 0 AND n_power > 0
  UNION ALL SELECT gpu_uuid, event_id, ts_us, 'ecc_correlated', 0.8, 3, NULL, n_ecc + n_fail + n_inference + n_training FROM frame WHERE n_ecc > 0 AND n_fail + n_inference + n_training > 0),
local AS (SELECT t.gpu_uuid, t.event_id, t.ts_us, 'sm_localized' AS pattern, 0.85 AS confidence, 3 AS severity, f.sm_id, count(*) AS contributing
  FROM evn t JOIN evn f ON f.gpu_uuid = t.gpu_uuid AND f.event_type = 'probe_fail' AND f.sm_id IS NOT NULL AND f.ts_us <= t.ts_us AND f.ts_us >= t.ts_us - {W_US}
  GROUP BY ALL HAVING count(*) >= 2),
patterns AS (SELECT gpu_uuid, event_id, ts_us, pattern, CAST(confidence AS DOUBLE) AS confidence, severity, sm_id, contributing FROM (SELECT * FROM single UNION ALL SELECT * FROM local))"""


@query(with_(EV, FRAME) + "SELECT gpu_uuid, event_id, ts_us, n_fail, n_inference, n_training, n_invariant, n_thermal, n_power, n_ecc FROM frame")
def window_counts(spark, d):
    return P.window_counts(ev(spark, d), WIN).drop("event_type", "fails_so_far")


@query(with_(EV, FRAME, PATT) + "SELECT * FROM patterns")
def match_patterns(spark, d):
    return P.match_patterns(ev(spark, d), WIN)


@query(with_(EV, FRAME, PATT) + "SELECT * FROM patterns WHERE pattern = 'sm_localized'")
def sm_localized(spark, d):
    s = P.sm_localized(ev(spark, d), WIN)
    return s.select("gpu_uuid", "event_id", "ts_us", "pattern", "confidence", "severity", "sm_id", "contributing")


RECENT = """latest AS (SELECT p.* FROM patterns p JOIN (SELECT gpu_uuid, max(ts_us) AS m FROM patterns GROUP BY 1) l ON l.gpu_uuid = p.gpu_uuid AND l.m = p.ts_us)"""


@query(with_(EV, FRAME, PATT, RECENT) + "SELECT * FROM latest")
def recent_patterns(spark, d):
    return P.recent_patterns(match_patterns(spark, d))


@query(with_(EV, FRAME, PATT, RECENT) + f"""SELECT l.gpu_uuid, l.event_id AS trigger_id, l.pattern, CASE WHEN l.pattern = 'sm_localized' THEN l.sm_id END AS pattern_sm,
    e.event_id, e.event_type, e.ts_us
  FROM latest l JOIN evn e ON e.gpu_uuid = l.gpu_uuid AND e.ts_us BETWEEN l.ts_us - {W_US} AND l.ts_us
  WHERE CASE l.pattern
    WHEN 'sm_localized' THEN e.event_type = 'probe_fail' AND e.sm_id = l.sm_id
    WHEN 'thermal_correlated' THEN e.event_type IN ('probe_fail', 'thermal_spike')
    WHEN 'power_correlated' THEN e.event_type IN ('probe_fail', 'power_anomaly')
    WHEN 'ecc_correlated' THEN e.event_type IN ('ecc_error', 'probe_fail', 'inference_anomaly', 'training_anomaly')
    WHEN 'multi_signal' THEN e.event_type IN ('ecc_error', 'probe_fail', 'inference_anomaly', 'training_anomaly', 'invariant_violation')
    WHEN 'anomaly_without_probe' THEN e.event_type IN ('inference_anomaly', 'training_anomaly', 'invariant_violation')
    ELSE e.event_type IN ('probe_fail', 'inference_anomaly', 'training_anomaly', 'invariant_violation') END""")
def pattern_evidence(spark, d):
    return P.pattern_evidence(recent_patterns(spark, d), ev(spark, d), WIN)


@query(with_(EV, FRAME, PATT) + f"""SELECT l.gpu_uuid, l.event_id AS trigger_id, l.pattern, CASE WHEN l.pattern = 'sm_localized' THEN l.sm_id END AS pattern_sm,
    e.event_id, e.event_type, e.ts_us
  FROM patterns l JOIN evn e ON e.gpu_uuid = l.gpu_uuid AND e.ts_us BETWEEN l.ts_us - {W_US} AND l.ts_us
  WHERE CASE l.pattern
    WHEN 'sm_localized' THEN e.event_type = 'probe_fail' AND e.sm_id = l.sm_id
    WHEN 'thermal_correlated' THEN e.event_type IN ('probe_fail', 'thermal_spike')
    WHEN 'power_correlated' THEN e.event_type IN ('probe_fail', 'power_anomaly')
    WHEN 'ecc_correlated' THEN e.event_type IN ('ecc_error', 'probe_fail', 'inference_anomaly', 'training_anomaly')
    WHEN 'multi_signal' THEN e.event_type IN ('ecc_error', 'probe_fail', 'inference_anomaly', 'training_anomaly', 'invariant_violation')
    WHEN 'anomaly_without_probe' THEN e.event_type IN ('inference_anomaly', 'training_anomaly', 'invariant_violation')
    ELSE e.event_type IN ('probe_fail', 'inference_anomaly', 'training_anomaly', 'invariant_violation') END""")
def pattern_links(spark, d):
    """The events behind every pattern row, not only the latest ones."""
    return P.pattern_evidence(match_patterns(spark, d), ev(spark, d), WIN)


@query(with_(EV) + f"""SELECT e.gpu_uuid, t.event_id AS trigger_id, e.event_id, e.event_type, e.ts_us FROM evn e
  JOIN (SELECT gpu_uuid, max_by(event_id, ts_us) AS event_id, max(ts_us) AS ts_us FROM evn GROUP BY 1) t
  ON e.gpu_uuid = t.gpu_uuid AND e.ts_us BETWEEN t.ts_us - {W_US} AND t.ts_us""")
def window_events(spark, d):
    e = ev(spark, d)
    t = e.groupBy("gpu_uuid").agg(F.max_by("event_id", "ts_us").alias("trigger_id"), F.max("ts_us").alias("trigger_us"))
    return P.window_events(e.select("gpu_uuid", "event_id", "event_type", "ts_us"), t, WIN).drop("trigger_us")


_FAILING = "('probe_fail', 'inference_anomaly', 'training_anomaly')"


@query(with_(EV) + f"""SELECT t.hostname, t.event_id, t.ts_us, 'node_correlated' AS pattern, CAST(0.7 AS DOUBLE) AS confidence, 3 AS severity,
    count(DISTINCT CASE WHEN f.event_type IN {_FAILING} THEN f.gpu_uuid END) AS failing_gpus, count(*) AS contributing
  , arg_max(f.gpu_uuid, (f.ts_us, f.event_id)) FILTER (f.event_type IN {_FAILING}) AS gpu_uuid
  FROM evn t JOIN evn f ON f.hostname = t.hostname AND f.ts_us BETWEEN t.ts_us - {W_US} AND t.ts_us
  GROUP BY 1, 2, 3 HAVING failing_gpus >= 2""")
def node_correlated(spark, d):
    return P.node_correlated(ev(spark, d), WIN)


@query(with_(EV, f"""hits AS (SELECT t.hostname, t.event_id, t.ts_us FROM evn t JOIN evn f ON f.hostname = t.hostname AND f.ts_us BETWEEN t.ts_us - {W_US} AND t.ts_us
  WHERE f.event_type IN {_FAILING} GROUP BY 1, 2, 3 HAVING count(DISTINCT f.gpu_uuid) >= 2)""") + f"""SELECT h.hostname, h.event_id AS trigger_id, e.event_id, e.gpu_uuid, e.event_type, e.ts_us
  FROM hits h JOIN evn e ON e.hostname = h.hostname AND e.ts_us BETWEEN h.ts_us - {W_US} AND h.ts_us""")
def node_evidence(spark, d):
    return P.node_evidence(node_correlated(spark, d), ev(spark, d), WIN)


@query(with_(EV, GPUS) + f"""SELECT t.firmware_version, t.event_id, t.ts_us, 'firmware_correlated' AS pattern, CAST(0.7 AS DOUBLE) AS confidence, 3 AS severity,
    count(DISTINCT f.gpu_uuid) AS failing_gpus
  FROM (SELECT e.*, g.firmware_version FROM evn e JOIN gpus g USING (gpu_uuid)) t
  JOIN (SELECT e.*, g.firmware_version FROM evn e JOIN gpus g USING (gpu_uuid) WHERE e.event_type IN {_FAILING}) f
    ON f.firmware_version = t.firmware_version AND f.ts_us BETWEEN t.ts_us - {W_US} AND t.ts_us
  GROUP BY 1, 2, 3 HAVING failing_gpus >= 3""")
def firmware_correlated(spark, d):
    return P.firmware_correlated(ev(spark, d), A.gpus(spark, d), WIN)


@query(with_(EV) + """SELECT gpu_uuid, event_id, ts_us, streak FROM (
  SELECT *, count(*) FILTER (event_type = 'probe_fail') OVER (PARTITION BY gpu_uuid, island ORDER BY ts_us, event_id) AS streak
  FROM (SELECT *, count(*) FILTER (event_type <> 'probe_fail') OVER (PARTITION BY gpu_uuid ORDER BY ts_us, event_id) AS island
    FROM evn WHERE event_type LIKE 'probe_%')) WHERE event_type = 'probe_fail' AND streak >= 2""")
def consecutive_failures(spark, d):
    return P.consecutive_failures(ev(spark, d), 2, WIN)


@query(with_(EV) + f"""SELECT gpu_uuid, event_id, ts_us, failing_sms FROM (SELECT gpu_uuid, event_id, ts_us, len(list_distinct(list(sm_id) OVER w)) AS failing_sms FROM evn WHERE event_type = 'probe_fail'
  WINDOW w AS (PARTITION BY gpu_uuid ORDER BY ts_us RANGE BETWEEN {W_US} PRECEDING AND CURRENT ROW)) WHERE failing_sms >= 2""")
def distinct_sms_in_window(spark, d):
    return P.distinct_sms_in_window(ev(spark, d), 2, WIN.window_seconds, WIN)


@query("""SELECT canary_id, gpu_uuid, 'tmr_confirmed' AS pattern, CAST(0.9 AS DOUBLE) AS confidence, 4 AS severity FROM (
  SELECT l_orderkey AS canary_id, unnest([CASE WHEN b = c AND a <> b THEN g1 WHEN a = c AND a <> b THEN g2 WHEN a = b AND a <> c THEN g3 END]) AS gpu_uuid FROM (
    SELECT l_orderkey, max(l_returnflag) FILTER (l_linenumber = 1) AS a, max(l_returnflag) FILTER (l_linenumber = 2) AS b, max(l_returnflag) FILTER (l_linenumber = 3) AS c,
      max('GPU-' || l_suppkey) FILTER (l_linenumber = 1) AS g1, max('GPU-' || l_suppkey) FILTER (l_linenumber = 2) AS g2, max('GPU-' || l_suppkey) FILTER (l_linenumber = 3) AS g3
    FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY sha256(l_returnflag), 'GPU-' || l_suppkey) = 1) GROUP BY 1)) WHERE gpu_uuid IS NOT NULL""")
def tmr_confirmed(spark, d):
    return P.tmr_confirmed(TR.majority_vote(A.tmr_results(spark, d)))
