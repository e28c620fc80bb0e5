"""Sources, sinks and streams, run end to end over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.core import CFG, FRAME, PASSES, PATT, WIN, _FSM, ev, rounded
from catalog.alerts import DED, fired
from catalog.audit import PEND, _LINKED, hexed, led
from catalog.inference import CAP, CHART, STATS, _JSD, _LONG, _chart_sql, cap
from catalog.registry import BELIEF, EV, TRAJ, query, r6, with_
from catalog.training import GCFG, GN, norms
from catalog.trust import EDGES
from fleetwatch.config import DivergenceConfig, LossConfig
from fleetwatch.operators import audit as AU
from fleetwatch.operators import beliefs as B
from fleetwatch.operators import inference as I
from fleetwatch.plans.cut import checkpoint_dir
from fleetwatch.sinks import writers as W
from fleetwatch.sources import adapters as A
from fleetwatch.sources import readers as R
from fleetwatch.streaming import event_time as ET
from fleetwatch.streaming import stateful as SF
from fleetwatch.streaming import streams as S


def scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- sources -----------------------------------------------------------------------

def probe_batches(spark, d):
    """Probe rows packed per host and hour, as agents send them."""
    e = ev(spark, d).filter(F.col("event_type").startswith("probe_"))
    code = F.when(F.col("event_type") == "probe_pass", 1).when(F.col("event_type") == "probe_fail", 2).when(F.col("ts_us") % 2 == 0, 3).otherwise(4)
    null = F.lit(None).cast("string")
    device = F.struct(F.col("gpu_uuid").alias("uuid"), "hostname", F.lit(0).alias("device_index"), null.alias("model"),
                      null.alias("driver_version"), null.alias("firmware_version"))
    x = F.struct(F.col("event_id").alias("execution_id"), F.lit("FMA").alias("probe_type"), device.alias("gpu"), "sm_id", code.alias("result"),
                 F.lit(50.0).cast("float").alias("gpu_temperature_c"), F.lit(None).cast("float").alias("gpu_power_w"), F.col("ts").alias("timestamp"))
    return e.groupBy(F.col("hostname").alias("agent_hostname"), F.floor(F.col("ts_us") / 3_600_000_000).alias("sequence_number")).agg(
        F.collect_list(x).alias("executions"))


@query(with_(EV) + """SELECT event_id, gpu_uuid, hostname, event_type, ts_us, CASE WHEN event_type = 'probe_fail' THEN 1.0 ELSE 0.0 END::DOUBLE AS score, sm_id,
  CASE event_type WHEN 'probe_pass' THEN 1 WHEN 'probe_fail' THEN 4 ELSE CASE WHEN ts_us % 2 = 0 THEN 3 ELSE 2 END END AS severity, 3 AS metadata_keys FROM evn WHERE event_type LIKE 'probe_%'""")
def normalize_probes(spark, d):
    n = R.normalize_probes(probe_batches(spark, d))
    return n.withColumn("metadata_keys", F.size("metadata")).drop("ts", "metadata")


@query(with_(EV) + """SELECT event_id, gpu_uuid, hostname, event_type, ts_us, score, severity, CASE WHEN severity = 4 THEN 'layer' END AS layer_name FROM evn
  WHERE event_type IN ('inference_anomaly', 'training_anomaly', 'invariant_violation')""")
def normalize_anomalies(spark, d):
    e = ev(spark, d).filter(F.col("event_type").isin("inference_anomaly", "training_anomaly", "invariant_violation"))
    code = F.when(F.col("event_type") == "inference_anomaly", 1).when(F.col("event_type") == "training_anomaly", 2).otherwise(3)
    x = F.struct("event_id", F.lit("X").alias("anomaly_type"), code.alias("source"), "gpu_uuid", "severity", "score", F.col("ts").alias("timestamp"),
                 F.when(F.col("severity") == 4, "layer").alias("layer_name"), F.lit(None).cast("string").alias("model_id"))
    b = e.groupBy(F.col("hostname").alias("source_hostname"), F.floor(F.col("ts_us") / 3_600_000_000).alias("sequence_number")).agg(F.collect_list(x).alias("events"))
    n = R.normalize_anomalies(b)
    return n.withColumn("layer_name", F.try_element_at("metadata", F.lit("layer_name"))).drop("ts", "metadata", "sm_id")


@query("SELECT 'GPU-' || user_id AS gpu_uuid, epoch_us(ts) AS ts_us, round(40 + value % 60, 6) AS temperature_c, event_id % 97 = 0 AS throttle_active FROM events")
def normalize_telemetry(spark, d):
    t = A.telemetry(spark, d)
    x = F.struct("gpu_uuid", F.col("ts").alias("timestamp"), "temperature_c", "throttle_active", "power_w")
    host = F.concat(F.lit("node-"), F.floor(F.substring("gpu_uuid", 5, 20).cast("long") / 8).cast("string"))
    b = t.groupBy(host.alias("hostname"), F.floor(F.col("ts_us") / 3_600_000_000).alias("s")).agg(F.collect_list(x).alias("readings"))
    n = R.normalize_telemetry(b.drop("s"))
    return rounded(n.select("gpu_uuid", "ts_us", "temperature_c", "throttle_active"), "temperature_c")


@query("SELECT l_orderkey AS canary_id, count(*) AS devices, count(DISTINCT sha256(l_returnflag)) AS fingerprints FROM lineitem GROUP BY 1")
def read_tmr_results(spark, d):
    t = A.tmr_results(spark, d)
    packed = t.groupBy("canary_id", F.pmod(F.xxhash64("gpu_uuid"), F.lit(4)).alias("agent")).agg(
        F.collect_list(F.struct("gpu_uuid", "fingerprint", F.lit(True).alias("success"))).alias("results"))
    r = R.read_tmr_results(packed)
    return r.groupBy("canary_id").agg(F.count("*").alias("devices"), F.countDistinct("fingerprint").alias("fingerprints"))


@query(with_(EV) + "SELECT event_id, gpu_uuid, event_type FROM evn")
def union_events(spark, d):
    e = ev(spark, d).select("event_id", "gpu_uuid", "event_type", "ts_us")
    probes, rest = e.filter(F.col("event_type").startswith("probe_")), e.filter(~F.col("event_type").startswith("probe_"))
    return R.union_events(probes, rest.withColumn("extra", F.lit(1))).select("event_id", "gpu_uuid", "event_type")


# --- sinks -------------------------------------------------------------------------

@query(with_(EV) + "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS events, count(DISTINCT gpu_uuid) AS gpus FROM evn WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21' GROUP BY 1")
def write_events(spark, d):
    path = scratch(spark, "events")
    W.write_events(ev(spark, d), path)
    r = R.read_events(spark, path, "2024-01-05", "2024-01-20")
    return r.groupBy(F.col("date").cast("string").alias("date")).agg(F.count("*").alias("events"), F.countDistinct("gpu_uuid").alias("gpus"))


@query(with_(EV, BELIEF) + f"SELECT gpu_uuid, probe_passes, last_updated_us, {r6('reliability')} FROM belief")
def save_state(spark, d):
    """A snapshot from the first half of the events, then an upsert of the whole."""
    e, root, key = ev(spark, d), scratch(spark, "state"), ["gpu_uuid"]
    W.save_state(B.gpu_beliefs(e.filter("ts < '2024-01-15'"), CFG), root, key, "last_updated_us", 1)
    W.save_state(B.gpu_beliefs(e, CFG), root, key, "last_updated_us", 2, 1)
    return rounded(W.load_state(spark, root, 2).select("gpu_uuid", "probe_passes", "last_updated_us", "reliability"), "reliability")


@query("SELECT o_orderkey // 1000 AS batch_sequence, count(*) AS entries FROM orders GROUP BY 1")
def write_audit_batch(spark, d):
    """The same batch written twice must not count twice."""
    e, root = led(spark, d), scratch(spark, "audit")
    for batch_id, part in ((0, "batch_sequence % 2 = 0"), (1, "batch_sequence % 2 = 1"), (1, "batch_sequence % 2 = 1")):
        W.write_audit_batch(e.filter(part), root, batch_id)
    entries, _ = W.read_committed(spark, root)
    return entries.groupBy("batch_sequence").agg(F.count("*").alias("entries"))


@query("SELECT o_orderkey + 1 AS entry_id, CASE WHEN o_orderkey % 10 < 8 THEN 'GPU-' || o_custkey ELSE '' END AS gpu_uuid FROM orders")
def export_csv(spark, d):
    path = scratch(spark, "csv")
    W.export_csv(led(spark, d), path)
    r = spark.read.option("header", True).csv(path)
    return r.select(F.col("entry_id").cast("long").alias("entry_id"), F.coalesce("gpu_uuid", F.lit("")).alias("gpu_uuid"))


@query(with_(PEND) + "SELECT entry_type, count(*) AS entries FROM pend GROUP BY 1")
def export_json(spark, d):
    path = scratch(spark, "json")
    W.export_json(led(spark, d), path)
    return spark.read.schema("entry_id long, entry_type string").json(path).groupBy("entry_type").agg(F.count("*").alias("entries"))


@query("SELECT count(*) AS lines FROM orders")
def export_html(spark, d):
    path = scratch(spark, "html")
    W.export_html(led(spark, d), path)
    return spark.read.text(path).filter(F.col("value").startswith("<tr><td>")).agg(F.count("*").alias("lines"))


@query(with_(PEND) + """SELECT strftime(ts, '%Y_%m') AS month, count(*) AS entries FROM pend GROUP BY 1
  HAVING max(date_trunc('month', ts) + INTERVAL 1 MONTH) > DATE '2006-01-01' - 2555""")
def drop_expired(spark, d):
    """Months kept after the expired ones are dropped from a month-partitioned table."""
    from fleetwatch.functions.labels import month_key

    path, p = scratch(spark, "months"), A.pending_entries(spark, d)
    p.withColumn("month", month_key(F.col("ts"))).repartition("month").write.partitionBy("month").parquet(path)
    old = [r.month for r in W.expired_months(p, F.lit("2006-01-01"), 2555).select("month").collect()]  # one row per month
    W.drop_partitions(spark, path, "month", old)
    return spark.read.parquet(path).groupBy(F.col("month").cast("string").alias("month")).agg(F.count("*").alias("entries"))


# --- streams -----------------------------------------------------------------------

def event_stream(spark, d):
    return S.stream_events(A.as_events(S.read_stream(spark, f"{d}/events*.parquet")))


@query(with_(EV) + "SELECT event_id, gpu_uuid, event_type, ts_us FROM evn")
def stream_events(spark, d):
    s = event_stream(spark, d).select("event_id", "gpu_uuid", "event_type", "ts_us")
    return S.run_to_table(s, scratch(spark, "out"), scratch(spark, "cp"))


@query(with_(EV, BELIEF) + f"SELECT gpu_uuid, probe_passes, probe_failures, anomalies, {r6('reliability')}, tier FROM belief")
def stream_beliefs(spark, d):
    s = S.stream_beliefs(A.as_events(S.read_stream(spark, f"{d}/events*.parquet")), CFG)
    b = S.run_updates(s, ["gpu_uuid"], scratch(spark, "out"), scratch(spark, "cp"))
    return rounded(b.select("gpu_uuid", "probe_passes", "probe_failures", "anomalies", "reliability", "tier"), "reliability")


@query(with_(EDGES) + f"SELECT gpu_a, gpu_b, agreements, disagreements, {r6('trust')} FROM edges")
def stream_trust(spark, d):
    li = S.read_stream(spark, f"{d}/lineitem*.parquet")
    c = li.select(A.gpu(F.col("l_suppkey")).alias("gpu_a"), A.gpu(F.col("l_partkey") % 97).alias("gpu_b"),
                  (F.col("l_returnflag") != "R").alias("agree"), A.micros(F.col("l_shipdate")).alias("ts_us")).filter("gpu_a <> gpu_b")
    e = S.run_updates(S.stream_trust(c), ["gpu_a", "gpu_b"], scratch(spark, "out"), scratch(spark, "cp"))
    return rounded(e.select("gpu_a", "gpu_b", "agreements", "disagreements", "trust"), "trust")


def step_clock(pos):
    """A second for each step, for series that are ordered by a step number."""
    return (pos * 1_000_000).alias("ts_us")


# The watermark of a stream that has ended stays at its latest time: what lies there is still held.
_PASSED = "ts_us // 1000 < (SELECT max(ts_us) // 1000 FROM evn)"


@query(with_(EV, FRAME, PATT) + f"SELECT * FROM patterns WHERE {_PASSED}")
def stream_patterns(spark, d):
    SF.use_rocksdb(spark)
    s = ET.stream_patterns(A.as_events(S.read_stream(spark, f"{d}/events*.parquet")), WIN.window_seconds, "0 seconds")
    return ET.accepted(S.run_to_table(s, scratch(spark, "out"), scratch(spark, "cp")))


# Events land in four parts; some come one part late, some two. What the watermark has passed by then is late.
LATE_DAYS = 3
_LANDED = EV.replace("evn AS (", "landed AS (") + f""",
parts AS (SELECT *, least(3, (CASE WHEN ts < TIMESTAMP '2024-01-09' THEN 0 WHEN ts < TIMESTAMP '2024-01-16' THEN 1 WHEN ts < TIMESTAMP '2024-01-23' THEN 2 ELSE 3 END)
    + CASE WHEN CAST(event_id AS BIGINT) % 31 = 0 THEN 2 WHEN CAST(event_id AS BIGINT) % 7 = 0 THEN 1 ELSE 0 END) AS part FROM landed),
marks AS (SELECT p.part, (SELECT max(ts_us) // 1000 - {LATE_DAYS * 86_400_000} FROM parts b WHERE b.part < p.part) AS mark FROM (SELECT DISTINCT part FROM parts) p),
marked AS (SELECT p.*, coalesce(p.ts_us // 1000 < m.mark, false) AS late FROM parts p JOIN marks m USING (part)),
evn AS (SELECT * FROM marked WHERE NOT late)"""


def landings(spark, d):
    """The events in the four parts in which they land."""
    e = A.table(spark, d, "events")
    week = F.when(F.col("ts") < "2024-01-09", 0).when(F.col("ts") < "2024-01-16", 1).when(F.col("ts") < "2024-01-23", 2).otherwise(3)
    behind = F.when(F.col("event_id") % 31 == 0, 2).when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    part = F.least(F.lit(3), week + behind)
    return [e.filter(part == k) for k in range(4)]


def in_landings(spark, d):
    """Patterns of a stream that is started again after each landing, from its checkpoint."""
    SF.use_rocksdb(spark)
    path, out, cp = scratch(spark, "landed"), scratch(spark, "out"), scratch(spark, "cp")
    for part in landings(spark, d):
        part.write.mode("append").parquet(path)
        got = S.run_to_table(ET.stream_patterns(A.as_events(S.read_stream(spark, path)), WIN.window_seconds, f"{LATE_DAYS} days"), out, cp)
    return got


@query(with_(_LANDED, FRAME, PATT) + f"SELECT * FROM patterns WHERE ts_us // 1000 < (SELECT max(ts_us) // 1000 - {LATE_DAYS * 86_400_000} FROM marked)")
def stream_patterns_unordered(spark, d):
    """Rows out of the order of time give what the batch gives on the accepted ones."""
    return ET.accepted(in_landings(spark, d))


@query(with_(_LANDED) + "SELECT gpu_uuid, event_id, ts_us FROM marked WHERE late")
def stream_late_rows(spark, d):
    return ET.late_rows(in_landings(spark, d)).select("gpu_uuid", "event_id", "ts_us")


@query(with_(EV, FRAME, PATT) + f"SELECT * FROM patterns WHERE {_PASSED}")
def stream_patterns_resumed(spark, d):
    """A stream is stopped half way, its state saved as a table, and a new one started from there."""
    SF.use_rocksdb(spark)
    e, halves = A.table(spark, d, "events"), []
    records, floor = None, 0
    for k, part in enumerate((e.filter("ts < '2024-01-16'"), e.filter("ts >= '2024-01-16'"))):
        path, cp = scratch(spark, "half"), scratch(spark, "cp")
        part.write.parquet(path)
        s = ET.stream_patterns(A.as_events(S.read_stream(spark, path)), WIN.window_seconds, "0 seconds", records, floor)
        halves.append(ET.accepted(S.run_to_table(s, scratch(spark, "out"), cp)))
        if k == 0:
            root = scratch(spark, "state")
            W.save_state(ET.snapshot(spark, cp, "gpu_uuid"), root, ["gpu_uuid"], "seen_ms", 1)
            records = W.load_state(spark, root, 1)
            floor = ET.floor_of(records)
    return halves[0].union(halves[1])


@query(_FSM + f"SELECT gpu_uuid, ts_us, source, row_id, action, from_state, to_state, applied FROM run WHERE logged AND {_PASSED}")
def stream_quarantine(spark, d):
    SF.use_rocksdb(spark)
    raw = S.read_stream(spark, f"{d}/events*.parquet")
    s = ET.stream_quarantine(ET.quarantine_inputs(A.as_events(raw), A.as_actions(raw)), CFG, PASSES, "0 seconds")
    return ET.accepted(S.run_to_table(s, scratch(spark, "out"), scratch(spark, "cp")))


@query(with_(CAP, STATS, _LONG, _chart_sql("lg", "gpu_uuid || '|' || stat_name", "value", "request_id")) + f"SELECT k AS series, o AS pos, n::BIGINT AS count, {r6('ewma')}, {r6('target')}, {r6('sigma')}, breach FROM chart WHERE o < (SELECT max(o) FROM chart)")
def stream_ewma(spark, d):
    SF.use_rocksdb(spark)
    c = A.as_captures(S.read_stream(spark, f"{d}/embeddings*.parquet"))
    v = I.stats_long(I.logit_stats(c), "gpu_uuid", "request_id").select(
        F.concat_ws("|", "gpu_uuid", "stat_name").alias("series"), step_clock(F.col("request_id")), F.col("request_id").alias("pos"), "value")
    out = ET.accepted(S.run_to_table(ET.stream_ewma(v, CHART, "0 seconds"), scratch(spark, "out"), scratch(spark, "cp")))
    return rounded(out.drop("value", "ts_us", "severity"), "ewma", "target", "sigma")


@query(with_(GN) + f"SELECT run_id || '|' || layer_name AS series, step AS pos, CASE WHEN norm > ew_mean THEN 'gradient_spike' ELSE 'gradient_collapse' END AS anomaly_type, {r6('z', 'score')}, {r6('ew_mean')} FROM gr WHERE z > 2.0 AND n >= 20 AND step < (SELECT max(l_orderkey * 8 + l_linenumber) FROM lineitem)")
def stream_gradients(spark, d):
    SF.use_rocksdb(spark)
    li = S.read_stream(spark, f"{d}/lineitem*.parquet")
    pos = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    v = li.select(F.concat_ws("|", "l_returnflag", A.gpu(F.col("l_suppkey"))).alias("series"), step_clock(pos), pos.alias("pos"), (F.col("l_extendedprice") / 997).alias("value"))
    out = ET.accepted(S.run_to_table(ET.stream_gradients(v, GCFG, "0 seconds"), scratch(spark, "out"), scratch(spark, "cp")))
    return rounded(out.drop("ts_us"), "score", "ew_mean")


@query()
def stream_loss(spark, d):
    SF.use_rocksdb(spark)
    o = S.read_stream(spark, f"{d}/orders*.parquet")
    v = o.select(F.col("o_orderpriority").alias("series"), step_clock(F.col("o_orderkey")), F.col("o_orderkey").alias("pos"),
                 F.when(F.col("o_orderkey") % 211 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice") / 1000).alias("value"))
    return ET.accepted(S.run_to_table(ET.stream_loss(v, LossConfig(sigma=1.5), "0 seconds"), scratch(spark, "out"), scratch(spark, "cp"))).drop("ts_us")


@query(with_(CAP, STATS, _JSD) + f"SELECT input_hash, replica_a, replica_b, request_a, request_b, {r6('d', 'divergence')} FROM div WHERE d > 0.01")
def stream_cross_replica(spark, d):
    c = A.as_captures(S.read_stream(spark, f"{d}/embeddings*.parquet")).withColumn("ts", F.timestamp_micros(F.col("ts_us") + 86_400_000_000))
    out = S.run_to_table(S.stream_cross_replica(c, DivergenceConfig()), scratch(spark, "out"), scratch(spark, "cp"))
    return rounded(out, "divergence")


@query(DED + "SELECT * FROM sent")
def stream_dedup_alerts(spark, d):
    """The rules' alerts land as files and are then read as a stream."""
    SF.use_rocksdb(spark)
    path = scratch(spark, "alerts")
    fired(spark, d).withColumn("cooldown_seconds", F.col("cooldown_seconds") * 1000).drop("channels").write.parquet(path)
    s = SF.stream_dedup_alerts(S.read_stream(spark, path), 7_200_000)
    return S.run_to_table(s, scratch(spark, "out"), scratch(spark, "cp")).select("alert_id")


# Sessions still open at the end of the input stay in the stream's state.
@query(with_(EV) + """SELECT hostname, last_us, last_us + 14400000000 AS lost_us FROM (SELECT hostname, max(ts_us) AS last_us FROM (SELECT *, sum(fresh) OVER (PARTITION BY hostname ORDER BY ts_us) AS s FROM (
  SELECT hostname, ts_us, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY hostname ORDER BY ts_us) < 14400000000 THEN 0 ELSE 1 END AS fresh FROM evn)) GROUP BY hostname, s)
  WHERE last_us + 14400000000 <= (SELECT max(ts_us) FROM evn) // 1000 * 1000""")
def stream_heartbeat_lost(spark, d):
    e = A.as_events(S.read_stream(spark, f"{d}/events*.parquet"))
    s = S.stream_heartbeat_lost(e, "14400 seconds", "0 seconds")
    return S.run_to_table(s, scratch(spark, "out"), scratch(spark, "cp"))


def sealed_in_parts(spark, d, root):
    """The orders sealed as they arrive in three parts, none a multiple of a batch; the rest at the end."""
    path, cp = scratch(spark, "pending"), scratch(spark, "cp")
    p = A.pending_entries(spark, d).withColumnRenamed("seq", "key")
    for low, high in (("1900-01-01", "1994-03-05"), ("1994-03-05", "1997-07-20"), ("1997-07-20", "2100-01-01")):
        p.filter((F.col("ts") >= low) & (F.col("ts") < high)).write.mode("append").parquet(path)
        S.seal_stream(S.read_stream(spark, path), root, cp, "key").awaitTermination()
    S.seal_rest(spark, root, "key")
    return W.read_committed(spark, root)


@query(_LINKED + "SELECT n.rn + 1 AS entry_id, n.txt, lower(hex(r.prev)) AS previous_hash, lower(hex(r.h)) AS entry_hash, n.batch_sequence FROM nump n JOIN lk_run r USING (batch_sequence, pos)")
def seal_stream(spark, d):
    """Whole rows of a ledger sealed as the orders arrive: those of one sealed in one go."""
    entries, _ = sealed_in_parts(spark, d, scratch(spark, "ledger"))
    return hexed(entries.select("entry_id", F.col("data").cast("string").alias("txt"), "previous_hash", "entry_hash", "batch_sequence"), "previous_hash", "entry_hash")


@query(_LINKED + "SELECT batch_sequence, count(*) AS entry_count, min(rn) + 1 AS first_entry_id, max(rn) + 1 AS last_entry_id, false AS root_mismatch, 0::BIGINT AS chain_breaks, 0::BIGINT AS hash_mismatches FROM nump GROUP BY 1")
def verify_sealed_batches(spark, d):
    """Every batch of a ledger sealed in parts, verified with its links to the batch before."""
    entries, roots = sealed_in_parts(spark, d, scratch(spark, "ledger"))
    found = AU.verify_batches(entries, roots, linked=True)
    return roots.select("batch_sequence", "entry_count", "first_entry_id", "last_entry_id").join(found, "batch_sequence")
