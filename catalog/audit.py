"""Ledger sealing, verification, queries and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.core import WIN, ev, rounded
from catalog.registry import EV, query, r6, with_
from fleetwatch.config import AuditConfig
from fleetwatch.functions import hashing as HS
from fleetwatch.functions.labels import entry_type_code, entry_type_label
from fleetwatch.operators import audit as AU
from fleetwatch.sinks import writers as W
from fleetwatch.sources import adapters as A

_ZERO = "unhex('" + "0" * 64 + "')"
PEND = """pend AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 10 < 5 THEN 'ProbeResult' WHEN o_orderkey % 10 = 5 THEN 'AnomalyEvent' WHEN o_orderkey % 10 = 6 THEN 'QuarantineAction'
    WHEN o_orderkey % 10 = 7 THEN 'ConfigChange' WHEN o_orderkey % 10 = 8 THEN 'TmrResult' ELSE 'SystemEvent' END AS entry_type, o_orderdate AS ts, epoch_us(o_orderdate) AS ts_us,
    CASE WHEN o_orderkey % 10 < 8 THEN 'GPU-' || o_custkey END AS gpu_uuid, CAST(o_orderkey % 16 AS INTEGER) AS sm_id,
    CASE WHEN o_orderkey % 20 = 6 THEN 'unquarantine' ELSE 'quarantine' END || '|' || o_orderkey || '|' || o_orderpriority AS txt FROM orders)"""


def _chain(name, source, seed="''"):
    """Serial chain per batch, one row per step."""
    return f"""RECURSIVE {name}_run AS (
  SELECT batch_sequence, CAST(-1 AS BIGINT) AS pos, {_ZERO} AS h, {_ZERO} AS prev FROM (SELECT DISTINCT batch_sequence FROM {source})
  UNION ALL SELECT n.batch_sequence, n.pos, unhex(sha256(encode(n.txt) || r.h)), r.h FROM {name}_run r JOIN {source} n ON n.batch_sequence = r.batch_sequence AND n.pos = r.pos + 1)"""


LEDGER = PEND + ",\n" + "nump AS (SELECT *, seq // 1000 AS batch_sequence, seq % 1000 AS pos FROM pend),\n" + _chain("led", "nump") + """,
ledger AS (SELECT n.seq + 1 AS entry_id, n.entry_type, n.ts, n.ts_us, n.gpu_uuid, n.sm_id, CASE WHEN n.seq % 997 = 3 THEN n.txt || 'x' ELSE n.txt END AS txt,
    r.prev AS previous_hash, r.h AS entry_hash, n.batch_sequence FROM nump n JOIN led_run r ON r.batch_sequence = n.batch_sequence AND r.pos = n.pos)"""
LED = with_(LEDGER)
P0, P1 = 852_076_800_000_000, 978_307_200_000_000  # 1997-01-01 .. 2001-01-01


def led(spark, d):
    return A.ledger(spark, d)


def hexed(df, *cols):
    return df.select(*[F.lower(F.hex(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


@query(LED + "SELECT entry_id, entry_type, ts_us, gpu_uuid, sm_id, txt AS data, lower(hex(previous_hash)) AS previous_hash, lower(hex(entry_hash)) AS entry_hash, batch_sequence FROM ledger")
def sealed_ledger(spark, d):
    x = hexed(led(spark, d).drop("ts"), "previous_hash", "entry_hash")
    return x.withColumn("data", F.decode("data", "UTF-8"))


@query(with_(PEND) + "SELECT seq, rn // 1000 AS batch_sequence, rn % 1000 AS pos FROM (SELECT seq, row_number() OVER (ORDER BY ts_us, seq) - 1 AS rn FROM pend)")
def number_pending(spark, d):
    p = A.pending_entries(spark, d).withColumnRenamed("seq", "key")
    n = AU.number_pending(p, "key", AuditConfig())
    return n.select(F.col("key").alias("seq"), "batch_sequence", "pos")


_MERKLE = """RECURSIVE {n}_tree AS (
  SELECT {k}, 0 AS lvl, pos, h FROM {src}
  UNION ALL SELECT {k}, lvl + 1, pos // 2, CASE WHEN count(*) OVER (PARTITION BY {k}, pos // 2) = 2 THEN unhex(sha256(first(h) OVER (PARTITION BY {k}, pos // 2 ORDER BY pos) || last(h) OVER (PARTITION BY {k}, pos // 2 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))) ELSE h END
    FROM {n}_tree WHERE lvl < {depth} QUALIFY row_number() OVER (PARTITION BY {k}, pos // 2 ORDER BY pos) = 1)"""


def merkle_sql(name, src, key, depth):
    return _MERKLE.format(n=name, k=key, src=src, depth=depth) + f",\n{name} AS (SELECT {key}, h AS merkle_root FROM {name}_tree WHERE lvl = {depth})"


_DOCLEAF = "docl AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, unhex(sha256(encode(text))) AS h FROM documents)"


@query(with_(_DOCLEAF, merkle_sql("mr", "docl", "lang", 14)) + "SELECT lang, lower(hex(merkle_root)) AS merkle_root FROM mr")
def merkle_roots(spark, d):
    from fleetwatch.plans.chunked import running

    docs = A.documents(spark, d).select("lang", "doc_id", HS.sha256(F.encode("text", "UTF-8")).alias("h"))
    n = running(docs, ["lang"], ["doc_id"], F.floor(F.col("doc_id") / 4096), {"n": ("sum", F.lit(1))})
    return hexed(HS.merkle_roots(n.withColumn("pos", F.col("n") - 1), ["lang"], "pos", "h"), "merkle_root")


_ROOTS = "leaves AS (SELECT batch_sequence, entry_id - min(entry_id) OVER (PARTITION BY batch_sequence) AS pos, entry_hash AS h FROM ledger)"


@query(with_(LEDGER, _ROOTS, merkle_sql("mr", "leaves", "batch_sequence", 10)) + """SELECT l.batch_sequence, count(*) AS entry_count, min(entry_id) AS first_entry_id, max(entry_id) AS last_entry_id,
  lower(hex(any_value(m.merkle_root))) AS merkle_root FROM ledger l JOIN mr m USING (batch_sequence) GROUP BY 1""")
def batch_roots(spark, d):
    return hexed(AU.batch_roots(led(spark, d)), "merkle_root")


@query(with_(LEDGER, _ROOTS, merkle_sql("mr", "leaves", "batch_sequence", 10)) + "SELECT l.entry_id, l.batch_sequence, lower(hex(m.merkle_root)) AS merkle_root FROM ledger l JOIN mr m USING (batch_sequence)")
def entries_with_roots(spark, d):
    e = led(spark, d)
    return hexed(AU.entries_with_roots(e, AU.batch_roots(e)).select("entry_id", "batch_sequence", "merkle_root"), "merkle_root")


@query(LED + "SELECT batch_sequence, batch_sequence % 3 = 1 AS root_mismatch, 0::BIGINT AS chain_breaks, count(*) FILTER (unhex(sha256(encode(txt) || previous_hash)) <> entry_hash) AS hash_mismatches FROM ledger GROUP BY 1")
def verify_batches(spark, d):
    e = led(spark, d)
    stored = AU.batch_roots(e).withColumn(
        "merkle_root", F.when(F.col("batch_sequence") % 3 == 1, HS.sha256(F.col("merkle_root"))).otherwise(F.col("merkle_root"))
    )
    return AU.verify_batches(e, stored)


_FAIL = """fails AS (SELECT entry_id, 'hash_mismatch' AS failure FROM ledger WHERE unhex(sha256(encode(txt) || previous_hash)) <> entry_hash
  UNION ALL SELECT entry_id, 'chain_break' FROM (SELECT *, lag(entry_hash) OVER (ORDER BY entry_id) AS p FROM ledger) WHERE CASE WHEN p IS NULL THEN entry_id <= 1 AND previous_hash <> """ + _ZERO + """ ELSE previous_hash <> p END)"""


@query(with_(LEDGER, _FAIL) + "SELECT * FROM fails")
def verify_chain(spark, d):
    return AU.verify_chain(led(spark, d))


@query(with_(LEDGER, _FAIL) + "SELECT * FROM fails WHERE failure = 'hash_mismatch'")
def verify_entries(spark, d):
    return AU.verify_entries(led(spark, d))


@query(with_(LEDGER, _FAIL) + """SELECT (SELECT count(*) FROM ledger) AS checked, count(*) FILTER (failure = 'chain_break') AS chain_breaks, count(*) FILTER (failure = 'hash_mismatch') AS hash_mismatches,
  min(entry_id) AS first_failure, count(*) = 0 AS valid FROM fails""")
def verification_summary(spark, d):
    e = led(spark, d)
    return AU.verification_summary(e, AU.verify_chain(e))


@query(LED + f"""SELECT entry_id, unnest(list_filter([CASE WHEN p IS NOT NULL AND previous_hash <> p THEN 'chain_break' END, CASE WHEN unhex(sha256(encode(txt) || previous_hash)) <> entry_hash THEN 'hash_mismatch' END], lambda x: x IS NOT NULL)) AS failure
  FROM (SELECT *, lag(entry_hash) OVER (ORDER BY entry_id) AS p FROM ledger WHERE ts_us BETWEEN {P1} - 300::BIGINT * 86400000000 AND {P1}) WHERE p IS NOT NULL OR entry_id > 1""")
def verify_recent(spark, d):
    return AU.verify_recent(led(spark, d), P1, 300 * 24)


@query(LED + f"SELECT entry_id, entry_type, ts_us, gpu_uuid FROM ledger WHERE entry_type = 'AnomalyEvent' AND ts_us >= {P0} AND ts_us < {P1} ORDER BY entry_id DESC LIMIT 100 OFFSET 20")
def query_audit(spark, d):
    q = AU.query_audit(led(spark, d), entry_type="AnomalyEvent", start_us=P0, end_us=P1, limit=100, offset=20, descending=True)
    return q.select("entry_id", "entry_type", "ts_us", "gpu_uuid")


@query(LED + "SELECT max(entry_id) AS entry_id, lower(hex(arg_max(entry_hash, entry_id))) AS entry_hash, coalesce(max(batch_sequence), 0) AS last_batch_sequence FROM ledger")
def last_entry(spark, d):
    return hexed(AU.last_entry(led(spark, d)), "entry_hash")


@query(LED + """SELECT entry_id, entry_type, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS timestamp, coalesce(gpu_uuid, '') AS gpu_uuid, coalesce(sm_id::VARCHAR, '') AS sm_id, base64(encode(txt)) AS data_base64,
  lower(hex(previous_hash)) AS previous_hash, lower(hex(entry_hash)) AS entry_hash, batch_sequence FROM ledger""")
def export_rows(spark, d):
    return AU.export_rows(led(spark, d))


@query(LED + """SELECT entry_id, '<tr><td>' || entry_id || '</td><td>' || strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') || '</td><td>' || entry_type || '</td><td>' || coalesce(gpu_uuid, '') || '</td><td>' || batch_sequence || '</td><td>' || left(lower(hex(entry_hash)), 16) || '</td></tr>' AS value FROM ledger""")
def export_html_rows(spark, d):
    return AU.html_rows(led(spark, d))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents")
def data_preview(spark, d):
    docs = A.documents(spark, d)
    return docs.select("doc_id", AU.data_preview(F.encode("text", "UTF-8")).alias("preview"))


def _of(kind):
    return f"count(*) FILTER (entry_type = '{kind}')"


PER = f"per AS (SELECT * FROM ledger WHERE ts_us >= {P0} AND ts_us < {P1})"
PFAIL = """pfails AS (SELECT 1 FROM (SELECT *, lag(entry_hash) OVER (ORDER BY entry_id) AS p FROM per) WHERE unhex(sha256(encode(txt) || previous_hash)) <> entry_hash OR (p IS NOT NULL AND previous_hash <> p))"""


@query(with_(LEDGER, PER, PFAIL) + f"""SELECT count(*) AS total_events, {_of('SystemEvent')} AS system_events,
  {_of('QuarantineAction')} - count(*) FILTER (entry_type = 'QuarantineAction' AND contains(lower(txt), 'unquarantine')) AS quarantine_events,
  count(*) FILTER (entry_type = 'QuarantineAction' AND contains(lower(txt), 'unquarantine')) AS unquarantine_events,
  {r6(f"count(*) FILTER (entry_type = 'QuarantineAction' AND contains(lower(txt), 'unquarantine')) / {_of('QuarantineAction')}", 'availability_ratio')},
  {_of('AnomalyEvent')} AS anomalies, {_of('ProbeResult')} AS probes, {r6(f"{_of('AnomalyEvent')} / {_of('ProbeResult')}", 'anomaly_rate')},
  {_of('TmrResult')} AS tmr_comparisons, {_of('ConfigChange')} AS config_changes, (SELECT count(*) = 0 FROM pfails) AS chain_valid FROM per""")
def soc2_report(spark, d):
    return rounded(AU.soc2_report(led(spark, d), P0, P1), "availability_ratio", "anomaly_rate")


@query(with_(LEDGER, PER, PFAIL) + f"""SELECT count(*) AS total_events, count(gpu_uuid) AS gpu_events, {_of('QuarantineAction')} AS quarantine_actions, {_of('ConfigChange')} AS config_changes,
  {_of('AnomalyEvent')} AS anomalies, {_of('ProbeResult')} AS probes, {_of('TmrResult')} AS tmr_comparisons, count(DISTINCT gpu_uuid) AS gpus_observed,
  (SELECT count(*) FROM per a WHERE a.entry_type = 'AnomalyEvent' AND a.gpu_uuid IN (SELECT gpu_uuid FROM per WHERE entry_type = 'QuarantineAction')) AS incidents,
  (SELECT string_agg(entry_id::VARCHAR, ',' ORDER BY entry_id) FROM (SELECT entry_id FROM per WHERE entry_type = 'AnomalyEvent' ORDER BY entry_id LIMIT 10)) AS evidence,
  (SELECT count(*) = 0 FROM pfails) AS chain_valid, {r6(f"{_of('AnomalyEvent')} / {_of('ProbeResult')}", 'anomaly_rate')}, false AS no_gpus_finding,
  {_of('AnomalyEvent')} / {_of('ProbeResult')} > 0.01 AS anomaly_rate_finding, 1 AS findings_total FROM per""")
def iso27001_report(spark, d):
    r = AU.iso27001_report(led(spark, d), P0, P1)
    return rounded(r.withColumn("evidence", F.array_join(F.col("evidence").cast("array<string>"), ",")), "anomaly_rate")


@query(with_(LEDGER, PER) + "SELECT entry_id, entry_type, ts_us, gpu_uuid, txt AS preview, CASE entry_type WHEN 'QuarantineAction' THEN 1 ELSE 2 END AS part FROM per WHERE entry_type IN ('QuarantineAction', 'SystemEvent')")
def availability_events(spark, d):
    return AU.availability_events(led(spark, d), P0, P1)


@query(with_(LEDGER, PER) + "SELECT entry_id, gpu_uuid, ts_us FROM per a WHERE entry_type = 'AnomalyEvent' AND gpu_uuid IN (SELECT gpu_uuid FROM per WHERE entry_type = 'QuarantineAction')")
def incidents(spark, d):
    return AU.incidents(led(spark, d), P0, P1).select("entry_id", "gpu_uuid", "ts_us")


@query(with_(LEDGER, PER) + "SELECT DISTINCT gpu_uuid FROM per WHERE gpu_uuid IS NOT NULL ORDER BY 1")
def gpus_observed(spark, d):
    return AU.gpus_observed(led(spark, d), P0, P1)


@query(with_(LEDGER, PER) + "SELECT gpu_uuid, min(ts_us) AS first_seen_us, max(ts_us) AS last_seen_us, count(*) AS events FROM per WHERE gpu_uuid IS NOT NULL GROUP BY 1")
def ledger_inventory(spark, d):
    from fleetwatch.operators.health import asset_inventory as inventory

    return inventory(AU.in_period(led(spark, d), P0, P1))


@query(with_(EV) + """SELECT gpu_uuid, round(avg(dt) / 1e6, 3) AS mean_seconds, count(*) AS detections FROM (
  SELECT a.gpu_uuid, f.event_id, min(a.ts_us - f.ts_us) AS dt FROM (SELECT * FROM evn WHERE event_type IN ('inference_anomaly', 'training_anomaly', 'invariant_violation')) a
  ASOF JOIN (SELECT * FROM evn WHERE event_type = 'probe_fail') f ON f.gpu_uuid = a.gpu_uuid AND a.ts_us >= f.ts_us GROUP BY 1, 2) GROUP BY 1""")
def mean_time_to_detect(spark, d):
    return AU.mean_time_to_detect(ev(spark, d), WIN.chunk_us).withColumn("mean_seconds", F.round("mean_seconds", 3))


KEY = b"fleet signing key"
_IPAD = "".join(f"{b ^ 0x36:02x}" for b in KEY.ljust(64, b"\0"))
_OPAD = "".join(f"{b ^ 0x5C:02x}" for b in KEY.ljust(64, b"\0"))


@query(f"""SELECT doc_id, tag AS hmac, doc_id % 5 <> 0 AS valid FROM (SELECT doc_id, sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(text)))) AS tag FROM documents)""")
def hmac_verify(spark, d):
    docs = A.documents(spark, d).withColumn("data", F.encode("text", "UTF-8"))
    tag = HS.hmac_sha256(KEY, F.col("data"))
    sent = F.when(F.col("doc_id") % 5 == 0, HS.sha256(F.col("data"))).otherwise(tag)
    return docs.select("doc_id", HS.hex_lower(tag).alias("hmac"), HS.hmac_verify(KEY, F.col("data"), sent).alias("valid"))


@query("SELECT doc_id, sha256(encode(text)) AS input_hash, sha256(encode(text) || " + _ZERO + ") AS chained FROM documents")
def input_hashes(spark, d):
    data = F.encode("text", "UTF-8")
    return A.documents(spark, d).select(
        "doc_id", HS.hex_lower(HS.sha256(data)).alias("input_hash"),
        HS.hex_lower(HS.chain_hash(data, F.unhex(F.lit(HS.ZERO_HASH)))).alias("chained"),
    )


@query(with_(PEND) + """SELECT seq, entry_type, CASE entry_type WHEN 'ProbeResult' THEN 0 WHEN 'AnomalyEvent' THEN 1 WHEN 'QuarantineAction' THEN 2 WHEN 'ConfigChange' THEN 3 WHEN 'TmrResult' THEN 4 ELSE 5 END AS code,
  entry_type AS back FROM pend""")
def entry_type_codes(spark, d):
    code = entry_type_code(F.col("entry_type"))
    return A.pending_entries(spark, d).select("seq", "entry_type", code.alias("code"), entry_type_label(code).alias("back"))


@query("""SELECT o_orderkey AS seq, CASE WHEN o_orderstatus = 'P' THEN 'rejected' ELSE 'accepted' END AS outcome,
  CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN o_orderkey % 3 = 0 THEN 42 ELSE epoch_us(o_orderdate) END END AS ts_us FROM orders""")
def split_pending(spark, d):
    o = A.table(spark, d, "orders")
    raw = o.select(
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") == "P", "Unknown").otherwise("ProbeResult").alias("entry_type"),
        F.when(F.col("o_orderkey") % 3 != 0, A.micros(F.col("o_orderdate"))).alias("ts_us"),
    )
    ok, bad = AU.split_pending(raw, 42)
    return ok.select("seq", F.lit("accepted").alias("outcome"), "ts_us").unionByName(
        bad.select("seq", F.lit("rejected").alias("outcome"), F.lit(None).cast("long").alias("ts_us"))
    )


@query(with_(PEND) + """SELECT strftime(ts, '%Y_%m') AS month, count(*) AS entries, CAST(max(CAST(date_trunc('month', ts) + INTERVAL 1 MONTH AS DATE)) AS VARCHAR) AS month_end FROM pend GROUP BY 1
  HAVING max(date_trunc('month', ts) + INTERVAL 1 MONTH) <= DATE '2006-01-01' - 2555""")
def expired_months(spark, d):
    m = W.expired_months(A.pending_entries(spark, d), F.lit("2006-01-01"), 2555)
    return m.withColumn("month_end", F.col("month_end").cast("string"))


@query()
def storage_bytes(spark, d):
    return W.storage_bytes(A.table(spark, d, "lineitem"))


@query(with_(LEDGER, _ROOTS, merkle_sql("mr", "leaves", "batch_sequence", 10)) + "SELECT batch_sequence, lower(hex(merkle_root)) AS merkle_root, 7 AS external_us, 'notary' AS service FROM mr")
def chain_anchors(spark, d):
    return hexed(W.anchors(AU.batch_roots(led(spark, d)), 7, "notary"), "merkle_root")


_LINKED = with_(PEND, "nump AS (SELECT *, rn // 1000 AS batch_sequence, rn % 1000 AS pos FROM (SELECT *, row_number() OVER (ORDER BY ts_us, seq) - 1 AS rn FROM pend))",
    "pleaf AS (SELECT batch_sequence, pos, unhex(sha256(encode(txt))) AS h FROM nump)", merkle_sql("pr", "pleaf", "batch_sequence", 10),
    f"""RECURSIVE lk_run AS (
  SELECT b.batch_sequence, CAST(-1 AS BIGINT) AS pos, coalesce(p.merkle_root, {_ZERO}) AS h, {_ZERO} AS prev FROM (SELECT DISTINCT batch_sequence FROM nump) b LEFT JOIN pr p ON p.batch_sequence = b.batch_sequence - 1
  UNION ALL SELECT n.batch_sequence, n.pos, unhex(sha256(encode(n.txt) || r.h)), r.h FROM lk_run r JOIN nump n ON n.batch_sequence = r.batch_sequence AND n.pos = r.pos + 1)""")


@query(_LINKED + "SELECT n.rn + 1 AS entry_id, n.seq, lower(hex(r.prev)) AS previous_hash, lower(hex(r.h)) AS entry_hash, n.batch_sequence FROM nump n JOIN lk_run r USING (batch_sequence, pos)")
def seal_linked(spark, d):
    p = A.pending_entries(spark, d).withColumnRenamed("seq", "key")
    n = AU.number_pending(p, "key", AuditConfig())
    sealed = AU.seal_linked(n)
    keys = n.select((F.col("seq") + 1).alias("entry_id"), F.col("key").alias("seq"))
    out = sealed.select("entry_id", "previous_hash", "entry_hash", "batch_sequence").join(keys, "entry_id")
    return hexed(out, "previous_hash", "entry_hash")
