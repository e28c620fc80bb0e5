"""Behaviour of single operators on small inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetwatch.config import AuditConfig, BeliefConfig, DistributionConfig, GradientConfig, LossConfig, SpectralConfig, WindowConfig
from fleetwatch.functions.hashing import sha256
from fleetwatch.operators import alerts as AL
from fleetwatch.operators import audit as AU
from fleetwatch.operators import beliefs as B
from fleetwatch.operators import inference as I
from fleetwatch.operators import patterns as P
from fleetwatch.operators import quarantine as Q
from fleetwatch.operators import training as TN
from fleetwatch.operators import trust as TR
from fleetwatch.plans.chunked import time_chunk

EVENT = "gpu_uuid string, event_id string, ts_us long, event_type string, sm_id int"
SEC = 1_000_000


def events(spark, rows):
    return spark.createDataFrame([("g", f"e{i:03}", t * SEC, k, s) for i, (t, k, s) in enumerate(rows)], EVENT)


def test_one_failure_hardly_moves_a_strong_prior(spark):
    b = B.gpu_beliefs(events(spark, [(1, "probe_fail", 0)])).first()
    assert 0.998 < b.reliability < 1.0 and b.probe_failures == 1


def test_sustained_failures_escalate_in_order(spark):
    e = events(spark, [(i, "probe_fail", 0) for i in range(120)])
    t = Q.quarantine_auto(B.belief_trajectory(e, BeliefConfig(), WindowConfig(300, 10))).orderBy("ts_us").collect()
    assert [x.to_state for x in t] == ["SUSPECT", "QUARANTINED", "CONDEMNED"]


def test_telemetry_does_not_change_a_belief_and_errors_weigh_less(spark):
    rows = [(1, "thermal_spike", None), (2, "probe_error", 0), (3, "probe_pass", 0)]
    b = B.gpu_beliefs(events(spark, rows)).first()
    assert (b.alpha, b.beta) == (1001.0, pytest.approx(1.3))


def test_patterns_expire_with_the_window(spark):
    rows = [(0, "probe_fail", 3), (10, "inference_anomaly", None), (310, "probe_pass", 1), (400, "probe_pass", 1)]
    m = P.match_patterns(events(spark, rows), WindowConfig(300, 60)).collect()
    found = {(r.event_id, r.pattern) for r in m}
    assert ("e001", "probe_and_anomaly") in found and ("e001", "multi_signal") in found
    assert ("e002", "anomaly_without_probe") in found and not any(e == "e003" for e, _ in found)
    assert next(r.sm_id for r in m if r.pattern == "probe_and_anomaly") == 3


def test_sm_localized_counts_per_sm(spark):
    rows = [(0, "probe_fail", 1), (5, "probe_fail", 2), (9, "probe_fail", 1), (11, "probe_pass", 7)]
    m = P.sm_localized(events(spark, rows), WindowConfig(300, 4)).orderBy("event_id").collect()
    assert [(r.event_id, r.sm_id, r.contributing) for r in m] == [("e002", 1, 2), ("e003", 1, 2)]


def test_condemned_is_terminal_and_rejections_are_reported(spark):
    traj = B.belief_trajectory(events(spark, [(i, "probe_pass", 0) for i in range(5)]))
    acts = spark.createDataFrame(
        [("g", f"a{i}", (10 + i) * SEC, a) for i, a in enumerate(["condemn", "reinstate", "clear_suspect"])],
        "gpu_uuid string, action_id string, ts_us long, action string",
    )
    t = Q.quarantine_fsm(traj, acts).orderBy("ts_us").collect()
    assert [(x.action, x.applied, x.to_state) for x in t] == [
        ("condemn", True, "CONDEMNED"), ("reinstate", False, "CONDEMNED"), ("clear_suspect", False, "CONDEMNED")]


def test_votes(spark):
    rows = [(1, s, f"g{s}", f) for s, f in enumerate("aab", 1)] + [(2, s, f"g{s}", f) for s, f in enumerate("abc", 1)] + [(3, 1, "g1", "a")]
    r = spark.createDataFrame(rows, "canary_id long, slot int, gpu_uuid string, fingerprint string").withColumn("weight", F.lit(1.0)).withColumn("ts_us", F.lit(0))
    v = {x.canary_id: (x.outcome, x.dissenter_gpu) for x in TR.majority_vote(r).collect()}
    assert v == {1: ("dissent", "g3"), 2: ("no_consensus", None), 3: ("insufficient", None)}
    w = {x.canary_id: (x.consensus, x.dissenters) for x in TR.weighted_vote(r).collect()}
    assert w[2] == ("c", [1, 2])  # equal weights: the last wins


def chain(spark, n=25, batch=10):
    p = spark.createDataFrame([("SystemEvent", i * SEC, f"p{i}", i) for i in range(n)], "entry_type string, ts_us long, txt string, key long")
    p = p.select("entry_type", "ts_us", F.timestamp_micros("ts_us").alias("ts"), F.lit(None).cast("string").alias("gpu_uuid"),
                 F.lit(None).cast("int").alias("sm_id"), F.encode("txt", "UTF-8").alias("data"), "key")
    num = AU.number_pending(p, "key", AuditConfig(batch_rows=batch))
    return AU.seal_linked(num)


def test_linked_ledger_verifies_and_tampering_shows(spark):
    e = chain(spark).persist()
    assert AU.verify_linked(e).count() == 0
    flipped = e.withColumn("data", F.when(F.col("entry_id") == 5, F.encode(F.lit("evil"), "UTF-8")).otherwise(F.col("data")))
    assert {(r.entry_id, r.failure) for r in AU.verify_linked(flipped).collect()} >= {(5, "hash_mismatch"), (11, "chain_break")}
    dropped = e.filter("entry_id <> 7")
    assert {(r.entry_id, r.failure) for r in AU.verify_linked(dropped).collect()} >= {(8, "chain_break")}


def test_single_batch_chain_matches_serial_hashing(spark):
    import hashlib

    rows = chain(spark, 8, 100).orderBy("entry_id").collect()
    h = bytes(32)
    for r in rows:
        assert bytes(r.previous_hash) == h
        h = hashlib.sha256(bytes(r.data) + h).digest()
        assert bytes(r.entry_hash) == h


def _failures_by_batch(entries, roots, linked):
    """The batches' failures as `verify_batches` made them before, row by row from `verify_linked` and `verify_chain`."""
    again = AU.batch_roots(entries).select("batch_sequence", F.col("merkle_root").alias("again"))
    j = roots.select("batch_sequence", "merkle_root").join(again, "batch_sequence", "full")
    out = {r["batch_sequence"]: [r["merkle_root"] is None or r["merkle_root"] != r["again"], 0, 0] for r in j.collect()}
    batch = {r["entry_id"]: r["batch_sequence"] for r in entries.select("entry_id", "batch_sequence").collect()}
    heads = {min(i for i, b in batch.items() if b == x) for x in set(batch.values())}
    found = AU.verify_linked(entries) if linked else AU.verify_chain(entries)
    for r in found.collect():
        if linked or r["failure"] != "chain_break" or r["entry_id"] not in heads:
            out[batch[r["entry_id"]]][1 if r["failure"] == "chain_break" else 2] += 1
    return {b: tuple(v) for b, v in out.items()}


def test_batches_are_verified_row_by_row_or_in_blocks_alike(spark):
    e = chain(spark, 5200, 2500).persist()  # batches of three blocks
    roots = AU.batch_roots(e).persist()
    small = chain(spark, 45, 10).persist()
    where = lambda c, name, value: F.when(F.expr(c), value).otherwise(F.col(name)).alias(name)
    evil = F.encode(F.lit("evil"), "UTF-8")
    null = F.lit(None).cast("binary")
    forms = [
        (e, roots), (e.filter("entry_id NOT IN (1025, 2600, 4000)"), roots), (e.withColumn("data", where("entry_id IN (3, 2500, 5200)", "data", evil)), roots),
        (e.withColumn("entry_hash", where("entry_id IN (1024, 2000)", "entry_hash", null)), roots),
        (e.withColumn("previous_hash", where("entry_id IN (1025, 2501, 4)", "previous_hash", evil)), roots.filter("batch_sequence <> 1")),
    ]
    own = AU.batch_roots(small).persist()
    forms += [
        (small.withColumn("batch_sequence", where("entry_id IN (7, 8, 33)", "batch_sequence", F.lit(1).cast("long"))), own),  # rows of other batches on both sides
        (small.filter("batch_sequence <> 2"), own), (small.withColumn("data", where("entry_id = 20", "data", null)), own),
    ]
    for k, (entries, stored) in enumerate(forms):
        linked = k % 4 != 1
        got = {r[0]: (r[1], r[2], r[3]) for r in AU.verify_batches(entries, stored, linked).select("batch_sequence", "root_mismatch", "chain_breaks", "hash_mismatches").collect()}
        assert got == _failures_by_batch(entries, stored, linked)
        assert k or not any(map(any, got.values()))


def test_a_repeated_entry_fails_once(spark):
    e = chain(spark, 20, 10).persist()
    twice = e.union(e.filter("entry_id = 5"))
    got = {r["batch_sequence"]: (r["root_mismatch"], r["chain_breaks"]) for r in AU.verify_batches(twice, AU.batch_roots(e), linked=True).collect()}
    assert got == {0: (True, 1), 1: (False, 1)}


@pytest.mark.parametrize("batch", [3, 50])
def test_a_linked_ledger_equals_serial_hashing(spark, batch):
    """More batches than one task seals: the first of its neighbours has its seed from a pass ahead."""
    import hashlib

    def root(nodes):
        while len(nodes) > 1:
            nodes = [hashlib.sha256(b"".join(nodes[i:i + 2])).digest() if len(nodes[i:i + 2]) == 2 else nodes[i] for i in range(0, len(nodes), 2)]
        return nodes[0]

    rows, seed = chain(spark, 401, batch).orderBy("entry_id").collect(), bytes(32)
    assert [r.entry_id for r in rows] == list(range(1, 402))
    for k in range(0, 401, batch):
        h = seed
        for r in rows[k:k + batch]:
            assert (r.batch_sequence, bytes(r.previous_hash)) == (k // batch, h)
            h = hashlib.sha256(bytes(r.data) + h).digest()
            assert bytes(r.entry_hash) == h
        seed = root([hashlib.sha256(bytes(r.data)).digest() for r in rows[k:k + batch]])


def test_verified_batches_come_from_written_blocks(spark, tmp_path):
    """Before, the result's plan read all entries again for each root, link and count."""
    chain(spark, 3000, 100).write.parquet(str(tmp_path / "e"))
    e = spark.read.parquet(str(tmp_path / "e"))
    found = AU.verify_batches(e, AU.batch_roots(e).persist(), linked=True)
    assert not set(e.inputFiles()) & set(found.select("batch_sequence", "chain_breaks", "hash_mismatches").inputFiles())
    assert found.count() == 30 and found.filter("root_mismatch OR chain_breaks + hash_mismatches > 0").count() == 0


def test_genesis(spark):
    g = AU.genesis_entry(spark, 0)
    assert g.select((sha256(F.concat("data", "previous_hash")) == F.col("entry_hash"))).first()[0]


@pytest.mark.parametrize("chunk", [30, 1000])
def test_cooldown_is_greedy_over_sent_alerts(spark, chunk):
    rng = random.Random(9)
    rows = [(f"k{rng.randrange(2)}", f"a{i:03}", rng.randrange(600) * SEC, 10) for i in range(150)]
    a = spark.createDataFrame(rows, "dedup_key string, alert_id string, ts_us long, cooldown_seconds int")
    got = {r.alert_id for r in AL.dedup_alerts(a, chunk * SEC).collect()}
    want, last = set(), {}
    for k, i, t, c in sorted(rows, key=lambda r: (r[2], r[1])):
        if k not in last or t - last[k] >= c * SEC:
            want.add(i)
            last[k] = t
    assert got == want


def test_gradient_spike_needs_warmup(spark):
    vals = [1.0 + 0.01 * (i % 5) for i in range(60)] + [50.0]
    d = spark.createDataFrame([("l", i, v) for i, v in enumerate(vals)], "layer string, step long, norm double")
    a = TN.gradient_anomalies(d, ["layer"], ["step"], time_chunk("step", 16), GradientConfig()).collect()
    assert [(x.step, x.anomaly_type) for x in a] == [(60, "gradient_spike")]
    early = TN.gradient_anomalies(d.filter("step > 50"), ["layer"], ["step"], time_chunk("step", 16)).collect()
    assert early == []


@pytest.mark.parametrize("rows_per_chunk", [7, 10_000])
def test_ar_residuals_match_a_refit_per_step(spark, rows_per_chunk):
    rng = np.random.default_rng(1)
    x = [1.0, 0.8, 0.9, 1.1, 1.0]
    for _ in range(60):
        x.append(0.5 * x[-1] + 0.2 * x[-2] + 0.3 + rng.normal() * 0.05)
    d = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(x)], "run_id string, step long, loss double")
    cfg = LossConfig()
    got = {r.step: r for r in TN.ar_residuals(d, ["run_id"], ["step"], time_chunk("step", 9), cfg, rows_per_chunk).collect()}
    p = cfg.order
    for t in range(cfg.warmup, len(x)):
        h = np.array(x[:t])
        m = np.column_stack([h[p - i - 1 : t - i - 1] for i in range(p)])
        c = np.linalg.solve(m.T @ m + 1e-8 * np.eye(p), m.T @ h[p:])
        std = (h[p:] - m @ c).std()
        assert got[t].z == pytest.approx(abs(x[t] - c @ h[-p:][::-1]) / std, rel=1e-5)
    assert got[cfg.warmup - 1].z == 0.0


def test_nonfinite_and_plateau(spark):
    vals = [2.0] * 60 + [math.nan, math.inf]
    d = spark.createDataFrame([("r", i, v) for i, v in enumerate(vals)], "run_id string, step long, loss double")
    bad = TN.loss_nonfinite(d, ["run_id"], ["step"], time_chunk("step", 10)).orderBy("step").collect()
    assert [(b.step, b.nan_count) for b in bad] == [(60, 1), (61, 2)]
    flat = TN.loss_plateau(d, ["run_id"], ["step"], time_chunk("step", 10), LossConfig(), 13).collect()
    assert {f.step for f in flat} == set(range(49, 60))


def captures(spark, n, bad=()):
    rng = np.random.default_rng(8)
    rows = [("m", i, (rng.normal(size=32) * (9 if i in bad else 1) + (6 if i in bad else 0)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "model string, pos long, logits array<double>")


def test_distribution_monitor_flags_shifted_rows_in_any_chunking(spark):
    c = captures(spark, 90, bad={70, 85})
    cfg = DistributionConfig(baseline_size=60)
    runs = []
    for width in (20, 1000):
        r = I.distribution_monitor(c, ["model"], ["pos"], time_chunk("pos", width), cfg)
        runs.append({(x.pos, x.stat_name, x.baseline_n) for x in r.collect()})
    assert runs[0] == runs[1] and {(p, s) for p, s, _ in runs[0]} >= {(70, "ks_test"), (85, "ks_test")}


def test_spectral_monitor_does_not_depend_on_chunks(spark):
    f = I.spectral_features(captures(spark, 80, bad={50}))
    runs = []
    for width in (16, 1000):
        r = I.spectral_monitor(f, ["model"], ["pos"], time_chunk("pos", width), SpectralConfig(baseline_window=20))
        runs.append(sorted((x.pos, x.stat_name, round(x.observed, 9), x.baseline_n) for x in r.collect()))
    assert runs[0] == runs[1]


def test_spectral_monitor_equals_row_by_row(spark):
    """Against the plain definition, one row after the other; a non-finite row is passed over."""
    rows = I.spectral_features(captures(spark, 150, bad={50, 51, 90})).orderBy("pos").toPandas()
    rows.at[70, "hf_ratio"] = float("nan")
    cfg, clean, want = SpectralConfig(baseline_window=20, hf_ratio=0.35, z_warning=2.0, z_critical=2.5), [], []
    for r in rows.itertuples():
        if not np.isfinite(r.hf_ratio):
            continue
        base, mine, p = clean[-20:], [], np.array(r.psd)
        if r.hf_ratio > 0.35:
            mine.append((r.pos, "high_freq_ratio", r.hf_ratio, len(base), "warning"))
        if len(base) >= 10:
            h, mean = np.array([x for x, _ in base]), np.mean([x for _, x in base], axis=0)
            z, cosine = (r.hf_ratio - h.mean()) / h.std(), p @ mean / np.linalg.norm(p) / np.linalg.norm(mean)
            if abs(z) > 2.0:
                mine.append((r.pos, "high_freq_z_score", z, len(base), "critical" if abs(z) > 2.5 else "warning"))
            if cosine < 0.8:
                mine.append((r.pos, "psd_cosine_similarity", cosine, len(base), "warning"))
        want += mine
        if not mine:
            clean.append((r.hf_ratio, p))
    f = spark.createDataFrame(rows[["model", "pos", "hf_ratio", "psd"]], "model string, pos long, hf_ratio double, psd array<double>")
    got = I.spectral_monitor(f, ["model"], ["pos"], time_chunk("pos", 40), cfg).collect()
    key = lambda x: (x[0], x[1], round(x[2], 8), x[3], x[4])
    assert sorted(key((x.pos, x.stat_name, x.observed, x.baseline_n, x.severity)) for x in got) == sorted(map(key, want))
    assert {x.stat_name for x in got} == {"high_freq_ratio", "high_freq_z_score", "psd_cosine_similarity"}


def test_count_min_never_undercounts(spark):
    rng = random.Random(2)
    d = spark.createDataFrame([(rng.randrange(300),) for _ in range(2000)], "item int")
    exact = {r["item"]: r["count"] for r in d.groupBy("item").count().collect()}
    est = I.estimate_counts(I.count_min_sketch(d, "item", width=64), d, "item", width=64).collect()
    assert all(r.estimate >= exact[r["item"]] for r in est) and len(est) == len(exact)


def test_projection_of_chunks_adds_up(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=48).astype(np.float32)
    rows = [(1, c, v[c * 16 : c * 16 + 16].tolist()) for c in range(3)]
    d = spark.createDataFrame(rows, "step long, chunk int, values array<float>")
    p = np.array(TN.checkpoint_projections(d, ["step"], 8, 42).first().projection)
    want = sum(np.random.RandomState(42 ^ c).randn(8, 16).astype(np.float32) @ v[c * 16 : c * 16 + 16] for c in range(3)) / np.sqrt(8)
    assert p == pytest.approx(want, rel=1e-4)


def test_missing_hashes_are_failures(spark):
    """A NULL in the data, the hash or the previous hash of a ledger row never verifies."""
    import hashlib

    from fleetwatch.operators import audit as AU

    rows, before = [], bytes(32)
    for i in range(1, 7):
        data = f"entry {i}".encode()
        rows.append([i, bytearray(data), bytearray(before), bytearray(hashlib.sha256(data + before).digest()), (i - 1) // 3])
        before = bytes(rows[-1][3])
    schema = "entry_id long, data binary, previous_hash binary, entry_hash binary, batch_sequence long"

    def failures(change=None):
        mine = [list(r) for r in rows]
        if change:
            mine[change[0] - 1][change[1]] = None
        e = spark.createDataFrame(mine, schema)
        single = {r["entry_id"] for r in AU.verify_entries(e).collect()}
        return single, {(r["entry_id"], r["failure"]) for r in AU.verify_chain(e).collect()}

    assert failures() == (set(), set())
    assert failures((3, 1)) == ({3}, {(3, "hash_mismatch")})
    assert failures((3, 2)) == ({3}, {(3, "hash_mismatch"), (3, "chain_break")})
    assert failures((3, 3)) == ({3}, {(3, "hash_mismatch"), (4, "chain_break")})
    e = spark.createDataFrame(rows, schema)
    stored = AU.batch_roots(e).filter("batch_sequence = 0")
    extra = stored.withColumn("batch_sequence", F.lit(9).cast("long"))
    got = {r["batch_sequence"]: r["root_mismatch"] for r in AU.verify_batches(e, stored.unionByName(extra)).collect()}
    assert got == {0: False, 1: True, 9: True}


def test_probe_without_host_or_time_takes_the_batch_and_query(spark):
    from fleetwatch.sources.readers import normalize_probes

    gpu = "struct<uuid:string,hostname:string>"
    batches = spark.sql(f"""SELECT 'agent-1' AS agent_hostname, array(named_struct('execution_id', 'e', 'gpu', CAST(named_struct('uuid', 'g', 'hostname', NULL) AS {gpu}),
      'result', 1, 'timestamp', CAST(NULL AS TIMESTAMP), 'sm_id', 0, 'probe_type', 'fma', 'gpu_temperature_c', 1.0, 'gpu_power_w', 2.0)) AS executions""")
    r = normalize_probes(batches, now_us=5_000_000).first()
    assert (r["hostname"], r["metadata"]["hostname"], r["ts_us"]) == ("agent-1", "agent-1", 5_000_000)
