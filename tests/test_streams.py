"""A stream in several micro-batches gives what the batch gives."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetwatch.config import AuditConfig, BeliefConfig, EwmaConfig, GradientConfig, LossConfig, WindowConfig
from fleetwatch.operators import audit as AU
from fleetwatch.operators import beliefs as B
from fleetwatch.operators import patterns as P
from fleetwatch.operators import quarantine as Q
from fleetwatch.sinks import writers as W
from fleetwatch.sources import adapters as A
from fleetwatch.streaming import event_time as ET
from fleetwatch.streaming import stateful as SF
from fleetwatch.streaming import streams as S

SF_DIR = "/root/testdata/sf0.001"
CFG = BeliefConfig(**A.PRIOR)
WIN = WindowConfig(3 * 86_400, 86_400)


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """The events in four files, in time order."""
    path = str(tmp_path_factory.mktemp("in") / "events")
    e = A.table(spark, SF_DIR, "events")
    for day in (0, 8, 16, 24):
        part = e.filter(F.col("ts") >= f"2024-01-{day + 1:02}").filter(F.lit(day == 24) | (F.col("ts") < f"2024-01-{min(day + 9, 31):02}"))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_beliefs(spark, landed, tmp_path):
    s = S.stream_beliefs(A.as_events(S.read_stream(spark, landed, 1)), CFG)
    got = S.run_updates(s, ["gpu_uuid"], str(tmp_path / "o"), str(tmp_path / "c"))
    cols = ["gpu_uuid", "probe_passes", "probe_failures", "anomalies", "tier"]
    assert rows(got, *cols) == rows(B.gpu_beliefs(A.events_norm(spark, SF_DIR), CFG), *cols)


def passed(df, e):
    """Rows that a watermark without delay has passed at the end of the events."""
    last = e.agg(F.max("ts_us")).first()[0]
    return df.filter(F.expr(f"ts_us div 1000 < {last // 1000}"))


def test_patterns(spark, landed, tmp_path):
    SF.use_rocksdb(spark)
    s = ET.stream_patterns(A.as_events(S.read_stream(spark, landed, 1)), WIN.window_seconds, "0 seconds")
    got = ET.accepted(S.run_to_table(s, str(tmp_path / "o"), str(tmp_path / "c")))
    e = A.events_norm(spark, SF_DIR)
    cols = ["event_id", "pattern", "sm_id", "contributing"]
    assert rows(got, *cols) == rows(passed(P.match_patterns(e, WIN), e), *cols)


def test_late_rows_are_listed_and_silent_devices_forgotten(spark, tmp_path):
    SF.use_rocksdb(spark)
    path, out, cp = (str(tmp_path / x) for x in "ioc")
    schema = "gpu_uuid string, event_id string, ts_us long, event_type string, sm_id int"
    second = 1_000_000
    batches = [
        [("a", "1", 1000 * second, "probe_fail", 3), ("b", "2", 1001 * second, "probe_fail", None)],
        [("a", "4", 1100 * second, "training_anomaly", None), ("a", "3", 1050 * second, "probe_fail", 3)],  # out of order, not late
        [("c", "5", 5000 * second, "probe_pass", 1)],
        [("a", "6", 1200 * second, "probe_fail", 3), ("c", "7", 5001 * second, "probe_pass", 1)],  # 6 is late
    ]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        got = S.run_to_table(ET.stream_patterns(S.read_stream(spark, path), 300, "200 seconds"), out, cp)
    assert rows(ET.late_rows(got), "gpu_uuid", "event_id") == [("a", "6")]
    assert rows(ET.accepted(got), "event_id", "pattern", "sm_id", "contributing") == sorted(
        [("3", "sm_localized", 3, 2), ("4", "sm_localized", 3, 2), ("4", "probe_and_anomaly", 3, 3), ("4", "multi_signal", None, 3)], key=str)
    assert rows(ET.snapshot(spark, cp, "gpu_uuid"), "gpu_uuid") == [("c",)]  # a and b are silent: their state is gone


def test_stopped_stream_goes_on_elsewhere(spark, landed, tmp_path):
    SF.use_rocksdb(spark)
    e = A.table(spark, SF_DIR, "events")
    raw = [str(tmp_path / x) for x in ("one", "two", "both")]
    e.filter("ts < '2024-01-16'").write.parquet(raw[0])
    e.filter("ts >= '2024-01-16'").write.parquet(raw[1])

    def run(name, path, records=None, floor=0):
        table = S.read_stream(spark, path)
        s = ET.stream_quarantine(ET.quarantine_inputs(A.as_events(table), A.as_actions(table)), CFG, 5, "0 seconds", records, floor)
        return ET.accepted(S.run_to_table(s, str(tmp_path / f"o-{name}"), str(tmp_path / f"c-{name}")))

    first = run("one", raw[0])
    W.save_state(ET.snapshot(spark, str(tmp_path / "c-one"), "gpu_uuid"), str(tmp_path / "state"), ["gpu_uuid"], "seen_ms", 1)
    records = W.load_state(spark, str(tmp_path / "state"), 1)
    second = run("two", raw[1], records, ET.floor_of(records))
    whole = run("both", landed)
    cols = ["gpu_uuid", "ts_us", "source", "row_id", "action", "from_state", "to_state", "applied"]
    assert first.count() and second.count() and rows(first.union(second), *cols) == rows(whole, *cols)


def test_quarantine(spark, landed, tmp_path):
    SF.use_rocksdb(spark)
    raw = S.read_stream(spark, landed, 1)
    s = ET.stream_quarantine(ET.quarantine_inputs(A.as_events(raw), A.as_actions(raw)), CFG, 5, "0 seconds")
    got = ET.accepted(S.run_to_table(s, str(tmp_path / "o"), str(tmp_path / "c")))
    e = A.events_norm(spark, SF_DIR)
    want = passed(Q.quarantine_fsm(B.belief_trajectory(e, CFG, WIN), A.operator_actions(spark, SF_DIR), 5, WIN), e)
    cols = ["gpu_uuid", "ts_us", "source", "action", "from_state", "to_state", "applied"]
    assert rows(got, *cols) == rows(want, *cols)


def _in_pieces(fold, frame, sizes):
    state, at, parts = None, 0, []
    for n in sizes:
        out, state = fold(state, frame.iloc[at : at + n].reset_index(drop=True))
        parts.append(out)
        at += n
    return pd.concat([p for p in parts if len(p)], ignore_index=True)


def _series(n, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(10, 1, n).cumsum() / 20 + rng.normal(0, 1, n)
    v[rng.integers(0, n, n // 40)] *= 6
    v[::53] = np.nan
    return pd.DataFrame({"ts_us": np.arange(n) * 1000, "pos": np.arange(n), "value": v})


def test_losses_equal_one_by_one():
    cfg = LossConfig(sigma=2.0)
    p, frame = cfg.order, _series(900)
    seen, want, m = [], [], np.zeros((p + 2, p + 2))
    for r in frame.itertuples():
        if not np.isfinite(r.value):
            want.append((r.pos, "loss_nan", np.inf))
            continue
        if len(seen) >= cfg.warmup and m[0, 0] > 0:
            a, b, k = m[1 : p + 1, 1 : p + 1], m[1 : p + 1, p + 1], m[0, 0]
            c = np.linalg.solve(a + 1e-8 * np.eye(p), b)
            mean = (m[0, p + 1] - c @ m[0, 1 : p + 1]) / k
            std = np.sqrt(max((m[p + 1, p + 1] - 2 * c @ b + c @ a @ c) / k - mean**2, 0.0))
            z = abs(r.value - c @ np.array(seen[: -p - 1 : -1])) / std if std >= 1e-12 else 0.0
            if z > cfg.sigma:
                want.append((r.pos, "loss_spike", z))
        if len(seen) >= p:
            row = np.array([1.0, *seen[: -p - 1 : -1], r.value])
            m += np.outer(row, row)
        seen.append(r.value)
    for sizes in ([900], [3, 1, 2, 200, 94, 600], [1] * 900):
        got = _in_pieces(ET.Losses(cfg).fold, frame, sizes).sort_values("pos")
        assert [(a, b) for a, b, _ in want] == list(zip(got["pos"], got["anomaly_type"]))
        np.testing.assert_allclose(got["score"].to_numpy(float), [w[2] for w in want], rtol=1e-6)


def test_folds_do_not_depend_on_pieces():
    frame = _series(700, 4)
    for processor in (ET.Gradients(GradientConfig(sigma=1.0, warmup=5)), ET.Tracker(EwmaConfig(burn_in=10, limit=0.2))):
        source = frame if isinstance(processor, ET.Gradients) else frame[np.isfinite(frame["value"])].reset_index(drop=True)
        whole = _in_pieces(processor.fold, source, [len(source)])
        for sizes in ([1] * len(source), [5, 300, len(source) - 305]):
            pd.testing.assert_frame_equal(_in_pieces(processor.fold, source, sizes).astype(whole.dtypes), whole, rtol=1e-9)
    assert len(whole) and whole["severity"].notna().any()


def test_ledger_does_not_depend_on_how_rows_arrive(spark, tmp_path):
    o = A.table(spark, SF_DIR, "orders")
    p = A.as_pending(o).withColumnRenamed("seq", "key")
    times = [r[0] for r in p.select("ts_us").orderBy("ts_us").collect()]
    edges = [times[0], times[30], times[801], times[-1] + 1]
    cfg, got = AuditConfig(batch_rows=100), {}
    for name, cuts in (("parts", edges), ("whole", [edges[0], edges[-1]])):
        src, root = str(tmp_path / f"in-{name}"), str(tmp_path / name)
        for lo, hi in zip(cuts, cuts[1:]):
            p.filter(F.col("ts_us").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(src)
        S.seal_stream(S.read_stream(spark, src, 1), root, str(tmp_path / f"c-{name}"), "key", cfg).awaitTermination()
        entries, _ = W.read_committed(spark, root)
        assert entries.count() == len(times) // 100 * 100  # the last batch waits
        S.seal_rest(spark, root, "key", cfg)
        S.seal_rest(spark, root, "key", cfg)  # nothing is left
        entries, roots = W.read_committed(spark, root)
        assert AU.verify_linked(entries).count() == 0
        assert AU.verify_batches(entries, roots, linked=True).filter("root_mismatch OR chain_breaks + hash_mismatches > 0").count() == 0
        got[name] = rows(entries, "entry_id", "ts_us", "data", "previous_hash", "entry_hash", "batch_sequence"), rows(roots, "batch_sequence", "entry_count", "first_entry_id", "last_entry_id", "merkle_root")
    assert len(times) > 1400 and got["parts"] == got["whole"]


def test_a_commit_can_be_run_again(spark, tmp_path):
    p = A.as_pending(A.table(spark, SF_DIR, "orders")).withColumnRenamed("seq", "key")
    root, cfg = str(tmp_path / "ledger"), AuditConfig(batch_rows=64)
    parts = [p.filter(F.col("key") % 3 == k) for k in range(3)]
    for k, part in enumerate(parts):
        S._seal(spark, part, root, 2 * k, "key", cfg, False)
        if k:
            S._seal(spark, part, root, 2 * k, "key", cfg, False)
    S.seal_rest(spark, root, "key", cfg)
    entries, roots = W.read_committed(spark, root)
    assert entries.count() == p.count() == entries.agg(F.max("entry_id")).first()[0] and AU.verify_linked(entries).count() == 0


def test_calls_and_records_grow_with_groups_not_keys(spark, tmp_path):
    SF.use_rocksdb(spark)
    second, n = 1_000_000, 40
    schema = "gpu_uuid string, event_id string, ts_us long, event_type string, sm_id int"
    out = "event_id string, ts_us bigint, pattern string, confidence double, severity int, sm_id int, contributing bigint"
    names = [None, *(f"g{k}" for k in range(1, n))]  # a device without a name is one as well
    halves = [
        [(g, f"{k}-{i}", (1000 + 10 * i + k) * second, "probe_fail", None if i == 1 else k % 3) for k, g in enumerate(names) for i in range(3)],
        [(g, f"{k}-x", (1100 + k) * second, "ecc_error", None) for k, g in enumerate(names)] + [("end", "e", 9000 * second, "probe_pass", 0), ("end", "f", None, "probe_pass", 0)],
    ]

    def run(name, part, records=None, groups=4):
        path, cp = str(tmp_path / f"i-{name}"), str(tmp_path / f"c-{name}")
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(path)
        s = ET.run_in_order(S.read_stream(spark, path), "gpu_uuid", ET.Patterns(300 * second), out, "1 hour", records, groups)
        return S.run_to_table(s, str(tmp_path / f"o-{name}"), cp), cp

    first, cp = run("one", halves[0])
    assert first.count() == 0  # all wait
    assert 0 < spark.read.format("statestore").option("stateVarName", "record").load(cp).count() <= 4
    held = ET.snapshot(spark, cp, "gpu_uuid")
    assert sorted(r[0] or "" for r in held.select("gpu_uuid").collect()) == sorted(x or "" for x in names)
    records = spark.createDataFrame(held.collect(), held.schema)
    (resumed, _), (whole, _) = run("two", halves[1], records, 7), run("both", halves[0] + halves[1])
    cols = ["gpu_uuid", "event_id", "pattern", "sm_id", "contributing"]
    assert rows(ET.accepted(resumed), *cols) == rows(ET.accepted(whole), *cols)
    got = [(r["gpu_uuid"], r["event_id"], r["pattern"], r["sm_id"], r["contributing"]) for r in ET.accepted(whole).collect()]
    assert [r for r in got if r[1] == "0-x"].count((None, "0-x", "ecc_correlated", None, 4)) == 1
    assert got.count(("g4", "4-2", "sm_localized", 1, 2)) == 1 and sum(r[2] == "ecc_correlated" for r in got) == n
    assert rows(ET.late_rows(whole), "event_id", "ts_us") == [("f", None)]  # a row without a time can't be folded


def test_cooldowns_share_records_and_are_forgotten(spark, tmp_path):
    SF.use_rocksdb(spark)
    path, out, cp = (str(tmp_path / x) for x in "ioc")
    second = 1_000_000
    schema = "dedup_key string, alert_id string, ts_us long, cooldown_seconds int"
    keys = [None, *(f"k{k}" for k in range(1, 30))]
    counts = []
    for part in (
        [(k, f"{k}-{t}", t * second, 0 if k == "k3" else 100) for k in keys for t in (1000, 1050, 1100)],
        [(k, f"{k}-{t}", t * second, 100) for k in keys for t in (1150, 1201)],
        [("far", "far", 90_000 * second, 100)],
    ):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        got = S.run_to_table(SF.stream_dedup_alerts(S.read_stream(spark, path), 200, "10 minutes", groups=5), out, cp)
        counts.append(spark.read.format("statestore").option("stateVarName", "last").load(cp).count())
    want = [(str(k), t) for k in keys for t in ((1000, 1050, 1100, 1201) if k == "k3" else (1000, 1100, 1201))] + [("far", 90_000)]
    assert sorted((str(r["dedup_key"]), r["ts_us"] // second) for r in got.collect()) == sorted(want)
    assert max(counts) <= 5 and counts[-1] == 1  # all but the last key are forgotten


def test_held_rows_are_folded_in_pieces():
    class Held:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value
        update = lambda self, value: setattr(self, "value", value)
        clear = lambda self: setattr(self, "value", None)

    class Handle:
        getValueState = lambda self, name, schema: Held()
        registerTimer = deleteTimer = lambda self, at: None

    class Clock:
        def __init__(self, now):
            self.getCurrentWatermarkInMs = lambda: now

    sizes, got = [], {}
    frame = pd.concat([_series(500, k).assign(series=f"s{k}") for k in range(3)]).sample(frac=1, random_state=1)
    for piece in (ET.InOrder.piece, 70):
        p = ET.Losses(LossConfig(sigma=2.0))
        p.piece, p.row_schema, fold = piece, pa.schema([("series", "string"), ("ts_us", "int64"), ("pos", "int64"), ("value", "double")]), p.fold
        p.fold = lambda state, rows: sizes.append(len(rows)) or fold(state, rows)  # noqa: B023
        p.init(Handle())
        assert list(p.handleInputRows((0,), iter([frame]), Clock(0))) == []
        got[piece] = pd.concat(p.handleExpiredTimer((0,), Clock(10**9), None)).sort_values(["series", "pos"], ignore_index=True)
    assert max(sizes[3:]) <= 70 and sum(sizes[3:]) == len(frame) and len(got[70])
    pd.testing.assert_frame_equal(*got.values(), rtol=1e-9)
