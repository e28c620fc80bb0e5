import json

from pyspark.sql import functions as F

from fleetwatch.operators.training import composite_score
from fleetwatch.sources import readers as R


def test_golden_and_thresholds(spark, tmp_path):
    g = tmp_path / "golden.json"
    g.write_text(json.dumps({"version": 1, "fma": [{"index": 0, "expected_result": 1.5}], "transcendental": [{"index": 3, "expected_result": 0.25}]}))
    got = {(r.probe_type, r["index"], r.expected_result) for r in R.read_golden(spark, str(g)).collect()}
    assert got == {("FMA", 0, 1.5), ("TRANSCENDENTAL", 3, 0.25)}
    t = tmp_path / "limits.yaml"
    t.write_text("# limits\nthermal:\n  warn_c: 85  # degrees\n  mode: \"exact\"\n")
    assert {(r.name, r.value) for r in R.read_thresholds(spark, str(t)).collect()} == {("warn_c", "85"), ("mode", "exact")}


def test_probe_batch_codes(spark):
    g = ("u", "h", 0, None, None, None)
    rows = [("h", 1, [(f"x{c}", "FMA", g, 2, c, 50.0, None, None) for c in (1, 2, 3, 4, 9)])]
    n = R.normalize_probes(spark.createDataFrame(rows, R.PROBE_BATCH)).orderBy("event_id").collect()
    assert [(r.event_type, r.severity, r.score) for r in n] == [
        ("probe_pass", 1, 0.0), ("probe_fail", 4, 1.0), ("probe_error", 3, 0.0), ("probe_error", 2, 0.0), ("probe_error", 2, 0.0)]
    assert set(n[0].metadata) == {"hostname", "probe_type", "temperature_c"}


def test_infinite_score_leaves_the_window(spark):
    rows = [("g", i, t, "loss_nan", s, 1.0) for i, (t, s) in enumerate([(0, 3.0), (10, float("inf")), (65, 2.0), (80, 2.0)])]
    d = spark.createDataFrame(rows, "g string, i int, t long, anomaly_type string, score double, threshold double")
    d = d.withColumn("ts_us", F.col("t") * 1_000_000)
    got = [r.composite for r in composite_score(d, ["g"], 60, chunk_us=30_000_000).orderBy("i").collect()]
    assert got == [4.0, float("inf"), float("inf"), 4.0]
