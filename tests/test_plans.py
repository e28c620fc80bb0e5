"""Chunked plans against brute force; the answer must not depend on chunks or partitions."""

import math
import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetwatch.plans.chunked import asof, distinct_in_window, positions, running, sliding_counts, time_chunk
from fleetwatch.plans.ranks import bucket_of, medians, order_statistics, splitters, with_previous
from fleetwatch.plans.scan import ewma, state_scan


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    # One key owns a third of all rows; times repeat so that peers occur.
    return [(("hot" if i % 3 == 0 else f"k{rng.randrange(5)}"), i, rng.randrange(400), rng.randrange(4), rng.random() < 0.4)
            for i in range(600)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "key string, id long, ts long, item int, flag boolean")


@pytest.mark.parametrize("width", [1, 37, 10_000])
def test_running_sum_and_last(df, rows, width):
    aggs = {"s": ("sum", F.col("id")), "l": ("last", F.when(F.col("flag"), F.col("id")))}
    got = {r.id: (r.s, r.l) for r in running(df, ["key"], ["ts", "id"], time_chunk("ts", width), aggs).collect()}
    total, last = defaultdict(int), {}
    for key, i, _, _, flag in sorted(rows, key=lambda r: (r[2], r[1])):
        total[key] += i
        if flag:
            last[key] = i
        assert got[i] == (total[key], last.get(key))


@pytest.mark.parametrize("chunk", [5, 1000])
def test_sliding_counts_include_peers(df, rows, chunk):
    got = {r.id: r.n for r in sliding_counts(df, ["key"], "ts", 20, chunk, {"n": F.col("flag")}).collect()}
    for key, i, ts, _, _ in rows:
        assert got[i] == sum(f and k == key and ts - 20 <= t <= ts for k, _, t, _, f in rows)


@pytest.mark.parametrize("chunk", [5, 1000])
def test_distinct_in_window(df, rows, chunk):
    d = distinct_in_window(df, ["key"], "item", "ts", "id", 15, chunk, F.col("flag"), "n")
    got = {r.id: r.n for r in d.collect()}
    for key, i, ts, _, _ in rows:
        assert got[i] == len({it for k, _, t, it, f in rows if f and k == key and ts - 15 <= t <= ts})


def test_asof_takes_latest_at_or_before(df, rows):
    right = df.filter("flag").select("key", "ts", F.col("id").alias("rid"))
    got = {r.id: r.m and r.m.rid for r in asof(df, right, ["key"], "ts", 11, "m", tie="rid").collect()}
    for key, i, ts, _, _ in rows:
        hits = [(t, str(j), j) for k, j, t, _, f in rows if f and k == key and t <= ts]
        assert got[i] == (max(hits)[2] if hits else None)


def test_medians_exact_with_ties(spark):
    rng = random.Random(1)
    data = [("a", float(rng.choice([1, 1, 1, 5, 9.5]))) for _ in range(200)] + [("b", 2.0)] + [("c", float(x)) for x in (4, 1)]
    got = {r.k: r.m for r in medians(spark.createDataFrame(data, "k string, v double"), ["k"], "v", "m").collect()}
    a = sorted(v for k, v in data if k == "a")
    assert got == {"a": (a[99] + a[100]) / 2, "b": 2.0, "c": 2.5}


def test_with_previous_bridges_empty_ranges(spark):
    ids = [1, 2, 3, 500, 501, 90_000]
    d = spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string")
    got = {r.id: r.prev_v for r in with_previous(d, "id", ["v"], width=4, group=3).collect()}
    assert got == {b: f"v{a}" for a, b in zip(ids, ids[1:])} | {1: None}


@pytest.mark.parametrize("width", [3, 50, 10_000])
def test_ewma_does_not_depend_on_chunks(spark, width):
    rng = random.Random(3)
    data = [("a" if i % 3 else "b", i, rng.gauss(5, 2)) for i in range(300)]
    d = spark.createDataFrame(data, "k string, i long, x double")
    got = {r.i: (r.y, r.y_prev) for r in ewma(d, ["k"], ["i"], time_chunk("i", width), "x", 0.1, "y").collect()}
    y = {}
    for k, i, x in data:
        before = y.get(k, x)
        y[k] = x if k not in y else 0.1 * x + 0.9 * y[k]
        assert got[i][0] == pytest.approx(y[k], rel=1e-12)
        assert got[i][1] == pytest.approx(before, rel=1e-12)


@pytest.mark.parametrize("width", [7, 1000])
def test_state_scan_is_exact(spark, width):
    """A feedback baseline (values far from the mean of the last 5 accepted are refused)."""
    import pickle

    import pandas as pd

    rng = random.Random(5)
    data = [("hot" if i % 3 else "b", i, rng.choice([1.0, 1.1, 0.9, 4.0])) for i in range(120)]

    def feed(base, x):
        ok = len(base) < 2 or abs(x - sum(base) / len(base)) < 0.5
        return ok, ([*base, x] if ok else base)[-5:]

    def step(rows, state):
        base, out = (pickle.loads(state) if state else []), []
        for r in rows.itertuples():
            ok, base = feed(base, r.x)
            out.append((r.i, ok))
        return pd.DataFrame(out, columns=["i", "ok"]), pickle.dumps(base)

    d = spark.createDataFrame(data, "k string, i long, x double")
    got = {r.i: r.ok for r in state_scan(d, ["k"], ["i"], time_chunk("i", width), step, "i long, ok boolean").collect()}
    base = {"hot": [], "b": []}
    for k, i, x in data:
        ok, base[k] = feed(base[k], x)
        assert got[i] == ok


def test_partition_count_does_not_change_results(spark, df):
    def answer():
        r = sliding_counts(df, ["key"], "ts", 20, 50, {"n": F.col("flag")})
        return sorted((x.id, x.n) for x in r.collect())

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = answer()
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        assert one == answer()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_outliers_and_infinities_leave_buckets_even(spark):
    rng = random.Random(5)
    values = [rng.gauss(0, 1) for _ in range(20_000)] + [1e300, -1e300, math.inf, -math.inf] + [0.25] * 3000
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double").repartition(4)
    cut_at = df.groupBy("k").agg(splitters(F.col("v")).alias("c"))
    sizes = df.filter("v <> 0.25").join(cut_at, "k").groupBy(bucket_of(F.col("v"), F.col("c")).alias("b")).count().collect()
    assert len(sizes) > 200 and max(r["count"] for r in sizes) < 4 * len(values) / 256
    n = F.col("n")
    got = order_statistics(df, ["k"], "v", {"low": F.lit(0), "q": F.floor(n / 3), "high": n - 1, "p99": F.floor(n * 0.99)}).first()
    s = sorted(values)
    assert (got["low"], got["q"], got["high"], got["p99"]) == (-math.inf, s[len(s) // 3], math.inf, s[int(len(s) * 0.99)])


def test_positions_of_rows_of_one_time(spark):
    rows = [(7, f"{k:05}", k) for k in range(3000)] + [(k % 3, f"x{k}", k) for k in range(50)]
    df = spark.createDataFrame(rows, "ts_us long, key string, v int").repartition(5)
    got = positions(df, ["ts_us", "key"], "seq").collect()
    assert [(r["ts_us"], r["key"]) for r in sorted(got, key=lambda r: r["seq"])] == sorted((t, k) for t, k, _ in rows)
    assert sorted(r["seq"] for r in got) == list(range(len(rows)))


def test_tree_of_cooldowns(spark):
    from fleetwatch.operators.alerts import Sends

    rng = random.Random(2)
    for _ in range(300):
        times = sorted(rng.randrange(60) for _ in range(rng.randrange(1, 30)))
        cool, cuts = rng.randrange(1, 15), sorted(rng.randrange(31) for _ in range(2))
        parts = [p for p in (times[a:b] for a, b in zip([0, *cuts], [*cuts, 99])) if p]
        whole = Sends.of(parts[0], cool)
        for p in parts[1:]:
            whole = whole.then(Sends.unpack(Sends.of(p, cool).pack()))
        for start in [None, *range(-20, 70, 3)]:
            last = start
            for t in times:
                if last is None or t - last >= cool:
                    last = t
            assert whole.after(start) == last


def test_statistics_hold_if_each_sketch_cuts_elsewhere(spark, monkeypatch):
    """Parts of a quantile sketch merge in any order, so another run of the plan may cut a group's rows elsewhere."""
    from fleetwatch.plans import ranks

    draw = F.udf(lambda top: sorted({random.SystemRandom().uniform(0, top) for _ in range(200)}), "array<double>").asNondeterministic()
    monkeypatch.setattr(ranks, "splitters", lambda v: draw(F.max(v)))
    data = [(f"k{i % 2}", float(i * 37 % 401)) for i in range(401)]
    got = {r.k: r.m for r in medians(spark.createDataFrame(data, "k string, v double"), ["k"], "v", "m").collect()}
    want = {k: sorted(v for x, v in data if x == k) for k in ("k0", "k1")}
    assert got == {k: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 for k, v in want.items()}


def test_ewma_of_many_chunks_and_batches(spark):
    """Chunks of one row, chunks longer than an Arrow batch, and a start that no chunk forgets."""
    rng = random.Random(9)
    data = [("a" if i % 40 else "b", i, rng.gauss(1e6, 3)) for i in range(30_000)]
    d = spark.createDataFrame(data, "k string, i long, x double")
    want, y = {}, {}
    for k, i, x in data:
        before = y.get(k, x)
        y[k] = x if k not in y else 0.001 * x + 0.999 * y[k]
        want[i] = (y[k], before)
    for width in (3, 26_000):
        started = time.monotonic()
        got = {r.i: (r.y, r.y_prev) for r in ewma(d, ["k"], ["i"], time_chunk("i", width), "x", 0.001, "y").collect()}
        assert got.keys() == want.keys()
        assert all(got[i] == pytest.approx(want[i], rel=1e-12) for i in want)
        assert time.monotonic() - started < 60  # composing the starts anew for every chunk took longer


def test_state_scan_of_a_state_that_never_forgets(spark, monkeypatch):
    """Each chunk needs the true end of the one before; rounds must not be as many as chunks."""
    import pandas as pd

    from fleetwatch.plans import scan

    written = []
    monkeypatch.setattr(scan, "cut", lambda df, real=scan.cut: written.append(1) or real(df))
    data = [("a" if i % 4 else "b", i, i * 7 % 11) for i in range(80)]

    def step(rows: pd.DataFrame, state: bytes) -> tuple[pd.DataFrame, bytes]:
        totals = int(state or b"0") + rows["x"].cumsum()
        return rows[["k", "i"]].assign(total=totals), str(totals.iloc[-1]).encode()

    d = spark.createDataFrame(data, "k string, i long, x long")
    got = {(r.k, r.i): r.total for r in state_scan(d, ["k"], ["i"], F.col("i"), step, "k string, i long, total long").collect()}
    total = defaultdict(int)
    for k, i, x in data:
        total[k] += x
        assert got[k, i] == total[k]
    assert len(written) < 20


def test_fleet_ks_counts_once_and_holds_for_any_cuts(spark, monkeypatch, tmp_path):
    from fleetwatch.operators import inference

    draw = F.udf(lambda top: sorted({random.SystemRandom().uniform(0, top) for _ in range(40)}), "array<double>").asNondeterministic()
    monkeypatch.setattr(inference, "splitters", lambda v: draw(F.max(v)))
    data = [(f"g{i % 3}", float(i * 37 % 211)) for i in range(300)]
    fleet = [v for _, v in data]
    share = lambda values, x: sum(v <= x for v in values) / len(values)
    spark.createDataFrame(data, "gpu_uuid string, value double").write.parquet(f"{tmp_path}/values")
    found = inference.fleet_ks(spark.read.parquet(f"{tmp_path}/values"))
    assert not any(str(tmp_path / "values") in f for f in found.inputFiles())  # later passes read the written counts
    got = {r.gpu_uuid: r.ks for r in found.collect()}
    for g in ("g0", "g1", "g2"):
        own = [v for k, v in data if k == g]
        assert got[g] == pytest.approx(max(abs(share(own, x) - share(fleet, x)) for x in fleet))
