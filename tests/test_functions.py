import hashlib
import hmac

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetwatch.functions import hashing as H
from fleetwatch.functions import labels as L
from fleetwatch.functions import special as SP
from fleetwatch.functions import vectors as V


def test_beta_quantile_identities():
    q = 0.05
    assert SP.beta_ppf(q, pd.Series([1.0]), pd.Series([1.0]))[0] == pytest.approx(q, abs=1e-12)
    a = pd.Series([0.5, 3.0, 250.0])
    assert SP.beta_ppf(q, a, pd.Series([1.0] * 3)).to_numpy() == pytest.approx(q ** (1 / a.to_numpy()), rel=1e-9)
    x = SP.beta_ppf(0.3, pd.Series([1000.0]), pd.Series([5.0]))
    assert SP.beta_cdf(x, [1000.0], [5.0])[0] == pytest.approx(0.3, abs=1e-9)


def test_two_sample_tests_separate_distributions():
    rng = np.random.default_rng(0)
    x, y, z = np.sort(rng.normal(size=300)), np.sort(rng.normal(size=300)), np.sort(rng.normal(1.0, size=300))
    assert SP.ks_2sample(x, y)[1] > 0.05 > 0.001 > SP.ks_2sample(x, z)[1]
    assert SP.ad_2sample(x, y)[1] > 0.05 and SP.ad_2sample(x, z)[1] == pytest.approx(0.001)


def merkle(leaves):
    while len(leaves) > 1:
        pairs = [leaves[i : i + 2] for i in range(0, len(leaves), 2)]
        leaves = [hashlib.sha256(b"".join(p)).digest() if len(p) == 2 else p[0] for p in pairs]
    return leaves[0]


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1025, 2049])
def test_merkle_roots_match_a_plain_tree(spark, n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    d = spark.createDataFrame([("b", i, bytearray(h)) for i, h in enumerate(leaves)], "b string, pos long, h binary")
    assert bytes(H.merkle_roots(d, ["b"], "pos", "h").first().merkle_root) == merkle(leaves)


def test_hmac(spark):
    for key in (b"k", b"x" * 80):
        d = spark.createDataFrame([(bytearray(b"payload"),)], "data binary")
        assert bytes(d.select(H.hmac_sha256(key, F.col("data"))).first()[0]) == hmac.new(key, b"payload", "sha256").digest()


def test_ulp_and_bits(spark):
    up = float(np.nextafter(np.float32(1.5), np.float32(2)))
    nan, inf = float("nan"), float("inf")
    d = spark.createDataFrame(
        [(1.5, up), (0.0, -0.0), (nan, nan), (nan, 1.0), (inf, inf), (inf, -inf), (-1e-45, 1e-45)], "a float, b float"
    )
    assert [r[0] for r in d.select(H.ulp_distance(F.col("a"), F.col("b"))).collect()] == [1, 0, 0, None, 0, None, 2]
    bits = d.limit(1).select(H.float_bits("a").alias("x"), H.float_bits("b").alias("y")).select(
        H.differing_bits(F.col("x"), F.col("y"))).first()[0]
    assert bits == [0]


def test_vector_functions(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=40) * 3, rng.normal(size=40) * 3
    p, q = (np.exp(v) / np.exp(v).sum() for v in (a, b))
    m = (p + q) / 2
    jsd = 0.5 * (p * np.log(p / m)).sum() + 0.5 * (q * np.log(q / m)).sum()
    d = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    c = F.col
    r = d.select(
        V.jsd(V.softmax(c("a")), V.softmax(c("b"))).alias("j"), V.jsd_logits("a", "b").alias("ju"), V.entropy(c("a")).alias("e"),
        V.logit_stats("a").alias("s"), V.psd("a").alias("psd"), V.top_tokens(c("a"), 3).alias("top"),
        V.cosine_similarity(c("a"), c("b")).alias("cos"),
    ).first()
    assert (r.j, r.ju) == (pytest.approx(jsd), pytest.approx(jsd))
    assert r.e == pytest.approx(-(p * np.log(p)).sum()) == pytest.approx(r.s.entropy)
    assert r.s.variance == pytest.approx(a.var()) and r.s.mean == pytest.approx(a.mean())
    assert r.top == np.argsort(-a)[:3].tolist()
    assert r.cos == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    w = (a - a.mean()) * np.hanning(40)
    full = np.abs(np.fft.fft(w)) ** 2 / 40
    assert sum(r.psd) == pytest.approx(full.sum())


def test_fingerprint_and_hamming(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=64)
    near, far = x + rng.normal(size=64) * 1e-4, rng.normal(size=64)
    d = spark.createDataFrame([(v.tolist(),) for v in (x, near, far)], "v array<double>").select(V.tensor_fingerprint()("v").alias("f"))
    f = [bytes(r.f) for r in d.collect()]
    assert all(len(v) == 16 for v in f)
    pairs = spark.createDataFrame([(bytearray(f[0]), bytearray(g)) for g in (f[0], f[1], f[2], f[2][:15])], "a binary, b binary")
    got = [r[0] for r in pairs.select(V.hamming128(F.col("a"), F.col("b"))).collect()]
    want = [bin(int.from_bytes(f[0], "big") ^ int.from_bytes(g, "big")).count("1") for g in f]
    assert got == [*want, None] and got[1] < 8 < got[2]


def test_tiers_and_transitions(spark):
    d = spark.createDataFrame([(0.9995,), (0.999,), (0.9949,), (0.98,), (0.9,)], "s double")
    assert [r[0] for r in d.select(L.tier(F.col("s"))).collect()] == ["HEALTHY", "HEALTHY", "SUSPECT", "QUARANTINE", "CONDEMN"]
    t = spark.createDataFrame([("HEALTHY", "quarantine"), ("CONDEMNED", "reinstate"), ("HEALTHY", "schedule_deep_test")], "s string, a string")
    assert [r[0] for r in t.select(L.transition(F.col("s"), F.col("a"))).collect()] == ["QUARANTINED", None, None]


def test_display_strings(spark):
    d = spark.createDataFrame([(0.12345, 1_234_567.0, 59_000), (1.0, 999.0, 3_700_000), (0.5, 1500.0, 90_000_000)], "p double, n double, ms long")
    r = d.select(L.format_percent(F.col("p")), L.format_quantity(F.col("n")), L.format_duration(F.col("ms"))).collect()
    assert [tuple(x) for x in r] == [("12.35%", "1.23M", "59s"), ("100.00%", "999.00", "1h 1m"), ("50.00%", "1.50K", "1d 1h")]


def test_merkle_rounds_follow_the_largest_key(spark):
    rows = [(0, i, bytearray(hashlib.sha256(str(i).encode()).digest())) for i in range(1025)] + [(1, 0, bytearray(b"x" * 32))]
    got = {r.b: bytes(r.merkle_root) for r in H.merkle_roots(spark.createDataFrame(rows, "b int, pos long, h binary"), ["b"], "pos", "h").collect()}
    assert got == {0: merkle([bytes(r[2]) for r in rows[:-1]]), 1: b"x" * 32}


def test_fixed_decimals_round_the_binary_number(spark):
    values = [0.125, 0.375, 1.005, 2.675, 1706659195.005, 99.985, -0.001, 0.0, -2.5] + [k / 8000 for k in range(200)]
    d = spark.createDataFrame([(v,) for v in values], "v double")
    for r in d.select("v", L.format_percent(F.col("v")).alias("p"), L.format_quantity(F.col("v") * 1e6).alias("m")).collect():
        assert r.p == "%.2f%%" % (r.v * 100)
        if r.v >= 1:
            assert r.m == "%.2fM" % (r.v * 1e6 / 1e6)
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r[0] for r in odd.select(L.format_percent(F.col("v"))).collect()] == ["NaN%", "Infinity%", None]
