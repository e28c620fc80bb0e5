"""Trust for all devices against brute force: partners and transitive trust on graphs of several shapes."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from fleetwatch.config import TrustConfig
from fleetwatch.operators import trust as TR

EDGE = "gpu_a string, gpu_b string, trust double, comparisons long"


def graph(shape):
    rng = random.Random(shape)
    names = [f"g{i:02}" for i in range(9)]
    pairs = list(itertools.combinations(names, 2))
    if shape == "complete":
        return names, [(a, b, rng.choice([0.2, 0.7, 0.9, 1.0]), rng.randint(1, 4)) for a, b in pairs]
    if shape == "star":  # the first device was compared with all, with little trust in some
        return names, [("g00", b, rng.choice([0.1, 0.5, 1.0]), 3) for b in names[1:]]
    if shape == "weak":  # pairs never compared are best, or tie with edges of .5
        return names, [(a, b, rng.choice([0.0, 0.3, 0.5]), 2) for a, b in pairs if rng.random() < 0.5]
    if shape == "none":
        return names, []
    return names, [(a, b, rng.randint(0, 4) / 4, rng.randint(1, 12)) for a, b in pairs if rng.random() < 0.35]


def expected_partners(targets, available, edges):
    known = {(a, b): (t, n) for x, y, t, n in edges for a, b in ((x, y), (y, x))}
    found = {}
    for t in set(targets):
        scored = []
        for a, b in itertools.combinations(sorted(set(available) - {t}), 2):
            trusts = [known.get((t, x), (0.5, None)) for x in (a, b)]
            bonus = [2.0 if n is None else 1 / (1 + n) for _, n in trusts]
            mutual = known.get((a, b), (0.5, 0))[0]
            scored.append((-round(0.4 * mutual + 0.2 * sum(x for x, _ in trusts) + 0.1 * sum(bonus), 9), a, b))
        if scored:
            found[t] = min(scored)[1:]
    return found


@pytest.mark.parametrize("shape", ["complete", "star", "weak", "mixed", "none"])
def test_partners_of_all_devices_equal_brute_force(spark, shape):
    names, edges = graph(shape)
    available = names[:-1] + [names[0], None]  # one target isn't available, one name is there twice
    frames = [spark.createDataFrame([(n,) for n in rows], "gpu_uuid string") for rows in (names + [None], available)]
    found = TR.select_tmr_partners(*frames, spark.createDataFrame(edges, EDGE), width=2).collect()
    assert {r.gpu_uuid: (r.partner_a, r.partner_b) for r in found} == expected_partners(names, names[:-1], edges)
    assert len(found) == len(names)


def test_partners_need_two_other_devices(spark):
    few = spark.createDataFrame([("a",), ("b",)], "gpu_uuid string")
    edges = spark.createDataFrame([("a", "b", 1.0, 3)], EDGE)
    assert TR.select_tmr_partners(few, few, edges).collect() == []
    assert TR.select_tmr_partners(few.limit(0), few, edges).collect() == []


@pytest.mark.parametrize("hops", [1, 2, 3, 4])
def test_frontiers_meet_at_the_best_path(spark, hops):
    names, edges = graph("mixed")
    least = 3
    steps = {(a, b): t for x, y, t, n in edges if n >= least for a, b in ((x, y), (y, x))}
    direct = {(a, b): t for x, y, t, _ in edges for a, b in ((x, y), (y, x))}
    best = {(a, b): 1.0 if a == b else 0.0 for a in names for b in names}
    for _ in range(hops):
        best = {(a, b): max([best[a, b], *(best[a, x] * steps.get((x, b), 0.0) for x in names)]) for a in names for b in names}
    pairs = [(a, b) for a in names for b in names if a != b] + [("g00", "unseen"), ("g00", "g01")]
    got = TR.transitive_trust(
        spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame(edges, EDGE),
        TrustConfig(min_comparisons=least, max_hops=hops),
    ).collect()
    assert len(got) == len(set(pairs))
    for r in got:
        assert r.trust == pytest.approx(direct.get((r.src, r.dst), best.get((r.src, r.dst), 0.0)))


def test_targets_of_stars_read_edges_once_for_each_owner(spark, monkeypatch):
    """Three hubs know all devices, so no edge is free of a target's neighbours; targets x edges steps were taken."""
    rng = random.Random(5)
    hubs, leaves = ["h0", "h1", "h2"], [f"d{i:02}" for i in range(90)]
    edges = [(min(h, x), max(h, x), rng.choice([0.5, 0.8, 1.0]), rng.randint(1, 6)) for h in hubs for x in leaves]
    edges += [("h0", "h1", 0.5, 4), ("h0", "h2", 0.5, 4), ("h1", "h2", 0.5, 4)]
    written = []
    cut = TR.cut
    monkeypatch.setattr(TR, "cut", lambda df: written.append(cut(df)) or written[-1])
    names = spark.createDataFrame([(n,) for n in hubs + leaves], "gpu_uuid string")
    found = TR.select_tmr_partners(names, names, spark.createDataFrame(edges, EDGE), width=4).collect()
    assert {r.gpu_uuid: (r.partner_a, r.partner_b) for r in found} == expected_partners(hubs + leaves, hubs + leaves, edges)
    steps = sum(w.count() for w in written)
    assert steps < 15 * (len(edges) + len(names.collect())), steps  # targets x edges are 25,000


def test_canaries_read_states_and_edges_once(spark):
    """Both may be long plans: targets and partners shouldn't run them again."""
    names, edges = graph("mixed")
    seen = [spark.sparkContext.accumulator(0) for _ in range(2)]

    def told(counter):
        return F.udf(lambda v: counter.add(1) or v, "string")

    rows = [(n, "SUSPECT" if n in ("g01", "g02") else "CONDEMNED" if n == "g05" else "HEALTHY") for n in names]
    states = spark.createDataFrame(rows, "gpu_uuid string, _s string").select("gpu_uuid", told(seen[0])("_s").alias("state"))
    known = spark.createDataFrame(edges, EDGE).withColumn("gpu_b", told(seen[1])("gpu_b"))
    found = TR.plan_canaries(states, known, TrustConfig(canaries_per_interval=2)).collect()
    healthy = [n for n, s in rows if s == "HEALTHY"]
    assert {r.gpu_uuid: (r.partner_a, r.partner_b) for r in found} == expected_partners(["g01", "g02"], healthy, edges)
    assert [c.value for c in seen] == [len(names), len(edges)]
