import random

import pytest

from fleetwatch.operators import inference as I


@pytest.mark.parametrize("radius", [0, 3, 6])
def test_links_equal_brute_force(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(12)]
    values = []
    for b in base:
        for _ in range(12):
            x = b
            for bit in rng.sample(range(128), rng.randrange(9)):
                x ^= 1 << bit
            values.append(x)
    # Many fingerprints share their first eight bytes, which would be one hot band.
    values += [(base[0] >> 64 << 64) | rng.getrandbits(64) for _ in range(200)] + values[:20]
    rows = [(k, v.to_bytes(16, "big")) for k, v in enumerate(values)] + [(900, None), (901, b"short")]
    prints = spark.createDataFrame(rows, "request_id long, fingerprint binary").repartition(4)
    members, links = I.similar_fingerprints(prints, "request_id", radius)
    first = {}
    for k, v in enumerate(values):
        first.setdefault(v, k)
    assert {(r["request_id"], r["representative"]) for r in members.collect()} == {(k, first[v]) for k, v in enumerate(values)}
    want = {(i, j, (a ^ b).bit_count()) for a, i in first.items() for b, j in first.items() if i < j and (a ^ b).bit_count() <= radius}
    assert {tuple(r) for r in links.collect()} == want and links.count() == len(want)
    assert radius == 0 or len(want) > 20


def test_keys_are_never_broadcast(spark):
    prints = spark.createDataFrame([(k, bytes([k] * 16)) for k in range(50)], "request_id long, fingerprint binary")
    plan = I.similar_fingerprints(prints, "request_id", 3)[1]._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 4
