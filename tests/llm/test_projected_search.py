import math

import numpy as np
import pytest

from fleetwatch.llm import projected_search as ps


def brute(rows, k, asked):
    rows = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q in asked:
        found = sorted(((-float(rows[q] @ v), i) for i, v in rows.items() if i != q))[:k]
        out[q] = [(i, -s) for s, i in found]
    return out


def as_lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_recall_with_many_leaves(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 24))
    rows = [(i, [float(x) for x in centres[i % 30] + 0.5 * rng.standard_normal(24)]) for i in range(3000)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = as_lists(ps.search(vectors, vectors.where("vec_id % 50 = 0"), ps.SearchLimits(leaf=100, block=64, queries=16, step=32)))
    want = brute(rows, 20, [i for i in range(3000) if i % 50 == 0])
    hit = sum(s >= want[q][-1][1] - 1e-12 for q, found in got.items() for _, s in found)
    assert set(got) == set(want) and hit / (20 * len(want)) >= 0.9


def test_ties_copies_and_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(50, [0.0, 1.0]), (51, [2.0, 0.0]), (60, None), (61, [0.0, 0.0]), (62, [1.0, None]), (63, [nan, 1.0]), (64, [inf, 1.0]), (65, []), (66, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (3, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS leaf")
    got = as_lists(ps.search(vectors, vectors.where("vec_id IN (3, 50, 60, 61, 62, 63, 64, 66)")))
    want = brute([r for i, r in enumerate(rows) if r[0] is not None and r[0] < 60 and i < 42], 20, [3, 50])
    assert got == {q: [(i, pytest.approx(s)) for i, s in v] for q, v in want.items()}


def test_few_and_no_vectors(spark):
    two = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, -1.0])], "vec_id long, embedding array<float>")
    assert as_lists(ps.search(two, two)) == {1: [(2, 1.0)], 2: [(1, 1.0)]}
    assert ps.search(two.limit(0), two.limit(0)).count() == 0
    assert ps.search(two, two.limit(0)).count() == 0


def test_chi_square_law():
    assert ps.chi_square(ps.quantile(0.95, 8), 8) == pytest.approx(0.95)
    assert ps.quantile(0.95, 2) == pytest.approx(-2 * math.log(0.05))
