import random
import re

from fleetwatch.llm import ngram_join
from fleetwatch.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    sets = [(k, shingles(t)) for k, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k, len(s), least.get(find(i)) if s else k) for i, (k, s) in enumerate(sets) if k is not None)


def joined(docs):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).where("doc_id IS NOT NULL").collect())


def test_awkward_rows_equal_brute_force(awkward, no_docs):
    assert joined(awkward) == brute([(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert ngram_join.near_duplicates(awkward).count() == awkward.count()
    assert ngram_join.near_duplicates(no_docs).count() == 0


def test_groups_of_near_copies_equal_brute_force(spark):
    rng, rows = random.Random(8), []
    passage = [f"p{i}" for i in range(60)]
    for group in range(6):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 60, 150]))]
        for _ in range(rng.choice([1, 4, 25])):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words + (passage if group == 3 else []))))
    for _ in range(30):  # a passage that many share makes no pair
        rows.append((len(rows), " ".join([f"u{rng.randrange(10**6)}" for _ in range(200)] + passage)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    small = ngram_join.JoinLimits(block=8, rounds=1)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs, small).collect())
    assert got == brute(rows) == joined(docs)


def test_one_of_each_group_stays(awkward, no_docs):
    kept = ngram_join.keep_one(awkward)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == awkward.columns and len(ids) == len(set(ids))
    assert 1 in ids and 2 not in ids and None in ids and {4, 5, 6} <= set(ids)
    assert ngram_join.keep_one(no_docs).count() == 0


def test_keep_one_loses_no_text_and_no_row_without_an_id(spark):
    a, b, c = ("".join(f"{p}{i} " for i in range(30)) for p in "abc")
    rows = [(3, a, 1), (7, a, 2), (7, b, 3), (None, c, 4), (None, c, 5), (8, None, 6), (8, None, 6), (9, "", 7), (10, c, 8), (11, c, 9), (12, b, 10), (12, b, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int").repartition(3)
    kept = sorted(r["k"] for r in ngram_join.keep_one(docs).collect())
    assert kept == [1, 3, 4, 5, 6, 7, 8]
    unrepeated = docs.where("k NOT IN (6, 10)")
    assert sorted(r["k"] for r in ngram_join.keep_one(unrepeated).collect()) == [1, 3, 4, 5, 7, 8]


def test_keep_one_leaves_keys_only_and_deals_out_no_text(spark):
    from pathlib import Path

    from fleetwatch.plans.cut import shared_path

    words = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(words) + f" end{k}") for k in range(6)] + [(k, f"text {k} " * 9) for k in range(6, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = Path(shared_path(spark)).parent
    before = set(folder.glob("*"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = ngram_join.keep_one(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(p.name.split("-")[0] for p in set(folder.glob("*")) - before) == ["lost", "repeated"]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, *range(6, 12)]


def test_components_across_tasks(spark, monkeypatch):
    from fleetwatch.llm import components as module

    monkeypatch.setattr(module, "LOCAL", 40)  # so that several tasks hold edges
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 50)] + [(7, 7), (200, 201)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 150)}, 200: 200, 201: 200}


def test_copies_of_a_text_are_joined_once(spark, monkeypatch):
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w30 ", "other ")
    rows = [(1, base)] * 40 + [(2, near)]
    seen = []
    propose, count = ngram_join._proposals, ngram_join.count_overlaps
    monkeypatch.setattr(ngram_join, "_proposals", lambda lists, maps, *rest: (seen.append(maps.groupBy("set").count()), propose(lists, maps, *rest))[1])
    monkeypatch.setattr(ngram_join, "count_overlaps", lambda pairs, fragments: (seen.append(fragments.groupBy("set", "fragment").count()), count(pairs, fragments))[1])
    limits = ngram_join.JoinLimits(percent=70)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.near_duplicates(docs, limits).collect()}
    assert got == {(1, 1), (2, 1)}
    assert len(seen) > 1 and all(r["count"] == 1 for f in seen for r in f.collect())
