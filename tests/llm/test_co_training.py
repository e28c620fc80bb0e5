import random

from fleetwatch.llm import co_training as ct


def corpus(n=900):
    rng, rows, labels = random.Random(2), [], []
    for i in range(n):
        bad = i % 5 == 0
        words = [rng.choice(["the", "sea", "was", "calm", "and", "ships", "came", "home"]) for _ in range(rng.randrange(30, 80))]
        text = " ".join(w + rng.choice(["$$$", "***", "%%"]) for w in words) if bad else " ".join(words).capitalize() + "."
        rows.append((i, text, "en", "spam" if bad and rng.random() < 0.7 else f"s{rng.randrange(4)}", len(text)))
        if i % 3 == 0:
            labels.append((i, int(not bad)))
    return rows, labels


def test_held_out_accuracy_and_exchange(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    views = ct.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r["doc_id"]: r for r in ct.score(docs, ["doc_id"], views).collect()}
    unseen = [i for i in range(len(rows)) if i % 3]
    assert sum(got[i]["kept"] == (i % 5 != 0) for i in unseen) / len(unseen) > 0.98
    spam = [got[r[0]]["p_meta"] for r in rows if r[3] == "spam"]
    rest = [got[r[0]]["p_meta"] for r in rows if r[3] != "spam"]
    assert sum(spam) / len(spam) < 0.4 < 0.8 < sum(rest) / len(rest)  # the metadata view knows the bad source
    kept = ct.score(docs, ["doc_id", "text"], views, only_kept=True)
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["kept"]}
    again = ct.fit(docs.repartition(7), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert abs(again.text.bias - views.text.bias) < 1e-6  # no matter how rows are dealt out


def test_awkward_rows(awkward, no_docs, spark):
    rows, labels = corpus(300)
    docs = awkward.unionByName(spark.createDataFrame([(i + 1000, *r[1:]) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    more = [(i + 1000, q) for i, q in labels] + [(1, None), (1, 1), (1, 0), (None, 1), (99999, 0)]
    views = ct.fit(docs, spark.createDataFrame(more, "doc_id long, quality int"))
    out = ct.score(awkward, ["doc_id", "score", "text"], views).collect()
    assert len(out) == awkward.count() and all(0 <= r["p_good"] <= 1 for r in out)
    assert ct.score(no_docs, ["doc_id"], views).count() == 0


def test_nothing_to_learn_keeps_all(awkward, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    for docs in (awkward, no_docs):
        assert all(r["kept"] for r in ct.score(docs, ["doc_id"], ct.fit(docs, none)).collect())
    good = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert all(r["kept"] for r in ct.score(awkward, ["doc_id"], ct.fit(awkward, good)).collect())
