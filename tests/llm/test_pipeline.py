import random

import corpus_pipeline

from fleetwatch.llm import ngram_join
from fleetwatch.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_stages_take_effect_on_their_own_input(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    counts, last = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, last, DATA)
        path = corpus_pipeline.shared_path(spark, name)
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if name != "pieces":
            assert out.columns == docs.columns
        if name == "near_duplicates":
            assert all(r["doc_id"] == r["component_id"] for r in ngram_join.near_duplicates(out).collect())
        counts.append(out.count())
        last = out
    assert counts[1] < counts[0] and counts[2] <= counts[1] and counts[3] < counts[2] and counts[5] == counts[4] > 0
    assert last.where("NOT restored").count() == 0


def write(spark, folder, rows, labels):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_classifier_drops_junk_that_passes_the_rules(spark, tmp_path):
    """Labelled junk repeats itself, so the rules reject it; unlabelled junk of the same words doesn't."""
    rng, rows, labels = random.Random(4), [], []
    words = ["the", "sea", "was", "calm", "and", "ships", "came", "home"], ["jackpot", "bonus", "casino", "click", "win", "prize", "luxury", "quick"]
    for i in range(1000):
        junk, known = i % 4 == 0, i % 12 < 6
        drawn = [rng.choice(words[junk]) for _ in range(rng.randrange(40, 80))]
        half = drawn[: len(drawn) // 2]
        text = " ".join(half + half if junk and known else drawn)
        rows.append((i, text, "en", f"s{rng.randrange(4)}", len(text)))
        if known:
            labels.append((i, int(not junk)))
    docs = write(spark, tmp_path, rows, labels)
    passed = corpus_pipeline.rules(spark, docs, str(tmp_path))
    kept = {r["doc_id"] for r in corpus_pipeline.classifier(spark, passed, str(tmp_path)).collect()}
    ids = {r["doc_id"] for r in passed.select("doc_id").collect()}
    junk = {i for i in ids if i % 4 == 0}
    assert len(junk) > 50 and not junk & {i for i, _ in labels}
    assert len(kept & junk) <= len(junk) // 20 and len(kept - junk) >= 0.98 * len(ids - junk)


def test_stages_on_awkward_and_empty_tables(spark, awkward, tmp_path):
    for name, docs in (("awkward", awkward), ("empty", awkward.limit(0))):
        folder = tmp_path / name
        docs.select(*corpus_pipeline.COLUMNS).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, str(folder)).collect()
        assert all(r["restored"] for r in out) and (name == "awkward" or not out)
