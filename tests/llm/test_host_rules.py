import re
from collections import Counter

from fleetwatch.llm import host_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            inside.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_measures_equal_brute_force(awkward):
    got = host_rules.judge(awkward).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = {}
    for r in awkward.collect():
        want.setdefault(r["doc_id"], brute(r["text"]))
    assert len(got) == awkward.count()
    for r in got:
        assert tuple(r)[1:6] == want[r["doc_id"]], r["doc_id"]
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_bad_host_takes_its_documents_along(spark):
    text, junk = " ".join(f"w{i}" for i in range(40)), "too short"
    rows = [(i, text if i % 2 else junk, "good" if i % 2 else "bad") for i in range(200)] + [(1000, text, "bad"), (1001, text, "small"), (1002, junk, "small"), (1003, text, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in host_rules.judge(docs).collect()}
    assert not kept[1000] and kept[1] and kept[1003]
    rate = {r["host"]: r["shrunk_rate"] for r in host_rules.judge(docs).select("host", "shrunk_rate").distinct().collect()}
    assert rate["bad"] > 0.9 and rate["good"] < 0.1 and 0.3 < rate["small"] < 0.7  # two documents: near the mean
    assert {r["doc_id"] for r in host_rules.keep_good(docs).collect()} == {k for k, v in kept.items() if v}


def test_stage_keeps_columns_and_empty_tables(awkward, no_docs):
    assert host_rules.keep_good(awkward).columns == awkward.columns
    assert host_rules.judge(no_docs).count() == 0 and host_rules.keep_good(no_docs).count() == 0
