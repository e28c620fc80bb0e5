import random
import re

import duckdb
import pytest

from fleetwatch.llm import licenses

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, templates, threshold):
    """Every block of every step against every template."""
    found = split(text)
    out = []
    for k, (label, notice) in enumerate(templates):
        own = set(split(notice))
        if not own:
            continue
        step = 1
        while step < len(split(notice)):
            step *= 2
        for block in range(0, -(-len(found) // step)):
            common = len(own & set(found[block * step : (block + 2) * step]))
            if common >= max(1, -(-round(threshold * len(own) * 1000) // 1000)):
                out.append((k, label, block * step, min(len(found), (block + 2) * step) - 1, common))
    return sorted(out)


def base(text):
    found, out = split(text), []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        out += [(i, label) for i in range(len(found)) if found[i : i + len(p)] == p]
    return sorted(out)


def texts(seed=2):
    rng = random.Random(seed)
    words = ["the", "of", "license", "mit", "version", "software", "free", "Lorem", "naïve", "2", "0", "Apache", "general", "public", "GNU", "under", "Released"]
    out = [None, "", " \n", "MIT license.MIT-License mit", "the General\nPublic  License", "x" * 3000, "license " * 3000, "mit"]
    for label, notice in licenses.TEMPLATES:
        ws = notice.split()
        cut = [w for w in ws if rng.random() > 0.06]
        out += [notice, "\n".join(ws), "prefix " * 37 + notice.upper() + " suffix" * 91, " ".join(cut), " ".join(ws[: len(ws) // 2]), " ".join(rng.sample(ws, len(ws)))]
    out += [" ".join(rng.choices(words, k=rng.randrange(200))) for _ in range(60)]
    return [*out, out[8], out[8]]


@pytest.mark.parametrize(("threshold", "bound"), [(0.9, 1_000_000), (0.5, 20), (1.0, 60)])
def test_equals_brute_force(spark, monkeypatch, threshold, bound):
    monkeypatch.setattr(licenses, "VOCABULARY", bound)
    rows = [(k, t, "clash") for k, t in enumerate(texts())]
    templates = [*licenses.TEMPLATES, ("none", " .. "), ("mit", "mit")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, matches string").repartition(4)
    got = licenses.scan(docs, ["doc_id", "matches"], templates, threshold).orderBy("doc_id").collect()
    assert len(got) == len(rows)
    for r, (k, text, _) in zip(got, rows):
        assert r["doc_id"] == k and r["n_words"] == len(split(text))
        assert [(p["place"], p["label"]) for p in r["phrases"]] == base(text)
        assert sorted((m["template"], m["label"], m["first_word"], m["last_word"], m["common"]) for m in r["matches"]) == brute(text, templates, threshold)


def test_sql_says_the_same(spark, awkward):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()] + [(100 + k, t) for k, t in enumerate(texts(9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    key = lambda r: tuple((x is None, x) for x in r)
    got = licenses.labelled(licenses.scan(docs, ["doc_id"])).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(con.sql(licenses.labels_sql()).fetchall(), key=key)


def test_empty_table(no_docs):
    assert licenses.scan(no_docs, ["doc_id"]).collect() == []
