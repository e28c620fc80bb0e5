import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from fleetwatch.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, ranks, least=3):
    """All parts straight from the definition; rows are (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    groups = sorted({(lang, source) for _, lang, source in rows})
    out = []
    for lang in sorted({g[0] for g in groups}):
        docs, count = Counter(), defaultdict(Counter)
        for text, own, source in rows:
            if own == lang:
                found = TERM.findall(text.translate(LOWER))
                docs.update(set(found))
                count[source].update(found)
        kept = sorted(t for t, n in docs.items() if n >= least)
        whole = Counter()
        for c in count.values():
            whole.update(c)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        q = shares(whole)
        sources = [s for x, s in groups if x == lang]
        p = {s: shares(count[s]) for s in sources}
        for s in sources:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            term = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k) for k, (v, i) in enumerate(found if part == "pair" else found[:ranks], 1)]
    return sorted(out)


def corpus(seed=5, n=260, sources=9):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqr"] + ["É", "漢字", "\U0001F600x", "Ünï", "ﬀ", "Zz"]
    out = []
    for k in range(n):
        lang = rng.choice(["en", "en", "de", None, "xx"])
        source = rng.choice([None, *(f"s{j}" for j in range(sources))]) if lang != "xx" else f"only{k}"
        text = " ".join(rng.choices(words, [1 / (1 + j) for j in range(len(words))], k=rng.randrange(30))) if lang != "xx" else f"w{chr(97 + k % 26)}{k}"
        out.append((rng.choice([text, text.upper(), text.replace(" ", "9-")]), lang, source))
    return [*out, *out[:5], (None, "en", "s1"), ("", "en", "bare"), ("12 34", "fr", None), ("a_b" * 4000, "en", "s2")]


@pytest.mark.parametrize(("tile", "held", "step", "ranks"), [(512, 1_000_000, 1 << 18, 7), (4, 50, 3, 200), (1, 1_000_000, 1, 1)])
def test_equals_brute_force(spark, monkeypatch, tile, held, step, ranks):
    for name, value in (("TILE", tile), ("HELD", held), ("STEP", step)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "clash", 3) for r in rows], "text string, lang string, source string, term string, n int").repartition(4)
    got = sorted(tuple(r) for r in divergence.audit(docs, ranks).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute(rows, ranks)


def test_sql_says_the_same(awkward):
    rows = [(r["text"], r["lang"], r["source"]) for r in awkward.collect()]
    con = duckdb.connect()
    con.register("documents", awkward.select("text", "lang", "source").toPandas())
    assert sorted(con.sql(divergence.audit_sql()).fetchall()) == brute(rows, 200) == sorted(tuple(r) for r in divergence.audit(awkward).collect())


def test_empty_table(no_docs):
    assert divergence.audit(no_docs).collect() == []


def test_shares_of_very_large_counts(spark):
    row = spark.range(1).select(divergence.share(*(x.cast("long") for x in (divergence.F.lit(4 * 10**15), divergence.F.lit(9 * 10**15), divergence.F.lit(10**9)))).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (4 * 10**15 + 1) // (9 * 10**15 + 10**9)
