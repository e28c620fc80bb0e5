import gzip
import hashlib
import random
import re

import pytest

from fleetwatch.llm import url_rules, warc

SCHEMA = "page_id long, url string, html string, file string, host string"


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "<p>" + "x" * 2000, "<p>é漢" + "y" * 1500
    rows = [(1, "http://a.com/x", big), (2, "http://b.com/ y\nz", big), (9, None, big), (3, "u", other), (4, "http://c.net/", "small"), (5, "http://c.net/2", "small"), (6, "http://d.org/", None), (7, "http://d.org/", ""),
            (8, "http://e.org/", "z" * 999), (10, "http://e.org/", "z" * 999), (11, "http://f.org/", "z" * 1000), (12, "http://f.org/", "z" * 1000), (12, "http://f.org/", "z" * 1000), (None, "http://n.org/", big), (3, "u2", "another " * 200)]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)


def test_read_back_equals_what_was_written(pages):
    index = warc.write_archives(pages)
    got = warc.read_records(index).collect()
    assert len(got) == pages.count()
    payload = {}
    for r in pages.collect():
        payload.setdefault(r["page_id"], set()).add(hashlib.sha1((r["html"] or "").encode()).hexdigest())
    kinds = {}
    for r in got:
        assert r["payload_digest"] in payload[r["page_id"]]
        kinds.setdefault(r["page_id"], []).append((r["record_type"], r["refers_to"]))
        if r["record_type"] == "response":
            assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"]
    assert kinds[1] == kinds[2] == [("revisit", 9)] and kinds[9] == [("response", None)]
    assert kinds[11] == [("revisit", 12)] and kinds[12] == [("response", None)] * 2
    assert all(kinds[i] == [("response", None)] for i in (4, 5, 6, 7, 8, 10, None))


def test_some_records_by_range(pages, spark):
    index = warc.write_archives(pages)
    some = index.where("page_id IN (1, 4)")
    bodies = {r["page_id"]: bytes(r["payload"]) for r in warc.payloads(index, some).collect()}
    assert bodies == {1: b"<p>" + b"x" * 2000, 4: b"small"}
    place = index.where("page_id = 4").first()
    path = place["file"].removeprefix("file://")
    with open(path, "rb") as f:
        f.seek(place["offset"])
        head = gzip.decompress(f.read(place["length"])).decode()
    assert head.startswith("WARC/1.1\r\nWARC-Type: response") and "WARC-Target-URI: http://c.net/" in head and head.endswith("small\r\n\r\n")
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0


def test_ranges_are_joined():
    assert warc.ranges([0, 10, 30, 10**6, 10**6 + 5], [10, 10, 5, 5, 5]) == [(0, 3), (3, 5)]
    assert warc.ranges([0, warc.READ], [warc.READ, 9]) == [(0, 1), (1, 2)]
    assert warc.ranges([], []) == []


def test_a_damaged_record_is_an_error(pages):
    index = warc.write_archives(pages.where("page_id = 4"))
    place = index.first()
    with open(place["file"].removeprefix("file://"), "r+b") as f:
        data = f.read()
        bad = gzip.compress(gzip.decompress(data).replace(b"small", b"smell"))
        f.seek(0)
        f.write(bad)
    with pytest.raises(Exception, match="damaged|zlib|incorrect|Error"):
        warc.read_records(index.selectExpr("file", "offset", f"CAST({len(bad)} AS long) AS length")).collect()


def listed(url):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [(len(r), r, v) for v, r in url_rules.RULES if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_listed_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://COM/", "http://com", "http://x.com/a?b", "https://Example.com/en/x#y", "http://www.example.com/en/", "http://a.www.example.com/en/q", "http://badexample.com/en/", "http://q.net/es/1", "http://net/fr/", "http://q.net/es", "a://b://c/d", "http://x.com\n/p", "http://é.net/fr/ü", "http://x.com?u=http://y.net/fr/"]
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(0, None, "clash"), (None, "http://x.com/", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    none = spark.createDataFrame([], "url string, bad boolean")
    got = url_rules.judge_urls(pages, none).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] is not None:
            host, path, rule, verdict = listed(urls[r["page_id"]])
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")
    assert url_rules.judge_urls(pages.limit(0), none).count() == 0


def test_mined_rules_find_planted_combinations(spark):
    rng, rows = random.Random(5), []
    for i in range(1200):
        path, key = rng.choice(["casino", "news", "wiki"]), rng.choice(["ref", "page", "utm"])
        bad = path == "casino" and key == "ref" or rng.random() < 0.02
        rows.append((i, f"http://h{rng.randrange(9)}.org/{path}/{i}?{key}=1", bad))
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    mined = url_rules.mine(pages.where("page_id < 800"))
    items = [set(r["items"]) for r in mined.collect()]
    assert {"path:casino", "key:ref"} in items
    assert all(not (a < b and len(b) == len(a) + 1) for a in items for b in items)  # no rule that a shorter one covers
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge_urls(pages, pages.where("page_id < 800"), rules=[("allow", "nowhere.example/")]).collect()}
    for i, url, _ in rows[800:]:
        assert got[i] == ("block" if "/casino/" in url and "?ref" in url else "allow")


def test_few_bad_urls_of_many_make_a_rule(spark):
    good = spark.range(30_000).selectExpr("concat('http://h', id % 40, '.org/p/', id) AS url", "false AS bad")
    few = spark.range(30).selectExpr("concat('http://evil.net/p/', id) AS url", "true AS bad")  # 0.1 % of all
    mined = {tuple(r["items"]): (r["confidence"], r["support"]) for r in url_rules.mine(good.union(few)).collect()}
    assert mined["host:evil.net",] == (1.0, pytest.approx(30 / 30_030))
    assert url_rules.mine(good.union(few.limit(24))).count() == 0


def test_rules_of_more_than_four_tokens(spark):
    words = "abcdef"
    rows = [(f"http://x.org/{'/'.join(words)}", True)] * 60
    for k in range(6):  # any five of the words are mostly good
        rows += [(f"http://x.org/{'/'.join(words[:k] + words[k + 1 :])}", False)] * 60
    mined = url_rules.mine(spark.createDataFrame(rows, "url string, bad boolean")).collect()
    assert [sorted(r["items"]) for r in mined] == [[f"path:{w}" for w in words]]
    assert (mined[0]["confidence"], mined[0]["support"]) == (1.0, pytest.approx(60 / 420))
