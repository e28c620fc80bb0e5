import math
import zlib
from collections import Counter

import duckdb
import pandas as pd

from fleetwatch.llm import mixing, sharding


def test_mix_follows_target_weights(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN 'b' END AS source", "'t' AS copy")
    out = mixing.poisson_mix(docs, {"hot": 1.0, None: 3.0}, rows=8000)
    n = Counter(r["source"] for r in out.collect())
    assert "b" not in n
    assert abs(n["hot"] - 2000) < 5 * math.sqrt(2000) and abs(n[None] - 6000) < 5 * math.sqrt(6000)
    draws = Counter(r["n_copies"] for r in out.where("source IS NULL").select("doc_id", "n_copies").distinct().collect())
    rate = 6000 / 6666
    assert abs(draws[1] / 6666 - rate * math.exp(-rate)) < 0.03


def test_large_rates_are_sums_of_draws(spark):
    docs = spark.range(50).selectExpr("id AS doc_id", "'s' AS source")
    out = mixing.poisson_mix(docs, rows=50 * 900).groupBy("doc_id").count().collect()
    mean = sum(r["count"] for r in out) / 50
    assert abs(mean - 900) < 5 * 30 / math.sqrt(50)


def test_mix_equals_sql_and_takes_awkward_rows(awkward, no_docs, spark):
    out = mixing.poisson_mix(awkward)
    assert mixing.poisson_mix(no_docs).count() == 0
    con = duckdb.connect()
    con.register("documents", awkward.drop("copy").toArrow())
    want = con.execute(mixing.mix_sql()).fetchdf()
    got = out.toPandas()
    key = lambda f: sorted(("" if pd.isna(r.doc_id) else str(int(r.doc_id)), r.copy_, r.shuffle_key) for r in f.rename(columns={"copy": "copy_"}).itertuples())
    assert key(got) == key(want)
    assert set(out.columns) == {*awkward.columns, "n_copies", "shuffle_key"}


def test_shards_are_even_gapless_and_whole(awkward, no_docs):
    rows = sharding.assign_shards(awkward, 4).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in awkward.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(4)]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.assign_shards(no_docs, 4).count() == 0


def test_shards_are_repeatable_and_shuffled(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "CAST(id % 7 AS STRING) AS text")
    a, b = ({r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign_shards(docs, 8, bucket_bytes=20_000).collect()} for _ in range(2))
    assert a == b
    order = sorted(a, key=a.get)
    rising = sum(x < y for x, y in zip(order, order[1:]))
    assert 1800 < rising < 2200  # a sorted list has 3999, a random one about half
    other = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign_shards(docs, 8, seed=1, bucket_bytes=20_000).collect()}
    assert other != a


def test_written_shards_hold_all_columns(awkward, tmp_path, spark):
    sharding.write_shards(awkward.drop("shard"), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == awkward.count() and set(back.columns) == {*awkward.columns, "slot"}


def test_shards_come_from_written_records(awkward, tmp_path, spark, monkeypatch):
    wrote = []
    write = sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda docs, path, *rest: (wrote.append(path), write(docs, path, *rest)))
    want = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.assign_shards(awkward, 4).collect()}
    files = spark.read.parquet(wrote[0])
    assert {(r["doc_id"], r["into_shard"], r["into_slot"]) for r in files.collect()} == want
    assert Counter(map(str, files.select(awkward.columns).collect())) == Counter(map(str, awkward.collect()))


def test_equal_keys_keep_their_other_columns(tmp_path, spark):
    docs = spark.range(3000).selectExpr("IF(id < 2000, 7, id) AS doc_id", "IF(id < 2000, 'same', CAST(id AS STRING)) AS text", "id AS other")
    sharding.write_shards(docs, str(tmp_path / "out"), 4, bucket_bytes=4000)  # doc 7 would fill 34 buckets
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["other"] for r in rows) == list(range(3000))
    spread = Counter(r["shard"] for r in rows if r["doc_id"] == 7)
    assert all(400 < spread[k] < 600 for k in range(4))
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(k, s) for k in range(4) for s in range(750)]
