"""Output-vector monitors."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.core import rounded
from catalog.registry import query, r6, with_
from fleetwatch.config import DistributionConfig, DivergenceConfig, EntropyConfig, EwmaConfig, SpectralConfig
from fleetwatch.functions import vectors as V
from fleetwatch.operators import inference as I
from fleetwatch.plans.chunked import time_chunk
from fleetwatch.sources import adapters as A

CAP = """cap AS (SELECT vec_id AS request_id, CAST(vec_id // 2 AS VARCHAR) AS input_hash, CAST(vec_id % 2 AS VARCHAR) AS replica_id, 'model-' || label AS model_name, 'GPU-' || (vec_id % 13) AS gpu_uuid,
    vec_id * 700000 AS ts_us, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 10) AS x FROM embeddings)"""
STATS = """prob AS (SELECT *, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM cap),
soft AS (SELECT * EXCLUDE (e), list_transform(e, lambda v: v / list_sum(e)) AS p FROM prob),
st AS (SELECT request_id, input_hash, replica_id, model_name, gpu_uuid, ts_us, p, list_avg(x) AS mean,
    list_sum(list_transform(x, lambda v: pow(v - list_avg(x), 2))) / len(x) AS variance,
    list_sum(list_transform(x, lambda v: pow(v - list_avg(x), 4))) / len(x) / pow(list_sum(list_transform(x, lambda v: pow(v - list_avg(x), 2))) / len(x), 2) - 3 AS kurtosis,
    list_min(x) AS minimum, list_max(x) AS maximum, -list_sum(list_transform(p, lambda v: v * ln(greatest(v, 1e-30)))) AS entropy FROM soft)"""


def cap(spark, d):
    return A.captures(spark, d)


@query(with_(CAP, STATS) + f"SELECT request_id, {r6('mean')}, {r6('variance')}, {r6('kurtosis')}, {r6('minimum')}, {r6('maximum')}, {r6('entropy')} FROM st")
def logit_stats(spark, d):
    s = I.logit_stats(cap(spark, d)).select("request_id", *I.STAT_NAMES)
    return rounded(s, *I.STAT_NAMES)


@query(with_(CAP, STATS) + f"""SELECT request_id, {r6('entropy')}, {r6('list_sum(p)', 'softmax_sum')}, {r6('list_max(p)', 'softmax_max')}, {r6('sqrt(list_sum(list_transform(p, lambda v: v * v)))', 'softmax_l2')},
  {r6('list_sum(list_transform(p, lambda v: v * ln(greatest(v, 1e-30) / (1.0::DOUBLE / len(p)))))', 'kl_uniform')} FROM st""")
def vector_functions(spark, d):
    c = cap(spark, d).withColumn("p", V.softmax(F.col("logits")))
    uniform = F.transform("p", lambda x: F.lit(1.0) / F.size("p"))
    return rounded(c.select(
        "request_id", V.entropy(F.col("logits")).alias("entropy"), F.aggregate("p", F.lit(0.0), lambda s, x: s + x).alias("softmax_sum"),
        F.array_max("p").alias("softmax_max"), V.l2_norm(F.col("p")).alias("softmax_l2"), V.kl_divergence(F.col("p"), uniform).alias("kl_uniform"),
    ), "entropy", "softmax_sum", "softmax_max", "softmax_l2", "kl_uniform")


CHART = EwmaConfig(lam=0.1, limit=1.0, burn_in=10)
CH = 5_000_000


def _chart_sql(source, key, value, order, lam=0.1, limit=1.0, burn=10):
    return f"""cn AS (SELECT *, row_number() OVER w AS n, sum(v) OVER w AS s, sum(v * v) OVER w AS ss FROM (SELECT {key} AS k, {order} AS o, {value} AS v FROM {source}) WINDOW w AS (PARTITION BY k ORDER BY o ROWS UNBOUNDED PRECEDING)),
RECURSIVE cr AS (SELECT k, n, v AS ewma FROM cn WHERE n = 1 UNION ALL SELECT cn.k, cn.n, {lam}::DOUBLE * cn.v + {1 - lam}::DOUBLE * cr.ewma FROM cr JOIN cn ON cn.k = cr.k AND cn.n = cr.n + 1),
chart AS (SELECT *, n >= {burn} AND n > 1 AND sigma >= 1e-12 AND abs(ewma - target) > {limit} * sigma * sqrt({lam}::DOUBLE / {2 - lam}) AS breach FROM (
  SELECT cn.k, cn.o, cn.v, cn.n, cr.ewma, s / n AS target, CASE WHEN n = 1 THEN 0 ELSE sqrt(greatest(ss / n - pow(s / n, 2), 1e-15)) END AS sigma FROM cn JOIN cr USING (k, n)))"""


_LONG = "lg AS (SELECT gpu_uuid, request_id, stat_name, value FROM (SELECT gpu_uuid, request_id, mean, variance, kurtosis, minimum, maximum, entropy FROM st) UNPIVOT (value FOR stat_name IN (mean, variance, kurtosis, minimum, maximum, entropy)))"


@query(with_(CAP, STATS, _LONG, _chart_sql("lg", "gpu_uuid || '|' || stat_name", "value", "request_id")) + f"""SELECT split_part(k, '|', 1) AS gpu_uuid, split_part(k, '|', 2) AS stat_name, o AS request_id, n::BIGINT AS count, {r6('v', 'value')}, {r6('ewma')}, {r6('target')}, {r6('sigma')}, breach,
  CASE WHEN breach THEN CASE WHEN abs(ewma - target) / (sigma * sqrt(0.1::DOUBLE / 1.9)) > 1.5 THEN 'critical' ELSE 'warning' END END AS severity FROM chart""")
def ewma_chart(spark, d):
    s = I.stats_long(I.logit_stats(cap(spark, d)), "gpu_uuid", "request_id")
    c = I.ewma_chart(s, ["gpu_uuid", "stat_name"], ["request_id"], time_chunk("request_id", 128), CHART)
    return rounded(c.drop("ucl", "lcl"), "value", "ewma", "target", "sigma")


@query(with_(CAP, STATS, _chart_sql("st", "gpu_uuid", "entropy", "request_id")) + f"""SELECT k AS gpu_uuid, o AS request_id, {r6('v', 'entropy')}, unnest(list_filter([CASE WHEN breach THEN 'entropy_ewma' END, CASE WHEN v < 3.4 THEN 'entropy_collapse' END, CASE WHEN v > 3.9 THEN 'entropy_explosion' END], lambda x: x IS NOT NULL)) AS stat_name FROM chart""")
def entropy_monitor(spark, d):
    s = I.logit_stats(cap(spark, d))
    m = I.entropy_monitor(s, ["gpu_uuid"], ["request_id"], time_chunk("request_id", 128), EntropyConfig(3.4, 3.9), CHART)
    return rounded(m.select("gpu_uuid", "request_id", "entropy", "stat_name"), "entropy")


_JSD = """pairs AS (SELECT a.input_hash, a.replica_id AS replica_a, b.replica_id AS replica_b, a.request_id AS request_a, b.request_id AS request_b,
    list_transform(list_zip(a.p, b.p), lambda z: CAST((z[1] + z[2]) / 2 AS DOUBLE)) AS m, a.p AS pa, b.p AS pb
  FROM st a JOIN st b ON a.input_hash = b.input_hash AND a.replica_id <> b.replica_id AND (a.ts_us < b.ts_us OR (a.ts_us = b.ts_us AND a.request_id < b.request_id)) AND b.ts_us - a.ts_us < 2000000),
div AS (SELECT *, 0.5 * list_sum(list_transform(list_zip(pa, m), lambda z: greatest(z[1], 1e-30) * ln(greatest(z[1], 1e-30) / greatest(z[2], 1e-30))))
   + 0.5 * list_sum(list_transform(list_zip(pb, m), lambda z: greatest(z[1], 1e-30) * ln(greatest(z[1], 1e-30) / greatest(z[2], 1e-30)))) AS d FROM pairs)"""


@query(with_(CAP, STATS, _JSD) + f"SELECT input_hash, replica_a, replica_b, request_a, request_b, {r6('d', 'divergence')}, CASE WHEN d > 0.1 THEN 'critical' ELSE 'warning' END AS severity FROM div WHERE d > 0.01")
def cross_replica_divergence(spark, d):
    return rounded(I.cross_replica_divergence(cap(spark, d), DivergenceConfig()), "divergence")


@query(with_(CAP, """rk AS (SELECT request_id, model_name, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM cap),
top AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY v DESC, i) AS r FROM rk)""") + "SELECT request_id, CAST(i AS INTEGER) AS token FROM top WHERE r <= 10")
def top_tokens(spark, d):
    return I.tokens(cap(spark, d), 10).select("request_id", "token")


_TOK = "tok AS (SELECT model_name, CAST(i AS INTEGER) AS token FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY v DESC, i) AS r FROM (SELECT request_id, model_name, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM cap)) WHERE r <= 10)"


@query()
def count_min_sketch(spark, d):
    return I.count_min_sketch(I.tokens(cap(spark, d)), "token", ("model_name",))


# 64 tokens fit a 2048-wide sketch with next to no collisions, so the minimum is the count.
@query(with_(CAP, _TOK) + f"SELECT model_name, token, count(*) AS estimate, {r6('count(*) / any_value(t)', 'relative')} FROM tok JOIN (SELECT model_name, count(*) AS t FROM tok GROUP BY 1) USING (model_name) GROUP BY 1, 2")
def estimate_counts(spark, d):
    t = I.tokens(cap(spark, d))
    return rounded(I.estimate_counts(I.count_min_sketch(t, "token", ("model_name",)), t, "token"), "relative")


@query(with_(CAP, _TOK) + f"SELECT token, 2 * count(*) AS estimate, {r6('count(*) / (SELECT count(*) FROM tok)', 'relative')} FROM tok GROUP BY 1")
def merge_sketches(spark, d):
    t = I.tokens(cap(spark, d)).select("token")
    s = I.count_min_sketch(t, "token")
    return rounded(I.estimate_counts(I.merge_sketches(s, s), t, "token"), "relative")


@query()
def vocab_cardinality(spark, d):
    li = A.table(spark, d, "lineitem").select("l_returnflag", "l_partkey")
    return I.vocab_cardinality(li, "l_partkey", ("l_returnflag",)).select("l_returnflag", "estimate")


# The sketch's estimate must lie within 5 % of the exact count.
@query("SELECT l_returnflag, true AS within_5_percent FROM lineitem GROUP BY 1")
def vocab_cardinality_bound(spark, d):
    li = A.table(spark, d, "lineitem").select("l_returnflag", "l_partkey")
    exact = li.distinct().groupBy("l_returnflag").agg(F.count("*").alias("n"))
    e = I.vocab_cardinality(li, "l_partkey", ("l_returnflag",)).join(exact, "l_returnflag")
    return e.select("l_returnflag", (F.abs(F.col("estimate") - F.col("n")) <= F.col("n") * 0.05).alias("within_5_percent"))


@query()
def merge_cardinality(spark, d):
    li = A.table(spark, d, "lineitem").select("l_returnflag", "l_partkey")
    return I.merge_cardinality(I.vocab_cardinality(li, "l_partkey", ("l_returnflag",)))


@query(f"""WITH a AS (SELECT l_linenumber AS item, count(*) / (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS share_a FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
b AS (SELECT l_linenumber AS item, count(*) / (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R') AS share_b FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT item, {r6('coalesce(share_a, 0)', 'share_a')}, {r6('coalesce(share_b, 0)', 'share_b')}, {r6('abs(coalesce(share_a, 0) - coalesce(share_b, 0))', 'shift')}
FROM a FULL JOIN b USING (item) WHERE abs(coalesce(share_a, 0) - coalesce(share_b, 0)) > 0.0005""")
def frequency_shift(spark, d):
    li = A.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("item"), "l_returnflag")
    s = I.frequency_shift(li.filter("l_returnflag = 'R'"), li.filter("l_returnflag <> 'R'"), "item", 0.0005)
    return rounded(s, "share_a", "share_b", "shift")


@query(f"""WITH v AS (SELECT l_linestatus AS k, l_extendedprice AS value, l_returnflag = 'R' AS cur FROM lineitem),
span AS (SELECT k, min(value) AS lo, max(value) AS hi FROM v WHERE NOT cur GROUP BY 1),
h AS (SELECT k, cur, greatest(0, least(floor((value - lo) / (hi - lo) * 256), 255)) AS bin, count(*) AS n FROM v JOIN span USING (k) GROUP BY ALL),
f AS (SELECT k, cur, bin, n / sum(n) OVER (PARTITION BY k, cur) AS share FROM h)
SELECT p.k AS l_linestatus, {r6('sum(p.share * ln(p.share / greatest(coalesce(q.share, 1e-30), 1e-30)))', 'kl')}, count(*) AS bins_used
FROM f p LEFT JOIN f q ON q.k = p.k AND q.bin = p.bin AND NOT q.cur WHERE p.cur GROUP BY 1""")
def drift_vs_reference(spark, d):
    li = A.table(spark, d, "lineitem").select("l_linestatus", "l_returnflag", F.col("l_extendedprice").alias("value"))
    r = I.drift_vs_reference(li.filter("l_returnflag = 'R'"), li.filter("l_returnflag <> 'R'"), ["l_linestatus"])
    return rounded(r, "kl")


@query("""WITH v AS (SELECT 'GPU-' || l_suppkey AS gpu_uuid, l_extendedprice AS value FROM lineitem),
fl AS (SELECT DISTINCT value, cume_dist() OVER (ORDER BY value) AS f FROM v),
flb AS (SELECT value, f, coalesce(lag(f) OVER (ORDER BY value), 0) AS f0 FROM fl),
gp AS (SELECT DISTINCT gpu_uuid, value, cume_dist() OVER (PARTITION BY gpu_uuid ORDER BY value) AS g FROM v),
gpb AS (SELECT *, coalesce(lag(g) OVER (PARTITION BY gpu_uuid ORDER BY value), 0) AS g0 FROM gp),
sizes AS (SELECT gpu_uuid, count(*) AS n, (SELECT count(*) FROM v) AS fleet_n FROM v GROUP BY 1),
dist AS (SELECT gpu_uuid, max(greatest(abs(g - f), abs(g0 - f0))) AS ks FROM gpb JOIN flb USING (value) GROUP BY 1),
tails AS (SELECT gpu_uuid, ks, n, fleet_n, ks * sqrt(n * fleet_n / (n + fleet_n)) AS t FROM dist JOIN sizes USING (gpu_uuid)),
tested AS (SELECT gpu_uuid, ks, n, fleet_n, CASE WHEN t < 0.1 THEN 1.0 ELSE least(1, greatest(0, (SELECT 2 * sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * t * t)) FROM range(1, 200) r(k)))) END AS p FROM tails)
SELECT gpu_uuid, n, fleet_n, round(ks, 6) AS ks, round(p, 6) AS p_value, p < 0.001 / (SELECT count(*) FROM sizes) AS rejected FROM tested""")
def fleet_ks(spark, d):
    li = A.table(spark, d, "lineitem").select(A.gpu(F.col("l_suppkey")).alias("gpu_uuid"), F.col("l_extendedprice").alias("value"))
    return rounded(I.fleet_ks(li), "ks", "p_value")


@query()
def spectral_monitor(spark, d):
    c = cap(spark, d).withColumn("stream", F.pmod("request_id", F.lit(2)))
    f = I.spectral_features(c)
    return I.spectral_monitor(f, ["stream"], ["request_id"], time_chunk("request_id", 512), SpectralConfig(baseline_window=40))


@query()
def distribution_monitor(spark, d):
    c = cap(spark, d).withColumn("stream", F.pmod("request_id", F.lit(2)))
    return I.distribution_monitor(c, ["stream"], ["request_id"], time_chunk("request_id", 512), DistributionConfig(baseline_size=80))


_PSD = """psd AS (SELECT request_id, len(x) AS n, list_transform(range(len(x)), lambda j: (x[j + 1] - list_avg(x)) * (0.5 - 0.5 * cos(2 * pi() * j / (len(x) - 1)))) AS w FROM cap),
spec AS (SELECT request_id, list_transform(range(n // 2 + 1), lambda k: (pow(list_sum(list_transform(range(n), lambda j: w[j + 1] * cos(2 * pi() * k * j / n))), 2) + pow(list_sum(list_transform(range(n), lambda j: w[j + 1] * sin(2 * pi() * k * j / n))), 2)) / n
    * CASE WHEN k = 0 OR (n % 2 = 0 AND k = n // 2) THEN 1 ELSE 2 END) AS s FROM psd)"""


@query(with_(CAP, _PSD) + f"SELECT request_id, {r6('list_sum(s)', 'energy')}, {r6('list_sum(s[CAST(floor(len(s) * 0.75) AS BIGINT) + 1:]) / list_sum(s)', 'hf_ratio')} FROM spec")
def spectral_features(spark, d):
    f = I.spectral_features(cap(spark, d))
    e = F.aggregate("psd", F.lit(0.0), lambda s, x: s + x)
    return rounded(f.select("request_id", e.alias("energy"), "hf_ratio"), "energy", "hf_ratio")


@query()
def fingerprints(spark, d):
    return I.fingerprints(cap(spark, d)).select("request_id", F.lower(F.hex("fingerprint")).alias("fingerprint"))


@query()
def replica_fingerprint_distance(spark, d):
    return I.replica_fingerprint_distance(I.fingerprints(cap(spark, d)))


@query(f"""WITH f AS (SELECT doc_id, md5(text) AS h, md5(lang || text) AS g FROM documents)
SELECT doc_id, sum(bit_count(xor(CAST(('0x' || substr(h, i * 8 + 1, 8)) AS BIGINT), CAST(('0x' || substr(g, i * 8 + 1, 8)) AS BIGINT))))::BIGINT AS hamming FROM f, range(4) r(i) GROUP BY 1""")
def hamming_distance(spark, d):
    t = A.documents(spark, d)
    a, b = F.unhex(F.md5("text")), F.unhex(F.md5(F.concat("lang", "text")))
    return t.select("doc_id", V.hamming128(a, b).cast("long").alias("hamming"))


@query()
def similar_fingerprints(spark, d):
    """Links between different fingerprints at most 6 bits apart, among the captures and a slightly disturbed copy of each."""
    c = cap(spark, d)
    shifted = c.withColumn("request_id", -1 - F.col("request_id")).withColumn("logits", F.transform("logits", lambda x, i: F.when(i % 7 == 0, x + 0.05).otherwise(x)))
    return I.similar_fingerprints(I.fingerprints(c.unionByName(shifted)), "request_id", 6)[1]


@query()
def fingerprint_copies(spark, d):
    return I.fingerprint_copies(I.fingerprints(cap(spark, d)), "request_id")


@query(with_(CAP, STATS) + """SELECT request_id, unnest(list_filter([CASE WHEN list_max(list_transform(x, lambda v: abs(v))) > 3.5 THEN 'logit_magnitude' END], lambda r: r IS NOT NULL)) AS rule FROM cap""")
def check_invariants(spark, d):
    return I.check_invariants(cap(spark, d), 3.5)


@query()
def sample_captures(spark, d):
    return I.sample_captures(cap(spark, d), 0.1).select("request_id", "gpu_uuid")
