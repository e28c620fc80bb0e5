"""Trust graph, voting and causal factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.core import CFG, WIN, ev, rounded, traj
from catalog.registry import BELIEF, EV, GPUS, TRAJ, query, r6, with_
from catalog.core import AUTO, STATES
from fleetwatch.config import TrustConfig
from fleetwatch.operators import beliefs as B
from fleetwatch.operators import causal as C
from fleetwatch.operators import quarantine as Q
from fleetwatch.operators import trust as TR
from fleetwatch.plans.cut import cut
from fleetwatch.sources import adapters as A

EDGES = """edges AS (SELECT gpu_a, gpu_b, agreements, disagreements, last_us, agreements + disagreements AS comparisons,
    agreements / (agreements + disagreements) AS trust
  FROM (SELECT least(a, b) AS gpu_a, greatest(a, b) AS gpu_b, count(*) FILTER (ok) AS agreements, count(*) FILTER (NOT ok) AS disagreements, max(ts) AS last_us
    FROM (SELECT 'GPU-' || l_suppkey AS a, 'GPU-' || (l_partkey % 97) AS b, l_returnflag <> 'R' AS ok, epoch_us(l_shipdate) AS ts FROM lineitem)
    WHERE a <> b GROUP BY 1, 2))"""


def edges(spark, d):
    return TR.trust_edges(A.comparisons(spark, d))


@query(with_(EDGES) + f"SELECT gpu_a, gpu_b, agreements, disagreements, last_us, comparisons, {r6('trust')} FROM edges")
def trust_edges(spark, d):
    return rounded(edges(spark, d), "trust")


@query(with_(EDGES) + f"""SELECT *, {r6('a / (a + b)', 'trust')} FROM (SELECT gpu_a, gpu_b, CAST(round(agreements * CAST(0.95 AS DOUBLE)) AS BIGINT) AS a,
  CAST(round(disagreements * CAST(0.95 AS DOUBLE)) AS BIGINT) AS b FROM edges) WHERE a + b > 0""")
def decay_trust(spark, d):
    t = TR.decay_trust(edges(spark, d), TrustConfig(decay_factor=0.95))
    t = t.select("gpu_a", "gpu_b", F.col("agreements").alias("a"), F.col("disagreements").alias("b"), "trust")
    return rounded(t, "trust")


@query(with_(EDGES) + f"""SELECT count(*) AS edges, count(*) FILTER (comparisons >= 10) AS tested_edges, {r6('min(trust) FILTER (comparisons >= 10)', 'min_trust')},
  {r6('coalesce(avg(trust) FILTER (comparisons >= 10), 0)', 'mean_trust')}, {r6('sum(trust) / greatest(count(*), 1)', 'mean_all_edges')},
  any_value(n) AS gpus, {r6('count(*) FILTER (comparisons >= 10) / (any_value(n) * (any_value(n) - 1) / 2) * 100', 'coverage_pct')}
  FROM edges, (SELECT count(*) AS n FROM (SELECT gpu_a FROM edges UNION SELECT gpu_b FROM edges))""")
def trust_summary(spark, d):
    return rounded(TR.trust_summary(edges(spark, d)), "min_trust", "mean_trust", "mean_all_edges", "coverage_pct")


@query(with_(EV, TRAJ, GPUS, AUTO, STATES, BELIEF, EDGES) + f"""SELECT n.gpu_uuid, s.state, {r6('b.reliability', 'reliability')}
  FROM (SELECT gpu_a AS gpu_uuid FROM edges UNION SELECT gpu_b FROM edges) n LEFT JOIN states s USING (gpu_uuid) LEFT JOIN belief b USING (gpu_uuid)""")
def trust_nodes(spark, d):
    states = Q.current_states(Q.quarantine_auto(traj(spark, d), WIN), A.gpus(spark, d))
    return rounded(TR.trust_nodes(edges(spark, d), states, B.gpu_beliefs(ev(spark, d), CFG)), "reliability")


VOTES = """slots AS (SELECT l_orderkey AS canary_id, {cols}
  FROM (SELECT l_orderkey, l_linenumber, sha256(l_returnflag) AS fp, 'GPU-' || l_suppkey AS g, l_quantity AS q, epoch_us(l_shipdate) AS ts FROM lineitem WHERE l_linenumber <= 3
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY sha256(l_returnflag), 'GPU-' || l_suppkey, {tie}) = 1) GROUP BY 1),
votes AS (SELECT *, CASE WHEN f1 IS NULL OR f2 IS NULL OR f3 IS NULL THEN 'insufficient' WHEN f1 = f2 AND f2 = f3 THEN 'unanimous'
    WHEN f1 = f2 OR f1 = f3 OR f2 = f3 THEN 'dissent' ELSE 'no_consensus' END AS outcome,
  CASE WHEN f1 IS NULL OR f2 IS NULL OR f3 IS NULL THEN NULL WHEN f1 = f2 AND f2 <> f3 THEN 3 WHEN f1 = f3 AND f2 <> f3 THEN 2 WHEN f2 = f3 AND f1 <> f2 THEN 1 END AS dissenter_slot,
  CASE WHEN f1 IS NULL OR f2 IS NULL OR f3 IS NULL THEN NULL WHEN f1 = f2 OR f1 = f3 THEN f1 WHEN f2 = f3 THEN f2 END AS consensus FROM slots)"""
_COLS = ", ".join(f"max({c}) FILTER (l_linenumber = {i}) AS {n}{i}" for i in (1, 2, 3) for c, n in (("fp", "f"), ("g", "g"), ("q", "w"), ("ts", "t")))
V_TS = VOTES.format(cols=_COLS, tie="ts")
V_W = VOTES.format(cols=_COLS, tie="q")


@query(with_(V_TS) + "SELECT canary_id, outcome, consensus, dissenter_slot, CASE dissenter_slot WHEN 1 THEN g1 WHEN 2 THEN g2 WHEN 3 THEN g3 END AS dissenter_gpu FROM votes")
def majority_vote(spark, d):
    return TR.majority_vote(A.tmr_results(spark, d))


@query(with_(V_W) + """, heavy AS (SELECT *, CASE WHEN outcome = 'no_consensus' THEN CASE WHEN w3 >= w1 AND w3 >= w2 THEN 3 WHEN w2 >= w1 THEN 2 ELSE 1 END END AS h FROM votes)
SELECT canary_id, coalesce(consensus, CASE h WHEN 1 THEN f1 WHEN 2 THEN f2 WHEN 3 THEN f3 END) AS consensus,
  CASE WHEN outcome = 'dissent' THEN CAST(dissenter_slot AS VARCHAR) WHEN h = 1 THEN '2,3' WHEN h = 2 THEN '1,3' WHEN h = 3 THEN '1,2' ELSE '' END AS dissenters FROM heavy""")
def weighted_vote(spark, d):
    v = TR.weighted_vote(A.tmr_results(spark, d))
    return v.withColumn("dissenters", F.array_join(F.col("dissenters").cast("array<string>"), ","))


@query("""SELECT canary_id, fingerprint, string_agg(CAST(slot AS VARCHAR), ',' ORDER BY slot) AS slots, count(*) AS size
  FROM (SELECT DISTINCT l_orderkey AS canary_id, sha256(l_returnflag) AS fingerprint, l_linenumber AS slot FROM lineitem) GROUP BY 1, 2""")
def agreement_groups(spark, d):
    g = TR.agreement_groups(A.tmr_results(spark, d))
    return g.withColumn("slots", F.array_join(F.col("slots").cast("array<string>"), ","))


_PAIRS = " UNION ALL ".join(
    f"SELECT canary_id, g{i} AS gpu_a, g{j} AS gpu_b, f{i} = f{j} AS agree, greatest(t{i}, t{j}) AS ts_us FROM votes WHERE outcome IN ('unanimous', 'dissent')"
    for i, j in ((1, 2), (1, 3), (2, 3)))


@query(with_(V_TS) + _PAIRS)
def tmr_to_comparisons(spark, d):
    return TR.tmr_to_comparisons(A.tmr_results(spark, d))


_SPARSE = """raw AS (SELECT 'C-' || o_custkey AS a, 'C-' || ((o_custkey * 7 + o_orderkey % 3) % 1499) AS b, o_orderstatus <> 'F' AS ok FROM orders),
sparse AS (SELECT least(a, b) AS gpu_a, greatest(a, b) AS gpu_b, count(*) AS n, count(*) FILTER (ok) / count(*) AS trust FROM raw WHERE a <> b GROUP BY 1, 2),
ways AS (SELECT gpu_a AS src, gpu_b AS dst, n, trust FROM sparse UNION ALL SELECT gpu_b, gpu_a, n, trust FROM sparse)"""


def sparse_edges(spark, d):
    k = F.col("o_custkey")
    c = A.table(spark, d, "orders").select(
        F.concat(F.lit("C-"), k.cast("string")).alias("gpu_a"),
        F.concat(F.lit("C-"), ((k * 7 + F.col("o_orderkey") % 3) % 1499).cast("string")).alias("gpu_b"),
        (F.col("o_orderstatus") != "F").alias("agree"), F.lit(0).alias("ts_us"),
    )
    return TR.trust_edges(c.filter("gpu_a <> gpu_b"))


@query(with_(_SPARSE, """asked AS (SELECT DISTINCT 'C-' || c_custkey AS src, 'C-' || c_nationkey AS dst FROM customer),
RECURSIVE walk AS (SELECT src, src AS node, CAST(1 AS DOUBLE) AS p, 0 AS hops FROM (SELECT DISTINCT src FROM asked)
  UNION ALL SELECT w.src, y.dst, w.p * y.trust, w.hops + 1 FROM walk w JOIN ways y ON y.src = w.node AND y.n >= 3 WHERE w.hops < 3),
best AS (SELECT src, node AS dst, max(p) AS p FROM walk GROUP BY 1, 2)""") + f"""SELECT a.src, a.dst, {r6('coalesce(y.trust, b.p, 0)', 'trust')}
  FROM asked a LEFT JOIN ways y ON y.src = a.src AND y.dst = a.dst LEFT JOIN best b ON b.src = a.src AND b.dst = a.dst""")
def transitive_trust(spark, d):
    pairs = A.table(spark, d, "customer").select(
        F.concat(F.lit("C-"), F.col("c_custkey").cast("string")).alias("src"),
        F.concat(F.lit("C-"), F.col("c_nationkey").cast("string")).alias("dst"),
    )
    cfg = TrustConfig(min_comparisons=3, max_hops=3)
    return rounded(TR.transitive_trust(pairs, sparse_edges(spark, d), cfg), "trust")


# Pairs of compared devices, and for targets whose best one has at most .8, all pairs: never compared ones have no more.
_PARTNERS = """, near AS (SELECT t.gpu_uuid, y.dst AS gpu, 0.2::DOUBLE * y.trust + 0.1::DOUBLE / (1 + y.n) AS f FROM avail t JOIN ways y ON y.src = t.gpu_uuid),
tested AS (SELECT t.gpu_uuid, m.src AS a, m.dst AS b, round(0.4::DOUBLE * m.trust + coalesce(fa.f, 0.3::DOUBLE) + coalesce(fb.f, 0.3::DOUBLE), 9) AS score
  FROM avail t CROSS JOIN (SELECT y.* FROM ways y JOIN avail i ON i.gpu_uuid = y.src JOIN avail j ON j.gpu_uuid = y.dst WHERE y.src < y.dst) m
  LEFT JOIN near fa ON fa.gpu_uuid = t.gpu_uuid AND fa.gpu = m.src LEFT JOIN near fb ON fb.gpu_uuid = t.gpu_uuid AND fb.gpu = m.dst
  WHERE m.src <> t.gpu_uuid AND m.dst <> t.gpu_uuid),
rest AS (SELECT gpu_uuid FROM avail EXCEPT SELECT gpu_uuid FROM tested WHERE score > 0.8),
fresh AS (SELECT t.gpu_uuid, a.gpu_uuid AS a, b.gpu_uuid AS b, round(0.2::DOUBLE + coalesce(fa.f, 0.3::DOUBLE) + coalesce(fb.f, 0.3::DOUBLE), 9) AS score
  FROM rest t JOIN avail a ON a.gpu_uuid <> t.gpu_uuid JOIN avail b ON b.gpu_uuid <> t.gpu_uuid AND a.gpu_uuid < b.gpu_uuid
  LEFT JOIN near fa ON fa.gpu_uuid = t.gpu_uuid AND fa.gpu = a.gpu_uuid LEFT JOIN near fb ON fb.gpu_uuid = t.gpu_uuid AND fb.gpu = b.gpu_uuid
  WHERE NOT EXISTS (SELECT 1 FROM ways y WHERE y.src = a.gpu_uuid AND y.dst = b.gpu_uuid))
SELECT gpu_uuid, a AS partner_a, b AS partner_b, score FROM (SELECT * FROM tested UNION ALL SELECT * FROM fresh)
QUALIFY row_number() OVER (PARTITION BY gpu_uuid ORDER BY score DESC, a, b) = 1"""


@query(with_(_SPARSE, "avail AS (SELECT DISTINCT 'C-' || c_custkey AS gpu_uuid FROM customer)") + _PARTNERS)
def select_tmr_partners(spark, d):
    c = A.table(spark, d, "customer").select(F.concat(F.lit("C-"), F.col("c_custkey").cast("string")).alias("gpu_uuid"))
    return TR.select_tmr_partners(c, c, sparse_edges(spark, d))


@query(with_(EDGES, """avail AS (SELECT gpu_a AS gpu_uuid FROM edges UNION SELECT gpu_b FROM edges),
ways AS (SELECT gpu_a AS src, gpu_b AS dst, comparisons AS n, trust FROM edges UNION ALL SELECT gpu_b, gpu_a, comparisons, trust FROM edges)""") + _PARTNERS)
def select_tmr_partners_dense(spark, d):
    e = cut(edges(spark, d))
    nodes = TR.endpoints(e)
    return TR.select_tmr_partners(nodes, nodes, e)


@query()
def plan_canaries(spark, d):
    states = Q.current_states(Q.quarantine_auto(traj(spark, d), WIN), A.gpus(spark, d))
    return TR.plan_canaries(states, edges(spark, d))


@query(with_(_SPARSE) + """SELECT DISTINCT least(a, b) AS gpu_a, greatest(a, b) AS gpu_b FROM (SELECT 'C-' || c_custkey AS a, 'C-' || c_nationkey AS b FROM customer) p
  WHERE a <> b AND NOT EXISTS (SELECT 1 FROM sparse s WHERE s.gpu_a = least(p.a, p.b) AND s.gpu_b = greatest(p.a, p.b))""")
def uncompared_pairs(spark, d):
    pairs = A.table(spark, d, "customer").select(
        F.concat(F.lit("C-"), F.col("c_custkey").cast("string")).alias("gpu_a"),
        F.concat(F.lit("C-"), F.col("c_nationkey").cast("string")).alias("gpu_b"),
    )
    return TR.uncompared(pairs, sparse_edges(spark, d))


@query(with_(GPUS) + "SELECT * FROM gpus WHERE gpu_uuid <> 'GPU-7'")
def partner_candidates(spark, d):
    return TR.candidates(A.gpus(spark, d), "GPU-7")


OBS = """obs AS (SELECT 'GPU-' || l_suppkey AS gpu_uuid, l_returnflag = 'R' AS sdc, epoch_us(l_shipdate) AS ts_us, f.factor,
    CASE f.factor WHEN 'temperature' THEN l_quantity / 50 WHEN 'voltage' THEN l_discount * 10 ELSE l_tax * 12.5 END AS v
  FROM lineitem, (VALUES ('temperature'), ('voltage'), ('power')) f(factor)),
cedges AS (SELECT *, CASE WHEN a + b = 0 OR c + d = 0 THEN NULL WHEN c / (c + d) < 1e-10 THEN CASE WHEN a > 0 THEN 100.0 ELSE 0.0 END ELSE (a / (a + b)) / (c / (c + d)) END AS rr
  FROM (SELECT gpu_uuid, factor, count(*) FILTER (sdc AND v >= 0.7) AS a, count(*) FILTER (sdc AND v < 0.7) AS b,
    count(*) FILTER (NOT sdc AND v >= 0.7) AS c, count(*) FILTER (NOT sdc AND v < 0.7) AS d FROM obs GROUP BY GROUPING SETS ((gpu_uuid, factor), (factor)))),
cw AS (SELECT gpu_uuid, factor, a, b, c, d, rr, coalesce(1 - 1 / (1 + rr / 10), 0) AS weight FROM cedges),
cur AS (SELECT gpu_uuid, factor, v FROM obs QUALIFY row_number() OVER (PARTITION BY gpu_uuid, factor ORDER BY ts_us DESC, v DESC) = 1),
curw AS (SELECT cur.gpu_uuid, cur.factor, cur.v, coalesce(o.weight, f.weight, 0) AS weight FROM cur LEFT JOIN cw o ON o.gpu_uuid = cur.gpu_uuid AND o.factor = cur.factor
  LEFT JOIN cw f ON f.gpu_uuid IS NULL AND f.factor = cur.factor)"""


def causal(spark, d):
    return C.causal_edges(A.factor_observations(spark, d))


def current_factors(spark, d):
    o = A.factor_observations(spark, d)
    v = F.max(F.struct("ts_us", "normalized_value"))["normalized_value"]
    return o.groupBy("gpu_uuid", "factor").agg(v.alias("normalized_value"))


@query(with_(OBS) + f"SELECT gpu_uuid, factor, a AS sdc_elevated, b AS sdc_normal, c AS ok_elevated, d AS ok_normal, {r6('rr', 'relative_risk')}, {r6('weight')} FROM cw")
def causal_edges(spark, d):
    return rounded(causal(spark, d), "relative_risk", "weight")


@query(with_(OBS) + f"SELECT gpu_uuid, factor, {r6('v', 'normalized_value')}, {r6('weight')} FROM curw")
def factor_weights(spark, d):
    return rounded(C.factor_weights(current_factors(spark, d), causal(spark, d)), "normalized_value", "weight")


@query(with_(OBS) + f"""SELECT gpu_uuid, {r6('CASE WHEN sum(weight) > 0 THEN sum(weight * v) / sum(weight) ELSE 0 END', 'risk')},
  {r6("least(coalesce(sum(weight) FILTER (v >= 0.7), 0) / count(*), 1)", 'likelihood')} FROM curw GROUP BY 1""")
def environmental_risk(spark, d):
    return rounded(C.environmental_risk(current_factors(spark, d), causal(spark, d)), "risk", "likelihood")


@query(with_(OBS) + f"SELECT gpu_uuid, factor, {r6('weight')} FROM cw WHERE gpu_uuid IS NOT NULL ORDER BY gpu_uuid, weight DESC, factor")
def gpu_factors(spark, d):
    return rounded(C.gpu_factors(causal(spark, d)).select("gpu_uuid", "factor", "weight"), "weight")


@query(with_(OBS) + f"SELECT factor, {r6('weight')} FROM cw WHERE gpu_uuid IS NULL ORDER BY weight DESC, factor")
def fleet_factors(spark, d):
    return rounded(C.fleet_factors(causal(spark, d)).select("factor", "weight"), "weight")
