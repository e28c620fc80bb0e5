"""Training-run monitors."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.core import ev, rounded
from catalog.registry import EV, query, r6, with_
from fleetwatch.config import GradientConfig, LossConfig, TrainingLimits
from fleetwatch.operators import training as TN
from fleetwatch.plans.chunked import time_chunk
from fleetwatch.sources import adapters as A

GCFG = GradientConfig(alpha=0.05, warmup=20, sigma=2.0)
GN = """gn AS (SELECT l_returnflag AS run_id, 'GPU-' || l_suppkey AS layer_name, l_orderkey * 8 + l_linenumber AS step, l_extendedprice / 997 AS norm FROM lineitem),
gnn AS (SELECT *, row_number() OVER (PARTITION BY run_id, layer_name ORDER BY step, norm) AS n FROM gn),
RECURSIVE gr AS (SELECT run_id, layer_name, n, step, norm, norm AS ew_mean, 0::DOUBLE AS ew_var, 0::DOUBLE AS z FROM gnn WHERE n = 1
  UNION ALL SELECT g.run_id, g.layer_name, g.n, g.step, g.norm, r.ew_mean + 0.05::DOUBLE * (g.norm - r.ew_mean), 0.95::DOUBLE * (r.ew_var + 0.05::DOUBLE * pow(g.norm - r.ew_mean, 2)),
    CASE WHEN r.n >= 20 THEN abs(g.norm - r.ew_mean) / sqrt(greatest(r.ew_var, 1e-12)) ELSE 0 END
  FROM gr r JOIN gnn g ON g.run_id = r.run_id AND g.layer_name = r.layer_name AND g.n = r.n + 1)"""


def norms(spark, d):
    li = A.table(spark, d, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("run_id"), A.gpu(F.col("l_suppkey")).alias("layer_name"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("step"), (F.col("l_extendedprice") / 997).alias("norm"),
    )


KEYS, ORDER = ["run_id", "layer_name"], ["step", "norm"]


def wide(col="step"):
    return time_chunk(col, 200_000)


@query(with_(GN) + f"SELECT run_id, layer_name, step, n, {r6('norm')}, {r6('ew_mean')}, {r6('ew_var')}, {r6('z')} FROM gr")
def ew_zscore(spark, d):
    z = TN.ew_zscore(norms(spark, d), KEYS, ORDER, wide(), "norm", GCFG)
    return rounded(z.select("run_id", "layer_name", "step", "n", "norm", "ew_mean", "ew_var", "z"), "norm", "ew_mean", "ew_var", "z")


@query(with_(GN) + f"SELECT run_id, layer_name, step, CASE WHEN norm > ew_mean THEN 'gradient_spike' ELSE 'gradient_collapse' END AS anomaly_type, {r6('z', 'score')}, {r6('ew_mean')} FROM gr WHERE z > 2.0 AND n >= 20")
def gradient_anomalies(spark, d):
    return rounded(TN.gradient_anomalies(norms(spark, d), KEYS, ORDER, wide(), GCFG).drop("norm"), "score", "ew_mean")


@query(with_(GN.split(",\nRECURSIVE")[0]) + f"SELECT run_id, layer_name, (n - 1) // 4 AS step_group, {r6('avg(norm)', 'norm')} FROM gnn GROUP BY 1, 2, 3 HAVING count(*) = 4")
def grad_accumulation(spark, d):
    return rounded(TN.grad_accumulation(norms(spark, d), KEYS, ORDER, wide(), 4), "norm")


LOSS = """ls AS (SELECT o_orderpriority AS run_id, o_orderkey AS step, CASE WHEN o_orderkey % 211 = 0 THEN 'nan'::DOUBLE ELSE o_totalprice / 1000 END AS loss FROM orders),
lf AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS n FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS step_count FROM ls) WHERE NOT isnan(loss))"""


@query(with_(LOSS) + """SELECT run_id, step, 'inf'::DOUBLE AS score, nan_count FROM (SELECT *, count(*) FILTER (isnan(loss)) OVER (PARTITION BY run_id ORDER BY step) AS nan_count FROM ls) WHERE isnan(loss)""")
def loss_nonfinite(spark, d):
    return TN.loss_nonfinite(A.losses(spark, d), ["run_id"], ["step"], wide())


@query(with_(LOSS) + f"""SELECT run_id, step, round(1 / greatest(v, 1e-15), 9) AS score, {r6('m', 'mean_loss')}, {r6('v', 'variance')} FROM (
  SELECT *, avg(loss) OVER w AS m, var_pop(loss) OVER w AS v FROM lf WINDOW w AS (PARTITION BY run_id ORDER BY n ROWS 49 PRECEDING)) WHERE n >= 50 AND v < 10000 AND step_count > 20 AND abs(m) > 1e-3""")
def loss_plateau(spark, d):
    p = TN.loss_plateau(A.losses(spark, d), ["run_id"], ["step"], wide(), LossConfig(plateau_tolerance=10000.0), 1000)
    return rounded(p.withColumn("score", F.round("score", 9)), "mean_loss", "variance")


@query(with_(LOSS) + f"""SELECT a.run_id, a.step, {r6('a.best', 'best')}, {r6('b.best', 'best_before')} FROM (SELECT *, min(loss) OVER (PARTITION BY run_id ORDER BY n) AS best FROM lf) a
  JOIN (SELECT *, min(loss) OVER (PARTITION BY run_id ORDER BY n) AS best FROM lf) b ON b.run_id = a.run_id AND b.n = a.n - 500 WHERE b.best - a.best < 1e-4""")
def improvement_plateau(spark, d):
    p = TN.improvement_plateau(A.losses(spark, d), ["run_id"], ["step"], wide(), 500, 1e-4)
    return rounded(p, "best", "best_before")


@query()
def ar_loss_spikes(spark, d):
    r = TN.ar_loss_spikes(A.losses(spark, d), ["run_id"], ["step"], wide(), LossConfig(sigma=1.5), 1000)
    return rounded(r, "predicted", "residual_std", "z")


HASH = """gh AS (SELECT l_linestatus AS run_id, l_orderkey AS step, l_linenumber AS rank, sha256(l_returnflag) AS hash FROM lineitem),
ph AS (SELECT run_id, step, hash, count(*) AS n FROM gh GROUP BY ALL),
dv AS (SELECT run_id, step, sum(n)::BIGINT AS ranks, count(*) AS unique_hashes, first(hash ORDER BY n DESC, hash) AS majority_hash, max(n) AS majority_count FROM ph GROUP BY 1, 2 HAVING count(*) > 1)"""


@query(with_(HASH) + """SELECT run_id, step, CAST(ranks - majority_count AS DOUBLE) AS score, unique_hashes, majority_hash, majority_count,
  (SELECT string_agg(hash || '=' || n, ',' ORDER BY hash) FROM ph WHERE ph.run_id = dv.run_id AND ph.step = dv.step) AS distribution FROM dv""")
def cross_rank_divergence(spark, d):
    found = TN.cross_rank_divergence(A.grad_hashes(spark, d))
    parts = F.transform(F.map_entries("distribution"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return found.withColumn("distribution", F.array_join(parts, ","))


@query(with_(HASH) + "SELECT g.run_id, g.step, g.rank, g.hash FROM gh g JOIN dv USING (run_id, step) WHERE g.hash <> dv.majority_hash")
def suspect_ranks(spark, d):
    h = A.grad_hashes(spark, d)
    return TN.suspect_ranks(h, TN.cross_rank_divergence(h)).select("run_id", "step", "rank", "hash")


DN = "dn AS (SELECT l_linenumber AS step, l_linestatus AS param, 'GPU-' || l_suppkey AS device_id, l_orderkey AS sample, l_extendedprice / 1000 AS norm FROM lineitem)"


@query(with_(DN) + f"SELECT step, param, {r6('median(norm)', 'median')}, {r6('greatest(max(norm) - median(norm), median(norm) - min(norm)) / median(norm)', 'divergence')} FROM dn GROUP BY 1, 2 HAVING greatest(max(norm) - median(norm), median(norm) - min(norm)) / median(norm) > 0.05")
def relative_norm_divergence(spark, d):
    return rounded(TN.relative_norm_divergence(A.device_norms(spark, d), ["step", "param"]), "median", "divergence")


@query(with_("dn2 AS (SELECT l_linenumber AS step, l_shipdate AS day, l_suppkey AS device_id, l_orderkey AS sample, l_extendedprice * l_extendedprice AS norm FROM lineitem)",
             "m AS (SELECT step, year(day) AS yr, median(norm) AS med FROM dn2 GROUP BY 1, 2 HAVING count(*) >= 2)",
             "d AS (SELECT dn2.*, m.yr, m.med, abs(norm - med) AS dv FROM dn2 JOIN m ON m.step = dn2.step AND m.yr = year(dn2.day))",
             "q AS (SELECT step, yr, median(dv) AS mad FROM d GROUP BY 1, 2)")
       + f"SELECT d.step, d.yr AS param, d.device_id, d.sample, round(d.dv / q.mad, 6) AS deviation FROM d JOIN q USING (step, yr) WHERE mad >= 1e-12 AND d.dv / q.mad > 2.0")
def mad_outliers(spark, d):
    li = A.table(spark, d, "lineitem")
    n = li.select(F.col("l_linenumber").alias("step"), F.year("l_shipdate").cast("long").alias("param"), F.col("l_suppkey").alias("device_id"),
                  F.col("l_orderkey").alias("sample"), (F.col("l_extendedprice") * F.col("l_extendedprice")).alias("norm"))
    return rounded(TN.mad_outliers(n, ["step", "param"], 2.0).select("step", "param", "device_id", "sample", "deviation"), "deviation")


def checkpoints(spark, d):
    e = A.table(spark, d, "embeddings")
    return e.select(
        F.col("label").alias("run_id"), F.col("vec_id").alias("step"),
        F.explode(F.array(
            F.struct(F.lit("w").alias("param"), F.lit(0).alias("chunk"), F.slice("embedding", 1, 32).alias("values")),
            F.struct(F.lit("w").alias("param"), F.lit(1).alias("chunk"), F.slice("embedding", 33, 32).alias("values")),
        )).alias("_c"),
    ).select("run_id", "step", "_c.*")


@query()
def checkpoint_projections(spark, d):
    p = TN.checkpoint_projections(checkpoints(spark, d), ["run_id", "step"], 64)
    return p.select("run_id", "step", "projection_hash")


@query(f"""WITH e AS (SELECT label AS run_id, vec_id AS step, list_transform(embedding, lambda x: x::DOUBLE) AS p FROM embeddings),
l AS (SELECT *, lag(p) OVER (PARTITION BY run_id ORDER BY step) AS b FROM e)
SELECT run_id, step, round(sqrt(list_sum(list_transform(list_zip(p, b), lambda z: pow(z[1] - z[2], 2)))) / sqrt(list_sum(list_transform(b, lambda x: x * x))), 6) AS score,
  sqrt(list_sum(list_transform(list_zip(p, b), lambda z: pow(z[1] - z[2], 2)))) / sqrt(list_sum(list_transform(b, lambda x: x * x))) > 1.2 AS diverged FROM l WHERE b IS NOT NULL""")
def checkpoint_drift(spark, d):
    e = A.table(spark, d, "embeddings").select(
        F.col("label").alias("run_id"), F.col("vec_id").alias("step"), F.col("embedding").cast("array<double>").alias("projection")
    )
    return rounded(TN.checkpoint_drift(e, ["run_id"], "step", time_chunk("step", 100), 1.2), "score")


@query("""WITH s AS (SELECT label AS run_id, vec_id AS step, list_transform(embedding, lambda x: x::DOUBLE) AS w, (vec_id % 13) / 10 AS rate FROM embeddings),
m AS (SELECT *, list_max(list_transform(w, lambda x: abs(x))) AS largest, list_contains(list_transform(w, lambda x: vec_id_nan AND x > 0.3), true) AS nan_g,
    list_max(list_transform(list_zip(w, lag(w) OVER (PARTITION BY run_id ORDER BY step)), lambda z: abs(z[1] - z[2]))) AS moved FROM (SELECT *, step % 11 = 0 AS vec_id_nan FROM s))
SELECT run_id, step, 'nan_gradient' AS rule, CAST(NULL AS DOUBLE) AS value FROM m WHERE nan_g UNION ALL SELECT run_id, step, 'weight_magnitude', round(largest, 6) FROM m WHERE largest > 0.35
UNION ALL SELECT run_id, step, 'weight_update', round(moved, 6) FROM m WHERE moved > 0.5 UNION ALL SELECT run_id, step, 'learning_rate', round(rate, 6) FROM m WHERE rate <= 0 OR rate >= 1""")
def training_invariants(spark, d):
    v = F.col("embedding").cast("array<double>")
    steps = A.table(spark, d, "embeddings").select(
        F.col("label").alias("run_id"), F.col("vec_id").alias("step"), v.alias("weights"), (F.col("vec_id") % 13 / 10).alias("learning_rate"),
        F.transform(v, lambda x: F.when((F.col("vec_id") % 11 == 0) & (x > 0.3), float("nan")).otherwise(x)).alias("gradients"),
    )
    found = TN.training_invariants(steps, ["run_id"], "step", F.floor(F.col("step") / 1000), TrainingLimits(max_weight=0.35, max_update=0.5))
    return rounded(found, "value")


@query()
def gradient_hashes(spark, d):
    return TN.gradient_hashes(checkpoints(spark, d), ["run_id", "step"], 64)


@query()
def shard_hashes(spark, d):
    return TN.shard_hashes(checkpoints(spark, d))


@query()
def payload_hashes(spark, d):
    return TN.payload_hashes(checkpoints(spark, d), ["run_id", "step"])


@query("SELECT label AS run_id, vec_id AS step, vec_id % 7 <> 0 AS valid FROM embeddings")
def verify_sha256(spark, d):
    c = checkpoints(spark, d)
    want = TN.payload_hashes(c, ["run_id", "step"]).withColumn(
        "sha256", F.when(F.col("step") % 7 == 0, F.lit("tampered")).otherwise(F.col("sha256"))
    )
    return TN.verify_sha256(c, ["run_id", "step"], want).select("run_id", "step", "valid")


_STATE = """e AS (SELECT vec_id // 2 AS replay, label, vec_id % 2 AS side, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
j AS (SELECT a.replay, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: pow(z[1] - z[2], 2)))) / sqrt(list_sum(list_transform(a.v, lambda x: x * x))) AS r FROM e a JOIN e b USING (replay) WHERE a.side = 0 AND b.side = 1)"""


@query(with_(_STATE) + f"SELECT replay, {r6('r', 'divergence')}, CASE WHEN r > 1.0 THEN 'confirmed_sdc' ELSE 'false_alarm' END AS verdict FROM j")
def state_divergence(spark, d):
    c = checkpoints(spark, d).withColumn("replay", F.floor(F.col("step") / 2))
    a, b = c.filter("step % 2 = 0"), c.filter("step % 2 = 1")
    return rounded(TN.state_divergence(a, b, ["replay"], 1.0).select("replay", "divergence", "verdict"), "divergence")


@query("SELECT DISTINCT 'p' || l_suppkey AS param FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT DISTINCT 'p' || l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
def common_parameters(spark, d):
    li = A.table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("param"), "l_returnflag")
    return TN.common_parameters(li.filter("l_returnflag = 'R'"), li.filter("l_returnflag = 'A'"))


SC = """sc AS (SELECT gpu_uuid, event_id, ts_us, CASE event_type WHEN 'inference_anomaly' THEN 'loss_spike' WHEN 'training_anomaly' THEN 'gradient_spike' WHEN 'invariant_violation' THEN 'cross_rank_divergence' WHEN 'ecc_error' THEN 'checkpoint_divergence' ELSE 'gradient_collapse' END AS anomaly_type,
    score, 40.0::DOUBLE AS threshold FROM evn WHERE event_type NOT LIKE 'probe_%'),
ex AS (SELECT *, CASE WHEN score > threshold THEN CASE anomaly_type WHEN 'loss_spike' THEN 0.8 WHEN 'gradient_spike' THEN 1.0 WHEN 'cross_rank_divergence' THEN 2.0 ELSE 1.5 END::DOUBLE * (score - threshold) / threshold ELSE 0 END AS e FROM sc)"""


def scores(spark, d):
    t = F.col("event_type")
    kind = (
        F.when(t == "inference_anomaly", "loss_spike").when(t == "training_anomaly", "gradient_spike")
        .when(t == "invariant_violation", "cross_rank_divergence").when(t == "ecc_error", "checkpoint_divergence")
        .otherwise("gradient_collapse")
    )
    return ev(spark, d).filter(~t.startswith("probe_")).select(
        "gpu_uuid", "event_id", "ts_us", kind.alias("anomaly_type"), "score", F.lit(40.0).alias("threshold")
    )


W3 = 3 * 86_400
AT = 1_706_400_000_000_000


@query(with_(EV, SC) + f"""SELECT gpu_uuid, event_id, ts_us, {r6('c', 'composite')}, c > 1 AS sdc_suspected FROM (SELECT *, sum(e) OVER (PARTITION BY gpu_uuid ORDER BY ts_us RANGE BETWEEN {W3}000000 PRECEDING AND CURRENT ROW) AS c FROM ex)""")
def composite_score(spark, d):
    c = TN.composite_score(scores(spark, d), ["gpu_uuid"], W3, 1.0, 4 * 86_400_000_000)
    return rounded(c.select("gpu_uuid", "event_id", "ts_us", "composite", "sdc_suspected"), "composite")


@query(with_(EV, SC) + f"""SELECT gpu_uuid, {r6('sum(e)', 'composite')}, count(*) AS window_size, sum(e) > 1 AS sdc_suspected, """
       + ", ".join(f"count(*) FILTER (score > threshold AND anomaly_type = '{t}') AS {t}" for t in TN.TYPE_WEIGHTS)
       + f" FROM ex WHERE ts_us BETWEEN {AT} - {W3}000000 AND {AT} GROUP BY 1")
def anomaly_summary(spark, d):
    return rounded(TN.anomaly_summary(scores(spark, d), ["gpu_uuid"], AT, W3), "composite")


@query(with_(EV, SC) + f"SELECT gpu_uuid, event_id, ts_us, anomaly_type FROM sc WHERE ts_us BETWEEN {AT} - {W3}000000 AND {AT} AND anomaly_type = 'gradient_collapse'")
def recent_anomalies(spark, d):
    return TN.recent_anomalies(scores(spark, d), AT, W3, "gradient_collapse").select("gpu_uuid", "event_id", "ts_us", "anomaly_type")


@query(with_(EV, SC) + "SELECT gpu_uuid, event_id, score FROM sc WHERE score > threshold")
def anomalous_only(spark, d):
    return TN.anomalous_only(scores(spark, d)).select("gpu_uuid", "event_id", "score")
