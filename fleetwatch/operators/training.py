"""Monitors over gradients, losses, checkpoints and ranks of training runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwatch.config import GradientConfig, LossConfig, TrainingLimits
from fleetwatch.functions import vectors as V
from fleetwatch.functions.hashing import merkle_roots
from fleetwatch.plans.chunked import running, sliding_sums
from fleetwatch.plans.cut import cut
from fleetwatch.plans.ranks import medians
from fleetwatch.plans.scan import ewma, numbered, with_row_halo


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


# --- gradients -------------------------------------------------------------------

def ew_zscore(
    values: DataFrame, keys: list[str], order_by: list[str], chunk: Column, value: str,
    cfg: GradientConfig = GradientConfig(), rows_per_chunk: int = 65_536,
) -> DataFrame:
    """z of each value against the exponentially weighted mean and variance before it.

    Two affine scans: the mean, then the variance (1-a)(v + a d^2), whose input d is the
    distance to the mean before. 0 until `warmup` values were seen; non-finite skipped.
    """
    x = values.filter(finite(F.col(value)))
    n = numbered(x, keys, order_by, chunk, "n")
    chunk = F.floor((F.col("n") - 1) / rows_per_chunk)  # by rows, so that a short series is one chunk
    m = ewma(n, keys, order_by, chunk, value, cfg.alpha, "ew_mean")
    d = F.col(value) - F.col("ew_mean_prev")
    m = m.withColumn("_d2", F.when(F.col("n") == 1, 0.0).otherwise((1 - cfg.alpha) * d * d))
    v = ewma(m, keys, order_by, chunk, "_d2", cfg.alpha, "ew_var")
    std = F.sqrt(F.greatest(F.col("ew_var_prev"), F.lit(1e-12)))
    z = F.when(F.col("n") > cfg.warmup, F.abs(d) / std).otherwise(0.0)
    return v.withColumn("z", z).drop("_d2")


def gradient_anomalies(
    norms: DataFrame, keys: list[str], order_by: list[str], chunk: Column, cfg: GradientConfig = GradientConfig()
) -> DataFrame:
    """Spikes and collapses; which one is decided against the mean after the update."""
    z = ew_zscore(norms, keys, order_by, chunk, "norm", cfg)
    kind = F.when(F.col("norm") > F.col("ew_mean"), "gradient_spike").otherwise("gradient_collapse")
    return z.filter((F.col("z") > cfg.sigma) & (F.col("n") >= cfg.warmup)).select(
        *keys, *order_by, kind.alias("anomaly_type"), F.col("z").alias("score"), "ew_mean"
    )


def grad_accumulation(norms: DataFrame, keys: list[str], order_by: list[str], chunk: Column, k: int) -> DataFrame:
    """Mean of each k consecutive norms; an unfinished last group is left out."""
    n = numbered(norms, keys, order_by, chunk, "n")
    g = n.groupBy(*keys, F.floor((F.col("n") - 1) / k).alias("step_group")).agg(
        F.avg("norm").alias("norm"), F.count("*").alias("_n")
    )
    return g.filter(F.col("_n") == k).drop("_n")


# --- losses ----------------------------------------------------------------------

def loss_nonfinite(losses: DataFrame, keys: list[str], order_by: list[str], chunk: Column) -> DataFrame:
    bad = ~finite(F.col("loss"))
    c = running(losses, keys, order_by, chunk, {"nan_count": ("sum", bad.cast("int"))})
    return c.filter(bad).select(*keys, *order_by, F.lit(float("inf")).alias("score"), "nan_count")


def _history(losses: DataFrame, keys: list[str], order_by: list[str], chunk: Column) -> DataFrame:
    """Finite losses with their step count (all rows) and position (finite rows)."""
    ok = finite(F.col("loss"))
    c = running(losses, keys, order_by, chunk,
                {"step_count": ("sum", F.lit(1)), "n": ("sum", ok.cast("int"))})
    return c.filter(ok)


def loss_plateau(
    losses: DataFrame, keys: list[str], order_by: list[str], chunk: Column,
    cfg: LossConfig = LossConfig(), rows_per_chunk: int = 65_536,
) -> DataFrame:
    """Variance of the last finite losses below tolerance while their mean is not near 0."""
    w = cfg.plateau_window
    h = with_row_halo(_history(losses, keys, order_by, chunk), "n", rows_per_chunk, w - 1)
    frame = Window.partitionBy(*keys, "_chunk").orderBy("n").rowsBetween(1 - w, 0)
    s = h.select(
        *keys, *order_by, "n", "step_count", "_own", F.avg("loss").over(frame).alias("mean_loss"),
        F.var_pop("loss").over(frame).alias("variance"),
    ).filter("_own")
    flat = (
        (F.col("n") >= w) & (F.col("variance") < cfg.plateau_tolerance)
        & (F.col("step_count") > cfg.warmup) & (F.abs("mean_loss") > 1e-3)
    )
    return s.filter(flat).select(
        *keys, *order_by, (F.lit(1.0) / F.greatest("variance", F.lit(1e-15))).alias("score"), "mean_loss", "variance"
    )


def ar_residuals(
    losses: DataFrame, keys: list[str], order_by: list[str], chunk: Column,
    cfg: LossConfig = LossConfig(), rows_per_chunk: int = 65_536,
) -> DataFrame:
    """z of each loss against an AR(p) model refitted on all losses before it.

    The fit needs only running sums of lag products (X'X, X'y and first moments), so
    there is no refit over the history: sums run per key and a batched solve per Arrow
    batch gives coefficients, residual spread and prediction.
    """
    p = cfg.order
    h = with_row_halo(_history(losses, keys, order_by, chunk), "n", rows_per_chunk, p)
    w = Window.partitionBy(*keys, "_chunk").orderBy("n")
    lagged = h.select(
        *keys, *order_by, "n", "_own", "loss", *[F.lag("loss", i + 1).over(w).alias(f"x{i}") for i in range(p)]
    ).filter("_own").drop("_own")
    full = F.col("n") > p
    x = [F.col(f"x{i}") for i in range(p)]
    y = F.col("loss")
    prods = {f"s{i}_{j}": x[i] * x[j] for i in range(p) for j in range(i, p)}
    prods |= {f"t{i}": x[i] * y for i in range(p)} | {f"m{i}": x[i] for i in range(p)} | {"yy": y * y, "my": y}
    sums = running(
        lagged, keys, ["n"], F.floor((F.col("n") - 1) / rows_per_chunk),
        {k: ("sum", F.when(full, v)) for k, v in prods.items()} | {"rows": ("sum", full.cast("int"))}, exclusive=True,
    )
    names = [*prods]

    @F.pandas_udf("predicted double, residual_std double")
    def solve(n: pd.Series, rows: pd.Series, lags: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        pred, std = np.full(len(n), np.nan), np.zeros(len(n))
        ready = ((n.to_numpy() > cfg.warmup) & (rows.fillna(0).to_numpy() > 0)).nonzero()[0]
        if len(ready):
            s = {k: sums[k].to_numpy(float)[ready] for k in names}
            cnt = rows.to_numpy(float)[ready]
            a = np.empty((len(ready), p, p))
            for i in range(p):
                for j in range(i, p):
                    a[:, i, j] = a[:, j, i] = s[f"s{i}_{j}"]
            b = np.stack([s[f"t{i}"] for i in range(p)], axis=1)
            c = np.linalg.solve(a + 1e-8 * np.eye(p), b[:, :, None])[:, :, 0]
            mean = (s["my"] - (c * np.stack([s[f"m{i}"] for i in range(p)], axis=1)).sum(1)) / cnt
            sq = (s["yy"] - 2 * (c * b).sum(1) + np.einsum("ki,kij,kj->k", c, a, c)) / cnt
            std[ready] = np.sqrt(np.maximum(sq - mean**2, 0))
            pred[ready] = (c * lags.to_numpy(float)[ready]).sum(1)
        return pd.DataFrame({"predicted": pred, "residual_std": std})

    out = sums.withColumn("_f", solve("n", "rows", F.struct(*[f"x{i}" for i in range(p)]), F.struct(*names)))
    gap = F.abs(F.col("loss") - F.col("_f.predicted")) / F.col("_f.residual_std")
    z = F.when((F.col("n") > cfg.warmup) & (F.col("_f.residual_std") >= 1e-12), gap).otherwise(0.0)
    return out.select(*keys, *order_by, "n", "loss", "_f.predicted", "_f.residual_std", z.alias("z"))


def ar_loss_spikes(losses, keys, order_by, chunk, cfg: LossConfig = LossConfig(), rows_per_chunk: int = 65_536) -> DataFrame:
    r = ar_residuals(losses, keys, order_by, chunk, cfg, rows_per_chunk)
    return r.filter(F.col("z") > cfg.sigma)


def improvement_plateau(
    losses: DataFrame, keys: list[str], order_by: list[str], chunk: Column, patience: int = 5000, min_delta: float = 1e-4
) -> DataFrame:
    """Steps at which the best loss improved by less than `min_delta` over `patience` steps."""
    h = _history(losses, keys, order_by, chunk)
    best = cut(running(h, keys, ["n"], F.floor((F.col("n") - 1) / 65_536), {"best": ("min", F.col("loss"))}))
    before = best.select(*keys, (F.col("n") + patience).alias("n"), F.col("best").alias("best_before"))
    return best.join(before, [*keys, "n"]).filter(F.col("best_before") - F.col("best") < min_delta).select(
        *keys, *order_by, "best", "best_before"
    )


# --- ranks and devices -----------------------------------------------------------

def cross_rank_divergence(hashes: DataFrame) -> DataFrame:
    """Steps whose ranks disagree: majority hash (ties: smallest), suspect count and the ranks that hold each hash.

    A step has at most as many hashes as ranks, so its distribution is a short map.
    """
    per_hash = hashes.groupBy("run_id", "step", "hash").agg(F.count("*").alias("n"))
    s = per_hash.groupBy("run_id", "step").agg(
        F.sum("n").alias("ranks"), F.count("*").alias("unique_hashes"),
        F.min(F.struct((-F.col("n")).alias("n"), "hash")).alias("_m"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("hash", "n")))).alias("distribution"),
    )
    return s.filter("unique_hashes > 1").select(
        "run_id", "step", (F.col("ranks") + F.col("_m.n")).cast("double").alias("score"), "unique_hashes",
        F.col("_m.hash").alias("majority_hash"), (-F.col("_m.n")).alias("majority_count"), "distribution",
    )


def suspect_ranks(hashes: DataFrame, diverged: DataFrame) -> DataFrame:
    d = diverged.select("run_id", "step", "majority_hash")
    return hashes.join(d, ["run_id", "step"]).filter(F.col("hash") != F.col("majority_hash")).drop("majority_hash")


def relative_norm_divergence(norms: DataFrame, keys: list[str], limit: float = 0.05) -> DataFrame:
    """Groups whose norm strays from the median by more than the limit (relative)."""
    m = medians(norms, keys, "norm", "median")
    span = norms.groupBy(*keys).agg(F.min("norm").alias("_lo"), F.max("norm").alias("_hi"))
    dev = F.greatest(F.col("_hi") - F.col("median"), F.col("median") - F.col("_lo")) / F.col("median")
    return span.join(m, keys).filter(F.col("median") > 0).select(*keys, "median", dev.alias("divergence")).filter(
        F.col("divergence") > limit
    )


def mad_outliers(norms: DataFrame, keys: list[str], limit: float = 3.0) -> DataFrame:
    """Device norms more than `limit` median absolute deviations from the median."""
    size = norms.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= 2).drop("_n")
    m = cut(medians(norms, keys, "norm", "median").join(size, keys))  # one row per group
    d = norms.join(m, keys).withColumn("_d", F.abs(F.col("norm") - F.col("median")))
    mad = medians(d, keys, "_d", "mad").filter(F.col("mad") >= 1e-12)
    return d.join(mad, keys).withColumn("deviation", F.col("_d") / F.col("mad")).filter(
        F.col("deviation") > limit
    ).drop("_d")


# --- hashes and checkpoints --------------------------------------------------------

def gradient_hashes(gradients: DataFrame, keys: list[str], dim: int = 256, seed: int = 42, tolerance: float = 1e-6) -> DataFrame:
    """Hash of the projected gradient per key from (chunk, values) rows: projections of
    chunks are summed, rounded to the tolerance and hashed. Sorted chunk numbers stand
    for the sorted parameter order."""
    p = gradients.select(*keys, V.partial_projection(dim, seed)("values", "chunk").alias("_p"))
    total = V.vector_sum(p.groupBy(*keys), "_p", "_v", dim)
    return total.select(*keys, V.sha256_of_floats(tolerance)("_v").alias("hash"))


def checkpoint_projections(params: DataFrame, keys: list[str], dim: int = 512, seed: int = 42) -> DataFrame:
    """Projection of each checkpoint from its (chunk, values) rows, and its hash."""
    p = params.select(*keys, V.partial_projection(dim, seed)("values", "chunk").alias("_p"))
    total = V.vector_sum(p.groupBy(*keys), "_p", "_v", dim)
    scale = F.lit(float(1.0 / np.sqrt(dim)))
    v = total.select(*keys, F.transform("_v", lambda x: x * scale).alias("projection"))
    return v.withColumn("projection_hash", V.sha256_of_floats()("projection"))


def shard_hashes(shards: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    keep = [c for c in shards.columns if c != "values"]
    return shards.select(*keep, V.sha256_of_floats(tolerance)("values").alias("hash"))


def payload_hashes(params: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 per checkpoint over its sorted "name:root" lines, where a parameter's root
    is the Merkle root of its chunks' hashes. Values are hashed where they are, chunks
    meet 1024 at a time, and only one short line per parameter name is gathered."""
    leaves = params.select(*keys, "param", "chunk", F.unhex(V.sha256_of_floats()("values")).alias("_h"))
    roots = merkle_roots(leaves, [*keys, "param"], "chunk", "_h")
    line = F.concat_ws(":", "param", F.lower(F.hex("merkle_root")))
    return roots.groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("_a")).select(
        *keys, F.sha2(F.array_join("_a", "\n"), 256).alias("sha256")
    )


def verify_sha256(params: DataFrame, keys: list[str], expected: DataFrame) -> DataFrame:
    e = expected.select(*keys, F.col("sha256").alias("expected"))
    return payload_hashes(params, keys).join(e, keys, "left").select(
        *keys, "sha256", F.col("sha256").eqNullSafe(F.col("expected")).alias("valid")
    )


def checkpoint_drift(
    projections: DataFrame, keys: list[str], step: str, chunk: Column, limit: float = 0.1
) -> DataFrame:
    """Relative distance of each checkpoint's projection from the one before."""
    prev = running(projections, keys, [step], chunk, {"_b": ("last", F.col("projection"))}, exclusive=True)
    d = V.relative_distance(F.col("projection"), F.col("_b"))
    return prev.filter("_b is not null").select(*keys, step, d.alias("score")).withColumn(
        "diverged", F.col("score") > limit
    )


def training_invariants(steps: DataFrame, keys: list[str], step: str, chunk: Column, limits: TrainingLimits = TrainingLimits()) -> DataFrame:
    """Rules that a training step breaks: (keys, step, rule, value), `value` being what broke it (null for NaN and infinity).

    `steps` has `weights` and `gradients` (arrays; one row per chunk of a long tensor, the chunk being among the keys) and
    `learning_rate`. An update is compared with the key's step before; elements that are null, NaN or missing on one side
    are left to the other rules, and a null array or rate breaks none. Steps of a key are distinct.
    """
    w, g, rate = F.col("weights"), F.col("gradients"), F.col("learning_rate").cast("double")
    infinite = lambda v: F.abs(v) == float("inf")
    finite = lambda a: F.filter(a, lambda v: ~F.isnan(v) & ~infinite(v))
    moved = F.array_max(finite(F.zip_with(w, "_before", lambda a, b: F.abs(a.cast("double") - b.cast("double")))))
    largest = F.array_max(F.transform(finite(w), lambda v: F.abs(v.cast("double"))))
    none = F.lit(None).cast("double")
    rule = lambda name, broken, value: F.when(broken, F.struct(F.lit(name).alias("rule"), value.alias("value")))
    broken = F.array_compact(F.array(
        rule("nan_weight", F.exists(w, F.isnan), none), rule("infinite_weight", F.exists(w, infinite), none),
        rule("nan_gradient", F.exists(g, F.isnan), none), rule("weight_magnitude", largest > limits.max_weight, largest),
        rule("weight_update", moved > limits.max_update, moved),
        rule("learning_rate", ~((rate > 0) & (rate < limits.max_learning_rate)), rate),
    ))
    before = running(steps, keys, [step], chunk, {"_before": ("last", w)}, exclusive=True)
    return before.select(*keys, step, F.inline(broken))


def state_divergence(a: DataFrame, b: DataFrame, keys: list[str], limit: float = 1e-5) -> DataFrame:
    """Largest relative distance over shared parameters of two replays of a state.

    Chunks join on (key, param, chunk); squared sums are added up per parameter, so
    parameters of any size work. Parameters whose chunk sizes differ are skipped.
    """
    ids = [*keys, "param", "chunk"]
    j = a.select(*ids, F.col("values").alias("_a")).join(b.select(*ids, F.col("values").alias("_b")), ids)
    sq = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    diff = F.zip_with("_a", "_b", lambda x, y: x.cast("double") - y.cast("double"))
    p = j.groupBy(*keys, "param").agg(
        F.sum(sq(diff)).alias("_d"), F.sum(sq(F.col("_a"))).alias("_n"),
        F.max(F.size("_a") != F.size("_b")).alias("_mismatch"),
    ).filter(~F.col("_mismatch"))
    norm = F.sqrt("_n")
    rel = F.when(norm > 1e-12, F.sqrt("_d") / norm).otherwise(F.sqrt("_d"))
    m = p.withColumn("_r", rel).groupBy(*keys).agg(F.max("_r").alias("divergence"), F.max_by("param", "_r").alias("worst_param"))
    return m.withColumn("verdict", F.when(F.col("divergence") > limit, "confirmed_sdc").otherwise("false_alarm"))


def common_parameters(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("param").intersect(b.select("param"))


# --- composite score ---------------------------------------------------------------

# Weight of each anomaly type in the composite score.
TYPE_WEIGHTS = {
    "gradient_spike": 1.0, "gradient_collapse": 1.5, "loss_spike": 0.8, "loss_plateau": 0.5, "loss_nan": 2.0,
    "cross_rank_divergence": 2.0, "checkpoint_divergence": 1.5,
}


def anomalous_only(scores: DataFrame) -> DataFrame:
    return scores.filter(F.col("score") > F.col("threshold"))


def recent_anomalies(scores: DataFrame, as_of_us: int, seconds: int = 60, kind: str | None = None) -> DataFrame:
    r = scores.filter(F.col("ts_us").between(as_of_us - seconds * 1_000_000, as_of_us))
    return r if kind is None else r.filter(F.col("anomaly_type") == kind)


def excess(scores: DataFrame) -> DataFrame:
    weight = F.coalesce(
        F.try_element_at(F.create_map(*[x for k, v in TYPE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))]), F.col("anomaly_type")),
        F.lit(1.0),
    )
    over = (F.col("score") - F.col("threshold")) / F.greatest("threshold", F.lit(1e-12))
    return scores.withColumn("_e", F.when(F.col("score") > F.col("threshold"), weight * over).otherwise(0.0))


def composite_score(
    scores: DataFrame, keys: list[str], seconds: int = 60, limit: float = 1.0, chunk_us: int = 86_400_000_000
) -> DataFrame:
    """Weighted excess over the trailing window at each score. Finite excess is summed
    exactly as decimals; an infinite one (or one past 1e17) makes the frame infinite."""
    small = F.col("_e") < 1e17
    s = sliding_sums(
        excess(scores), keys, "ts_us", seconds * 1_000_000, chunk_us,
        {"_sum": F.when(small, F.col("_e").cast("decimal(33,15)")), "_inf": (~small).cast("int")},
    )
    total = F.when(F.col("_inf") > 0, float("inf")).otherwise(F.coalesce(F.col("_sum").cast("double"), F.lit(0.0)))
    return s.withColumn("composite", total).drop("_e", "_sum", "_inf").withColumn(
        "sdc_suspected", F.col("composite") > limit
    )


def anomaly_summary(scores: DataFrame, keys: list[str], as_of_us: int, seconds: int = 60, limit: float = 1.0) -> DataFrame:
    """Composite, verdict, counts per type and window size at one moment."""
    e = excess(recent_anomalies(scores, as_of_us, seconds))
    bad = F.col("score") > F.col("threshold")
    return e.groupBy(*keys).agg(
        F.sum("_e").alias("composite"), *[F.count_if(bad & (F.col("anomaly_type") == t)).alias(t) for t in TYPE_WEIGHTS],
        F.count("*").alias("window_size"),
    ).withColumn("sdc_suspected", F.col("composite") > limit)
