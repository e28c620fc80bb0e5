"""Beta beliefs about each device's (and each SM's) reliability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwatch.config import BeliefConfig, WindowConfig
from fleetwatch.functions.labels import tier, tier_rank
from fleetwatch.functions.special import beta_ppf
from fleetwatch.plans.chunked import running, time_chunk

ANOMALY_TYPES = ("inference_anomaly", "training_anomaly", "invariant_violation", "probe_error")
TELEMETRY_TYPES = ("thermal_spike", "power_anomaly", "ecc_error")


def _passed() -> Column:
    return F.col("event_type") == "probe_pass"


def _failed() -> Column:
    return F.col("event_type") == "probe_fail"


def _anomaly() -> Column:
    return F.col("event_type").isin(*ANOMALY_TYPES)


def reliability_score(alpha: Column, beta: Column) -> Column:
    return F.when(alpha + beta > 0, alpha / (alpha + beta)).otherwise(F.lit(0.5))


def belief_variance(alpha: Column, beta: Column) -> Column:
    s = alpha + beta
    return F.when(s > 0, alpha * beta / (s * s * (s + 1))).otherwise(F.lit(1.7976931348623157e308))


def _finish(df: DataFrame, cfg: BeliefConfig) -> DataFrame:
    a = F.lit(cfg.prior_alpha) + F.col("probe_passes")
    b = (
        F.lit(cfg.prior_beta)
        + F.col("probe_failures") * cfg.failure_weight
        + F.col("anomalies") * cfg.anomaly_weight
    )
    d = df.withColumn("alpha", a).withColumn("beta", b)
    return (
        d.withColumn("reliability", reliability_score(F.col("alpha"), F.col("beta")))
        .withColumn("variance", belief_variance(F.col("alpha"), F.col("beta")))
        .withColumn("tier", tier(F.col("reliability"), cfg))
    )


def _evidence() -> list[Column]:
    return [
        F.count_if(_passed()).alias("probe_passes"),
        F.count_if(_failed()).alias("probe_failures"),
        F.count_if(_anomaly()).alias("anomalies"),
        F.max("ts_us").alias("last_updated_us"),
    ]


def gpu_beliefs(events: DataFrame, cfg: BeliefConfig = BeliefConfig()) -> DataFrame:
    used = events.filter(~F.col("event_type").isin(*TELEMETRY_TYPES))
    return _finish(used.groupBy("gpu_uuid").agg(*_evidence()), cfg)


def sm_beliefs(events: DataFrame, cfg: BeliefConfig = BeliefConfig()) -> DataFrame:
    used = events.filter((_passed() | _failed()) & F.col("sm_id").isNotNull())
    return _finish(used.groupBy("gpu_uuid", "sm_id").agg(*_evidence()), cfg)


def credible_bounds(beliefs: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Add the lower credible bound: the Beta quantile at 1 - confidence."""
    ppf = F.pandas_udf(lambda a, b: beta_ppf(1.0 - confidence, a, b), T.DoubleType())
    return beliefs.withColumn("lower_bound", ppf("alpha", "beta"))


def dissent_events(votes: DataFrame) -> DataFrame:
    """Events (gpu_uuid, event_type, ts_us) of the devices that a canary's majority disagreed with; `votes` carry the canary's ts_us."""
    return votes.filter("outcome = 'dissent'").select(F.col("dissenter_gpu").alias("gpu_uuid"), F.lit("tmr_dissent").alias("event_type"), "ts_us")


def decayed_beliefs(
    events: DataFrame, as_of_us: int | Column, half_life_hours: float = 168.0, cfg: BeliefConfig = BeliefConfig()
) -> DataFrame:
    """Evidence halves in weight every half-life; `tmr_dissent` rows weigh more."""
    at = as_of_us if isinstance(as_of_us, Column) else F.lit(as_of_us)
    age_h = (at - F.col("ts_us")) / F.lit(3.6e9)
    w = F.pow(F.lit(0.5), age_h / half_life_hours)
    bad = (
        F.when(_failed(), cfg.failure_weight)
        .when(_anomaly(), cfg.anomaly_weight)
        .when(F.col("event_type") == "tmr_dissent", cfg.tmr_dissent_weight)
        .otherwise(0.0)
    )
    g = events.filter(F.col("ts_us") <= at).groupBy("gpu_uuid").agg(
        (F.lit(cfg.prior_alpha) + F.sum(F.when(_passed(), w).otherwise(0.0))).alias("alpha"),
        (F.lit(cfg.prior_beta) + F.sum(bad * w)).alias("beta"),
    )
    return g.withColumn("reliability", reliability_score(F.col("alpha"), F.col("beta"))).withColumn(
        "tier", tier(F.col("reliability"), cfg)
    )


def reset_beliefs(events: DataFrame, resets: DataFrame, cfg: BeliefConfig = BeliefConfig()) -> DataFrame:
    """Beliefs from the evidence after each device's last reset (gpu_uuid, ts_us)."""
    last = resets.groupBy("gpu_uuid").agg(F.max("ts_us").alias("_reset"))
    after = F.col("_reset").isNull() | (F.col("ts_us") > F.col("_reset"))
    used = events.join(last, "gpu_uuid", "left").withColumn("event_type", F.when(after, F.col("event_type")).otherwise("_reset"))
    return gpu_beliefs(used, cfg)


def belief_trajectory(
    events: DataFrame, cfg: BeliefConfig = BeliefConfig(), win: WindowConfig = WindowConfig()
) -> DataFrame:
    """Belief and tier after each event of the device."""
    cols = events.select("gpu_uuid", "event_id", "ts_us", "event_type")
    counts = running(
        cols, ["gpu_uuid"], ["ts_us", "event_id"], time_chunk("ts_us", win.chunk_us),
        {
            "probe_passes": ("sum", _passed().cast("long")),
            "probe_failures": ("sum", _failed().cast("long")),
            "anomalies": ("sum", _anomaly().cast("long")),
        },
    )
    return _finish(counts, cfg).withColumn("tier_rank", tier_rank(F.col("reliability"), cfg))
