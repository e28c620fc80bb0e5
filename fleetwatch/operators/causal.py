"""Which environmental factors come with corruption, per device and fleet-wide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELEVATED = 0.7
LIKELIHOOD_FACTORS = ("temperature", "voltage", "power", "memory_temperature")


def _risk(sdc_hi: Column, sdc: Column, ok_hi: Column, ok: Column) -> tuple[Column, Column]:
    p1, p0 = sdc_hi / sdc, ok_hi / ok
    rr = F.when(p0 < 1e-10, F.when(sdc_hi > 0, 100.0).otherwise(0.0)).otherwise(p1 / p0)
    either_empty = (sdc == 0) | (ok == 0)
    weight = F.when(either_empty, 0.0).otherwise(F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + rr / 10.0))
    return F.when(~either_empty, rr), weight


def causal_edges(observations: DataFrame) -> DataFrame:
    """Relative risk and weight per (device, factor), and per factor (gpu_uuid NULL)."""
    hi, sdc = F.col("normalized_value") >= ELEVATED, F.col("during_sdc")
    per_gpu = observations.groupBy("gpu_uuid", "factor").agg(
        F.count_if(sdc & hi).alias("sdc_elevated"), F.count_if(sdc & ~hi).alias("sdc_normal"),
        F.count_if(~sdc & hi).alias("ok_elevated"), F.count_if(~sdc & ~hi).alias("ok_normal"),
    )
    sums = [F.sum(c).alias(c) for c in ("sdc_elevated", "sdc_normal", "ok_elevated", "ok_normal")]
    both = per_gpu.groupingSets([["gpu_uuid", "factor"], ["factor"]], "gpu_uuid", "factor").agg(*sums)
    c = F.col
    rr, w = _risk(c("sdc_elevated"), c("sdc_elevated") + c("sdc_normal"), c("ok_elevated"), c("ok_elevated") + c("ok_normal"))
    return both.withColumn("relative_risk", rr).withColumn("weight", w)


def factor_weights(current: DataFrame, edges: DataFrame) -> DataFrame:
    """Weight for each (gpu_uuid, factor): the device's own edge, else the fleet's, else 0."""
    own = edges.filter("gpu_uuid is not null").select("gpu_uuid", "factor", F.col("weight").alias("_own"))
    fleet = edges.filter("gpu_uuid is null").select("factor", F.col("weight").alias("_fleet"))
    return (
        current.join(own, ["gpu_uuid", "factor"], "left").join(fleet, "factor", "left")
        .withColumn("weight", F.coalesce("_own", "_fleet", F.lit(0.0))).drop("_own", "_fleet")
    )


def environmental_risk(current: DataFrame, edges: DataFrame) -> DataFrame:
    """Weighted mean of the current factor values, and the hot-factor likelihood."""
    w = factor_weights(current, edges)
    total = F.sum("weight")
    key = F.col("factor").isin(*LIKELIHOOD_FACTORS)
    hot = F.sum(F.when(key & (F.col("normalized_value") >= ELEVATED), F.col("weight")).otherwise(0.0))
    n = F.count_if(key)
    return w.groupBy("gpu_uuid").agg(
        F.when(total > 0, F.sum(F.col("weight") * F.col("normalized_value")) / total).otherwise(0.0).alias("risk"),
        F.when(n > 0, F.least(hot / n, F.lit(1.0))).otherwise(0.0).alias("likelihood"),
    )


def gpu_factors(edges: DataFrame) -> DataFrame:
    return edges.filter("gpu_uuid is not null").orderBy("gpu_uuid", F.desc("weight"), "factor")


def fleet_factors(edges: DataFrame) -> DataFrame:
    return edges.filter("gpu_uuid is null").drop("gpu_uuid").orderBy(F.desc("weight"), "factor")
