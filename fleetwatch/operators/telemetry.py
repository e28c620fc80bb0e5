"""Thermal and power state, and the events derived from telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatch.config import TelemetryConfig
from fleetwatch.plans.chunked import asof, running, sliding_sums, time_chunk

DAY_US = 86_400_000_000


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(20,6)")


def thermal_state(telemetry: DataFrame, cfg: TelemetryConfig = TelemetryConfig(), chunk_us: int = DAY_US) -> DataFrame:
    """Rolling mean, running maximum and limits at each reading. The rolling sum is
    decimal: adding and removing readings leaves no rounding behind."""
    t = telemetry.select("gpu_uuid", "event_id", "ts_us", "temperature_c", "throttle_active")
    s = sliding_sums(
        t, ["gpu_uuid"], "ts_us", cfg.rolling_seconds * 1_000_000, chunk_us,
        {"_sum": _exact("temperature_c"), "_n": F.lit(1)},
    )
    m = running(s, ["gpu_uuid"], ["ts_us", "event_id"], time_chunk("ts_us", chunk_us),
                {"max_temp_c": ("max", F.col("temperature_c"))})
    c = F.col("temperature_c")
    return m.select(
        "gpu_uuid", "event_id", "ts_us", "temperature_c", "max_temp_c",
        (F.col("_sum").cast("double") / F.col("_n")).alias("avg_temp_c"),
        (c >= cfg.warn_c).alias("warning"), (c >= cfg.critical_c).alias("critical"),
        ((c >= cfg.backoff_c) | F.col("throttle_active")).alias("backoff"),
    )


def temp_rate(telemetry: DataFrame, cfg: TelemetryConfig = TelemetryConfig(), chunk_us: int = DAY_US) -> DataFrame:
    """Degrees per second against the newest reading at least `rate_seconds` older."""
    t = telemetry.select("gpu_uuid", "event_id", "ts_us", "temperature_c")
    old = t.select("gpu_uuid", "ts_us", "temperature_c")
    hit = asof(t, old, ["gpu_uuid"], "ts_us", chunk_us, "_old", lag_us=cfg.rate_seconds * 1_000_000,
               within_us=cfg.rolling_seconds * 1_000_000)
    dt = F.floor((F.col("ts_us") - F.col("_old.ts_us")) / 1000) / 1000.0
    rate = F.when(dt > 0, (F.col("temperature_c") - F.col("_old.temperature_c")) / dt).otherwise(0.0)
    return hit.select("gpu_uuid", "event_id", "ts_us", rate.alias("temp_rate"))


def power_state(telemetry: DataFrame, cfg: TelemetryConfig = TelemetryConfig(), chunk_us: int = DAY_US) -> DataFrame:
    t = telemetry.select("gpu_uuid", "event_id", "ts_us", "power_w", "power_limit_w", "power_throttle_active")
    s = sliding_sums(
        t, ["gpu_uuid"], "ts_us", cfg.rolling_seconds * 1_000_000, chunk_us,
        {"_sum": _exact("power_w"), "_n": F.lit(1)},
    )
    m = running(s, ["gpu_uuid"], ["ts_us", "event_id"], time_chunk("ts_us", chunk_us),
                {"max_power_w": ("max", F.col("power_w"))})
    limit, p = F.col("power_limit_w"), F.col("power_w")
    return m.select(
        "gpu_uuid", "event_id", "ts_us", "power_w", "max_power_w",
        (F.col("_sum").cast("double") / F.col("_n")).alias("avg_power_w"), (limit - p).alias("headroom_w"),
        F.when(limit <= 0, False).otherwise((p >= limit * cfg.power_fraction) | F.col("power_throttle_active")).alias("stressed"),
    )


def telemetry_events(telemetry: DataFrame, cfg: TelemetryConfig = TelemetryConfig(), chunk_us: int = DAY_US) -> DataFrame:
    """Thermal, power and memory-error events; a reading can give several."""
    t = running(
        telemetry, ["gpu_uuid"], ["ts_us", "event_id"], time_chunk("ts_us", chunk_us),
        {"_before": ("last", F.col("dram_corrected"))}, exclusive=True,
    )
    c, limit = F.col, F.col("power_limit_w")
    hot = (c("temperature_c") >= cfg.critical_c) | c("throttle_active")
    power = (limit > 0) & ((c("power_w") >= limit * cfg.power_fraction) | c("power_throttle_active"))
    bad = c("dram_uncorrected") > 0
    ecc = bad | (c("dram_corrected") > c("_before"))
    row = lambda kind, sev, score: F.struct(
        F.lit(kind).alias("event_type"), sev.cast("int").alias("severity"), score.cast("double").alias("score")
    )
    found = F.array_compact(
        F.array(
            F.when(hot | (c("temperature_c") >= cfg.warn_c),
                   row("thermal_spike", F.when(hot, 4).otherwise(2), c("temperature_c"))),
            F.when(power, row("power_anomaly", F.lit(2), c("power_w"))),
            F.when(ecc, row("ecc_error", F.when(bad, 4).otherwise(2), c("dram_uncorrected"))),
        )
    )
    return t.select("gpu_uuid", "event_id", "ts_us", F.inline(found))


def telemetry_asof(probes: DataFrame, telemetry: DataFrame, chunk_us: int = DAY_US) -> DataFrame:
    """Stamp each probe with the device's latest reading at or before it."""
    r = telemetry.select("gpu_uuid", "ts_us", "temperature_c", "throttle_active")
    hit = asof(probes, r, ["gpu_uuid"], "ts_us", chunk_us, "_r")
    return hit.select(
        *probes.columns, F.col("_r.ts_us").alias("reading_us"), F.col("_r.temperature_c").alias("temperature_c"),
        F.col("_r.throttle_active").alias("throttle_active"),
    )
