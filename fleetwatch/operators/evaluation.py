"""Golden comparisons, detection scoring and latency percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.functions.hashing import differing_bits, float_bits, ulp_distance
from fleetwatch.plans.chunked import asof, running
from fleetwatch.plans.ranks import order_statistics

# Allowed distance in units in the last place; other probes are exact.
ULP_TOLERANCE = {"TRANSCENDENTAL": 1, "TRANSCENDENTAL_FP16": 2, "TRANSCENDENTAL_BF16": 2}


def golden_compare(actual: DataFrame, golden: DataFrame, on: tuple[str, ...] | list[str] = ("probe_type", "index")) -> DataFrame:
    """Each result against its golden value: bit-exact, or within the probe's ULPs."""
    j = actual.join(golden, list(on))
    tol = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in ULP_TOLERANCE.items() for x in kv]), F.col("probe_type")), F.lit(0)
    )
    a, e = F.col("actual_result"), F.col("expected_result")
    j = j.withColumn("actual_bits", float_bits(a)).withColumn("expected_bits", float_bits(e)).withColumn("ulps", ulp_distance(a, e))
    ok = F.when(tol > 0, F.coalesce(F.col("ulps") <= tol, F.lit(False))).otherwise(F.col("actual_bits") == F.col("expected_bits"))
    bits = differing_bits(F.col("actual_bits"), F.col("expected_bits"))
    return j.withColumn("ok", ok).withColumn("differing_bits", F.when(~ok, bits))


def mismatch_details(compared: DataFrame, run: list[str], limit: int = 64, cell: int = 4096) -> DataFrame:
    """The first mismatches of each run by index, as a probe report lists them.

    Numbering runs over cells of the index, so a run with many mismatches is not sorted
    in one task.
    """
    bad = compared.filter(~F.col("ok"))
    n = running(bad, run, ["index", "line"], F.floor(F.col("index") / cell), {"_n": ("sum", F.lit(1))})
    return n.filter(F.col("_n") <= limit).drop("_n")


def golden_report(compared: DataFrame, category: str = "probe_type") -> DataFrame:
    g = compared.groupBy(category).agg(F.count("*").alias("total"), F.count_if("ok").alias("passed"))
    return g.withColumn("failed", F.col("total") - F.col("passed")).withColumn("ok", F.col("failed") == 0)


def score_detections(injections: DataFrame, detections: DataFrame, chunk_us: int = 86_400_000_000) -> DataFrame:
    """Earliest detection on the injected device from the expected layer, at or after the
    injection, and whether it met the time budget.

    The earliest at-or-after row is an as-of join over reversed time, so the work is
    linear in both tables, however many of either a device has.
    """
    back = -F.col("_us")
    i = injections.select("scenario", "gpu_index", "expected_layer", "expected_time_s", F.col("injected_us").alias("_us"))
    i = i.withColumn("_back", back)
    d = detections.select("gpu_index", F.col("layer").alias("expected_layer"), F.col("ts_us").alias("_us"), "confidence").withColumn("_back", back)
    any_layer = asof(i, d.select("gpu_index", "_back"), ["gpu_index"], "_back", chunk_us, "_seen")
    hit = asof(any_layer, d.select("gpu_index", "expected_layer", "_back", "confidence"), ["gpu_index", "expected_layer"], "_back",
               chunk_us, "_match", tie="confidence")
    latency = (-F.col("_match._back") - F.col("_us")) / 1e6
    r = hit.select(
        "scenario", "gpu_index", F.col("_us").alias("injected_us"), "expected_layer", "expected_time_s",
        F.col("_seen").isNotNull().alias("detected"), latency.alias("latency_s"), F.col("_match.confidence").alias("confidence"),
        F.col("_match").isNotNull().alias("layer_match"),
    )
    r = r.withColumn("within_budget", F.coalesce(F.col("latency_s") <= F.col("expected_time_s"), F.lit(False)))
    return r.withColumn("passed", F.col("detected") & F.col("layer_match") & F.col("within_budget"))


def detection_report(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def latency_percentiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """p50, p95, p99 as the sorted list's element floor(n q), and the mean."""
    n = F.col("n")
    at = {f"p{int(q * 100)}": F.floor(n * F.lit(q)) for q in (0.50, 0.95, 0.99)}
    p = order_statistics(df, keys, value, at)
    return p.join(df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n")), keys)
