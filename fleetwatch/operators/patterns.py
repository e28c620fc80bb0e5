"""Failure patterns in the trailing event-time window of each event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatch.config import WindowConfig
from fleetwatch.plans.chunked import asof, distinct_in_window, running, sliding_counts, time_chunk

# Pattern name, confidence and severity.
PATTERNS = {
    "probe_and_anomaly": (0.95, 4),
    "sm_localized": (0.85, 3),
    "thermal_correlated": (0.70, 2),
    "anomaly_without_probe": (0.40, 2),
    "multi_signal": (0.90, 4),
    "power_correlated": (0.65, 2),
    "ecc_correlated": (0.80, 3),
    "node_correlated": (0.70, 3),
    "tmr_confirmed": (0.90, 4),
    "firmware_correlated": (0.70, 3),
}
SIGNALS = {
    "n_fail": "probe_fail", "n_inference": "inference_anomaly", "n_training": "training_anomaly",
    "n_invariant": "invariant_violation", "n_thermal": "thermal_spike", "n_power": "power_anomaly",
    "n_ecc": "ecc_error",
}
FAILING = ("probe_fail", "inference_anomaly", "training_anomaly")


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def window_counts(events: DataFrame, win: WindowConfig = WindowConfig()) -> DataFrame:
    """Signals of each kind in the device's trailing window, per event."""
    cols = events.select("gpu_uuid", "event_id", "ts_us", "event_type")
    return sliding_counts(
        cols, ["gpu_uuid"], "ts_us", win.window_us, win.chunk_us,
        {n: _is(t) for n, t in SIGNALS.items()}, {"fails_so_far": _is("probe_fail")},
    )


def window_events(events: DataFrame, triggers: DataFrame, win: WindowConfig = WindowConfig(), key: str = "gpu_uuid") -> DataFrame:
    """Events in the trailing window of given triggers (`key`, trigger_id, trigger_us).

    Its output is the sum of the triggers' windows. Keys are cut into window-wide buckets, so the join spreads.
    """
    b = win.window_us
    t = triggers.select(
        key, "trigger_id", "trigger_us",
        F.explode(F.sequence(F.floor((F.col("trigger_us") - b) / b), F.floor(F.col("trigger_us") / b))).alias("_b"),
    )
    e = events.withColumn("_b", F.floor(F.col("ts_us") / b))
    keep = (F.col("ts_us") <= F.col("trigger_us")) & (F.col("ts_us") >= F.col("trigger_us") - b)
    return e.join(t, [key, "_b"]).filter(keep).drop("_b")


def _conditions() -> dict[str, Column]:
    c = F.col
    anomalies = c("n_inference") + c("n_training") + c("n_invariant")
    kinds = sum(
        ((c(n) > 0).cast("int") for n in ("n_inference", "n_training", "n_invariant", "n_ecc")),
        (c("n_fail") > 0).cast("int"),
    )
    return {
        "probe_and_anomaly": (c("n_fail") > 0) & (anomalies > 0),
        "thermal_correlated": (c("n_fail") > 0) & (c("n_thermal") > 0),
        "anomaly_without_probe": (c("n_fail") == 0) & (anomalies > 0),
        "multi_signal": kinds >= 2,
        "power_correlated": (c("n_fail") > 0) & (c("n_power") > 0),
        "ecc_correlated": (c("n_ecc") > 0) & (c("n_fail") + c("n_inference") + c("n_training") > 0),
    }


def _contributing() -> dict[str, Column]:
    c = F.col
    anomalies = c("n_inference") + c("n_training") + c("n_invariant")
    return {
        "probe_and_anomaly": c("n_fail") + anomalies,
        "thermal_correlated": c("n_fail") + c("n_thermal"),
        "anomaly_without_probe": anomalies,
        "multi_signal": c("n_fail") + anomalies + c("n_ecc"),
        "power_correlated": c("n_fail") + c("n_power"),
        "ecc_correlated": c("n_ecc") + c("n_fail") + c("n_inference") + c("n_training"),
    }


def single_device_patterns(events: DataFrame, win: WindowConfig = WindowConfig()) -> DataFrame:
    """All patterns that need only counts, one row per (event, pattern)."""
    conds, sizes = _conditions(), _contributing()
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    cond,
                    F.struct(
                        F.lit(n).alias("pattern"), F.lit(PATTERNS[n][0]).alias("confidence"),
                        F.lit(PATTERNS[n][1]).alias("severity"), sizes[n].alias("contributing"),
                    ),
                )
                for n, cond in conds.items()
            ]
        )
    )
    return window_counts(events, win).select(
        "gpu_uuid", "event_id", "ts_us", "n_fail", "fails_so_far", F.inline(found)
    )


def numbered_failures(events: DataFrame, win: WindowConfig) -> DataFrame:
    """Each device's probe failures with their ordinal (1 = first)."""
    f = events.filter(_is("probe_fail")).select("gpu_uuid", "event_id", "ts_us", "sm_id")
    return running(
        f, ["gpu_uuid"], ["ts_us", "event_id"], time_chunk("ts_us", win.chunk_us), {"ordinal": ("sum", F.lit(1))}
    )


def with_first_failure_sm(patterns: DataFrame, events: DataFrame, win: WindowConfig) -> DataFrame:
    """SM of the first failure in the frame. Of `fails_so_far` failures the last
    `n_fail` are in the frame, so the first one has a known ordinal: an equi join."""
    first = numbered_failures(events, win).select("gpu_uuid", "ordinal", "sm_id")
    p = patterns.withColumn(
        "ordinal",
        F.when(F.col("pattern") == "probe_and_anomaly", F.col("fails_so_far") - F.col("n_fail") + 1),
    )
    # Other patterns have no ordinal and so no SM; the left join reads the frames once.
    return p.join(first, ["gpu_uuid", "ordinal"], "left").drop("ordinal")


def sm_localized(events: DataFrame, win: WindowConfig = WindowConfig(), min_failures: int = 2) -> DataFrame:
    """One row per (event, SM) with enough failures of that SM in the frame.

    A trigger is repeated once for each SM that failed around its time chunk, which
    the device's SM count bounds; counting then runs per (device, SM).
    """
    e = events.select("gpu_uuid", "event_id", "ts_us", "event_type", "sm_id")
    chunk = win.chunk_us
    fails = e.filter(_is("probe_fail") & F.col("sm_id").isNotNull())
    reach = F.sequence(time_chunk("ts_us", chunk), time_chunk(F.col("ts_us") + win.window_us, chunk))
    sms = (
        fails.select("gpu_uuid", "sm_id", F.explode(reach).alias("_c"))
        .groupBy("gpu_uuid", "_c", "sm_id").agg(F.count("*").alias("_n"))
        .filter(F.col("_n") >= min_failures)
        .groupBy("gpu_uuid", "_c").agg(F.collect_set("sm_id").alias("_sms"))
    )
    triggers = (
        e.withColumn("_c", time_chunk("ts_us", chunk)).join(sms, ["gpu_uuid", "_c"])
        .select("gpu_uuid", "event_id", "ts_us", F.explode("_sms").alias("sm_id"), F.lit(False).alias("_fail"))
    )
    marks = fails.select("gpu_uuid", "event_id", "ts_us", "sm_id", F.lit(True).alias("_fail"))
    n = sliding_counts(
        triggers.unionByName(marks), ["gpu_uuid", "sm_id"], "ts_us", win.window_us, chunk,
        {"contributing": F.col("_fail")},
    )
    conf, sev = PATTERNS["sm_localized"]
    return n.filter(~F.col("_fail") & (F.col("contributing") >= min_failures)).select(
        "gpu_uuid", "event_id", "ts_us", "sm_id", F.lit("sm_localized").alias("pattern"),
        F.lit(conf).alias("confidence"), F.lit(sev).alias("severity"), "contributing",
    )


def match_patterns(events: DataFrame, win: WindowConfig = WindowConfig()) -> DataFrame:
    cols = ["gpu_uuid", "event_id", "ts_us", "pattern", "confidence", "severity", "sm_id", "contributing"]
    single = with_first_failure_sm(single_device_patterns(events, win), events, win)
    return single.select(*cols).unionByName(sm_localized(events, win).select(*cols))


def recent_patterns(patterns: DataFrame) -> DataFrame:
    """Patterns of each device's latest event that matched any."""
    last = patterns.groupBy("gpu_uuid").agg(F.max(F.struct("ts_us", "event_id")).alias("_l"))
    return patterns.join(last, "gpu_uuid").filter(F.struct("ts_us", "event_id") == F.col("_l")).drop("_l")


# The event types each pattern cites as evidence.
EVIDENCE_TYPES = {
    "probe_and_anomaly": ["probe_fail", "inference_anomaly", "training_anomaly", "invariant_violation"],
    "sm_localized": ["probe_fail"],
    "thermal_correlated": ["probe_fail", "thermal_spike"],
    "anomaly_without_probe": ["inference_anomaly", "training_anomaly", "invariant_violation"],
    "multi_signal": ["probe_fail", "inference_anomaly", "training_anomaly", "invariant_violation", "ecc_error"],
    "power_correlated": ["probe_fail", "power_anomaly"],
    "ecc_correlated": ["ecc_error", "probe_fail", "inference_anomaly", "training_anomaly"],
}


def pattern_evidence(patterns: DataFrame, events: DataFrame, win: WindowConfig = WindowConfig()) -> DataFrame:
    """The events behind given pattern rows, one row per (pattern row, event)."""
    table = F.create_map(*[x for k, v in EVIDENCE_TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    sm = F.when(F.col("pattern") == "sm_localized", F.col("sm_id"))
    p = patterns.select("gpu_uuid", F.col("event_id").alias("trigger_id"), F.col("ts_us").alias("trigger_us"),
                        "pattern", sm.alias("pattern_sm"), F.element_at(table, F.col("pattern")).alias("_types"))
    signal = events.filter(F.col("event_type").isin(*SIGNALS.values()))
    trig = p.select("gpu_uuid", "trigger_id", "trigger_us").distinct()
    hit = window_events(signal, trig, win)
    out = hit.join(p.drop("trigger_us"), ["gpu_uuid", "trigger_id"]).filter(
        F.array_contains("_types", F.col("event_type"))
        & (F.col("pattern_sm").isNull() | (F.col("pattern_sm") == F.col("sm_id")))
    )
    return out.select("gpu_uuid", "trigger_id", "pattern", "pattern_sm", "event_id", "event_type", "ts_us")


def correlated_group(
    events: DataFrame, group: str, pattern: str, win: WindowConfig = WindowConfig(), min_gpus: int = 2
) -> DataFrame:
    """Events at which several devices of one host (or firmware) have failed in the window."""
    e = events.select(group, "gpu_uuid", "event_id", "ts_us", "event_type")
    n = distinct_in_window(
        e, [group], "gpu_uuid", "ts_us", "event_id", win.window_us, win.chunk_us,
        F.col("event_type").isin(*FAILING), "failing_gpus",
    )
    conf, sev = PATTERNS[pattern]
    return n.filter(F.col("failing_gpus") >= min_gpus).select(
        group, "event_id", "ts_us", F.lit(pattern).alias("pattern"), F.lit(conf).alias("confidence"),
        F.lit(sev).alias("severity"), "failing_gpus",
    )


def node_correlated(events: DataFrame, win: WindowConfig = WindowConfig(), min_gpus: int = 2) -> DataFrame:
    """Also counts all events of the host in the frame, which are its evidence (`node_evidence`).

    gpu_uuid is the device the pattern is put down to: that of the latest failure up to the event (ties: the largest event id).
    """
    hits = correlated_group(events, "hostname", "node_correlated", win, min_gpus)
    all_rows = sliding_counts(
        events.select("hostname", "event_id", "ts_us"), ["hostname"], "ts_us", win.window_us, win.chunk_us,
        {"contributing": F.lit(True)},
    )
    failing = events.filter(F.col("event_type").isin(*FAILING)).select("hostname", "gpu_uuid", "event_id", "ts_us")
    blamed = asof(hits.join(all_rows.select("event_id", "contributing"), "event_id"), failing, ["hostname"], "ts_us", win.chunk_us, "_f", tie="event_id")
    return blamed.withColumn("gpu_uuid", F.col("_f.gpu_uuid")).drop("_f")


def node_evidence(patterns: DataFrame, events: DataFrame, win: WindowConfig = WindowConfig()) -> DataFrame:
    """The events behind host patterns: one row per (pattern row, event of the host in its window)."""
    t = patterns.select("hostname", F.col("event_id").alias("trigger_id"), F.col("ts_us").alias("trigger_us"))
    hit = window_events(events.select("hostname", "gpu_uuid", "event_id", "event_type", "ts_us"), t, win, "hostname")
    return hit.select("hostname", "trigger_id", "event_id", "gpu_uuid", "event_type", "ts_us")


def firmware_correlated(events: DataFrame, gpus: DataFrame, win: WindowConfig = WindowConfig(), min_gpus: int = 3):
    e = events.join(gpus.select("gpu_uuid", "firmware_version"), "gpu_uuid")
    return correlated_group(e, "firmware_version", "firmware_correlated", win, min_gpus)


def tmr_confirmed(votes: DataFrame) -> DataFrame:
    """Dissenting device of each canary whose majority disagreed with it."""
    conf, sev = PATTERNS["tmr_confirmed"]
    return votes.filter("outcome = 'dissent'").select(
        "canary_id", F.col("dissenter_gpu").alias("gpu_uuid"), F.lit("tmr_confirmed").alias("pattern"),
        F.lit(conf).alias("confidence"), F.lit(sev).alias("severity"),
    )


def consecutive_failures(events: DataFrame, n: int = 3, win: WindowConfig = WindowConfig()) -> DataFrame:
    """Failures that end a run of at least n probe failures with no other result between."""
    probes = events.filter(F.col("event_type").startswith("probe_")).select("gpu_uuid", "event_id", "ts_us", "event_type")
    order, chunk = ["ts_us", "event_id"], time_chunk("ts_us", win.chunk_us)
    seq = running(probes, ["gpu_uuid"], order, chunk, {"seq": ("sum", F.lit(1))})
    last_ok = F.when(~_is("probe_fail"), F.col("seq"))
    run = running(seq, ["gpu_uuid"], order, chunk, {"ok": ("max", last_ok)})
    return run.withColumn("streak", F.col("seq") - F.coalesce("ok", F.lit(0))).filter(F.col("streak") >= n).select(
        "gpu_uuid", "event_id", "ts_us", "streak"
    )


def distinct_sms_in_window(events: DataFrame, n: int = 3, seconds: int = 600, win: WindowConfig = WindowConfig()):
    """Failures at which at least n different SMs of the device failed in the window."""
    f = events.filter(_is("probe_fail")).select("gpu_uuid", "event_id", "ts_us", "sm_id")
    d = distinct_in_window(f, ["gpu_uuid"], "sm_id", "ts_us", "event_id", seconds * 1_000_000, win.chunk_us,
                           F.lit(True), "failing_sms")
    return d.filter(F.col("failing_sms") >= n).select("gpu_uuid", "event_id", "ts_us", "failing_sms")
