"""Alert rules, rate limits, grouping and routing."""

from __future__ import annotations

import json
from bisect import bisect_left
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatch.config import AlertConfig, WindowConfig
from fleetwatch.functions.labels import event_key
from fleetwatch.operators.patterns import consecutive_failures, distinct_sms_in_window
from fleetwatch.plans.chunked import running, time_chunk
from fleetwatch.plans.tree import tree_scan


@dataclass(frozen=True)
class Rule:
    name: str
    condition: str
    severity: str
    channels: tuple[str, ...]
    cooldown_seconds: int
    group_by: str = "gpu_uuid"


_CHAT, _PAGE, _ALL = ("chat",), ("chat", "pager"), ("chat", "pager", "email")

# Rule names, conditions over an observation, severity, channels,
# cooldown in seconds and grouping.
RULES = (
    Rule("probe_single_failure", "kind = 'probe_result' AND result = 'FAIL'", "WARNING", _CHAT, 300),
    Rule("probe_consecutive_failures", "kind = 'probe_result' AND result = 'FAIL' AND streak >= 3", "HIGH", _PAGE, 60),
    Rule("probe_multi_sm_failure", "kind = 'probe_result' AND result = 'FAIL' AND failing_sms >= 3", "CRITICAL", _ALL, 0),
    Rule("probe_timeout", "kind = 'probe_result' AND result = 'TIMEOUT'", "WARNING", _CHAT, 600),
    Rule("inference_anomaly_warning", "kind = 'anomaly' AND source = 'INFERENCE_MONITOR' AND severity_code = 2", "WARNING", _CHAT, 600),
    Rule("inference_anomaly_high", "kind = 'anomaly' AND source = 'INFERENCE_MONITOR' AND severity_code = 3", "HIGH", _PAGE, 120),
    Rule("inference_anomaly_critical", "kind = 'anomaly' AND source = 'INFERENCE_MONITOR' AND severity_code >= 4", "CRITICAL", _ALL, 0),
    Rule("training_anomaly_gradient_spike", "kind = 'anomaly' AND anomaly_type = 'GRADIENT_NORM_SPIKE'", "HIGH", _PAGE, 120),
    Rule("training_anomaly_cross_rank", "kind = 'anomaly' AND anomaly_type = 'CROSS_RANK_DIVERGENCE'", "CRITICAL", _ALL, 0),
    Rule("training_anomaly_loss_spike", "kind = 'anomaly' AND anomaly_type = 'LOSS_SPIKE'", "HIGH", _PAGE, 300),
    Rule("invariant_violation", "kind = 'anomaly' AND anomaly_type = 'INVARIANT_VIOLATION'", "CRITICAL", _ALL, 0),
    Rule("gpu_quarantined", "kind = 'quarantine' AND action = 'quarantine'", "HIGH", _ALL, 0),
    Rule("gpu_condemned", "kind = 'quarantine' AND action = 'condemn'", "CRITICAL", _ALL, 0),
    Rule("gpu_reinstated", "kind = 'quarantine' AND action = 'reinstate'", "INFO", _CHAT, 0),
    Rule("high_confidence_correlation", "kind = 'correlation' AND confidence >= 0.8", "HIGH", _PAGE, 120),
    Rule("node_correlated_failures", "kind = 'correlation' AND pattern = 'node_correlated'", "CRITICAL", _ALL, 0, "hostname"),
    Rule("tmr_dissent", "kind = 'tmr_result' AND NOT unanimous", "HIGH", _PAGE, 120),
    Rule("gpu_thermal_throttle", "kind = 'telemetry' AND thermal_throttle", "WARNING", _CHAT, 600),
    Rule("gpu_ecc_uncorrected", "kind = 'telemetry' AND ecc_uncorrected > 0", "CRITICAL", _ALL, 0),
    Rule("gpu_retired_pages", "kind = 'telemetry' AND retired_pages > 0", "HIGH", _PAGE, 3600),
    Rule("audit_chain_broken", "kind = 'audit_verification' AND NOT valid", "CRITICAL", _ALL, 0, "cluster"),
    Rule("agent_heartbeat_lost", "kind = 'system' AND sub_type = 'heartbeat_timeout'", "HIGH", _PAGE, 300, "hostname"),
    Rule("fleet_sdc_rate_elevated", "kind = 'fleet_health' AND sdc_rate > 0.001", "HIGH", _ALL, 1800, "cluster"),
)

OBSERVATION = {
    "observation_id": "string", "kind": "string", "ts_us": "bigint", "gpu_uuid": "string", "hostname": "string",
    "cluster": "string", "result": "string", "source": "string", "severity_code": "int", "anomaly_type": "string",
    "action": "string", "confidence": "double", "pattern": "string", "unanimous": "boolean",
    "thermal_throttle": "boolean", "ecc_uncorrected": "bigint", "retired_pages": "bigint", "valid": "boolean",
    "sub_type": "string", "sdc_rate": "double", "streak": "bigint", "failing_sms": "bigint",
}


def observation(df: DataFrame, **columns: Column) -> DataFrame:
    """Project onto the observation schema; columns not given are NULL."""
    return df.select(*[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in OBSERVATION.items()])


def probe_observations(events: DataFrame, win: WindowConfig = WindowConfig(), sm_seconds: int = 600) -> DataFrame:
    """Probe failures with their streak and distinct failing SMs, and other results."""
    streaks = consecutive_failures(events, 1, win).select("event_id", "streak")
    sms = distinct_sms_in_window(events, 1, sm_seconds, win).select("event_id", "failing_sms")
    p = events.filter(F.col("event_type").startswith("probe_"))
    p = p.join(streaks, "event_id", "left").join(sms, "event_id", "left")
    c = F.col
    result = F.when(c("event_type") == "probe_fail", "FAIL").when(
        c("event_type") == "probe_error", F.when(c("severity") <= 2, "TIMEOUT").otherwise("ERROR")
    ).otherwise("PASS")
    return observation(
        p, observation_id=c("event_id"), kind=F.lit("probe_result"), ts_us=c("ts_us"), gpu_uuid=c("gpu_uuid"),
        hostname=c("hostname"), result=result, streak=c("streak"), failing_sms=c("failing_sms"), severity_code=c("severity"),
    )


def anomaly_observations(events: DataFrame) -> DataFrame:
    c = F.col
    a = events.filter(c("event_type").isin("inference_anomaly", "training_anomaly", "invariant_violation"))
    source = F.when(c("event_type") == "inference_anomaly", "INFERENCE_MONITOR").when(
        c("event_type") == "training_anomaly", "TRAINING_MONITOR").otherwise("INVARIANT_CHECKER")
    kind = F.when(c("event_type") == "invariant_violation", "INVARIANT_VIOLATION").otherwise(
        F.try_element_at(c("metadata"), F.lit("anomaly_type")))
    return observation(
        a, observation_id=c("event_id"), kind=F.lit("anomaly"), ts_us=c("ts_us"), gpu_uuid=c("gpu_uuid"),
        hostname=c("hostname"), source=source, severity_code=c("severity"), anomaly_type=kind,
    )


def quarantine_observations(transitions: DataFrame) -> DataFrame:
    c = F.col
    return observation(
        transitions, observation_id=F.concat_ws(":", c("gpu_uuid"), c("event_id"), c("action")), kind=F.lit("quarantine"),
        ts_us=c("ts_us"), gpu_uuid=c("gpu_uuid"), action=c("action"),
    )


def correlation_observations(patterns: DataFrame) -> DataFrame:
    c = F.col
    return observation(
        patterns, observation_id=F.concat_ws(":", c("event_id"), c("pattern"), c("sm_id")), kind=F.lit("correlation"),
        ts_us=c("ts_us"), gpu_uuid=c("gpu_uuid"), confidence=c("confidence"), pattern=c("pattern"),
    )


def telemetry_observations(telemetry: DataFrame) -> DataFrame:
    c = F.col
    return observation(
        telemetry, observation_id=F.concat(F.lit("t"), c("event_id")), kind=F.lit("telemetry"), ts_us=c("ts_us"),
        gpu_uuid=c("gpu_uuid"), thermal_throttle=c("throttle_active"), ecc_uncorrected=c("dram_uncorrected"),
        retired_pages=c("retired_pages"),
    )


def alert_rules(observations: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per (observation, matching rule); every rule is tested in one pass."""
    def made(r: Rule) -> Column:
        group = F.coalesce(F.col(r.group_by), F.lit("all"))
        return F.when(
            F.expr(r.condition),
            F.struct(
                F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"),
                F.array(*map(F.lit, r.channels)).alias("channels"), F.lit(r.cooldown_seconds).alias("cooldown_seconds"),
                F.concat_ws(":", F.lit(r.name), group).alias("dedup_key"),
            ),
        )

    hits = F.array_compact(F.array(*[made(r) for r in rules]))
    a = observations.select("observation_id", "ts_us", "gpu_uuid", "hostname", F.inline(hits))
    return a.withColumn("alert_id", event_key(F.col("dedup_key"), F.col("observation_id")))


class Sends:
    """What a run of one key's alerts makes of the last sent time before it.

    An alert's chain is the alerts sent from it on: the next one is the first that is a cooldown later. Chains that
    meet end alike, so the run is a short list of (time up to which the first sent alert may lie, last sent time then).
    """

    def __init__(self, steps: list[tuple[int, int]], cool: int):
        self.steps, self.cool = steps, cool

    @staticmethod
    def of(times: list[int], cool: int) -> Sends:
        """Times in order; the pointer to the next sendable alert moves with the alert, so this is one pass from the end."""
        ends, steps, j = [0] * len(times), [], len(times)
        for i in range(len(times) - 1, -1, -1):
            while j > i + 1 and times[j - 1] >= times[i] + cool:
                j -= 1
            ends[i] = times[i] if j == len(times) else ends[j]
            if not steps or steps[-1][1] != ends[i]:
                steps.append((times[i], ends[i]))
        return Sends(steps[::-1], cool)

    def after(self, last: int | None) -> int | None:
        """The last sent time after the run; None if none was ever sent."""
        k = 0 if last is None else bisect_left(self.steps, (last + self.cool,))
        return self.steps[k][1] if k < len(self.steps) else last

    def then(self, later: Sends) -> Sends:
        steps: list[tuple[int, int]] = []
        for upto, end in [(t, later.after(e)) for t, e in self.steps] + later.steps:
            if steps and steps[-1][1] == end:
                steps[-1] = upto, end
            else:
                steps.append((upto, end))
        return Sends(steps, self.cool)

    def pack(self) -> bytes:
        return json.dumps([self.steps, self.cool]).encode()

    @staticmethod
    def unpack(data: bytes) -> Sends:
        steps, cool = json.loads(data)
        return Sends([tuple(x) for x in steps], cool)


def dedup_alerts(alerts: DataFrame, chunk_us: int = 86_400_000_000) -> DataFrame:
    """Keep an alert unless one with its key was sent less than its cooldown before.

    A key's alerts share one cooldown, their rule's. The kept set depends on itself; a
    chunk of a key's alerts composes to one short map of the last sent time, so chunks are scanned as a tree.
    """
    free = alerts.filter("cooldown_seconds = 0")
    held = alerts.filter("cooldown_seconds > 0")

    def summed(rows: list[tuple]) -> bytes:
        return Sends.of([r[0] for r in rows], int(rows[0][2]) * 1_000_000).pack()

    def composed(maps: list[bytes]) -> bytes:
        return reduce(Sends.then, map(Sends.unpack, maps)).pack()

    def applied(sends: bytes, last: bytes) -> bytes:
        return json.dumps(Sends.unpack(sends).after(json.loads(last))).encode()

    def replayed(rows: list[tuple], before: bytes) -> list[tuple]:
        last, sent = json.loads(before), []
        for ts, alert, cool in rows:
            if last is None or ts - last >= cool * 1_000_000:
                last = ts
                sent.append((alert,))
        return sent

    sent = tree_scan(held, ["dedup_key"], ["ts_us", "alert_id"], ["cooldown_seconds"], time_chunk("ts_us", chunk_us), summed, composed, applied, replayed, b"null", "alert_id string")
    return held.join(sent.select("alert_id"), "alert_id", "left_semi").unionByName(free)


def cap_alerts(alerts: DataFrame, per_minute: int = AlertConfig().per_minute) -> DataFrame:
    """The first alerts of each clock minute, counted over one-second chunks."""
    m = alerts.withColumn("_minute", F.floor(F.col("ts_us") / 60_000_000))
    n = running(m, ["_minute"], ["ts_us", "alert_id"], time_chunk("ts_us", 1_000_000), {"_n": ("sum", F.lit(1))})
    return n.filter(F.col("_n") <= per_minute).drop("_minute", "_n")


def aggregate_similar(alerts: DataFrame, seconds: int = 60, session: bool = False) -> DataFrame:
    """Alerts of one rule and key within a window, as one row with their count."""
    ts = F.timestamp_micros("ts_us")
    w = F.session_window(ts, f"{seconds} seconds") if session else F.window(ts, f"{seconds} seconds")
    g = alerts.groupBy("rule", "dedup_key", w.alias("_w")).agg(
        F.count("*").alias("alerts"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")
    )
    return g.drop("_w")


def heartbeat_lost(events: DataFrame, timeout_seconds: int = 120, as_of_us: int | None = None, chunk_us: int = 86_400_000_000):
    """Moments a host fell silent: a gap longer than the timeout, or silence until now."""
    limit = timeout_seconds * 1_000_000
    e = events.select("hostname", "event_id", "ts_us")
    g = running(e, ["hostname"], ["ts_us", "event_id"], time_chunk("ts_us", chunk_us),
                {"last_us": ("max", F.col("ts_us"))}, exclusive=True)
    gaps = g.filter(F.col("ts_us") - F.col("last_us") > limit).select("hostname", "last_us", F.col("ts_us").alias("back_us"))
    if as_of_us is None:
        return gaps
    silent = e.groupBy("hostname").agg(F.max("ts_us").alias("last_us")).filter(as_of_us - F.col("last_us") > limit)
    return gaps.unionByName(silent.withColumn("back_us", F.lit(None).cast("long")))


def silent_hosts(known: DataFrame, events: DataFrame, as_of_us: int, timeout_seconds: int = 120) -> DataFrame:
    """Known hosts with no event inside the timeout."""
    recent = events.filter(F.col("ts_us").between(as_of_us - timeout_seconds * 1_000_000, as_of_us))
    return known.select("hostname").distinct().join(recent.select("hostname").distinct(), "hostname", "left_anti")


# Colours of the chat attachment per severity.
_COLORS = {"INFO": "#2196F3", "WARNING": "#FF9800", "HIGH": "#F44336", "CRITICAL": "#9C27B0"}


def route_alerts(alerts: DataFrame) -> DataFrame:
    """One row per (alert, channel) with the channel's JSON payload: chat and webhook for
    all alerts, pager for HIGH and above."""
    c = F.col
    color = F.element_at(F.create_map(*[x for kv in _COLORS.items() for x in map(F.lit, kv)]), c("severity"))
    chat = F.to_json(F.struct(F.struct(color.alias("color"), c("rule").alias("title"), F.lower("severity").alias("severity"),
                                       c("gpu_uuid"), c("hostname")).alias("attachment")))
    pager = F.to_json(F.struct(F.lit("trigger").alias("event_action"), c("dedup_key"), F.struct(
        c("rule").alias("summary"), F.lower("severity").alias("severity"), F.coalesce("hostname", F.lit("unknown")).alias("group"),
        F.struct("alert_id", "gpu_uuid").alias("custom_details")).alias("payload")))
    hook = F.to_json(F.struct("alert_id", "rule", "severity", "dedup_key", "gpu_uuid", "hostname", "ts_us"))
    row = lambda name, body: F.struct(F.lit(name).alias("channel"), body.alias("payload"))
    out = F.array_compact(F.array(row("chat", chat), row("webhook", hook),
                                  F.when(c("severity").isin("HIGH", "CRITICAL"), row("pager", pager))))
    return alerts.select("alert_id", "severity", F.inline(out))
