"""Fixed label tables and the small expressions built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetwatch.config import BeliefConfig

# Event types, probe results, anomaly sources, entry types, states,
# actions, severities and the legal state transitions.
EVENT_TYPES = [
    "probe_pass", "probe_fail", "probe_error", "inference_anomaly", "training_anomaly",
    "invariant_violation", "thermal_spike", "power_anomaly", "ecc_error",
]
PROBE_RESULTS = {1: "PASS", 2: "FAIL", 3: "ERROR", 4: "TIMEOUT"}
ANOMALY_SOURCES = {1: "inference_anomaly", 2: "training_anomaly", 3: "invariant_violation"}
ENTRY_TYPES = ["ProbeResult", "AnomalyEvent", "QuarantineAction", "ConfigChange", "TmrResult", "SystemEvent"]
SEVERITIES = {0: "UNSPECIFIED", 1: "INFO", 2: "WARNING", 3: "HIGH", 4: "CRITICAL"}
STATES = ["HEALTHY", "SUSPECT", "QUARANTINED", "DEEP_TEST", "CONDEMNED"]
TIERS = ["HEALTHY", "INCREASED_PROBING", "SUSPECT", "QUARANTINE", "CONDEMN"]
TIER_ACTIONS = {2: "mark_suspect", 3: "quarantine", 4: "condemn"}
TIER_STATES = {0: "HEALTHY", 1: "HEALTHY", 2: "SUSPECT", 3: "QUARANTINED", 4: "CONDEMNED"}
TRANSITIONS = {
    "HEALTHY|mark_suspect": "SUSPECT",
    "HEALTHY|quarantine": "QUARANTINED",
    "HEALTHY|condemn": "CONDEMNED",
    "SUSPECT|quarantine": "QUARANTINED",
    "SUSPECT|clear_suspect": "HEALTHY",
    "SUSPECT|reinstate": "HEALTHY",
    "SUSPECT|condemn": "CONDEMNED",
    "QUARANTINED|schedule_deep_test": "DEEP_TEST",
    "QUARANTINED|condemn": "CONDEMNED",
    "QUARANTINED|reinstate": "HEALTHY",
    "DEEP_TEST|reinstate": "HEALTHY",
    "DEEP_TEST|condemn": "CONDEMNED",
}


def lookup(table: dict, key: Column, default: str | None = None) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    hit = F.try_element_at(F.create_map(*pairs), key)
    return F.coalesce(hit, F.lit(default)) if default is not None else hit


def transition(state: Column, action: Column) -> Column:
    """Next state, or NULL if the action is not legal in that state."""
    return lookup(TRANSITIONS, F.concat_ws("|", state, action))


def tier_rank(score: Column, cfg: BeliefConfig = BeliefConfig()) -> Column:
    return (
        F.when(score < cfg.condemn_below, 4)
        .when(score < cfg.quarantine_below, 3)
        .when(score < cfg.suspect_below, 2)
        .when(score < cfg.increased_probing_below, 1)
        .otherwise(0)
    )


def tier(score: Column, cfg: BeliefConfig = BeliefConfig()) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TIERS]), tier_rank(score, cfg) + 1)


def entry_type_code(label: Column, one_based: bool = False) -> Column:
    base = 1 if one_based else 0
    return lookup({t: i + base for i, t in enumerate(ENTRY_TYPES)}, label)


def entry_type_label(code: Column, one_based: bool = False) -> Column:
    base = 1 if one_based else 0
    return lookup({i + base: t for i, t in enumerate(ENTRY_TYPES)}, code)


def severity_label(code: Column) -> Column:
    return lookup(SEVERITIES, code, "UNSPECIFIED")


def event_key(*parts: Column) -> Column:
    """Deterministic id of a row's content."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy_MM")


def next_month_start(ts: Column) -> Column:
    return F.add_months(F.trunc(ts.cast("date"), "month"), 1)


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def _fixed(x: Column, decimals: int) -> Column:
    """`x` with fixed decimals, rounded as the binary number it is, ties to even, as C's printf does; format_string rounds its
    shortest decimal form instead, so 1.005 would become 1.01."""
    x = x.cast("double")
    pattern = "0." + "0" * decimals if decimals else "0"
    exact = F.call_function("format_number", x, F.lit(pattern))
    return F.when(F.abs(x) < float("inf"), exact).when(x.isNotNull(), F.format_string(f"%.{decimals}f", x))


def format_percent(x: Column, decimals: int = 2) -> Column:
    return F.concat(_fixed(x * 100, decimals), F.lit("%"))


def format_quantity(x: Column, decimals: int = 2) -> Column:
    return (
        F.when(x >= 1e6, F.concat(_fixed(x / 1e6, decimals), F.lit("M")))
        .when(x >= 1e3, F.concat(_fixed(x / 1e3, decimals), F.lit("K")))
        .otherwise(_fixed(x, decimals))
    )


def format_duration(ms: Column) -> Column:
    s = F.floor(ms / 1000).cast("long")
    m, h = F.floor(s / 60), F.floor(s / 3600)
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(m < 60, F.format_string("%dm %ds", m, s % 60))
        .when(h < 24, F.format_string("%dh %dm", h, m % 60))
        .otherwise(F.format_string("%dd %dh", F.floor(h / 24), h % 24))
    )
