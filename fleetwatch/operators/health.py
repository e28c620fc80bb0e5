"""Device and fleet health views, cohorts, filters and listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwatch.config import WindowConfig
from fleetwatch.functions.labels import EVENT_TYPES, rfc3339
from fleetwatch.plans.chunked import running, sliding_counts, time_chunk

ANOMALIES = ("inference_anomaly", "training_anomaly", "invariant_violation")


def _kind(*names: str) -> Column:
    return F.col("event_type").isin(*names)


# --- views -----------------------------------------------------------------------

def enrich_identity(df: DataFrame, gpus: DataFrame) -> DataFrame:
    """Add identity columns. The dimension has one row per device; Spark broadcasts it
    when its measured size is under the session's threshold and shuffles it otherwise."""
    extra = [c for c in gpus.columns if c == "gpu_uuid" or c not in df.columns]
    return df.join(gpus.select(*extra), "gpu_uuid", "left")


def rolling_rates(events: DataFrame, win: WindowConfig) -> DataFrame:
    """Failures and anomalies per hour in the trailing window, at each event."""
    hours = win.window_seconds / 3600.0
    n = sliding_counts(
        events.select("gpu_uuid", "event_id", "ts_us", "event_type"), ["gpu_uuid"], "ts_us",
        win.window_us, win.chunk_us, {"_f": _kind("probe_fail"), "_a": _kind(*ANOMALIES)},
    )
    per_hour = lambda c: F.col(c) / hours if hours else F.lit(0.0)
    return n.select("gpu_uuid", "event_id", "ts_us", per_hour("_f").alias("failures_per_hour"),
                    per_hour("_a").alias("anomalies_per_hour"))


def rates_as_of(events: DataFrame, as_of_us: int, window_seconds: int) -> DataFrame:
    """The rates at one moment: a filtered count per device, no window needed."""
    hours = window_seconds / 3600.0
    recent = F.col("ts_us").between(as_of_us - window_seconds * 1_000_000, as_of_us)
    return events.filter(recent).groupBy("gpu_uuid").agg(
        (F.count_if(_kind("probe_fail")) / hours).alias("failures_per_hour"),
        (F.count_if(_kind(*ANOMALIES)) / hours).alias("anomalies_per_hour"),
    )


def last_seen(events: DataFrame) -> DataFrame:
    return events.groupBy("gpu_uuid").agg(
        F.max(F.when(F.col("event_type").startswith("probe_"), F.col("ts_us"))).alias("last_probe_us"),
        F.max(F.when(_kind(*ANOMALIES), F.col("ts_us"))).alias("last_anomaly_us"),
    )


def health_view(
    gpus: DataFrame, beliefs: DataFrame, states: DataFrame, rates: DataFrame, seen: DataFrame,
    telemetry: DataFrame, sm: DataFrame,
) -> DataFrame:
    """One row per device. Every input is aggregated to the device first, so all joins
    are device-sized; the SM array is bounded by the device's SM count."""
    last_t = telemetry.groupBy("gpu_uuid").agg(F.max_by(F.struct("temperature_c", "power_w"), "ts_us").alias("_t"))
    sms = sm.groupBy("gpu_uuid").agg(
        F.array_sort(F.collect_list(F.struct("sm_id", "reliability", "tier"))).alias("sms")
    )
    return (
        gpus.join(beliefs.select("gpu_uuid", "alpha", "beta", "reliability", "tier"), "gpu_uuid", "left")
        .join(states, "gpu_uuid", "left").join(rates, "gpu_uuid", "left").join(seen, "gpu_uuid", "left")
        .join(last_t, "gpu_uuid", "left").join(sms, "gpu_uuid", "left")
        .withColumn("state", F.coalesce("state", F.lit("HEALTHY")))
        .withColumn("failures_per_hour", F.coalesce("failures_per_hour", F.lit(0.0)))
        .withColumn("anomalies_per_hour", F.coalesce("anomalies_per_hour", F.lit(0.0)))
        .withColumn("temperature_c", F.col("_t.temperature_c")).withColumn("power_w", F.col("_t.power_w")).drop("_t")
    )


def gpu_history(
    gpu: str, start_us: int, end_us: int, transitions: DataFrame, patterns: DataFrame, trajectory: DataFrame
) -> dict[str, DataFrame]:
    """Transitions, correlations and reliability samples of one device in a time range."""
    inside = (F.col("gpu_uuid") == gpu) & F.col("ts_us").between(start_us, end_us)
    return {
        "transitions": transitions.filter(inside),
        "correlations": patterns.filter(inside),
        "reliability": trajectory.filter(inside).select("ts_us", "alpha", "beta", "reliability"),
    }


# --- aggregates ------------------------------------------------------------------

def fleet_health(health: DataFrame) -> DataFrame:
    state = lambda s: F.count_if(F.col("state") == s)
    return health.agg(
        F.count("*").alias("total"), state("HEALTHY").alias("healthy"), state("SUSPECT").alias("suspect"),
        state("QUARANTINED").alias("quarantined"), state("DEEP_TEST").alias("deep_test"),
        state("CONDEMNED").alias("condemned"),
        F.coalesce(F.avg("reliability"), F.lit(1.0)).alias("mean_reliability"),
    )


def fleet_summary(health: DataFrame) -> DataFrame:
    return health.agg(
        F.count("*").alias("total"),
        F.coalesce(F.avg("reliability"), F.lit(1.0)).alias("mean_reliability"),
        F.least(F.coalesce(F.min("reliability"), F.lit(1.0)), F.lit(1.0)).alias("min_reliability"),
        F.coalesce(F.avg("failures_per_hour"), F.lit(0.0)).alias("sdc_rate"),
        F.countDistinct("hostname").alias("active_agents"),
    )


def cohorts(health: DataFrame, by: tuple[str, ...] = ("model", "firmware_version", "hostname")) -> DataFrame:
    """Cohorts by each attribute in one pass: (attribute, cohort, count, ...)."""
    g = health.groupingSets([[c] for c in by], *by).agg(
        F.grouping_id(*by).alias("_g"), F.count("*").alias("gpus"),
        F.avg("reliability").alias("mean_reliability"), F.count_if(F.col("state") != "HEALTHY").alias("unhealthy"),
        F.avg("failures_per_hour").alias("mean_failure_rate"),
    )
    full = (1 << len(by)) - 1
    name = reduce(
        lambda acc, ic: acc.when(F.col("_g") == full - (1 << (len(by) - 1 - ic[0])), ic[1]),
        list(enumerate(by))[1:], F.when(F.col("_g") == full - (1 << (len(by) - 1)), by[0]),
    )
    return g.select(name.alias("attribute"), F.coalesce(*by).alias("cohort"), "gpus", "mean_reliability",
                    "unhealthy", "mean_failure_rate")


def event_type_counts(events: DataFrame) -> DataFrame:
    """Counts of each type per device, one column per type."""
    return events.groupBy("gpu_uuid").agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in EVENT_TYPES])


def asset_inventory(df: DataFrame, ts: str = "ts_us") -> DataFrame:
    return df.filter("gpu_uuid is not null").groupBy("gpu_uuid").agg(
        F.min(ts).alias("first_seen_us"), F.max(ts).alias("last_seen_us"), F.count("*").alias("events")
    )


def failure_rate_series(events: DataFrame, minutes: int = 30) -> DataFrame:
    """Per time bin: probes, share that failed, share that was corrupted or anomalous."""
    width = minutes * 60_000_000
    probes, fails = F.count_if(F.col("event_type").startswith("probe_")), F.count_if(_kind("probe_fail"))
    anomalies = F.count_if(_kind(*ANOMALIES))
    return events.groupBy((F.floor(F.col("ts_us") / width) * width).alias("bin_us")).agg(
        probes.alias("probes"),
        F.when(probes > 0, fails / probes).otherwise(0.0).alias("failure_rate"),
        F.when(probes > 0, (fails + anomalies) / probes).otherwise(0.0).alias("sdc_rate"),
    )


def activity_24h(events: DataFrame, as_of_us: int) -> DataFrame:
    day = F.col("ts_us").between(as_of_us - 86_400_000_000, as_of_us)
    return events.filter(day).agg(
        F.count_if(F.col("event_type").startswith("probe_")).alias("total_probes_24h"),
        F.count_if(_kind(*ANOMALIES)).alias("anomalies_24h"),
    )


def ingest_counters(events: DataFrame, patterns: DataFrame, transitions: DataFrame) -> DataFrame:
    """(counter, label, value) over events by type, patterns by kind, actions by kind."""
    one = lambda df, name, col: df.groupBy(F.col(col).alias("label")).agg(F.count("*").alias("value")).select(
        F.lit(name).alias("counter"), "label", "value"
    )
    return (
        one(events, "events", "event_type").unionByName(one(patterns, "patterns", "pattern"))
        .unionByName(one(transitions, "actions", "action"))
    )


# --- filters and listings --------------------------------------------------------

def query_events(events: DataFrame, gpu: str | None, start_us: int, end_us: int, limit: int) -> DataFrame:
    """Inclusive at both ends, first `limit` in arrival order. Stored events are read by their `date` folders."""
    hit = F.col("ts_us").between(start_us, end_us)
    if "date" in events.columns:
        hit &= F.col("date").cast("date").between(*[F.to_date(F.timestamp_micros(F.lit(x))) for x in (start_us, end_us)])
    if gpu is not None:
        hit &= F.col("gpu_uuid") == gpu
    return events.filter(hit).orderBy("ts_us", "event_id").limit(limit)


def events_of_type(events: DataFrame, kind: str) -> DataFrame:
    return events.filter(F.col("event_type") == kind)


def events_on_host(events: DataFrame, host: str) -> DataFrame:
    return events.filter(F.col("hostname") == host)


def filter_fleet(
    health: DataFrame, hostname_prefix: str | None = None, model: str | None = None,
    states: tuple[str, ...] | None = None, limit: int | None = None,
) -> DataFrame:
    """Matching devices; each row also carries how many matched and whether more exist."""
    q = health
    if hostname_prefix:
        q = q.filter(F.col("hostname").startswith(hostname_prefix))
    if model:
        q = q.filter(F.col("model") == model)
    if states:
        q = q.filter(F.col("state").isin(*states))
    total = q.agg(F.count("*").alias("total_matching"))
    page = q.orderBy("gpu_uuid").limit(limit) if limit else q
    out = page.crossJoin(F.broadcast(total))  # one row
    return out.withColumn("truncated", F.lit(False) if limit is None else F.col("total_matching") > limit)


def text_search(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c)), F.lit(text.lower())) for c in columns])
    return df.filter(hit)


def available_gpus(states: DataFrame) -> DataFrame:
    return states.filter("state = 'HEALTHY'").select("gpu_uuid")


def severity_band(events: DataFrame, low: int, high: int) -> DataFrame:
    return events.filter(F.col("severity").between(low, high))


def event_summary(events: DataFrame) -> DataFrame:
    return events.select("event_id", "event_type", rfc3339(F.col("ts")).alias("timestamp"), "severity", "score")


def worst_gpus(health: DataFrame, n: int) -> DataFrame:
    return health.orderBy("reliability", "gpu_uuid").limit(n)


def rank_worst(health: DataFrame, n: int) -> DataFrame:
    """Ranks of the n worst; the window sees those n rows only."""
    w = Window.orderBy("reliability")
    return worst_gpus(health, n).select(
        "gpu_uuid", "reliability", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense_rank")
    )


def ring_buffer(events: DataFrame, n: int, win: WindowConfig = WindowConfig()) -> DataFrame:
    """Last n events per device. Counting from the newest is a running sum over
    reversed time, so a device's history is still cut into chunks."""
    back = events.withColumn("_back", -F.col("ts_us"))
    counted = running(back, ["gpu_uuid"], ["_back", "event_id"], time_chunk("_back", win.chunk_us), {"_n": ("sum", F.lit(1))})
    return counted.filter(F.col("_n") <= n).drop("_back", "_n")


def page(df: DataFrame, key: str, after: int | None, limit: int) -> DataFrame:
    """Keyset pagination: rows after the last key seen."""
    q = df if after is None else df.filter(F.col(key) > after)
    return q.orderBy(key).limit(limit)


def page_with_total(df: DataFrame, key: str, after: int | None, limit: int) -> DataFrame:
    """A page whose rows also tell how many rows there are in all."""
    return page(df, key, after, limit).crossJoin(df.agg(F.count("*").alias("total_count")))  # one row


def sort_by(df: DataFrame, field: str, descending: bool = False, tie: str = "gpu_uuid") -> DataFrame:
    c = F.col(field)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), tie)


def all_recent_events(events: DataFrame, as_of_us: int, win: WindowConfig = WindowConfig()) -> DataFrame:
    return events.filter(F.col("ts_us").between(as_of_us - win.window_us, as_of_us)).orderBy("ts_us", "event_id")


def active_gpus(events: DataFrame) -> DataFrame:
    return events.select("gpu_uuid").distinct()
