"""Monitors over captured model outputs."""

from __future__ import annotations

import pickle
from collections import deque
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwatch.config import DistributionConfig, DivergenceConfig, EntropyConfig, EwmaConfig, SpectralConfig
from fleetwatch.functions import vectors as V
from fleetwatch.functions.special import ad_2sample, kolmogorov_sf, ks_2sample
from fleetwatch.plans.chunked import running
from fleetwatch.plans.cut import cut
from fleetwatch.plans.ranks import bucket_of, splitters
from fleetwatch.plans.scan import ewma, state_scan

STAT_NAMES = ("mean", "variance", "kurtosis", "minimum", "maximum", "entropy")


def sample_captures(captures: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Keep each request with the given probability, by a hash of its id: the same
    requests on every run, and the predicate stays below the vector work."""
    return captures.filter(F.pmod(F.xxhash64("request_id", F.lit(seed)), F.lit(1_000_000)) < int(rate * 1_000_000))


def logit_stats(captures: DataFrame) -> DataFrame:
    keep = [c for c in captures.columns if c != "logits"]
    return captures.select(*keep, V.logit_stats("logits").alias("_s")).select(*keep, "_s.*")


def stats_long(stats: DataFrame, *keys: str) -> DataFrame:
    """(keys, stat_name, value), one row per statistic."""
    pairs = F.array(*[F.struct(F.lit(n).alias("stat_name"), F.col(n).alias("value")) for n in STAT_NAMES])
    return stats.select(*keys, F.inline(pairs))


def ewma_chart(
    values: DataFrame, keys: list[str], order_by: list[str], chunk: Column, cfg: EwmaConfig = EwmaConfig()
) -> DataFrame:
    """Control chart per key over `value`: target and sigma are cumulative and include
    the current value; the smoothed value is tested against the limits."""
    x = F.col("value")
    cum = running(
        values, keys, order_by, chunk,
        {"count": ("sum", F.lit(1)), "_s": ("sum", x), "_ss": ("sum", x * x)},
    )
    e = ewma(cum, keys, order_by, chunk, "value", cfg.lam, "ewma")
    target = F.col("_s") / F.col("count")
    var = F.greatest(F.col("_ss") / F.col("count") - target * target, F.lit(1e-15))
    sigma = F.when(F.col("count") == 1, 0.0).otherwise(F.sqrt(var))
    e = e.withColumn("target", target).withColumn("sigma", sigma).drop("_s", "_ss", "ewma_prev")
    spread = F.col("sigma") * float(np.sqrt(cfg.lam / (2 - cfg.lam)))
    e = e.withColumn("ucl", F.col("target") + cfg.limit * spread).withColumn("lcl", F.col("target") - cfg.limit * spread)
    breach = (
        (F.col("count") >= cfg.burn_in) & (F.col("count") > 1) & (F.col("sigma") >= 1e-12)
        & ((F.col("ewma") > F.col("ucl")) | (F.col("ewma") < F.col("lcl")))
    )
    far = F.abs(F.col("ewma") - F.col("target")) / spread > cfg.limit * cfg.critical_factor
    severity = F.when(breach, F.when((spread > 1e-12) & far, "critical").otherwise("warning"))
    return e.withColumn("breach", breach).withColumn("severity", severity)


def entropy_monitor(
    stats: DataFrame, keys: list[str], order_by: list[str], chunk: Column,
    cfg: EntropyConfig = EntropyConfig(), chart: EwmaConfig = EwmaConfig(),
) -> DataFrame:
    """Chart breaches (warning) and hard bounds (critical, also during burn-in)."""
    c = ewma_chart(stats.select(*keys, *order_by, F.col("entropy").alias("value")), keys, order_by, chunk, chart)
    row = lambda name, sev: F.struct(F.lit(name).alias("stat_name"), F.lit(sev).alias("severity"))
    found = F.array_compact(
        F.array(
            F.when(F.col("breach"), row("entropy_ewma", "warning")),
            F.when(F.col("value") < cfg.floor, row("entropy_collapse", "critical")),
            F.when(F.col("value") > cfg.ceiling, row("entropy_explosion", "critical")),
        )
    )
    return c.select(*keys, *order_by, F.col("value").alias("entropy"), "ewma", "count", F.inline(found))


def replica_pairs(df: DataFrame, width_us: int, payload: str) -> DataFrame:
    """Each row with every earlier row of another replica for the same input less than
    `width` before it. Time buckets as wide as the window are part of the join key, so an
    input repeated all day is cut into window-sized groups."""
    cols = ["replica_id", "request_id", "ts_us", payload]
    bucket = F.floor(F.col("ts_us") / width_us)
    new = df.select("input_hash", *cols, bucket.alias("_b"))
    old = df.select(
        "input_hash", *[F.col(c).alias(f"old_{c}") for c in cols],
        F.explode(F.sequence(bucket, F.floor((F.col("ts_us") + width_us) / width_us))).alias("_b"),
    )
    dt = F.col("ts_us") - F.col("old_ts_us")
    earlier = (dt > 0) | ((dt == 0) & (F.col("old_request_id") < F.col("request_id")))
    return new.join(old, ["input_hash", "_b"]).filter(
        (F.col("replica_id") != F.col("old_replica_id")) & earlier & (dt < width_us)
    )


def cross_replica_divergence(captures: DataFrame, cfg: DivergenceConfig = DivergenceConfig()) -> DataFrame:
    """Outputs of different replicas for the same input that differ by more than the
    threshold; the later output is measured against each earlier one."""
    measure = V.jsd_logits if cfg.use_jsd else V.kl_logits
    d = replica_pairs(captures, cfg.match_window_ms * 1000, "logits").select(
        "input_hash", F.col("old_replica_id").alias("replica_a"), F.col("replica_id").alias("replica_b"),
        F.col("old_request_id").alias("request_a"), F.col("request_id").alias("request_b"),
        measure("logits", "old_logits").alias("divergence"),
    )
    return d.filter(F.col("divergence") > cfg.threshold_nats).withColumn(
        "severity", F.when(F.col("divergence") > cfg.threshold_nats * 10, "critical").otherwise("warning")
    )


# --- sketches --------------------------------------------------------------------

def tokens(captures: DataFrame, k: int = 10) -> DataFrame:
    keep = [c for c in captures.columns if c != "logits"]
    return captures.select(*keep, F.explode(V.top_tokens(F.col("logits"), k)).alias("token"))


def _cells(item: Column, width: int, depth: int) -> Column:
    return F.array(
        *[F.struct(F.lit(r).alias("row"), F.pmod(F.xxhash64(item, F.lit(r)), F.lit(width)).cast("int").alias("col")) for r in range(depth)]
    )


def count_min_sketch(items: DataFrame, item: str, keys: tuple[str, ...] = (), width: int = 2048, depth: int = 5) -> DataFrame:
    """Sketch table (keys, row, col, count). Equal items are counted before they are
    spread over the rows, and the table never exceeds width x depth rows per key."""
    counted = items.groupBy(*keys, F.col(item).alias("_i")).agg(F.count("*").alias("_n"))
    return counted.select(*keys, "_n", F.inline(_cells(F.col("_i"), width, depth))).groupBy(*keys, "row", "col").agg(
        F.sum("_n").alias("count")
    )


def merge_sketches(a: DataFrame, b: DataFrame) -> DataFrame:
    keys = [c for c in a.columns if c != "count"]
    return a.unionByName(b).groupBy(*keys).agg(F.sum("count").alias("count"))


def estimate_counts(sketch: DataFrame, items: DataFrame, item: str, width: int = 2048, depth: int = 5) -> DataFrame:
    """Estimate and share of the total for each distinct item; never below the count."""
    keys = [c for c in sketch.columns if c not in ("row", "col", "count")]
    total = sketch.filter("row = 0").groupBy(*keys).agg(F.sum("count").alias("_total"))
    asked = items.select(*keys, F.col(item)).distinct().select(*keys, item, F.inline(_cells(F.col(item), width, depth)))
    hit = asked.join(sketch, [*keys, "row", "col"], "left").groupBy(*keys, item).agg(
        F.min(F.coalesce("count", F.lit(0))).alias("estimate")
    )
    with_total = hit.join(total, keys) if keys else hit.crossJoin(total)  # one row
    return with_total.withColumn("relative", F.col("estimate") / F.col("_total")).drop("_total")


def vocab_cardinality(items: DataFrame, item: str, keys: tuple[str, ...] = (), precision: int = 14) -> DataFrame:
    """Mergeable distinct-count sketch and its estimate per key."""
    return items.groupBy(*keys).agg(F.hll_sketch_agg(item, precision).alias("sketch")).withColumn(
        "estimate", F.hll_sketch_estimate("sketch")
    )


def merge_cardinality(sketches: DataFrame) -> DataFrame:
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def frequency_shift(a: DataFrame, b: DataFrame, item: str, threshold: float = 0.05) -> DataFrame:
    """Items whose share of the two sets differs by more than the threshold."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        n = df.groupBy(item).agg(F.count("*").alias("_n"))
        t = n.agg(F.sum("_n").alias("_t"))
        return n.crossJoin(t).select(item, (F.col("_n") / F.col("_t")).alias(name))  # one row

    j = shares(a, "share_a").join(shares(b, "share_b"), item, "full")
    d = j.select(item, F.coalesce("share_a", F.lit(0.0)).alias("share_a"), F.coalesce("share_b", F.lit(0.0)).alias("share_b"))
    return d.withColumn("shift", F.abs(F.col("share_a") - F.col("share_b"))).filter(F.col("shift") > threshold)


# --- drift -----------------------------------------------------------------------

def drift_vs_reference(current: DataFrame, reference: DataFrame, keys: list[str], bins: int = 256) -> DataFrame:
    """KL(current || reference) over a histogram spanning the reference's range."""
    span = reference.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))

    def histogram(df: DataFrame, name: str) -> DataFrame:
        pos = F.floor((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
        b = F.when(F.col("_hi") > F.col("_lo"), F.greatest(F.lit(0), F.least(pos, F.lit(bins - 1)))).otherwise(0)
        n = df.join(span, keys).groupBy(*keys, b.cast("int").alias("bin")).agg(F.count("*").alias("_n"))
        w = Window.partitionBy(*keys)  # at most `bins` rows per key
        return n.select(*keys, "bin", (F.col("_n") / F.sum("_n").over(w)).alias(name))

    eps = F.lit(1e-30)
    j = histogram(current, "p").join(histogram(reference, "q"), [*keys, "bin"], "left")
    p, q = F.greatest("p", eps), F.greatest(F.coalesce("q", eps), eps)
    return j.groupBy(*keys).agg(F.sum(p * F.ln(p / q)).alias("kl"), F.count("*").alias("bins_used"))


def fleet_ks(values: DataFrame, key: str = "gpu_uuid", alpha: float = 0.001) -> DataFrame:
    """KS distance of each device's values from the whole fleet's, Bonferroni-corrected.

    Ranks come from running counts over value buckets, for the fleet and per device, so
    neither the fleet nor a device is sorted in one task. Buckets hold about equal numbers of rows. They and the
    counts are written once, as five passes read them and a sketch made anew gives other buckets.
    """
    counted = values.groupBy(key, "value").agg(F.count("*").alias("_n"))
    span = cut(values.agg(splitters(F.col("value")).alias("_cuts")))
    c = counted.crossJoin(span)  # one row
    c = counted = cut(c.select(key, "value", "_n", bucket_of(F.col("value"), F.col("_cuts")).cast("long").alias("_b")))
    fleet = running(c.groupBy("value", "_b").agg(F.sum("_n").alias("_n")), [], ["value"], F.col("_b"), {"_cf": ("sum", F.col("_n"))})
    fleet = fleet.select("value", "_cf", (F.col("_cf") - F.col("_n")).alias("_cf0"))
    own = running(c, [key], ["value"], F.col("_b"), {"_cg": ("sum", F.col("_n"))})
    own = own.select(key, "value", "_cg", (F.col("_cg") - F.col("_n")).alias("_cg0"))
    sizes = counted.groupBy(key).agg(F.sum("_n").alias("n"))
    total = sizes.agg(F.sum("n").alias("fleet_n"), F.count("*").alias("_tests"))
    j = own.join(fleet, "value").join(sizes, key).crossJoin(total)  # one row
    gap = lambda a, b: F.abs(F.col(a) / F.col("n") - F.col(b) / F.col("fleet_n"))
    d = j.groupBy(key, "n", "fleet_n", "_tests").agg(F.max(F.greatest(gap("_cg", "_cf"), gap("_cg0", "_cf0"))).alias("ks"))
    root = F.sqrt(F.col("n") * F.col("fleet_n") / (F.col("n") + F.col("fleet_n")))
    p = F.pandas_udf(lambda t: t.map(kolmogorov_sf).astype(float), T.DoubleType())
    return d.withColumn("p_value", p(F.col("ks") * root)).withColumn(
        "rejected", F.col("p_value") < F.lit(alpha) / F.col("_tests")
    ).drop("_tests")


# --- monitors with a feedback baseline ---------------------------------------------

def spectral_features(captures: DataFrame, cfg: SpectralConfig = SpectralConfig()) -> DataFrame:
    """Power spectrum and high-frequency share; vectors under 8 values are skipped."""
    keep = [c for c in captures.columns if c != "logits"]
    s = captures.filter(F.size("logits") >= 8).select(*keep, V.psd("logits").alias("psd"))
    return s.withColumn("hf_ratio", V.hf_energy_ratio(F.col("psd"), cfg.cutoff_fraction))


FOUND = "stat_name string, observed double, baseline_n int, severity string"

#: Significance levels that an index chooses from.
LEVELS = (0.15, 0.10, 0.05, 0.025, 0.01)


#: Rows that are scored at once, at least and at most.
RUN = (8, 256)


def _widened(spectra: np.ndarray, width: int) -> np.ndarray:
    return np.pad(spectra, ((0, 0), (0, width - spectra.shape[1])))


def _recent_spread(shares: np.ndarray, held: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, mean and standard deviation of the up to `size` values before each one from `held` on."""
    count = np.minimum(np.arange(held, len(shares)), size)
    views = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.zeros(size), shares)), size)[held : len(shares)]
    inside = np.arange(size) >= size - count[:, None]
    mean = (views * inside).sum(axis=1) / np.maximum(count, 1)
    return count, mean, np.sqrt((((views - mean[:, None]) * inside) ** 2).sum(axis=1) / np.maximum(count, 1))


def _recent_cosine(spectra: np.ndarray, lengths: np.ndarray, held: int, size: int) -> np.ndarray:
    """Cosine of each spectrum from `held` on with the mean of those of its length among the up to `size` before it, by running sums."""
    out, end = np.ones(len(lengths) - held), np.arange(held, len(lengths))
    for length in np.unique(lengths[held:]):
        same, at = lengths == length, end[lengths[held:] == length]
        start = np.maximum(at - size, 0)
        total = np.cumsum(np.vstack((np.zeros(length), np.where(same[:, None], spectra[:, :length], 0.0))), axis=0)
        number = np.concatenate(([0], np.cumsum(same)))
        mean = (total[at] - total[start]) / np.maximum(number[at] - number[start], 1)[:, None]
        mine = spectra[at, :length]
        a, b = np.linalg.norm(mine, axis=1), np.linalg.norm(mean, axis=1)
        there = np.minimum(a, b) > 1e-12
        out[at[there] - held] = (mine * mean).sum(axis=1)[there] / (a * b)[there]
    return out


def _off_limits(share, z, shape, cfg: SpectralConfig) -> tuple:
    """The three checks, on arrays and on columns alike."""
    return share > cfg.hf_ratio, (z > cfg.z_warning) | (z < -cfg.z_warning), shape < cfg.cosine


def _found(rows: pd.DataFrame, keep: list[str], hits: list[tuple[int, str, float, int, str]]) -> pd.DataFrame:
    """Findings (row number, name, value, baseline size, severity) with the rows' keys."""
    out = rows[keep].iloc[[h[0] for h in hits]].reset_index(drop=True)
    for k, name in enumerate(("stat_name", "observed", "baseline_n", "severity"), 1):
        out[name] = pd.Series([h[k] for h in hits], dtype={2: "float64", 3: "int32"}.get(k, "object"))
    return out


def spectral_monitor(
    features: DataFrame, keys: list[str], order_by: list[str], chunk: Column, cfg: SpectralConfig = SpectralConfig()
) -> DataFrame:
    """High-frequency share, its z-score and spectrum shape against recent clean rows.

    Rows are scored in runs as if all of a run were clean; a run is used up to its first row that isn't, and the next
    one starts behind it. The baseline holds the latest clean rows as arrays. A row with a missing or non-finite share
    or spectrum gets no finding and doesn't join it; a spectrum without one of its length there has cosine 1.
    """
    keep, size = [*keys, *order_by], cfg.baseline_window

    def step(rows: pd.DataFrame, state: bytes) -> tuple[pd.DataFrame, bytes]:
        raw = [np.asarray(p if p is not None else (), float) for p in rows["psd"]]
        share, length = rows["hf_ratio"].to_numpy(float), np.array([len(p) for p in raw], np.int64)
        sound = np.isfinite(share) & np.array([len(p) > 0 and bool(np.isfinite(p).all()) for p in raw])
        old = [np.frombuffer(x, t) for x, t in zip(pickle.loads(state), (float, np.int64, float))] if state else [np.zeros(0), np.zeros(0, np.int64), np.zeros(0)]
        shares, lengths = old[0], old[1]
        width = max(lengths.max(initial=0), length.max(initial=0))
        spectra = _widened(old[2].reshape(len(shares), lengths.max(initial=0)), width)
        z, shape, count = np.full(len(rows), np.nan), np.full(len(rows), np.nan), np.zeros(len(rows), np.int32)
        at, run = 0, RUN[0]
        while at < len(rows):
            here, held = slice(at, min(at + run, len(rows))), len(shares)
            block = np.stack([_widened(p[None], width)[0] for p in raw[here]])
            s, n, x = np.concatenate((shares, share[here])), np.concatenate((lengths, length[here])), np.concatenate((spectra, block))
            number, mean, spread = _recent_spread(s, held, size)
            ready = (number > 0) & (number >= size // 2)
            far = np.where(ready & (spread > 1e-12), (share[here] - mean) / np.maximum(spread, 1e-12), 0.0)
            alike = np.where(ready, _recent_cosine(x, n, held, size), 1.0)
            bad = np.logical_or.reduce(_off_limits(share[here], far, alike, cfg)) | ~sound[here]
            clean = int(bad.argmax()) if bad.any() else len(bad)
            used = min(clean + 1, len(bad))
            z[at : at + used], shape[at : at + used], count[at : at + used] = far[:used], alike[:used], number[:used]
            latest = slice(max(0, held + clean - size), held + clean)
            shares, lengths, spectra = s[latest], n[latest], x[latest]
            at, run = at + used, RUN[0] if bad.any() else min(2 * run, RUN[1])
        scored = rows[keep].assign(share=np.where(sound, share, np.nan), z=np.where(sound, z, np.nan), shape=np.where(sound, shape, np.nan), baseline_n=count)
        return scored, pickle.dumps((shares.tobytes(), lengths.tobytes(), spectra[:, : lengths.max(initial=0)].tobytes()), protocol=5)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in features.select(*keep).schema.fields)
    scored = state_scan(features.select(*keep, "hf_ratio", "psd"), keys, order_by, chunk, step, f"{ddl}, share double, z double, shape double, baseline_n int")
    share, z, shape = (F.nanvl(c, F.lit(None).cast("double")) for c in ("share", "z", "shape"))
    grave = F.abs(z) > cfg.z_critical
    findings = [
        F.when(bad, F.struct(F.lit(name).alias("stat_name"), value.alias("observed"), F.col("baseline_n"), F.when(worse, "critical").otherwise("warning").alias("severity")))
        for (name, value, worse), bad in zip(
            (("high_freq_ratio", share, F.lit(False)), ("high_freq_z_score", z, grave), ("psd_cosine_similarity", shape, F.lit(False))), _off_limits(share, z, shape, cfg))
    ]
    return scored.select(*keep, F.inline(F.array_compact(F.array(*findings))))


class CleanValues:
    """All values of the latest clean rows, kept sorted: a row's values are merged in and taken out, not sorted anew."""

    def __init__(self, size: int, saved: bytes):
        self.size = size
        self.rows: deque[np.ndarray] = deque(pickle.loads(saved) if saved else ())
        self.pool = np.sort(np.concatenate(self.rows)) if self.rows else np.zeros(0)

    def add(self, values: np.ndarray) -> None:
        self.rows.append(values)
        self.pool = np.insert(self.pool, np.searchsorted(self.pool, values), values)
        if len(self.rows) > self.size:
            old = self.rows.popleft()
            repeat = np.arange(len(old)) - np.searchsorted(old, old)  # equal values go one after the other
            self.pool = np.delete(self.pool, np.searchsorted(self.pool, old) + repeat)

    def save(self) -> bytes:
        return pickle.dumps(list(self.rows), protocol=5)


def distribution_monitor(
    captures: DataFrame, keys: list[str], order_by: list[str], chunk: Column, cfg: DistributionConfig = DistributionConfig()
) -> DataFrame:
    """KS and Anderson-Darling tests of each row's values against all values of the recent clean rows."""
    keep = [*keys, *order_by]
    tests = (("ks_test", ks_2sample, cfg.ks_p), ("anderson_darling", ad_2sample, LEVELS[min(cfg.ad_level_index, len(LEVELS) - 1)]))

    def step(rows: pd.DataFrame, state: bytes) -> tuple[pd.DataFrame, bytes]:
        clean, hits = CleanValues(cfg.baseline_size, state), []
        for at, raw in enumerate(rows["logits"]):
            values, n = np.sort(np.asarray(raw, float)), len(clean.rows)
            results = [(name, *test(values, clean.pool), limit) for name, test, limit in tests if n >= max(50, cfg.baseline_size // 10)]
            mine = [(at, name, float(v), n, "critical" if 10 * p < limit else "warning") for name, v, p, limit in results if p < limit]
            hits += mine
            if not mine:
                clean.add(values)
        return _found(rows, keep, hits), clean.save()

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in captures.select(*keep).schema.fields)
    return state_scan(captures.select(*keep, "logits"), keys, order_by, chunk, step, f"{ddl}, {FOUND}")


# --- fingerprints and invariants ---------------------------------------------------

def fingerprints(captures: DataFrame, seed: int = 42) -> DataFrame:
    keep = [c for c in captures.columns if c != "logits"]
    return captures.select(*keep, V.tensor_fingerprint(seed)("logits").alias("fingerprint"))


def replica_fingerprint_distance(prints: DataFrame, window_ms: int = 2000) -> DataFrame:
    """Hamming distance and estimated cosine distance between replicas' fingerprints of
    the same input within the match window (same time buckets as the divergence join)."""
    pairs = replica_pairs(prints, window_ms * 1000, "fingerprint")
    return pairs.select(
        "input_hash", F.col("old_request_id").alias("request_a"), F.col("request_id").alias("request_b"),
        V.hamming128(F.col("fingerprint"), F.col("old_fingerprint")).alias("hamming"),
    ).withColumn("cosine_distance", V.cosine_distance_estimate(F.col("hamming")))


def fingerprint_copies(prints: DataFrame, id_col: str) -> DataFrame:
    """Each capture with the smallest id that shares its fingerprint."""
    first = prints.groupBy("fingerprint").agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies"))
    return prints.join(first, "fingerprint").select(id_col, "first_id", "copies")


def _cut_bytes(places: list[int], parts: int) -> list[list[int]]:
    """Byte places dealt out to `parts` runs of about equal length."""
    edge = [len(places) * k // parts for k in range(parts + 1)]
    return [places[a:b] for a, b in zip(edge, edge[1:])]


def band_keys(fingerprint: Column, radius: int) -> Column:
    """Keys of which two 16-byte fingerprints within `radius` bits share at least one.

    Of radius + 1 bands two such fingerprints agree in one whole band; of radius + 1 parts of the other bytes they then
    agree in one part as well. Keys name a band and a part, so a value that very many fingerprints have in a band is split.
    """
    keys = []
    for k, band in enumerate(_cut_bytes(list(range(16)), radius + 1)):
        rest = [b for b in range(16) if b not in band]
        for j, part in enumerate(_cut_bytes(rest, radius + 1)):
            keys.append(F.concat(F.lit(bytes([k, j])), *[F.substring(fingerprint, b + 1, 1) for b in [*band, *part]]))
    return F.array(*keys)


def similar_fingerprints(prints: DataFrame, id_col: str, radius: int = 3) -> tuple[DataFrame, DataFrame]:
    """Near-equal fingerprints: members (id, representative, copies) and links between representatives.

    Equal fingerprints are one representative, the smallest id; links (a < b) are all pairs of
    representatives at most `radius` bits apart, from an equi join on band keys verified by the bits that differ. Copies
    are never expanded into pairs. `radius` is at most 6, so that no part is empty. NULL fingerprints and those of another length are in neither.
    """
    if not 0 <= radius <= 6:
        raise ValueError("radius must lie between 0 and 6")
    sound = prints.filter(F.octet_length("fingerprint") == 16)
    first = cut(sound.groupBy("fingerprint").agg(F.min(id_col).alias("representative"), F.count("*").alias("copies")))
    members = sound.select(id_col, "fingerprint").join(first, "fingerprint").select(id_col, "representative", "copies")
    keys, links = band_keys(F.col("fingerprint"), radius), []
    # Keys take far more room than the table they come from, so Spark must not take its size for theirs and broadcast them;
    # each band is joined by itself, so a task holds one band's keys.
    for band in range(radius + 1):
        keyed = first.select("representative", "fingerprint", F.explode(F.slice(keys, band * (radius + 1) + 1, radius + 1)).alias("_key"))
        a = keyed.select("_key", F.col("representative").alias("a"), F.col("fingerprint").alias("_fa"))
        b = keyed.select("_key", F.col("representative").alias("b"), F.col("fingerprint").alias("_fb"))
        near = a.hint("merge").join(b, "_key").filter("a < b").withColumn("hamming", V.hamming128(F.col("_fa"), F.col("_fb")))
        links.append(near.filter(F.col("hamming") <= radius).select("a", "b", "hamming"))
    return members, reduce(DataFrame.unionByName, links).distinct()


def check_invariants(captures: DataFrame, max_logit: float = 100.0, tolerance: float = 1e-4, probs: str | None = None) -> DataFrame:
    """Rows that break a numeric rule, one row per (request, rule).

    `probs` names a column of probabilities, where captures carry them: none may be negative, and they instead of the
    logits' softmax must sum to one. Null or empty probabilities break no rule.
    """
    x = F.col("logits")
    bad = lambda v: F.isnan(v) | (F.abs(v) == float("inf"))
    broken = F.exists(x, bad)
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda s, v: s + v)
    if probs is None:
        off = broken | (F.abs(V.let(V.softmax(x), total) - 1.0) > tolerance)
        negative = F.lit(False)
    else:
        p = F.col(probs).cast("array<double>")
        off = (F.size(p) > 0) & (F.exists(p, bad) | (F.abs(total(p) - 1.0) > tolerance))
        negative = F.exists(p, lambda v: v < 0)
    rules = F.array_compact(
        F.array(
            F.when(broken, F.lit("non_finite")),
            F.when(F.exists(x, lambda v: F.abs(v) > max_logit), F.lit("logit_magnitude")),
            F.when(off, F.lit("softmax_sum")),
            F.when(negative, F.lit("negative_probability")),
        )
    )
    return captures.select("request_id", F.explode(rules).alias("rule"))
