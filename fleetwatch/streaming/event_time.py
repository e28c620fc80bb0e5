"""Keyed streams in the order of event time, with late rows listed and state that can be carried elsewhere.

A key's rows are held until the watermark has passed them and are then folded in order of time, all that are
ready at once as columns. So a result depends on the rows alone, not on the files or
micro-batches they came in. A row that comes after the watermark has passed its time can't be folded any more: it
is put out as it is, marked late. A timer on event time wakes a key that gets no more rows; when
what it holds can't matter any more, the key is forgotten.

Keys are hashed into groups, and all state of a group is one record (held rows, folded states, next timer). A
snapshot of it is a table of (key, record); a new query starts from such a table by `initialState`.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetwatch.config import BeliefConfig, EwmaConfig, GradientConfig, LossConfig
from fleetwatch.functions.labels import TRANSITIONS
from fleetwatch.operators.patterns import PATTERNS, SIGNALS
from fleetwatch.operators.quarantine import ESCALATIONS

RECORD = "waiting binary, folded binary, next_ms bigint, seen_ms bigint"
#: Groups into which the keys of a stream are hashed. A checkpoint belongs to one number of groups, a snapshot to none.
GROUPS = 1024


def pack(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes | None) -> pa.Table | None:
    return pa.ipc.open_stream(data).read_all() if data else None


def _joined(*tables: pa.Table | None) -> pa.Table | None:
    some = [t for t in tables if t is not None and t.num_rows]
    return pa.concat_tables(some) if some else None


def _codes(keys: pd.Series) -> np.ndarray:
    """A number for each different key, null among them."""
    return pd.factorize(keys, use_na_sentinel=False)[0]


class InOrder(StatefulProcessor):
    """Holds rows until the watermark passes them. Subclasses fold a key's ready rows, sorted by time.

    A state record holds the keys of one hash group, so the calls and timers of a micro-batch grow with the groups, not the keys.
    """

    #: Order of rows besides ts_us.
    ties: list[str] = []
    #: Result columns after the key, with their pandas types; `late` follows.
    columns: dict[str, str] = {}
    #: Columns of an input row that a late row keeps.
    late_columns: list[str] = []
    key_name = "gpu_uuid"
    #: Rows folded at once.
    piece = 200_000
    #: Columns of the input rows, set by `run_in_order`.
    row_schema: pa.Schema | None = None

    def __init__(self, floor_ms: int = 0):
        #: Rows before this were put out by the query that the initial state comes from.
        self.floor_ms = floor_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", RECORD)

    # what a subclass says ------------------------------------------------------

    def fold(self, state: bytes | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, bytes | None]:
        """Result rows (without the key) of one key's ready rows, and its state after them."""
        raise NotImplementedError

    def fold_all(self, folded: pa.Table | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, pa.Table | None]:
        """Result rows of ready rows, sorted by key and time, and the states after them: a table with the key's column."""
        states = {} if folded is None else dict(zip(folded[self.key_name].to_pylist(), folded["state"].to_pylist()))
        ends = [*(np.flatnonzero(np.diff(_codes(rows[self.key_name]))) + 1).tolist(), len(rows)]
        parts, start = [], 0
        for end in ends:
            key = rows[self.key_name].iat[start]
            out, states[key] = self.fold(states.get(key), rows.iloc[start:end])
            if len(out):
                parts.append(out.assign(**{self.key_name: key}))
            start = end
        keys = pa.array(list(states), pa.string())
        after = pa.table({self.key_name: keys, "state": pa.array(list(states.values()), pa.binary())})
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(), after

    def forget(self, folded: pa.Table, now: int) -> tuple[pa.Table | None, int | None]:
        """What of the states can matter to rows from `now` on, and when that ends (milliseconds), or None for never."""
        return folded, None

    # ---------------------------------------------------------------------------

    def _load(self) -> tuple[pa.Table | None, pa.Table | None, int | None]:
        if not self.record.exists():
            return None, None, None
        waiting, folded, next_ms, _ = self.record.get()
        return unpack(bytes(waiting)) if waiting else None, unpack(bytes(folded)) if folded else None, next_ms

    def _save(self, waiting: pa.Table | None, folded: pa.Table | None, next_ms: int | None, now: int) -> None:
        """Keep the record with a timer for its next row, or for its end."""
        first = None if waiting is None else pc.min(waiting["ts_us"]).as_py() // 1000
        due = None
        if folded is not None:
            # Rows that the watermark has passed may still wait for their timer.
            folded, due = self.forget(folded, now if first is None else min(first, now))
        due = due if first is None else first
        if waiting is None and folded is None:
            self.record.clear()
            return
        if due is not None and (next_ms is None or due < next_ms or next_ms < now):
            if next_ms is not None and next_ms > now:
                self.handle.deleteTimer(next_ms)
            next_ms = max(due, now) + 1
            self.handle.registerTimer(next_ms)
        self.record.update((None if waiting is None else pack(waiting), None if folded is None else pack(folded), next_ms, now))

    def _out(self, rows: pd.DataFrame, late: bool) -> Iterator[pd.DataFrame]:
        if len(rows):
            none = pd.Series([None] * len(rows), index=rows.index, dtype=object)
            out = {name: rows.get(name, none).astype(kind) for name, kind in {self.key_name: "object", **self.columns}.items()}
            yield pd.DataFrame(out).assign(late=late)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        fresh = []
        for came in rows:
            ready = came["ts_us"] // 1000 >= max(now, self.floor_ms)
            if ready.any():
                fresh.append(pa.Table.from_pandas(came[ready], self.row_schema, preserve_index=False))
            yield from self._out(came.loc[~ready, [self.key_name, *self.late_columns]], True)
        if fresh:
            waiting, folded, next_ms = self._load()
            self._save(_joined(waiting, *fresh), folded, next_ms, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting, folded, _ = self._load()
        if waiting is not None:
            passed = pc.less(waiting["ts_us"], now * 1000)
            rows = waiting.filter(passed).combine_chunks()
            waiting = _joined(waiting.filter(pc.invert(passed)))
            rows = rows.sort_by([(c, "ascending") for c in (self.key_name, "ts_us", *self.ties)])
            for at in range(0, rows.num_rows, self.piece):
                out, folded = self.fold_all(folded, rows.slice(at, self.piece).to_pandas())
                yield from self._out(out, False)
        self._save(waiting, _joined(folded), None, now)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        waiting, folded, next_ms = self._load()
        first = {c: [unpack(bytes(x)) for x in initialState[c] if x is not None] for c in ("waiting", "folded")}
        now = int(timerValues.getCurrentWatermarkInMs())
        self._save(_joined(waiting, *first["waiting"]), _joined(folded, *first["folded"]), next_ms, now)

    def close(self) -> None:
        pass


def run_in_order(rows: DataFrame, key: str, processor: InOrder, schema: str, late: str, initial: DataFrame | None = None, groups: int = GROUPS) -> DataFrame:
    """`rows` (key, ts_us, ...) through a processor; the watermark trails the latest time by `late`.

    The watermark's own column isn't handed on, since Spark would drop late rows by it unseen.
    """
    processor.row_schema = to_arrow_schema(rows.schema)
    group = F.pmod(F.xxhash64(key), F.lit(groups)).alias("_group")
    marked = rows.withColumn("_ts", F.timestamp_micros("ts_us")).withWatermark("_ts", late).drop("_ts")
    start = None if initial is None else initial.select(group, "waiting", "folded").groupBy("_group")
    return marked.withColumn("_group", group).groupBy("_group").transformWithStateInPandas(
        processor, f"{key} string, {schema}, late boolean", "Append", "EventTime", initialState=start
    )


def accepted(result: DataFrame) -> DataFrame:
    """The result rows proper."""
    return result.filter(~F.col("late")).drop("late")


def late_rows(result: DataFrame) -> DataFrame:
    """The table of rows that came too late to count: their key, time and other kept columns."""
    return result.filter("late").drop("late")


def snapshot(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """Every key's record in a stopped query's checkpoint, as `initial` of a new query takes it."""
    held = spark.read.format("statestore").option("stateVarName", "record").load(checkpoint).select("value.*")

    def by_key(table: pa.Table | None) -> dict[str | None, bytes]:
        if table is None:
            return {}
        code = _codes(table[key].to_pandas())
        order = np.argsort(code, kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        edges = [0, *(np.flatnonzero(np.diff(code[order])) + 1).tolist(), table.num_rows]
        return {table[key][a].as_py(): pack(table.slice(a, b - a)) for a, b in zip(edges, edges[1:])}

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                waiting, folded = by_key(unpack(r.waiting)), by_key(unpack(r.folded))
                keys = [*waiting, *(k for k in folded if k not in waiting)]
                yield pd.DataFrame({key: pd.Series(keys, dtype=object), "waiting": [waiting.get(k) for k in keys], "folded": [folded.get(k) for k in keys], "next_ms": r.next_ms, "seen_ms": r.seen_ms})

    return held.mapInPandas(split, f"{key} string, {RECORD}")


def floor_of(records: DataFrame) -> int:
    """The watermark up to which the stopped query had put results out, as far as its records tell."""
    return records.agg(F.coalesce(F.max("seen_ms"), F.lit(0))).first()[0]


# --- patterns --------------------------------------------------------------------

class Patterns(InOrder):
    """What the trailing window of every event matches. Only signals are state; counts are differences of running counts."""

    ties = ["event_id"]
    columns = {"event_id": "object", "ts_us": "Int64", "pattern": "object", "confidence": "float64", "severity": "Int32", "sm_id": "Int32", "contributing": "Int64"}
    late_columns = ["event_id", "ts_us"]

    def __init__(self, window_us: int, floor_ms: int = 0):
        super().__init__(floor_ms)
        self.window_us = window_us

    def forget(self, folded, now):
        kept = _joined(folded.filter(pc.greater_equal(folded["ts_us"], now * 1000 - self.window_us)))
        return kept, None if kept is None else (pc.max(kept["ts_us"]).as_py() + self.window_us) // 1000

    def fold_all(self, folded, rows):
        own = rows[rows["event_type"].isin(set(SIGNALS.values()))]
        table = _joined(folded, pa.Table.from_pandas(own, pa.schema([self.row_schema.field(c) for c in ("gpu_uuid", "ts_us", "event_type", "sm_id")]), preserve_index=False))
        if table is None:
            return pd.DataFrame(), None
        signals = table.to_pandas()
        n = len(rows)
        # One order of (key, time) for the signals and both ends of all windows.
        at = rows["ts_us"].to_numpy(np.int64)
        times, rank = np.unique(np.concatenate((at, at - self.window_us, signals["ts_us"].to_numpy(np.int64))), return_inverse=True)
        code = _codes(pd.concat([rows["gpu_uuid"], signals["gpu_uuid"]], ignore_index=True))
        end, low = code[:n] * len(times) + rank[:n], code[:n] * len(times) + rank[n : 2 * n]
        place = code[n:] * len(times) + rank[2 * n :]
        order = np.argsort(place, kind="stable")
        place, signals = place[order], signals.iloc[order]

        def within(mask: np.ndarray, of: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
            some = place[mask]
            first = np.searchsorted(some, low[of], "left")
            return first, np.searchsorted(some, end[of], "right") - first

        kind = signals["event_type"].to_numpy(object)
        count = {name: within(kind == k)[1] for name, k in SIGNALS.items()}
        fails = kind == "probe_fail"
        known = signals["sm_id"].notna().to_numpy()
        sms = signals["sm_id"].fillna(0).to_numpy(np.int32)
        first, _ = within(fails)
        some = pd.arrays.IntegerArray(np.append(sms[fails], np.int32(0))[first], ~np.append(known[fails], False)[first])
        fail, anomaly, ecc = count["n_fail"], count["n_inference"] + count["n_training"] + count["n_invariant"], count["n_ecc"]
        other = fail + count["n_inference"] + count["n_training"]
        kinds = sum((count[x] > 0).astype(int) for x in ("n_fail", "n_inference", "n_training", "n_invariant", "n_ecc"))
        hits = [
            ("probe_and_anomaly", (fail > 0) & (anomaly > 0), fail + anomaly, some),
            ("thermal_correlated", (fail > 0) & (count["n_thermal"] > 0), fail + count["n_thermal"], None),
            ("anomaly_without_probe", (fail == 0) & (anomaly > 0), anomaly, None),
            ("multi_signal", kinds >= 2, fail + anomaly + ecc, None),
            ("power_correlated", (fail > 0) & (count["n_power"] > 0), fail + count["n_power"], None),
            ("ecc_correlated", (ecc > 0) & (other > 0), ecc + other, None),
        ]
        found = [(pattern, np.flatnonzero(hit), size[hit], None if sm is None else sm[hit]) for pattern, hit, size, sm in hits]
        twice = np.flatnonzero(fail >= 2)
        for sm in np.unique(sms[fails & known]).tolist():
            size = within(fails & known & (sms == sm), twice)[1]
            found.append(("sm_localized", twice[size >= 2], size[size >= 2], pd.array([sm] * int((size >= 2).sum()), "Int32")))
        parts = []
        for pattern, places, size, sm in found:
            if len(places):
                hit = rows.iloc[places][["gpu_uuid", "event_id", "ts_us"]]
                sm = pd.array([None] * len(places), "Int32") if sm is None else sm
                parts.append(hit.assign(pattern=pattern, confidence=PATTERNS[pattern][0], severity=PATTERNS[pattern][1], sm_id=sm, contributing=size))
        return (pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()), table


def stream_patterns(events: DataFrame, window_seconds: int = 300, late: str = "10 minutes", initial: DataFrame | None = None, floor_ms: int = 0) -> DataFrame:
    """Patterns of every event that isn't late, once the watermark has passed it; late events with `late` set."""
    rows = events.select("gpu_uuid", "event_id", "ts_us", "event_type", "sm_id")
    schema = "event_id string, ts_us bigint, pattern string, confidence double, severity int, sm_id int, contributing bigint"
    return run_in_order(rows, "gpu_uuid", Patterns(window_seconds * 1_000_000, floor_ms), schema, late, initial)


# --- lifecycle -------------------------------------------------------------------

class Quarantine(InOrder):
    """Belief counts and lifecycle state; reports each transition and each rejected operator action.

    Beliefs and tiers of all ready rows are columns; only rows that may change the state are walked:
    actions, tiers beyond the state's own, and passes during a deep test.
    """

    ties = ["is_action", "row_id"]
    columns = {"ts_us": "Int64", "source": "object", "row_id": "object", "action": "object", "from_state": "object", "to_state": "object", "applied": "boolean"}
    late_columns = ["ts_us", "row_id"]
    counted = {"passes": ["probe_pass"], "failures": ["probe_fail"], "anomalies": ["inference_anomaly", "training_anomaly", "invariant_violation", "probe_error"]}

    def __init__(self, cfg: BeliefConfig, pass_count: int, floor_ms: int = 0):
        super().__init__(floor_ms)
        self.cfg, self.pass_count = cfg, pass_count

    def fold(self, state, rows):
        s = json.loads(state) if state else {"state": "HEALTHY", "passes": 0, "failures": 0, "anomalies": 0, "since": 0}
        kind = rows["event_type"]
        total = {name: s[name] + kind.isin(kinds).to_numpy().cumsum() for name, kinds in self.counted.items()}
        alpha = self.cfg.prior_alpha + total["passes"]
        beta = self.cfg.prior_beta + total["failures"] * self.cfg.failure_weight + total["anomalies"] * self.cfg.anomaly_weight
        reliability = alpha / (alpha + beta)
        action = np.select(
            [reliability < self.cfg.condemn_below, reliability < self.cfg.quarantine_below, reliability < self.cfg.suspect_below],
            ["condemn", "quarantine", "mark_suspect"], "")
        acts = rows["is_action"].to_numpy() == 1
        passed = (kind == "probe_pass").to_numpy()
        # A tier acts only in states that it moves on; a repeated tier after an unchanged state does nothing.
        tiers = np.flatnonzero(~acts & (action != ""))
        log: list[tuple] = []
        now, since = s["state"], s["since"]

        def move(i: int, source: str, what: str, to: str | None) -> None:
            nonlocal now, since
            log.append((int(rows["ts_us"].iat[i]), source, rows["row_id"].iat[i], what, now, to or now, to is not None))
            if to is not None:
                now, since = to, int(total["passes"][i])

        operators = np.flatnonzero(acts)
        at, size = 0, len(rows)
        while at < size:
            # The next row at which this state can change.
            moving = [a for a in ("mark_suspect", "quarantine", "condemn") if f"{now}|{TRANSITIONS.get(f'{now}|{a}')}" in ESCALATIONS]
            ahead = [size]
            later = tiers[np.searchsorted(tiers, at):]
            if moving and len(later):
                good = np.isin(action[later], moving)
                if good.any():
                    ahead.append(int(later[np.argmax(good)]))
            k = np.searchsorted(operators, at)
            if k < len(operators):
                ahead.append(int(operators[k]))
            if now == "DEEP_TEST":
                end = int(np.searchsorted(total["passes"], since + self.pass_count))
                if end < size:
                    ahead.append(max(end, at))
            i = min(ahead)
            if i == size:
                break
            if acts[i]:
                what = rows["action"].iat[i]
                move(i, "operator", what, TRANSITIONS.get(f"{now}|{what}"))
            else:
                if passed[i] and now == "DEEP_TEST" and total["passes"][i] - since >= self.pass_count:
                    move(i, "deep_test", "reinstate", "HEALTHY")
                to = TRANSITIONS.get(f"{now}|{action[i]}")
                if to and f"{now}|{to}" in ESCALATIONS:
                    move(i, "tier", str(action[i]), to)
            at = i + 1
        after = {"state": now, "since": since, **{name: int(t[-1]) for name, t in total.items()}}
        return pd.DataFrame(log, columns=list(self.columns)), json.dumps(after).encode()


def stream_quarantine(inputs: DataFrame, cfg: BeliefConfig = BeliefConfig(), pass_count: int = 1000, late: str = "10 minutes", initial: DataFrame | None = None, floor_ms: int = 0) -> DataFrame:
    """Transitions from events and operator actions (`quarantine_inputs`), in the order of their times."""
    schema = "ts_us bigint, source string, row_id string, action string, from_state string, to_state string, applied boolean"
    return run_in_order(inputs, "gpu_uuid", Quarantine(cfg, pass_count, floor_ms), schema, late, initial)


def quarantine_inputs(events: DataFrame, actions: DataFrame) -> DataFrame:
    e = events.select("gpu_uuid", "ts_us", F.col("event_id").alias("row_id"), F.lit(0).alias("is_action"), "event_type", F.lit(None).cast("string").alias("action"))
    a = actions.select("gpu_uuid", "ts_us", F.col("action_id").alias("row_id"), F.lit(1).alias("is_action"), F.lit(None).cast("string").alias("event_type"), "action")
    return e.unionByName(a)


# --- trackers --------------------------------------------------------------------

class Tracker(InOrder):
    """Control chart over `value`: cumulative target and sigma, smoothed test value, severity by how far it is out."""

    ties = ["pos"]
    columns = {"ts_us": "Int64", "pos": "Int64", "value": "float64", "count": "Int64", "ewma": "float64", "target": "float64", "sigma": "float64", "breach": "boolean", "severity": "object"}
    late_columns = ["ts_us", "pos", "value"]
    key_name = "series"

    def __init__(self, cfg: EwmaConfig, floor_ms: int = 0):
        super().__init__(floor_ms)
        self.cfg = cfg

    def fold(self, state, rows):
        s = json.loads(state) if state else {"n": 0, "s": 0.0, "ss": 0.0, "ewma": None}
        v = rows["value"].to_numpy(float)
        n = s["n"] + np.arange(1, len(v) + 1)
        total, squares = s["s"] + np.cumsum(v), s["ss"] + np.cumsum(v * v)
        lam = self.cfg.lam
        x = v if s["ewma"] is None else np.append(s["ewma"], v)
        y = pd.Series(x).ewm(alpha=lam, adjust=False).mean().to_numpy()[-len(v):]
        target = total / n
        sigma = np.where(n == 1, 0.0, np.sqrt(np.maximum(squares / n - target * target, 1e-15)))
        limit = self.cfg.limit * sigma * math.sqrt(lam / (2 - lam))
        out = np.abs(y - target)
        breach = (n > 1) & (n >= self.cfg.burn_in) & (sigma >= 1e-12) & (out > limit)
        severity = np.where(breach, np.where(out > self.cfg.critical_factor * limit, "critical", "warning"), None)
        result = rows[["ts_us", "pos", "value"]].assign(count=n, ewma=y, target=target, sigma=sigma, breach=breach, severity=severity)
        return result, json.dumps({"n": int(n[-1]), "s": float(total[-1]), "ss": float(squares[-1]), "ewma": float(y[-1])}).encode()


def stream_ewma(values: DataFrame, cfg: EwmaConfig = EwmaConfig(), late: str = "10 minutes", initial: DataFrame | None = None, floor_ms: int = 0) -> DataFrame:
    """`values` are (series, ts_us, pos, value)."""
    schema = "ts_us bigint, pos bigint, value double, count bigint, ewma double, target double, sigma double, breach boolean, severity string"
    return run_in_order(values.select("series", "ts_us", "pos", "value"), "series", Tracker(cfg, floor_ms), schema, late, initial)


class Gradients(InOrder):
    """Exponentially weighted mean and variance; z of each value against the state before it. Values that aren't finite are passed over."""

    ties = ["pos", "value"]
    columns = {"ts_us": "Int64", "pos": "Int64", "anomaly_type": "object", "score": "float64", "ew_mean": "float64"}
    late_columns = ["ts_us", "pos"]
    key_name = "series"

    def __init__(self, cfg: GradientConfig, floor_ms: int = 0):
        super().__init__(floor_ms)
        self.cfg = cfg

    def fold(self, state, rows):
        s = json.loads(state) if state else {"n": 0, "mean": 0.0, "var": 0.0}
        v = rows["value"].to_numpy(float)
        fine = np.isfinite(v)
        if not fine.all():
            rows, v = rows[fine], v[fine]
        if not len(v):
            return pd.DataFrame(), json.dumps(s).encode()
        a = self.cfg.alpha

        def smooth(start: float, x: np.ndarray) -> np.ndarray:
            """States before each value and after the last one."""
            return pd.Series(np.append(start, x)).ewm(alpha=a, adjust=False).mean().to_numpy()

        # The first value of a series is its first mean.
        mean = smooth(s["mean"] if s["n"] else v[0], v)
        d = v - mean[:-1]
        var = smooth(s["var"], (1 - a) * d * d)
        n = s["n"] + np.arange(len(v))
        z = np.abs(d) / np.sqrt(np.maximum(var[:-1], 1e-12))
        hit = (n >= max(self.cfg.warmup, 1)) & (z > self.cfg.sigma)
        after = mean[1:]
        kind = np.where(v > after, "gradient_spike", "gradient_collapse")
        out = pd.DataFrame({**{c: rows[c].to_numpy()[hit] for c in ("ts_us", "pos")}, "anomaly_type": kind[hit], "score": z[hit], "ew_mean": after[hit]})
        return out, json.dumps({"n": int(n[-1]) + 1, "mean": float(mean[-1]), "var": float(var[-1])}).encode()


def stream_gradients(values: DataFrame, cfg: GradientConfig = GradientConfig(), late: str = "10 minutes", initial: DataFrame | None = None, floor_ms: int = 0) -> DataFrame:
    """`values` are (series, ts_us, pos, value)."""
    schema = "ts_us bigint, pos bigint, anomaly_type string, score double, ew_mean double"
    return run_in_order(values.select("series", "ts_us", "pos", "value"), "series", Gradients(cfg, floor_ms), schema, late, initial)


class Losses(InOrder):
    """AR residual test and non-finite values; the state is the last values and the running sums of lag products."""

    ties = ["pos"]
    columns = {"ts_us": "Int64", "pos": "Int64", "anomaly_type": "object", "score": "float64"}
    late_columns = ["ts_us", "pos"]
    key_name = "series"
    #: Rows whose equations are solved at once.
    block = 4096

    def __init__(self, cfg: LossConfig, floor_ms: int = 0):
        super().__init__(floor_ms)
        self.cfg = cfg

    def fold(self, state, rows):
        p = self.cfg.order
        s = json.loads(state) if state else {"n": 0, "last": [], "sums": [[0.0] * (p + 2)] * (p + 2)}
        value = rows["value"].to_numpy(float)
        fine = np.isfinite(value)
        parts = [rows.loc[~fine, ["ts_us", "pos"]].assign(anomaly_type="loss_nan", score=math.inf)]
        good = rows.loc[fine, ["ts_us", "pos"]]
        last, sums, n = np.array(s["last"], float), np.array(s["sums"]), s["n"]
        for at in range(0, len(good), self.block):
            v = value[fine][at : at + self.block]
            line = np.concatenate((last, v))
            # Each value with the p before it, latest first; values with fewer before them have no equation.
            short = min(len(v), max(0, p - len(last)))
            lags = np.lib.stride_tricks.sliding_window_view(line, p + 1)[:, ::-1] if len(line) > p else np.zeros((0, p + 1))
            x = np.column_stack((np.ones(len(lags)), lags[:, 1:], lags[:, 0]))
            products = np.concatenate((sums[None], x[:, :, None] * x[:, None, :])).cumsum(axis=0)
            m = products[:-1]  # before each value
            able = (m[:, 0, 0] > 0) & (n + short + np.arange(len(x)) >= self.cfg.warmup)
            m, x_able = m[able], x[able]
            a, b, count = m[:, 1 : p + 1, 1 : p + 1], m[:, 1 : p + 1, p + 1], m[:, 0, 0]
            c = np.linalg.solve(a + 1e-8 * np.eye(p), b[..., None])[..., 0] if len(m) else np.zeros((0, p))
            mean = (m[:, 0, p + 1] - (c * m[:, 0, 1 : p + 1]).sum(1)) / count
            square = m[:, p + 1, p + 1] - 2 * (c * b).sum(1) + np.einsum("ki,kij,kj->k", c, a, c)
            std = np.sqrt(np.maximum(square / count - mean**2, 0.0))
            far = np.abs(x_able[:, p + 1] - (c * x_able[:, 1 : p + 1]).sum(1))
            z = np.divide(far, std, out=np.zeros(len(std)), where=std >= 1e-12)
            hit = z > self.cfg.sigma
            place = at + short + np.flatnonzero(able)[hit]
            parts.append(good.iloc[place].assign(anomaly_type="loss_spike", score=z[hit]))
            last, sums, n = line[-p:], products[-1], n + len(v)
        after = {"n": n, "last": last.tolist(), "sums": sums.tolist()}
        return pd.concat([x for x in parts if len(x)] or parts, ignore_index=True), json.dumps(after).encode()


def stream_loss(values: DataFrame, cfg: LossConfig = LossConfig(), late: str = "10 minutes", initial: DataFrame | None = None, floor_ms: int = 0) -> DataFrame:
    """`values` are (series, ts_us, pos, value)."""
    schema = "ts_us bigint, pos bigint, anomaly_type string, score double"
    return run_in_order(values.select("series", "ts_us", "pos", "value"), "series", Losses(cfg, floor_ms), schema, late, initial)
