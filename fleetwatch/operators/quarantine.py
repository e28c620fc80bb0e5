"""State history: automatic escalation, and the full machine with operator actions."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.config import WindowConfig
from fleetwatch.functions.labels import STATES, TIER_ACTIONS, TIER_STATES, TRANSITIONS, lookup
from fleetwatch.plans.chunked import asof, running, time_chunk
from fleetwatch.plans.cut import cut
from fleetwatch.plans.tree import tree_scan

#: A time after all others: the end of a span that is still open.
_FOREVER = 1 << 60

# Tier changes the machine takes on its own.
ESCALATIONS = {
    "HEALTHY|SUSPECT", "HEALTHY|QUARANTINED", "HEALTHY|CONDEMNED", "SUSPECT|QUARANTINED",
    "SUSPECT|CONDEMNED", "QUARANTINED|CONDEMNED", "DEEP_TEST|CONDEMNED",
}


def quarantine_auto(trajectory: DataFrame, win: WindowConfig = WindowConfig()) -> DataFrame:
    """Transitions when only tiers drive the state: the state is the worst tier so far."""
    cols = trajectory.select("gpu_uuid", "event_id", "ts_us", "reliability", "tier_rank")
    seen = running(
        cols, ["gpu_uuid"], ["ts_us", "event_id"], time_chunk("ts_us", win.chunk_us),
        {"worst": ("max", F.col("tier_rank"))}, exclusive=True,
    )
    before = F.coalesce(F.col("worst"), F.lit(0))
    return seen.filter((F.col("tier_rank") >= 2) & (F.col("tier_rank") > before)).select(
        "gpu_uuid", "event_id", "ts_us", "reliability",
        lookup(TIER_STATES, before).alias("from_state"),
        lookup(TIER_STATES, F.col("tier_rank")).alias("to_state"),
        lookup(TIER_ACTIONS, F.col("tier_rank")).alias("action"),
    )


def fsm_inputs(trajectory: DataFrame, actions: DataFrame, pass_count: int, win: WindowConfig) -> DataFrame:
    """The few rows per device that can change its state.

    A deep test that begins with an operator's action can only end by itself at one
    known probe pass: the one numbered `pass_count` past it. Between two such points
    or actions (an epoch) a repeated or lower tier changes nothing, so only new worst
    tiers of an epoch matter. The rest is dropped before anything is gathered.
    """
    steps = trajectory.select(
        "gpu_uuid", "ts_us", "tier_rank", F.col("event_id").alias("row_id"), F.lit(0).alias("is_action"),
        F.lit(None).cast("string").alias("action"), (F.col("event_type") == "probe_pass").alias("passed"),
    )
    acts = actions.select(
        "gpu_uuid", "ts_us", F.lit(None).cast("int").alias("tier_rank"), F.col("action_id").alias("row_id"),
        F.lit(1).alias("is_action"), "action", F.lit(False).alias("passed"),
    )
    order, chunk = ["ts_us", "is_action", "row_id"], time_chunk("ts_us", win.chunk_us)
    p = cut(
        running(steps.unionByName(acts), ["gpu_uuid"], order, chunk, {"passes": ("sum", F.col("passed").cast("long"))})
    )
    ends = p.filter("action = 'schedule_deep_test'").select(
        "gpu_uuid", (F.col("passes") + pass_count).alias("passes"), F.lit(True).alias("passed"),
        F.lit(True).alias("_end"),
    ).distinct()
    marked = p.join(ends, ["gpu_uuid", "passes", "passed"], "left").withColumn(
        "completes", F.coalesce("_end", F.lit(False))
    )
    breaks = F.greatest("is_action", F.col("completes").cast("int"))
    e = cut(running(marked, ["gpu_uuid"], order, chunk, {"epoch": ("sum", breaks)}))
    w = running(e, ["gpu_uuid", "epoch"], order, chunk, {"worst": ("max", F.col("tier_rank"))}, exclusive=True)
    new_worst = (F.col("tier_rank") >= 2) & (F.col("tier_rank") > F.coalesce(F.col("worst"), F.lit(1)))
    kinds = F.array_compact(
        F.array(
            F.when(F.col("is_action") == 1, F.struct(F.lit(2).alias("k"), F.col("action").alias("action"))),
            F.when(F.col("completes"), F.struct(F.lit(0).alias("k"), F.lit("reinstate").alias("action"))),
            F.when(new_worst, F.struct(F.lit(1).alias("k"), lookup(TIER_ACTIONS, F.col("tier_rank")).alias("action"))),
        )
    )
    return w.select("gpu_uuid", "ts_us", "is_action", "row_id", "passes", F.inline(kinds))


LOG = "ts_us bigint, source string, row_id string, action string, from_state string, to_state string, applied boolean"
SOURCES = ("deep_test", "tier", "operator")
Known = tuple[str, int]  # a state, and the passes counted when its deep test began (0 elsewhere)


def _moved(state: str, k: int, action: str) -> str | None:
    """Where a tier (k = 1) or an operator (k = 2) moves a state, if anywhere."""
    to = TRANSITIONS.get(f"{state}|{action}")
    return to if k == 2 or f"{state}|{to}" in ESCALATIONS else None


class Moves:
    """What a run of inputs makes of every state before it.

    For all states but a deep test this is one state after it. A deep test that is under way ends at
    the pass that its own start asks for: `ends` has what follows for each start whose end lies in the run, and `other` what
    follows for the rest (None: still under way).
    """

    def __init__(self, plain: dict[str, Known] | None = None, ends: dict[int, Known] | None = None, other: Known | None = None):
        self.plain = plain or {s: (s, 0) for s in STATES if s != "DEEP_TEST"}
        self.ends, self.other = ends or {}, other

    def after(self, state: str, since: int) -> Known:
        if state != "DEEP_TEST":
            return self.plain[state]
        return self.ends.get(since) or self.other or (state, since)

    def before(self, k: int, action: str, passes: int, pass_count: int) -> Moves:
        """The run with one more input before it."""
        if k == 0:
            return Moves(self.plain, self.ends | {passes - pass_count: self.after("HEALTHY", 0)}, self.other)
        plain = {s: self.after(_moved(s, k, action) or s, passes) for s in self.plain}
        out = _moved("DEEP_TEST", k, action)
        return Moves(plain, self.ends, self.other) if out is None else Moves(plain, {}, self.after(out, passes))

    def then(self, later: Moves) -> Moves:
        ends = {since: later.after(*known) for since, known in self.ends.items()}
        if self.other is None:
            return Moves({s: later.after(*known) for s, known in self.plain.items()}, later.ends | ends, later.other)
        return Moves({s: later.after(*known) for s, known in self.plain.items()}, ends, later.after(*self.other))

    def pack(self) -> bytes:
        return json.dumps([self.plain, list(self.ends.items()), self.other]).encode()

    @staticmethod
    def unpack(data: bytes) -> Moves:
        plain, ends, other = json.loads(data)
        return Moves({s: tuple(v) for s, v in plain.items()}, {k: tuple(v) for k, v in ends}, tuple(other) if other else None)


def quarantine_fsm(
    trajectory: DataFrame, actions: DataFrame, pass_count: int = 1000, win: WindowConfig = WindowConfig()
) -> DataFrame:
    """Every applied transition and every rejected operator action.

    Inputs of a chunk compose to one map of states, so a device's chunks are scanned as a tree.
    """
    rows = fsm_inputs(trajectory, actions, pass_count, win)

    def summed(chunk: list[tuple]) -> bytes:
        moves = Moves()
        for _, _, _, k, action, passes in reversed(chunk):
            moves = moves.before(k, action, passes, pass_count)
        return moves.pack()

    def composed(maps: list[bytes]) -> bytes:
        return reduce(Moves.then, map(Moves.unpack, maps)).pack()

    def applied(moves: bytes, state: bytes) -> bytes:
        return json.dumps(Moves.unpack(moves).after(*json.loads(state))).encode()

    def replayed(chunk: list[tuple], before: bytes) -> list[tuple]:
        state, since = json.loads(before)
        log = []
        for ts, _, row, k, action, passes in chunk:
            if k == 0:
                to = "HEALTHY" if state == "DEEP_TEST" and passes == since + pass_count else None
            else:
                to = _moved(state, k, action)
            if to is not None or k == 2:
                log.append((ts, SOURCES[k], row, action, state, to or state, to is not None))
            if to is not None:
                state, since = to, passes if to == "DEEP_TEST" else 0
        return log

    order, start = ["ts_us", "is_action", "row_id", "k"], json.dumps(["HEALTHY", 0]).encode()
    return tree_scan(rows, ["gpu_uuid"], order, ["action", "passes"], time_chunk("ts_us", win.chunk_us), summed, composed, applied, replayed, start, LOG)


def deep_test_progress(fsm: DataFrame, events: DataFrame, win: WindowConfig = WindowConfig()) -> DataFrame:
    """Probe passes since each deep test began, up to its end; 0-length tests keep 0.

    Ends and counts of passes are found by as-of joins on running counts.
    """
    applied = fsm.filter("applied").select("gpu_uuid", "ts_us", "from_state", "to_state")
    starts = applied.filter("to_state = 'DEEP_TEST'").select("gpu_uuid", F.col("ts_us").alias("started_us")).distinct()
    ends = applied.filter("from_state = 'DEEP_TEST'").select("gpu_uuid", F.col("ts_us").alias("ended_us"), (-F.col("ts_us")).alias("_back")).distinct()
    # The first end at or after a start is the last one at or before it in time that runs backwards.
    spans = asof(starts.withColumn("_back", -F.col("started_us")), ends, ["gpu_uuid"], "_back", win.chunk_us, "_end")
    spans = spans.select("gpu_uuid", "started_us", F.col("_end.ended_us").alias("ended_us"))
    passes = events.filter("event_type = 'probe_pass'").select("gpu_uuid", "ts_us", F.lit(1).alias("_one"))
    at = F.explode(F.array(F.struct(F.lit("low").alias("side"), F.col("started_us").alias("ts_us")), F.struct(F.lit("high").alias("side"), F.coalesce("ended_us", F.lit(_FOREVER)).alias("ts_us"))))
    points = spans.select("gpu_uuid", "started_us", "ended_us", at.alias("_at")).select("gpu_uuid", "started_us", "ended_us", "_at.*", F.lit(0).alias("_one"))
    counted = running(points.unionByName(passes, allowMissingColumns=True), ["gpu_uuid"], ["ts_us"], time_chunk("ts_us", win.chunk_us), {"_n": ("sum", F.col("_one"))}, peers=True)
    return counted.filter("side IS NOT NULL").groupBy("gpu_uuid", "started_us", "ended_us").agg(
        F.sum(F.when(F.col("side") == "high", F.col("_n")).otherwise(-F.col("_n"))).alias("passes"))


def current_states(transitions: DataFrame, known: DataFrame) -> DataFrame:
    """Latest state per known device; HEALTHY where nothing happened."""
    t = transitions.filter("applied") if "applied" in transitions.columns else transitions
    row = "row_id" if "row_id" in t.columns else "event_id"
    last = t.groupBy("gpu_uuid").agg(
        F.max_by(F.struct("to_state", "ts_us"), F.struct("ts_us", row)).alias("_l")
    )
    return known.select("gpu_uuid").join(last, "gpu_uuid", "left").select(
        "gpu_uuid",
        F.coalesce(F.col("_l.to_state"), F.lit("HEALTHY")).alias("state"),
        F.col("_l.ts_us").alias("state_since_us"),
    )


def state_counts(states: DataFrame) -> DataFrame:
    """Devices per state, with a row for every state."""
    spark = states.sparkSession
    names = spark.createDataFrame([(s,) for s in STATES], "state string")
    counted = states.groupBy("state").agg(F.count("*").alias("gpus"))
    return names.join(counted, "state", "left").select("state", F.coalesce("gpus", F.lit(0)).alias("gpus"))


def quarantine_queue(health: DataFrame, state: str | None = None) -> DataFrame:
    q = health.filter(F.col("state") != "HEALTHY")
    return q.filter(F.col("state") == state) if state else q


def queue_reasons(queue: DataFrame, transitions: DataFrame, beliefs: DataFrame) -> DataFrame:
    """The queue with why each device is in it: the action of its latest transition, the event behind it and the
    evidence against it so far (`beliefs`: probe_failures, anomalies). NULL reason for a device without a transition."""
    t = transitions.filter("applied") if "applied" in transitions.columns else transitions
    row = "row_id" if "row_id" in t.columns else "event_id"
    last = t.groupBy("gpu_uuid").agg(F.max_by(F.struct("action", F.col(row).alias("event_id")), F.struct("ts_us", row)).alias("_l"))
    why = last.select("gpu_uuid", F.col("_l.action").alias("reason"), F.col("_l.event_id").alias("reason_event"))
    return queue.join(why, "gpu_uuid", "left").join(beliefs.select("gpu_uuid", "probe_failures", "anomalies"), "gpu_uuid", "left")


def filter_directives(transitions: DataFrame, gpus: DataFrame, hostname: str | None = None, action: str | None = None):
    """Applied transitions as directives, narrowed by host and action."""
    t = transitions if action is None else transitions.filter(F.col("action") == action)
    d = t.join(gpus.select("gpu_uuid", "hostname"), "gpu_uuid")
    return d if hostname is None else d.filter(F.col("hostname") == hostname)
