"""The tree of composed state maps gives what walking each device's inputs one by one gives."""

import random

import pytest

from fleetwatch.config import WindowConfig
from fleetwatch.functions.labels import TRANSITIONS
from fleetwatch.operators import quarantine as Q
from fleetwatch.plans import tree

ACTIONS = ["mark_suspect", "quarantine", "condemn", "reinstate", "schedule_deep_test", "clear_suspect"]
STATES = ["HEALTHY", "SUSPECT", "QUARANTINED", "DEEP_TEST", "CONDEMNED"]
COUNT = 3


def walk(inputs, state="HEALTHY", since=0):
    for k, action, passes in inputs:
        if k == 0:
            to = "HEALTHY" if state == "DEEP_TEST" and passes == since + COUNT else None
        else:
            to = TRANSITIONS.get(f"{state}|{action}")
            to = to if k == 2 or f"{state}|{to}" in Q.ESCALATIONS else None
        if to:
            state, since = to, passes if to == "DEEP_TEST" else 0
    return state, since


def test_maps_compose_like_walks():
    rng = random.Random(8)
    for _ in range(400):
        passes, inputs = 0, []
        for _ in range(rng.randrange(25)):
            passes += rng.randrange(3)
            k = rng.choice([0, 1, 2, 2])
            inputs.append((k, "reinstate" if k == 0 else rng.choice(ACTIONS[:3] if k == 1 else ACTIONS), passes))
        cuts = sorted(rng.randrange(len(inputs) + 1) for _ in range(3))
        whole = Q.Moves()
        for low, high in zip([0, *cuts], [*cuts, len(inputs)]):
            part = Q.Moves()
            for k, action, n in reversed(inputs[low:high]):
                part = part.before(k, action, n, COUNT)
            whole = whole.then(Q.Moves.unpack(part.pack()))
        for state in STATES:
            for since in range(-4, 5) if state == "DEEP_TEST" else [0]:
                got = whole.after(state, since)
                assert got == walk(inputs, state, since)


@pytest.mark.parametrize("fan", [2, 32])
def test_one_device_with_most_rows(spark, monkeypatch, fan):
    monkeypatch.setattr(tree, "FAN", fan)
    rng = random.Random(3)
    hour = 3_600_000_000
    steps, acts, want = [], [], []
    for gpu, n in (("hot", 300), ("a", 20), ("b", 1)):
        inputs = []
        for i in range(n):
            ts = i * hour
            if rng.random() < 0.6:
                rank = rng.choice([0, 0, 0, 2, 3])
                steps.append((gpu, ts, rank, f"e{i:03}", "probe_pass" if rng.random() < 0.8 else "probe_fail"))
                inputs.append((ts, f"e{i:03}", None, rank, steps[-1][4] == "probe_pass"))
            else:
                acts.append((gpu, ts, f"a{i:03}", rng.choice(ACTIONS[:1] + ACTIONS[3:])))
                inputs.append((ts, f"a{i:03}", acts[-1][3], None, False))
        state, since, passes = "HEALTHY", 0, 0
        for ts, row, action, rank, passed in inputs:
            passes += passed
            if action is not None:
                to = TRANSITIONS.get(f"{state}|{action}")
                want.append((gpu, ts, "operator", row, action, state, to or state, to is not None))
                if to:
                    state, since = to, passes
                continue
            if passed and state == "DEEP_TEST" and passes == since + COUNT:
                want.append((gpu, ts, "deep_test", row, "reinstate", state, "HEALTHY", True))
                state = "HEALTHY"
            action = {2: "mark_suspect", 3: "quarantine"}.get(rank)
            to = TRANSITIONS.get(f"{state}|{action}")
            if to and f"{state}|{to}" in Q.ESCALATIONS:
                want.append((gpu, ts, "tier", row, action, state, to, True))
                state = to
    t = spark.createDataFrame(steps, "gpu_uuid string, ts_us long, tier_rank int, event_id string, event_type string")
    a = spark.createDataFrame(acts, "gpu_uuid string, ts_us long, action_id string, action string")
    win = WindowConfig(3600, 4 * 3600)
    got = Q.quarantine_fsm(t, a, COUNT, win)
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(w[2] == "deep_test" for w in want)
    progress = Q.deep_test_progress(got, t, win).collect()
    log = [w for w in want if w[0] == "hot" and w[-1]]
    for r in (r for r in progress if r["gpu_uuid"] == "hot"):
        end = min([w[1] for w in log if w[5] == "DEEP_TEST" and w[1] >= r["started_us"]], default=None)
        assert r["ended_us"] == end
        assert r["passes"] == sum(s[0] == "hot" and s[4] == "probe_pass" and s[1] > r["started_us"] and (end is None or s[1] <= end) for s in steps)


def test_no_inputs(spark):
    t = spark.createDataFrame([], "gpu_uuid string, ts_us long, tier_rank int, event_id string, event_type string")
    a = spark.createDataFrame([], "gpu_uuid string, ts_us long, action_id string, action string")
    assert Q.quarantine_fsm(t, a, COUNT).collect() == []
