"""Rules and limits from nested documents, and the invariants of training steps and captures."""

import json
import math

import pytest
from pyspark.sql import functions as F

from fleetwatch.config import TrainingLimits
from fleetwatch.operators import alerts as AL
from fleetwatch.operators.inference import check_invariants
from fleetwatch.operators.rules import making_seconds, predicate, rules_from
from fleetwatch.operators.training import training_invariants
from fleetwatch.sources import readers as R

YAML = """
global:
  default_cooldown_seconds: 45
rules:
  - name: "many_sms"          # three SMs
    condition:
      event_type: "probe_result"
      distinct_sms: 3
      window_seconds: 600
    severity: CRITICAL
    channels: [talk, email]
    cooldown_seconds: 0
  - name: node
    condition: {event_type: correlation, pattern_type: NODE_CORRELATED, min_confidence: 0.8}
    severity: HIGH
    group_by: hostname
  - name: broken
    condition: {valid: false}
    severity: CRITICAL
    group_by: cluster
"""


def test_conditions_become_predicates():
    assert predicate({"event_type": "anomaly", "min_severity": "HIGH", "max_severity": 4}) == "kind = 'anomaly' AND severity_code >= 3 AND severity_code <= 4"
    assert predicate({"sdc_rate_gt": 0.001, "unanimous": False}) == "sdc_rate > 0.001 AND unanimous = false"
    assert predicate({"result": ["FAIL", "it's"]}) == "result IN ('FAIL', 'it\\'s')"
    assert predicate({}) == predicate({"window_seconds": 5}) == "true"


@pytest.mark.parametrize("condition", [{"nope": 1}, {"nope_gt": 1}, {"result": None}, {"result": []}, {"ecc_uncorrected_gt": [1]}, {"min_severity": "LOUD"}])
def test_unknown_conditions_are_errors(condition):
    with pytest.raises(ValueError):
        predicate(condition)


def test_documents_are_checked():
    rule = {"name": "a", "severity": "HIGH"}
    assert rules_from({}) == () and rules_from({"rules": None}) == ()
    assert rules_from({"rules": [rule]})[0].cooldown_seconds == 300
    for bad in ([rule, rule], [rule | {"severity": "LOUD"}], [rule | {"group_by": "nope"}]):
        with pytest.raises(ValueError):
            rules_from({"rules": bad})


def test_rules_of_a_file_match_observations(spark, tmp_path):
    pytest.importorskip("yaml")
    file = tmp_path / "rules.yaml"
    file.write_text(YAML)
    rules = R.read_rules(spark, str(file), {"talk": "chat"})
    assert [r.cooldown_seconds for r in rules] == [0, 45, 45] and rules[0].channels == ("chat", "email")
    assert making_seconds(R.read_document(spark, str(file))) == {"many_sms": 600}
    rows = [("a", "probe_result", 3, None, None, None), ("b", "probe_result", 2, None, None, None), ("c", "correlation", None, 0.9, "node_correlated", None),
            ("d", "correlation", None, 0.7, "node_correlated", None), ("e", "audit_verification", None, None, None, False), ("f", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, kind string, sms int, confidence double, pattern string, valid boolean")
    c = F.col
    obs = AL.observation(df, observation_id=c("id"), kind=c("kind"), failing_sms=c("sms"), confidence=c("confidence"), pattern=c("pattern"),
                         valid=c("valid"), hostname=F.lit("h"), cluster=F.lit("x"), ts_us=F.lit(1))
    assert {(r.observation_id, r.rule, r.dedup_key) for r in AL.alert_rules(obs, rules).collect()} == {
        ("a", "many_sms", "many_sms:all"), ("c", "node", "node:h"), ("e", "broken", "broken:x")}


def test_parameters_keep_their_place(spark, tmp_path):
    file = tmp_path / "limits.json"
    file.write_text(json.dumps({"invariants": {"max_update": 10.0, "no_nan": True}, "steps": [1, {"a": "b"}], "empty": {}, "none": None}))
    assert {(r.name, r.value) for r in R.read_parameters(spark, str(file)).collect()} == {
        ("invariants.max_update", "10.0"), ("invariants.no_nan", "true"), ("steps.0", "1"), ("steps.1.a", "b"), ("empty", "{}"), ("none", "null")}
    file.write_text("")
    assert R.read_document(spark, str(file)) == {} and R.read_parameters(spark, str(file)).count() == 0
    with pytest.raises(ValueError):
        file.write_text("[1, 2, 3]")
        R.read_document(spark, str(file), most_bytes=3)


def test_training_steps_that_break_rules(spark):
    nan, inf = math.nan, math.inf
    rows = [
        ("r", 0, [1.0, 2.0], [0.0, 0.0], 0.1), ("r", 1, [1.0, 14.0], [0.0, nan], 0.1), ("r", 2, [nan, 14.0], None, 1.0),
        ("r", 3, [1.0, -inf], [0.0], 0.0), ("r", 4, [1.0, 5000.0], [0.0], nan), ("s", 4, None, None, None), ("s", 5, [], [], 0.5),
        ("s", 6, [100.0], [0.0], 0.5),
    ]
    steps = spark.createDataFrame(rows, "run string, step int, weights array<double>, gradients array<double>, learning_rate double")
    found = training_invariants(steps, ["run"], "step", F.floor(F.col("step") / 2), TrainingLimits())
    got = {(r.run, r.step, r.rule): r.value for r in found.collect()}
    assert math.isnan(got.pop(("r", 4, "learning_rate")))
    assert got == {
        ("r", 1, "nan_gradient"): None, ("r", 1, "weight_update"): 12.0, ("r", 2, "nan_weight"): None, ("r", 2, "learning_rate"): 1.0,
        ("r", 3, "infinite_weight"): None, ("r", 3, "learning_rate"): 0.0, ("r", 4, "weight_magnitude"): 5000.0,
    }
    assert training_invariants(steps.limit(0), ["run"], "step", F.lit(0)).count() == 0


def test_probabilities_of_captures(spark):
    rows = [(1, [0.5, 0.5]), (2, [1.1, -0.1]), (3, [0.5, 0.4]), (4, [math.nan, 1.0]), (5, None), (6, [])]
    c = spark.createDataFrame(rows, "request_id int, probs array<double>").withColumn("logits", F.array(F.lit(1.0), F.lit(2.0)))
    assert {(r.request_id, r.rule) for r in check_invariants(c, probs="probs").collect()} == {
        (2, "negative_probability"), (3, "softmax_sum"), (4, "softmax_sum")}
