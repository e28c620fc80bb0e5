"""Projections of the test tables onto the domain tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRIOR = {"prior_alpha": 200.0, "prior_beta": 0.1}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def gpu(user: Column) -> Column:
    return F.concat(F.lit("GPU-"), user.cast("string"))


def events_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(table(spark, sf_dir, "events"))


def as_events(e: DataFrame) -> DataFrame:
    """Raw event rows (batch or stream) as canonical events."""
    eid, uid, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    event_type = (
        F.when((kind == "error") & ((uid % 10 == 0) | (eid % 40 == 0)), "probe_fail")
        .when((kind == "error") & (eid % 40 == 1), "probe_error")
        .when((kind == "click") & (eid % 25 == 0), "inference_anomaly")
        .when((kind == "click") & (eid % 25 == 1), "training_anomaly")
        .when((kind == "click") & (eid % 25 == 2), "invariant_violation")
        .when((kind == "signup") & (eid % 12 == 0), "thermal_spike")
        .when((kind == "signup") & (eid % 12 == 1), "power_anomaly")
        .when((kind == "signup") & (eid % 12 == 2), "ecc_error")
        .otherwise("probe_pass")
    )
    probe = F.col("event_type").startswith("probe_")
    severity = (
        F.when(F.col("event_type") == "probe_pass", 1)
        .when(F.col("event_type") == "probe_fail", 4)
        .when(F.col("event_type").isin("probe_error", "ecc_error"), 3)
        .when(F.col("event_type").isin("thermal_spike", "power_anomaly"), 2)
        .otherwise(2 + F.col("event_id").cast("long") % 3)
        .cast("int")
    )
    return (
        e.select(
            eid.cast("string").alias("event_id"),
            gpu(uid).alias("gpu_uuid"),
            F.concat(F.lit("node-"), F.floor(uid / 8).cast("string")).alias("hostname"),
            event_type.alias("event_type"),
            F.col("ts").cast("timestamp").alias("ts"),
            micros(F.col("ts")).alias("ts_us"),
            F.col("value").alias("score"),
            (eid % 16).cast("int").alias("sm_id"),
        )
        .withColumn("sm_id", F.when(probe, F.col("sm_id")))
        .withColumn("severity", severity)
        .withColumn("metadata", F.create_map(F.lit("hostname"), F.col("hostname")))
    )


def gpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    uid = F.col("user_id")
    return (
        table(spark, sf_dir, "events").select("user_id").distinct()
        .select(
            gpu(uid).alias("gpu_uuid"),
            F.concat(F.lit("node-"), F.floor(uid / 8).cast("string")).alias("hostname"),
            (uid % 8).cast("int").alias("device_index"),
            F.concat(F.lit("model-"), (uid % 3).cast("string")).alias("model"),
            F.concat(F.lit("driver-"), (uid % 2).cast("string")).alias("driver_version"),
            F.concat(F.lit("fw-"), (uid % 5).cast("string")).alias("firmware_version"),
        )
    )


def operator_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_actions(table(spark, sf_dir, "events"))


def as_actions(e: DataFrame) -> DataFrame:
    """Every purchase event read as an operator's action on that device."""
    r = F.col("event_id") % 40
    action = (
        F.when(r == 0, "condemn").when(r <= 8, "schedule_deep_test").when(r <= 20, "reinstate")
        .when(r <= 28, "clear_suspect").when(r <= 34, "mark_suspect").otherwise("quarantine")
    )
    return e.filter("event_type = 'purchase'").select(
        F.col("event_id").cast("string").alias("action_id"),
        gpu(F.col("user_id")).alias("gpu_uuid"),
        micros(F.col("ts")).alias("ts_us"),
        action.alias("action"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, eid = F.col("value"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        eid.cast("string").alias("event_id"),
        gpu(F.col("user_id")).alias("gpu_uuid"),
        F.col("ts").cast("timestamp").alias("ts"),
        micros(F.col("ts")).alias("ts_us"),
        (40 + v % 60).alias("temperature_c"),
        ((eid % 97) == 0).alias("throttle_active"),
        (200 + v).alias("power_w"),
        F.lit(700.0).alias("power_limit_w"),
        ((eid % 89) == 0).alias("power_throttle_active"),
        F.floor(v / 200).cast("long").alias("dram_uncorrected"),
        F.floor(v / 10).cast("long").alias("dram_corrected"),
        F.when(eid % 500 == 0, 1).otherwise(0).alias("retired_pages"),
    )


def tmr_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("canary_id"),
        F.col("l_linenumber").alias("slot"),
        gpu(F.col("l_suppkey")).alias("gpu_uuid"),
        F.sha2(F.col("l_returnflag"), 256).alias("fingerprint"),
        F.col("l_quantity").alias("weight"),
        micros(F.col("l_shipdate")).alias("ts_us"),
    )


def comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier and a part-group device compared on each line; agree if not returned."""
    return table(spark, sf_dir, "lineitem").select(
        gpu(F.col("l_suppkey")).alias("gpu_a"),
        gpu(F.col("l_partkey") % 97).alias("gpu_b"),
        (F.col("l_returnflag") != "R").alias("agree"),
        micros(F.col("l_shipdate")).alias("ts_us"),
    ).filter("gpu_a <> gpu_b")


def factor_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        gpu(F.col("l_suppkey")).alias("gpu_uuid"),
        (F.col("l_returnflag") == "R").alias("during_sdc"),
        micros(F.col("l_shipdate")).alias("ts_us"),
        F.expr(
            "stack(3, 'temperature', l_quantity / 50, 'voltage', l_discount * 10, 'power', l_tax * 12.5)"
            " as (factor, normalized_value)"
        ),
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_captures(table(spark, sf_dir, "embeddings"))


def as_captures(e: DataFrame) -> DataFrame:
    v = F.col("vec_id")
    return e.select(
        v.alias("request_id"),
        F.floor(v / 2).cast("string").alias("input_hash"),
        (v % 2).cast("string").alias("replica_id"),
        F.concat(F.lit("model-"), F.col("label").cast("string")).alias("model_name"),
        gpu(v % 13).alias("gpu_uuid"),
        (v * 700_000).alias("ts_us"),
        F.transform("embedding", lambda x: x.cast("double") * 10).alias("logits"),
    )


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("run_id"),
        F.col("o_orderkey").alias("step"),
        F.when(F.col("o_orderkey") % 211 == 0, F.lit(float("nan")))
        .otherwise(F.col("o_totalprice") / 1000).alias("loss"),
    )


def grad_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("run_id"),
        F.concat(F.lit("layer-"), F.col("l_linestatus")).alias("layer_name"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("step"),
        (F.col("l_extendedprice") / 1000).alias("norm"),
    )


def device_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("step"),
        F.col("l_linestatus").alias("param"),
        gpu(F.col("l_suppkey")).alias("device_id"),
        F.col("l_orderkey").alias("sample"),
        (F.col("l_extendedprice") / 1000).alias("norm"),
    )


def grad_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of a step are the lines of an order; the hash is of the return flag."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("run_id"),
        F.col("l_orderkey").alias("step"),
        F.col("l_linenumber").alias("rank"),
        F.sha2(F.col("l_returnflag"), 256).alias("hash"),
    )


def pending_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_pending(table(spark, sf_dir, "orders"))


def as_pending(o: DataFrame) -> DataFrame:
    """Ledger rows before hashing: one per order, its type from the order's key."""
    k = F.col("o_orderkey")
    label = (
        F.when(k % 10 < 5, "ProbeResult").when(k % 10 == 5, "AnomalyEvent")
        .when(k % 10 == 6, "QuarantineAction").when(k % 10 == 7, "ConfigChange")
        .when(k % 10 == 8, "TmrResult").otherwise("SystemEvent")
    )
    action = F.when(k % 20 == 6, "unquarantine").otherwise("quarantine")
    text = F.concat_ws("|", action, k.cast("string"), "o_orderpriority")
    return o.select(
        k.alias("seq"),
        label.alias("entry_type"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        micros(F.col("o_orderdate")).alias("ts_us"),
        F.when(k % 10 < 8, gpu(F.col("o_custkey"))).alias("gpu_uuid"),
        (k % 16).cast("int").alias("sm_id"),
        text.cast("binary").alias("data"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as sealed entries, one chain per batch of 1000; rows whose key is 3
    modulo 997 then get a tampered payload."""
    from fleetwatch.operators.audit import seal_batches

    p = pending_entries(spark, sf_dir)
    numbered = p.withColumn("batch_sequence", F.floor(F.col("seq") / 1000)).withColumn("pos", F.col("seq") % 1000)
    broken = (F.col("entry_id") - 1) % 997 == 3
    return seal_batches(numbered).withColumn(
        "data", F.when(broken, F.concat(F.col("data"), F.lit("x").cast("binary"))).otherwise(F.col("data"))
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")
