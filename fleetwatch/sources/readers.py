"""Normalisation of landed batches into the canonical event table, and table readers."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwatch.functions.labels import ANOMALY_SOURCES, PROBE_RESULTS
from fleetwatch.operators.alerts import Rule
from fleetwatch.operators.rules import rules_from

GPU_TYPE = "struct<uuid:string,hostname:string,device_index:int,model:string,driver_version:string,firmware_version:string>"
PROBE_BATCH = (
    "agent_hostname string, sequence_number bigint, executions array<struct<execution_id:string,probe_type:string,"
    f"gpu:{GPU_TYPE},sm_id:int,result:int,gpu_temperature_c:float,gpu_power_w:float,timestamp:timestamp>>"
)
ANOMALY_BATCH = (
    "source_hostname string, sequence_number bigint, events array<struct<event_id:string,anomaly_type:string,source:int,"
    "gpu_uuid:string,severity:int,score:float,timestamp:timestamp,layer_name:string,model_id:string>>"
)
TELEMETRY_BATCH = (
    "hostname string, readings array<struct<gpu_uuid:string,timestamp:timestamp,temperature_c:float,throttle_active:boolean,"
    "power_w:float,power_limit_w:float,power_throttle_active:boolean,dram_corrected:bigint,dram_uncorrected:bigint,retired_pages:int>>"
)


def _metadata(**values: Column) -> Column:
    m = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(m, lambda k, v: v.isNotNull())


def normalize_probes(batches: DataFrame, now_us: int | None = None) -> DataFrame:
    """One event per execution. Result codes: 1 pass, 2 fail, 3 error, else timeout.

    An execution without a host name gets that of its batch's agent (agent_hostname, where
    batches have it), one without a time the given one, by default that of the query.
    """
    agent = F.col("agent_hostname") if "agent_hostname" in batches.columns else F.lit(None).cast("string")
    now = F.current_timestamp() if now_us is None else F.timestamp_micros(F.lit(now_us))
    x = batches.select(agent.alias("_agent"), F.explode("executions").alias("x")).select("_agent", "x.*")
    x = x.withColumn("timestamp", F.coalesce("timestamp", now))
    r, host = F.col("result"), F.coalesce("gpu.hostname", "_agent")
    return x.select(
        F.col("execution_id").alias("event_id"), F.col("gpu.uuid").alias("gpu_uuid"), host.alias("hostname"),
        F.when(r == 1, "probe_pass").when(r == 2, "probe_fail").otherwise("probe_error").alias("event_type"),
        F.col("timestamp").alias("ts"), F.unix_micros("timestamp").alias("ts_us"),
        F.when(r == 2, 1.0).otherwise(0.0).alias("score"), "sm_id",
        F.when(r == 1, 1).when(r == 2, 4).when(r == 3, 3).otherwise(2).alias("severity"),
        _metadata(hostname=host, probe_type=F.col("probe_type"), temperature_c=F.col("gpu_temperature_c"),
                  power_w=F.col("gpu_power_w")).alias("metadata"),
    )


def normalize_anomalies(batches: DataFrame) -> DataFrame:
    x = batches.select("source_hostname", F.explode("events").alias("x")).select("source_hostname", "x.*")
    kinds = F.create_map(*[F.lit(v) for kv in ANOMALY_SOURCES.items() for v in kv])
    return x.select(
        "event_id", "gpu_uuid", F.col("source_hostname").alias("hostname"),
        F.coalesce(F.try_element_at(kinds, F.col("source")), F.lit("inference_anomaly")).alias("event_type"),
        F.col("timestamp").alias("ts"), F.unix_micros("timestamp").alias("ts_us"), F.col("score").cast("double").alias("score"),
        F.lit(None).cast("int").alias("sm_id"), "severity",
        _metadata(hostname=F.col("source_hostname"), anomaly_type=F.col("anomaly_type"), layer_name=F.col("layer_name"),
                  model_id=F.col("model_id")).alias("metadata"),
    )


def normalize_telemetry(batches: DataFrame) -> DataFrame:
    x = batches.select("hostname", F.explode("readings").alias("x")).select("hostname", "x.*")
    return x.withColumn("ts_us", F.unix_micros("timestamp")).withColumn(
        "event_id", F.sha2(F.concat_ws(":", "gpu_uuid", "ts_us"), 256)
    ).withColumnRenamed("timestamp", "ts")


def result_label(code: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in PROBE_RESULTS.items() for v in kv]), code), F.lit("UNKNOWN"))


def union_events(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_tmr_results(batches: DataFrame) -> DataFrame:
    """(canary_id, results array) rows as one row per participating device."""
    return batches.select("canary_id", F.posexplode("results").alias("_i", "_r")).select(
        "canary_id", (F.col("_i") + 1).alias("slot"), "_r.*"
    )


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden vectors from a JSON document {category: [{index, expected_result, ...}]}."""
    raw = spark.read.json(path, multiLine=True)
    arrays = [f.name for f in raw.schema.fields if isinstance(f.dataType, T.ArrayType)]
    parts = [
        raw.select(F.explode(c).alias("g")).select(
            F.upper(F.lit(c)).alias("probe_type"), F.col("g.index").cast("long").alias("index"),
            F.col("g.expected_result").cast("float").alias("expected_result"),
        )
        for c in arrays
    ]
    return union_events(*parts)


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """A flat parameter file (one `name: value` per line) as (name, value) rows."""
    line = F.split(F.regexp_replace("value", r"\s*#.*$", ""), r":\s*", 2)
    return spark.read.text(path).filter(F.col("value").rlike(r"^\s*[\w.]+:\s*\S")).select(
        F.trim(line[0]).alias("name"), F.trim(F.trim(line[1]), F.lit('"')).alias("value")
    )


def read_document(spark: SparkSession, path: str, most_bytes: int = 1 << 20) -> dict[str, Any]:
    """A nested document of settings (YAML; JSON where no YAML library is installed), read by Spark from any store.

    It goes to the driver, so larger ones than `most_bytes` are refused; an empty one is {}.
    """
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    if files.filter(F.col("length") > most_bytes).limit(1).count():
        raise ValueError(f"{path} is larger than {most_bytes} bytes")
    rows = files.select("content").take(2)
    if len(rows) > 1:
        raise ValueError(f"{path} is more than one document")
    text = bytes(rows[0].content).decode() if rows else ""
    try:
        import yaml
    except ModuleNotFoundError:
        return json.loads(text) if text.strip() else {}
    return yaml.safe_load(text) or {}


def read_rules(spark: SparkSession, path: str, channels: dict[str, str] | None = None) -> tuple[Rule, ...]:
    """Alert rules of a settings document, as `alert_rules` takes them."""
    return rules_from(read_document(spark, path), channels)


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """A nested settings document as (name, value) rows: names joined by dots, list items numbered from 0, values as JSON text."""
    def leaves(name: str, value: Any) -> Iterator[tuple[str, str]]:
        if isinstance(value, (dict, list)) and value:
            for k, v in value.items() if isinstance(value, dict) else enumerate(value):
                yield from leaves(f"{name}.{k}" if name else str(k), v)
        elif name:
            yield name, value if isinstance(value, str) else json.dumps(value)

    return spark.createDataFrame(list(leaves("", read_document(spark, path))), "name string, value string")


def read_events(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Date-partitioned events; date bounds prune folders before any file is opened."""
    e = spark.read.parquet(path)
    if start is not None:
        e = e.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        e = e.filter(F.col("date") <= F.lit(end).cast("date"))
    return e
