"""Structured Streaming forms of the batch operators that need only built-in state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwatch.config import AuditConfig, BeliefConfig, DivergenceConfig
from fleetwatch.functions import vectors as V
from fleetwatch.operators import audit as AU
from fleetwatch.operators.beliefs import _evidence, _finish
from fleetwatch.plans.cut import cut
from fleetwatch.sinks.writers import write_audit_batch


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream, with the schema of the files already there."""
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def stream_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Watermarked events, each id once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run an append stream over what is available and read the result."""
    q = (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_updates(df: DataFrame, keys: list[str], root: str, checkpoint: str) -> DataFrame:
    """Run an update-mode aggregate, keeping each key's latest row.

    Every micro-batch writes its changed keys under its own id, so a retry overwrites
    itself; the newest id wins when reading.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    q = (
        df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode("update")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    rows = df.sparkSession.read.parquet(root)
    rest = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("_r")).select(*keys, "_r.*")


def stream_beliefs(events: DataFrame, cfg: BeliefConfig = BeliefConfig(), by_sm: bool = False) -> DataFrame:
    """Running belief per device (or SM). Counting commutes, so any lateness is fine."""
    used = events.filter(~F.col("event_type").isin("thermal_spike", "power_anomaly", "ecc_error"))
    if by_sm:
        used = used.filter(F.col("event_type").isin("probe_pass", "probe_fail") & F.col("sm_id").isNotNull())
    keys = ["gpu_uuid", "sm_id"] if by_sm else ["gpu_uuid"]
    return _finish(used.groupBy(*keys).agg(*_evidence()), cfg)


def stream_trust(comparisons: DataFrame) -> DataFrame:
    """Running agreement counts per unordered pair."""
    from fleetwatch.operators.trust import trust_edges

    return trust_edges(comparisons)


def stream_cross_replica(captures: DataFrame, cfg: DivergenceConfig = DivergenceConfig(), late: str = "10 seconds") -> DataFrame:
    """Interval join of the captures with themselves; the watermark bounds the state."""
    c = captures.select("input_hash", "replica_id", "request_id", "ts", "logits").withWatermark("ts", late)
    old = c.select(F.col("input_hash").alias("old_hash"), *[F.col(x).alias(f"old_{x}") for x in ("replica_id", "request_id", "ts", "logits")])
    gap = F.expr(f"INTERVAL {cfg.match_window_ms} MILLISECONDS")
    # Ordering by (ts, request) makes each pair appear once.
    on = (
        (F.col("input_hash") == F.col("old_hash")) & (F.col("replica_id") != F.col("old_replica_id"))
        & (F.col("old_ts") <= F.col("ts")) & (F.col("old_ts") > F.col("ts") - gap)
        & ((F.col("old_ts") < F.col("ts")) | (F.col("old_request_id") < F.col("request_id")))
    )
    measure = V.jsd_logits if cfg.use_jsd else V.kl_logits
    j = c.join(old, on).select(
        "input_hash", F.col("old_replica_id").alias("replica_a"), F.col("replica_id").alias("replica_b"),
        F.col("old_request_id").alias("request_a"), F.col("request_id").alias("request_b"),
        measure("logits", "old_logits").alias("divergence"),
    )
    return j.filter(F.col("divergence") > cfg.threshold_nats)


def stream_heartbeat_lost(events: DataFrame, timeout: str = "120 seconds", late: str = "10 minutes") -> DataFrame:
    """A host's activity session closes when it stays silent for the timeout."""
    s = events.withWatermark("ts", late).groupBy("hostname", F.session_window("ts", timeout).alias("_s")).agg(F.max("ts_us").alias("last_us"))
    return s.select("hostname", "last_us", F.unix_micros(F.col("_s.end")).alias("lost_us"))


def seal_stream(pending: DataFrame, root: str, checkpoint: str, tie: str, cfg: AuditConfig = AuditConfig()):
    """Seal a stream onto the ledger under `root` in batches of `cfg.batch_rows` entries.

    A micro-batch's whole batches are sealed in parallel, each from the payload root of the
    batch before. What is left over waits in a buffer for the next micro-batch, so batches, hashes and roots
    follow from the order of the rows alone, not from how many arrive together. `seal_rest` closes the last batch.
    A ledger belongs to one checkpoint: commits are numbered by its micro-batches.
    """
    spark = pending.sparkSession

    def seal(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            _seal(spark, batch, root, 2 * batch_id, tie, cfg, False)

    return (
        pending.writeStream.foreachBatch(seal).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def seal_rest(spark: SparkSession, root: str, tie: str, cfg: AuditConfig = AuditConfig()) -> None:
    """Seal what waits in the buffer as a batch of its own: a batch's time limit, or the end of a stream.

    To be called while no stream seals onto the ledger. An empty buffer changes nothing.
    """
    done = _commits(spark, f"{root}/waiting")
    if done:
        waiting = spark.read.parquet(f"{root}/waiting/commit={done[-1]}")
        if not waiting.isEmpty():
            _seal(spark, None, root, done[-1] | 1, tie, cfg, True)


def _seal(spark: SparkSession, batch: DataFrame | None, root: str, commit: int, tie: str, cfg: AuditConfig, close: bool) -> None:
    """One commit: even numbers are micro-batches, the odd one after a micro-batch closes what it left over.

    A commit reads only what earlier ones left and overwrites its own folders, so it can be run again.
    """
    earlier = [c for c in _commits(spark, f"{root}/waiting") if c < commit]
    last_id, last_batch, seed = 0, -1, bytes(32)
    if earlier:
        waiting = spark.read.parquet(f"{root}/waiting/commit={earlier[-1]}")
        batch = waiting if batch is None else waiting.unionByName(batch)
        tail = spark.read.parquet(f"{root}/tail/commit={earlier[-1]}").first()  # one row
        last_id, last_batch, seed = tail["entry_id"], tail["batch_sequence"], bytes(tail["seed"])
    numbered = AU.number_pending(batch, tie, cfg)
    size = numbered.count()
    sealed_rows = size if close else size - size % cfg.batch_rows
    if sealed_rows:
        write_audit_batch(AU.seal_linked(numbered.filter(F.col("seq") < sealed_rows), seed, last_id + 1, last_batch + 1), root, commit, in_order=True)
        entries = spark.read.parquet(f"{root}/entries/commit={commit}")
        last_id, last_batch = last_id + sealed_rows, last_batch + -(-sealed_rows // cfg.batch_rows)
        seed = AU.payload_root(entries.filter(F.col("batch_sequence") == last_batch))
    tail = spark.range(1).select(F.lit(last_id).cast("long").alias("entry_id"), F.lit(last_batch).cast("long").alias("batch_sequence"), F.lit(seed).alias("seed"))
    tail.write.mode("overwrite").parquet(f"{root}/tail/commit={commit}")
    numbered.filter(F.col("seq") >= sealed_rows).select(*batch.columns).write.mode("overwrite").parquet(f"{root}/waiting/commit={commit}")
    for old in earlier[:-1]:  # the one before this commit serves a second run of it
        for kind in ("waiting", "tail"):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{kind}/commit={old}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _commits(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the commit folders there that are complete."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(f.getPath().getName().split("=")[1]) for f in system.listStatus(path) if system.exists(done(f.getPath(), "_SUCCESS")))
