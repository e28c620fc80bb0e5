"""Table sinks. Each write is idempotent for its batch id or version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwatch.functions.labels import month_key, next_month_start
from fleetwatch.operators.audit import batch_roots, export_rows, html_rows


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Date-partitioned events, sorted by device inside files for row-group skipping.
    The rebalance splits a large date over several tasks and merges small ones."""
    (
        events.withColumn("date", F.to_date("ts")).hint("rebalance", F.col("date"))
        .sortWithinPartitions("date", "gpu_uuid", "ts").write.mode(mode).partitionBy("date").parquet(path)
    )


def events_stream_sink(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    return (
        events.withColumn("date", F.to_date("ts")).writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).partitionBy("date").trigger(**(trigger or {"availableNow": True})).start()
    )


def merge_latest(snapshot: DataFrame | None, updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Latest row per key of snapshot and updates; partial max per map task."""
    both = updates if snapshot is None else snapshot.unionByName(updates)
    rest = [c for c in both.columns if c not in keys]
    latest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_r"))
    return latest.select(*keys, "_r.*").select(*both.columns)


def save_state(updates: DataFrame, root: str, keys: list[str], version: str, new_version: int, old_version: int | None = None) -> str:
    """Write a new snapshot version next to the old one; readers never see half a write."""
    spark = updates.sparkSession
    old = spark.read.parquet(f"{root}/v={old_version}") if old_version is not None else None
    path = f"{root}/v={new_version}"
    merge_latest(old, updates, keys, version).write.mode("overwrite").parquet(path)
    return path


def load_state(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/v={version}")


def write_audit_batch(entries: DataFrame, root: str, batch_id: int, in_order: bool = False) -> None:
    """Entries and their batch roots under one batch id; a retry overwrites itself.
    The roots are written last, from the entries as written, and mark the batch as complete.
    `in_order`: a task's rows lie in few months already, as those of batches sealed by time do."""
    path, e = f"{root}/entries/commit={batch_id}", entries.withColumn("month", month_key(F.col("ts")))
    # Rebalancing gathers a month's rows into few files and still splits a large month.
    e = e if in_order else e.hint("rebalance", F.col("month"))
    e.write.mode("overwrite").partitionBy("month").parquet(path)
    batch_roots(entries.sparkSession.read.schema(entries.schema).parquet(path)).write.mode("overwrite").parquet(f"{root}/roots/commit={batch_id}")


def read_committed(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    roots = spark.read.parquet(f"{root}/roots")
    entries = spark.read.parquet(f"{root}/entries").join(roots.select("commit").distinct(), "commit", "left_semi")
    return entries, roots


def write_chain_anchor(roots: DataFrame, external_us: int, service: str, path: str) -> None:
    anchors(roots, external_us, service).write.mode("append").parquet(path)


def anchors(roots: DataFrame, external_us: int, service: str) -> DataFrame:
    return roots.select("batch_sequence", "merkle_root", F.lit(external_us).alias("external_us"), F.lit(service).alias("service"))


def export_csv(entries: DataFrame, path: str) -> None:
    export_rows(entries).write.mode("overwrite").option("header", True).csv(path)


def export_json(entries: DataFrame, path: str) -> None:
    export_rows(entries).write.mode("overwrite").json(path)


def export_html(entries: DataFrame, path: str) -> None:
    html_rows(entries).select("value").write.mode("overwrite").text(path)


# --- lifecycle -------------------------------------------------------------------

def expired_months(entries: DataFrame, as_of: Column, retention_days: int = 2555) -> DataFrame:
    """Months that ended on or before the retention cutoff, with their row counts."""
    m = entries.groupBy(month_key(F.col("ts")).alias("month")).agg(
        F.count("*").alias("entries"), F.max(next_month_start(F.col("ts"))).alias("month_end")
    )
    return m.filter(F.col("month_end") <= F.date_sub(as_of.cast("date"), retention_days))


def drop_partitions(spark: SparkSession, table_path: str, column: str, values: list[str]) -> int:
    """Delete partition folders; the list is one value per month. Returns how many existed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = 0
    for v in values:
        p = jvm.org.apache.hadoop.fs.Path(f"{table_path.rstrip('/')}/{column}={v}")
        gone += bool(p.getFileSystem(conf).delete(p, True))
    return gone


def storage_bytes(files: DataFrame) -> DataFrame:
    """Bytes of the distinct files behind a file-based DataFrame."""
    f = files.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("b"))
    return f.groupBy("p").agg(F.max("b").alias("b")).agg(F.count("*").alias("files"), F.sum("b").alias("bytes"))
