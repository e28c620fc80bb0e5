"""Tamper-evident audit ledger: sealing, verification, queries and reports."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetwatch.config import AuditConfig
from fleetwatch.functions.hashing import ZERO_HASH, chain_hash, fold_pairs, hex_lower, merkle_roots, sha256
from fleetwatch.functions.labels import ENTRY_TYPES, month_key
from fleetwatch.plans.chunked import asof, positions, running, time_chunk
from fleetwatch.plans.cut import cut
from fleetwatch.plans.ranks import with_previous

_FIELDS = ["entry_type", "ts", "ts_us", "gpu_uuid", "sm_id", "data"]
#: Neighbouring batches that one task seals, one after another.
_NEAR = 64


# --- sealing ---------------------------------------------------------------------

def genesis_entry(spark: SparkSession, ts_us: int, payload: bytes = b"audit ledger genesis") -> DataFrame:
    d = spark.range(1).select(
        F.lit(0).cast("long").alias("entry_id"), F.lit("SystemEvent").alias("entry_type"),
        F.timestamp_micros(F.lit(ts_us)).alias("ts"), F.lit(ts_us).cast("long").alias("ts_us"),
        F.lit(None).cast("string").alias("gpu_uuid"), F.lit(None).cast("int").alias("sm_id"),
        F.lit(payload).alias("data"), F.unhex(F.lit(ZERO_HASH)).alias("previous_hash"),
    )
    return d.withColumn("entry_hash", chain_hash(F.col("data"), F.col("previous_hash"))).withColumn(
        "batch_sequence", F.lit(0).cast("long")
    )


def number_pending(pending: DataFrame, tie: str, cfg: AuditConfig) -> DataFrame:
    """Order all rows by time and cut them into batches: (seq from 0, batch, pos)."""
    n = positions(pending, ["ts_us", tie], "seq")
    return n.withColumns({"batch_sequence": F.floor(F.col("seq") / cfg.batch_rows), "pos": F.col("seq") % cfg.batch_rows})


def seal_batches(numbered: DataFrame, seeds: DataFrame | None = None, first_id: int = 1, linked: bool = False) -> DataFrame:
    """Chain the rows inside each batch; batches run in parallel.

    `seeds` (batch_sequence, seed) gives the hash each batch starts from; zeros
    otherwise. Neighbouring batches are dealt out together, so a task's rows lie in few months;
    they pass through it in order. With `linked`, only the first of a task's `_NEAR` neighbours needs a seed:
    the others start from the payload root of the one before.
    """
    seed = numbered.withColumn("seed", F.lit(None).cast("binary")) if seeds is None else numbered.join(seeds, "batch_sequence", "left")
    rows = seed.select((F.col("seq") + first_id).alias("entry_id"), *_FIELDS, F.col("seed").alias("previous_hash"), "batch_sequence", "pos")
    in_order = rows.repartition(F.floor(F.col("batch_sequence") / _NEAR)).sortWithinPartitions("batch_sequence", "pos")
    sealed = rows.withColumn("entry_hash", F.col("previous_hash")).select("entry_id", *_FIELDS, "previous_hash", "entry_hash", "batch_sequence")
    return in_order.mapInArrow(partial(_chained, linked=linked), sealed.schema)


def _chained(parts: Iterator[pa.RecordBatch], linked: bool) -> Iterator[pa.RecordBatch]:
    """Rows in order of batch and position, with their hashes; `previous_hash` comes as the batch's seed. A missing payload leaves the batch's further hashes missing."""
    batch, last, leaves = None, None, []
    for part in parts:
        before, after = [], []
        for b, seed, data in zip(*(_listed(part.column(c)) for c in ("batch_sequence", "previous_hash", "data"))):
            if b != batch:
                if seed is None and linked and leaves and b % _NEAR:
                    seed = fold_pairs(leaves)
                batch, last, leaves = b, bytes(32) if seed is None else seed, []
            before.append(last)
            last = None if data is None or last is None else hashlib.sha256(data + last).digest()
            after.append(last)
            if linked:
                leaves.append(None if data is None else hashlib.sha256(data).digest())
        names = ["entry_id", *_FIELDS, "previous_hash", "entry_hash", "batch_sequence"]
        made = {"previous_hash": pa.array(before, pa.binary()), "entry_hash": pa.array(after, pa.binary())}
        yield pa.RecordBatch.from_arrays([made[n] if n in made else part.column(n) for n in names], names)


def _listed(column: pa.Array | pa.ChunkedArray) -> list:
    """Its values; by way of NumPy, which is far faster but has no missing integers."""
    return column.to_pylist() if column.null_count and pa.types.is_integer(column.type) else column.to_numpy(zero_copy_only=False).tolist()


def linked_seeds(numbered: DataFrame) -> DataFrame:
    """Start hash of the batch after each: the Merkle root of a batch's payload hashes.

    An entry-by-entry chain across batches can only be built one batch after another.
    Seeding from payload roots ties every batch to the one before it just as firmly
    and is computed in parallel. (The resulting hashes differ from a serial chain's.)
    """
    leaves = numbered.select("batch_sequence", "pos", sha256(F.col("data")).alias("_leaf"))
    return merkle_roots(leaves, ["batch_sequence"], "pos", "_leaf").select(
        (F.col("batch_sequence") + 1).alias("batch_sequence"), F.col("merkle_root").alias("seed")
    )


def seal_linked(numbered: DataFrame, seed: bytes | None = None, first_id: int = 1, first_batch: int = 0) -> DataFrame:
    """Seal all batches in parallel, each from the payload root of the one before; the first from `seed` (zeros by default).

    Ids and batch numbers go on from `first_id` and `first_batch`.
    """
    start = numbered.sparkSession.range(1).select(F.col("id").alias("batch_sequence"), F.lit(seed or bytes(32)).alias("seed"))
    last = numbered.agg(F.max("batch_sequence")).first()[0]
    ends = numbered.filter((F.col("batch_sequence") % _NEAR == _NEAR - 1) & (F.col("batch_sequence") < F.lit(last)))
    seeds = start if not last or last < _NEAR else cut(linked_seeds(ends).union(start))
    return seal_batches(numbered, seeds, first_id, linked=True).withColumn("batch_sequence", F.col("batch_sequence") + first_batch)


def payload_root(entries: DataFrame) -> bytes:
    """The payload root of one batch, from which the next one is sealed."""
    first = entries.agg(F.min("entry_id")).first()[0]
    leaves = entries.select(F.lit(0).alias("k"), (F.col("entry_id") - first).alias("pos"), sha256(F.col("data")).alias("leaf"))
    return bytes(merkle_roots(leaves, ["k"], "pos", "leaf").first()["merkle_root"])


def batch_roots(entries: DataFrame) -> DataFrame:
    """Root row of each batch over its entry hashes."""
    span = entries.groupBy("batch_sequence").agg(
        F.count("*").alias("entry_count"), F.min("entry_id").alias("first_entry_id"), F.max("entry_id").alias("last_entry_id")
    )
    pos = entries.join(span.select("batch_sequence", "first_entry_id"), "batch_sequence").select(
        "batch_sequence", (F.col("entry_id") - F.col("first_entry_id")).alias("pos"), "entry_hash"
    )
    return span.join(merkle_roots(pos, ["batch_sequence"], "pos", "entry_hash"), "batch_sequence")


def split_pending(raw: DataFrame, now_us: int) -> tuple[DataFrame, DataFrame]:
    """Accepted rows (missing time set to now) and rejected rows (unknown type)."""
    known = F.coalesce(F.col("entry_type").isin(*ENTRY_TYPES), F.lit(False))
    ok = raw.filter(known).withColumn("ts_us", F.coalesce("ts_us", F.lit(now_us)))
    return ok, raw.filter(~known)


# --- verification ----------------------------------------------------------------

def _differs(a: Column, b: Column) -> Column:
    """True unless both are there and equal: a missing hash or payload verifies nothing."""
    return ~F.coalesce(a == b, F.lit(False))


def verify_entries(entries: DataFrame) -> DataFrame:
    """Entries whose hash isn't that of their data and previous hash; a NULL in any of the three is a mismatch."""
    bad = _differs(chain_hash(F.col("data"), F.col("previous_hash")), F.col("entry_hash"))
    return entries.filter(bad).select("entry_id", F.lit("hash_mismatch").alias("failure"))


def verify_chain(entries: DataFrame, expected_previous: bytes | None = None) -> DataFrame:
    """One row per failure: a broken link to the row before, or a wrong hash.

    The first row is compared with the given hash, else zeros if its id is at most 1,
    else it is taken as the start. A NULL hash or payload is a failure of its row, and
    a NULL hash of the row that follows it as well.
    """
    e = entries.select("entry_id", "data", "previous_hash", "entry_hash")
    linked = with_previous(e, "entry_id", ["entry_id", "entry_hash"])
    first = (
        F.lit(expected_previous) if expected_previous is not None
        else F.when(F.col("entry_id") <= 1, F.unhex(F.lit(ZERO_HASH))).otherwise(F.col("previous_hash"))
    )
    before = F.when(F.col("prev_entry_id").isNull(), first).otherwise(F.col("prev_entry_hash"))
    broken = _differs(F.col("previous_hash"), before)
    wrong = _differs(chain_hash(F.col("data"), F.col("previous_hash")), F.col("entry_hash"))
    kinds = F.array_compact(F.array(F.when(broken, F.lit("chain_break")), F.when(wrong, F.lit("hash_mismatch"))))
    return linked.select("entry_id", F.explode(kinds).alias("failure"))


def _heads(entries: DataFrame) -> DataFrame:
    """First id of each batch and the hash it must go on from: the payload root of the batch before, zeros for batch 0; NULL if that batch isn't there."""
    start = entries.groupBy("batch_sequence").agg(F.min("entry_id").alias("entry_id"))
    payload = entries.join(start.withColumnRenamed("entry_id", "_first"), "batch_sequence").select(
        "batch_sequence", (F.col("entry_id") - F.col("_first")).alias("pos"), sha256(F.col("data")).alias("_leaf"))
    seeds = merkle_roots(payload, ["batch_sequence"], "pos", "_leaf").select((F.col("batch_sequence") + 1).alias("batch_sequence"), F.col("merkle_root").alias("seed"))
    zero = F.when(F.col("batch_sequence") == 0, F.unhex(F.lit(ZERO_HASH)))
    return start.join(seeds, "batch_sequence", "left").select("batch_sequence", "entry_id", F.coalesce("seed", zero).alias("seed"))


def verify_linked(entries: DataFrame) -> DataFrame:
    """As `verify_chain` for a ledger sealed in parallel: the first row of a batch goes on from the
    payload root of the batch before and from nothing else."""
    heads = _heads(entries)
    broken = entries.select("entry_id", "previous_hash").join(heads, "entry_id").filter(_differs(F.col("previous_hash"), F.col("seed")))
    inner = verify_chain(entries)
    inside = inner.join(heads.select("entry_id", F.lit("chain_break").alias("failure")), ["entry_id", "failure"], "left_anti")
    return inside.unionByName(broken.select("entry_id", F.lit("chain_break").alias("failure")))


def verify_batches(entries: DataFrame, roots: DataFrame, linked: bool = False) -> DataFrame:
    """Each batch: whether its recomputed root differs from the stored one (or either is missing), and its failures inside.

    chain_breaks are links inside the batch and, for a `linked` ledger, from the batch before;
    hash_mismatches are wrong entry hashes. A row goes on from the one before it in order of ids, as in `verify_chain`: where ids
    follow each other that is the batch's own, so the entries are dealt out once, in blocks of 1,024 ids of a batch. Only rows after
    a gap, which another batch's rows may fill, are looked up in `verify_chain`.
    """
    blocks = cut(_checked_blocks(entries))
    ordered = Window.partitionBy("batch_sequence").orderBy("block")
    edge = blocks.withColumns({"_id": F.lag("last_entry_id").over(ordered), "_hash": F.lag("last_hash").over(ordered)})
    follows = F.coalesce(F.col("_id") + 1 == F.col("first_entry_id"), F.lit(False))
    edge = edge.filter("block > 0").select("batch_sequence", "first_entry_id", follows.alias("_follows"), _differs(F.col("first_previous"), F.col("_hash")).alias("_broken"))
    broken = [edge.filter("_follows AND _broken").groupBy("batch_sequence").agg(F.count("*").alias("_n")), blocks.groupBy("batch_sequence").agg(F.sum("chain_breaks").alias("_n"))]
    gaps = blocks.select("batch_sequence", F.explode("gaps").alias("entry_id")).unionByName(
        edge.filter("NOT _follows").select("batch_sequence", F.col("first_entry_id").alias("entry_id")))
    if not gaps.isEmpty():
        found = verify_chain(entries).filter("failure = 'chain_break'").select("entry_id")
        broken.append(gaps.join(found, "entry_id", "left_semi").groupBy("batch_sequence").agg(F.count("*").alias("_n")))
    if linked:
        seeds = merkle_roots(blocks, ["batch_sequence"], "block", "payload_root").select((F.col("batch_sequence") + 1).alias("batch_sequence"), F.col("merkle_root").alias("seed"))
        zero = F.when(F.col("batch_sequence") == 0, F.unhex(F.lit(ZERO_HASH)))
        heads = blocks.filter("block = 0").join(seeds, "batch_sequence", "left")
        broken.append(heads.select("batch_sequence", _differs(F.col("first_previous"), F.coalesce("seed", zero)).cast("long").alias("_n")))
    again = merkle_roots(blocks, ["batch_sequence"], "block", "entry_root").withColumnRenamed("merkle_root", "_again")
    wrong = blocks.groupBy("batch_sequence").agg(F.sum("hash_mismatches").alias("hash_mismatches"))
    breaks = reduce(DataFrame.unionByName, broken).groupBy("batch_sequence").agg(F.sum("_n").alias("chain_breaks"))
    j = roots.select("batch_sequence", "merkle_root").join(again, "batch_sequence", "full").join(breaks, "batch_sequence", "left").join(wrong, "batch_sequence", "left")
    return j.select("batch_sequence", _differs(F.col("merkle_root"), F.col("_again")).alias("root_mismatch"),
                    F.coalesce("chain_breaks", F.lit(0)).alias("chain_breaks"), F.coalesce("hash_mismatches", F.lit(0)).alias("hash_mismatches"))


_BLOCK = """batch_sequence long, block long, first_entry_id long, last_entry_id long, first_previous binary, last_hash binary,
  entry_root binary, payload_root binary, chain_breaks long, hash_mismatches long, gaps array<long>"""


def _checked_blocks(entries: DataFrame) -> DataFrame:
    """One row for each block of 1,024 ids of a batch: its ends, its roots over entry and payload hashes, its failures, and ids that don't follow the row before."""
    e = entries.select(F.col("batch_sequence").cast("long").alias("batch_sequence"), F.col("entry_id").cast("long").alias("entry_id"), "data", "previous_hash", "entry_hash")
    starts = cut(e.groupBy("batch_sequence").agg(F.min("entry_id").alias("_first")))
    block = F.floor((F.col("entry_id") - F.col("_first")) / 1024).cast("long")
    return e.join(starts, "batch_sequence").withColumn("block", block).drop("_first").groupBy("batch_sequence", "block").applyInArrow(_checked, _BLOCK)


def _checked(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("entry_id")
    ids, data, before, after = (_listed(rows.column(c)) for c in ("entry_id", "data", "previous_hash", "entry_hash"))
    leaves = [None if d is None else hashlib.sha256(d).digest() for d in data]
    wrong = sum(h is None or d is None or p is None or hashlib.sha256(d + p).digest() != h for d, p, h in zip(data, before, after))
    breaks, gaps = 0, []
    for i in range(1, len(ids)):
        if ids[i] is None or ids[i] != ids[i - 1] + 1:
            gaps.append(ids[i])
        elif before[i] is None or before[i] != after[i - 1]:
            breaks += 1
    made = [key[0].as_py(), key[1].as_py(), ids[0], ids[-1], before[0], after[-1], fold_pairs(after), fold_pairs(leaves), breaks, wrong, gaps]
    types = [pa.int64()] * 4 + [pa.binary()] * 4 + [pa.int64()] * 2 + [pa.list_(pa.int64())]
    names = [c.split()[0] for c in _BLOCK.split(",")]
    return pa.Table.from_arrays([pa.array([m], t) for m, t in zip(made, types)], names)


def verification_summary(entries: DataFrame, failures: DataFrame) -> DataFrame:
    f = failures.agg(
        F.count_if(F.col("failure") == "chain_break").alias("chain_breaks"),
        F.count_if(F.col("failure") == "hash_mismatch").alias("hash_mismatches"),
        F.min("entry_id").alias("first_failure"),
    )
    s = entries.agg(F.count("*").alias("checked")).crossJoin(f)  # one row by one row
    return s.withColumn("valid", (F.col("chain_breaks") == 0) & (F.col("hash_mismatches") == 0))


def verify_recent(entries: DataFrame, as_of_us: int, hours: int = 24) -> DataFrame:
    return verify_chain(entries.filter(F.col("ts_us").between(as_of_us - hours * 3_600_000_000, as_of_us)))


def entries_with_roots(entries: DataFrame, roots: DataFrame) -> DataFrame:
    return entries.join(roots.select("batch_sequence", "merkle_root"), "batch_sequence")


# --- queries ---------------------------------------------------------------------

def query_audit(
    entries: DataFrame, gpu: str | None = None, entry_type: str | None = None, start_us: int | None = None,
    end_us: int | None = None, limit: int | None = None, offset: int = 0, descending: bool = False,
) -> DataFrame:
    """Optional predicates, time in [start, end), ordered by id. On a table partitioned
    by month the month bounds are added, so whole months are pruned."""
    q = entries
    if gpu is not None:
        q = q.filter(F.col("gpu_uuid") == gpu)
    if entry_type is not None:
        q = q.filter(F.col("entry_type") == entry_type)
    if start_us is not None:
        q = q.filter(F.col("ts_us") >= start_us)
        if "month" in entries.columns:
            q = q.filter(F.col("month") >= month_key(F.timestamp_micros(F.lit(start_us))))
    if end_us is not None:
        q = q.filter(F.col("ts_us") < end_us)
        if "month" in entries.columns:
            q = q.filter(F.col("month") <= month_key(F.timestamp_micros(F.lit(end_us))))
    q = q.orderBy(F.col("entry_id").desc() if descending else F.col("entry_id"))
    if offset:
        q = q.offset(offset)
    return q if limit is None else q.limit(limit)


def last_entry(entries: DataFrame) -> DataFrame:
    return entries.agg(
        F.max("entry_id").alias("entry_id"), F.max_by("entry_hash", "entry_id").alias("entry_hash"),
        F.coalesce(F.max("batch_sequence"), F.lit(0)).alias("last_batch_sequence"),
    )


def data_preview(data: Column, length: int = 200) -> Column:
    text = F.decode(data, "UTF-8")
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def export_rows(entries: DataFrame) -> DataFrame:
    empty = F.lit("")
    return entries.select(
        "entry_id", "entry_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"),
        F.coalesce("gpu_uuid", empty).alias("gpu_uuid"), F.coalesce(F.col("sm_id").cast("string"), empty).alias("sm_id"),
        F.base64("data").alias("data_base64"), hex_lower(F.col("previous_hash")).alias("previous_hash"),
        hex_lower(F.col("entry_hash")).alias("entry_hash"), "batch_sequence",
    )


def _escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def html_rows(entries: DataFrame) -> DataFrame:
    x = export_rows(entries)
    cells = [F.col("entry_id").cast("string"), F.col("timestamp"), F.col("entry_type"), F.col("gpu_uuid"),
             F.col("batch_sequence").cast("string"), F.substring("entry_hash", 1, 16)]
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), _escape(c), F.lit("</td>")) for c in cells], F.lit("</tr>"))
    return x.select("entry_id", row.alias("value"))


def event_summaries(entries: DataFrame) -> DataFrame:
    return entries.select("entry_id", "entry_type", "ts_us", "gpu_uuid", data_preview(F.col("data")).alias("preview"))


# --- reports ---------------------------------------------------------------------

def in_period(entries: DataFrame, start_us: int, end_us: int) -> DataFrame:
    return entries.filter((F.col("ts_us") >= start_us) & (F.col("ts_us") < end_us))


def _of(kind: str) -> Column:
    return F.count_if(F.col("entry_type") == kind)


def soc2_report(entries: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """All control metrics of the period in one conditional aggregate."""
    e = in_period(entries, start_us, end_us)
    back = F.count_if(
        (F.col("entry_type") == "QuarantineAction")
        & F.contains(F.lower(F.decode("data", "UTF-8")), F.lit("unquarantine"))
    )
    s = e.agg(
        F.count("*").alias("total_events"), _of("SystemEvent").alias("system_events"),
        _of("QuarantineAction").alias("_q"), back.alias("unquarantine_events"), _of("AnomalyEvent").alias("anomalies"),
        _of("ProbeResult").alias("probes"), _of("TmrResult").alias("tmr_comparisons"),
        _of("ConfigChange").alias("config_changes"),
    )
    ok = verify_chain(e).agg((F.count("*") == 0).alias("chain_valid"))
    return s.crossJoin(ok).select(  # one row by one row
        "total_events", "system_events", (F.col("_q") - F.col("unquarantine_events")).alias("quarantine_events"),
        "unquarantine_events",
        F.when(F.col("_q") == 0, 1.0).otherwise(F.col("unquarantine_events") / F.col("_q")).alias("availability_ratio"),
        "anomalies", "probes",
        F.when(F.col("probes") == 0, 0.0).otherwise(F.col("anomalies") / F.col("probes")).alias("anomaly_rate"),
        "tmr_comparisons", "config_changes", "chain_valid",
    )


def availability_events(entries: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Quarantine entries followed by system entries of the period, as summaries."""
    e = in_period(entries, start_us, end_us)
    part = lambda kind, n: event_summaries(e.filter(F.col("entry_type") == kind)).withColumn("part", F.lit(n))
    return part("QuarantineAction", 1).unionByName(part("SystemEvent", 2))


def incidents(entries: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Anomalies on devices that were quarantined in the period."""
    e = in_period(entries, start_us, end_us)
    q = e.filter("entry_type = 'QuarantineAction' and gpu_uuid is not null").select("gpu_uuid").distinct()
    return e.filter("entry_type = 'AnomalyEvent'").join(q, "gpu_uuid", "left_semi")


def iso27001_report(entries: DataFrame, start_us: int, end_us: int) -> DataFrame:
    e = in_period(entries, start_us, end_us)
    s = e.agg(
        F.count("*").alias("total_events"), F.count("gpu_uuid").alias("gpu_events"),
        _of("QuarantineAction").alias("quarantine_actions"), _of("ConfigChange").alias("config_changes"),
        _of("AnomalyEvent").alias("anomalies"), _of("ProbeResult").alias("probes"), _of("TmrResult").alias("tmr_comparisons"),
    )
    seen = e.select("gpu_uuid").filter("gpu_uuid is not null").distinct().agg(F.count("*").alias("gpus_observed"))
    inc = incidents(entries, start_us, end_us).agg(F.count("*").alias("incidents"))
    first = e.filter("entry_type = 'AnomalyEvent'").select("entry_id").orderBy("entry_id").limit(10)
    ids = first.agg(F.array_sort(F.collect_list("entry_id")).alias("evidence"))
    ok = verify_chain(e).agg((F.count("*") == 0).alias("chain_valid"))
    r = s.crossJoin(seen).crossJoin(inc).crossJoin(ids).crossJoin(ok)  # one row each
    rate = F.when(F.col("probes") == 0, 0.0).otherwise(F.col("anomalies") / F.col("probes"))
    return r.withColumn("anomaly_rate", rate).withColumn("no_gpus_finding", F.col("gpus_observed") == 0).withColumn(
        "anomaly_rate_finding", F.col("anomaly_rate") > 0.01
    ).withColumn("evidence", F.when(F.col("anomaly_rate_finding"), F.col("evidence"))).withColumn(
        "findings_total", F.col("no_gpus_finding").cast("int") + F.col("anomaly_rate_finding").cast("int")
    )


def gpus_observed(entries: DataFrame, start_us: int, end_us: int) -> DataFrame:
    return in_period(entries, start_us, end_us).filter("gpu_uuid is not null").select("gpu_uuid").distinct().orderBy("gpu_uuid")


def mean_time_to_detect(events: DataFrame, chunk_us: int = 86_400_000_000) -> DataFrame:
    """Per device: mean seconds from a probe failure to its first anomaly after it."""
    cols = ["gpu_uuid", "event_id", "ts_us"]
    anomalies = events.filter(
        F.col("event_type").isin("inference_anomaly", "training_anomaly", "invariant_violation")
    ).select(*cols)
    fails = events.filter("event_type = 'probe_fail'").select("gpu_uuid", "ts_us", "event_id")
    hit = asof(anomalies, fails, ["gpu_uuid"], "ts_us", chunk_us, "_f")
    first = hit.filter("_f is not null").groupBy("gpu_uuid", F.col("_f.event_id").alias("fail_id")).agg(
        F.min(F.col("ts_us") - F.col("_f.ts_us")).alias("_d")
    )
    return first.groupBy("gpu_uuid").agg((F.avg("_d") / 1e6).alias("mean_seconds"), F.count("*").alias("detections"))
