"""Shards by a two-pass external shuffle.

Pass one scatters whole records into buckets by a seeded hash and writes them, as the files of
one Spark shuffle; there are so many buckets that each holds about `bucket_bytes`. Pass two reads
a bucket, permutes it with Fisher and Yates' algorithm (Spark's `shuffle`, drawn for the bucket's
places) and writes its records into the shards. Buckets in order, each permuted, are one random
order of all records; shards are equal ranges of it, so their row counts differ by one at most.

Every record's bucket, and its place there, follow from its contents and the seed, so a repeated
task deals out the same records again. Only records so often repeated that they would make a
bucket large get a random bucket each; they are written with it before they are scattered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwatch.plans.cut import cut, shared_path

#: Bytes that a record takes in a bucket beside its text.
OVERHEAD = 64


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes, 0 for null, plus 1) and CRC-32 of each text; null ids stay null."""
    return docs.select(*_keys())


def _keys() -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")]


def assign_shards(docs: DataFrame, shards: int = 16, seed: int = 20240613, bucket_bytes: int = 32 << 20) -> DataFrame:
    """The shard and slot of each record, read back from written shards: doc_id, size, text_crc32, shard, slot.

    Slots count from 0 in each shard without gaps. An empty table gives an empty table; with
    fewer records than shards some shards are empty.
    """
    path, names = shared_path(docs.sparkSession, "shards"), ("into_shard", "into_slot")
    write_shards(docs, path, shards, seed, bucket_bytes, names)
    schema = docs.select("doc_id", "text", F.lit(0).alias(names[0]), F.lit(0).cast("long").alias(names[1])).schema
    back = docs.sparkSession.read.schema(schema).parquet(path)
    return back.select(*_keys(), F.col(names[0]).alias("shard"), F.col(names[1]).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 20240613, bucket_bytes: int = 32 << 20, names: tuple[str, str] = ("shard", "slot")) -> None:
    """Write all columns of `docs` as Parquet under `path`, a folder for each shard, rows of a file by slot.

    `names` are those of the shard's and the slot's column, which `docs` must not have.
    """
    if clash := {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} are there already: give other names")
    key = ["doc_id", "size", "text_crc32"]
    counted = cut(records(docs).groupBy(*key).agg(F.count("*").alias("n")))
    weight = (F.col("size") + OVERHEAD) * F.col("n")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(weight), F.lit(0))).first()
    rows, buckets = max(1, total[0]), max(4 * shards, -(-total[1] // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(buckets)).alias("bucket")

    held = docs.select(F.struct(*docs.columns).alias("row"), *_keys())
    plain = held.select("row", *key, bucket)
    sizes = counted.select(bucket, "n")
    hot = counted.where(weight > bucket_bytes).select(*[F.col(k).alias(f"_{k}") for k in key])  # one for each bucket at most
    if not hot.isEmpty():
        same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("size") == F.col("_size")) & (F.col("text_crc32") == F.col("_text_crc32"))
        often = cut(held.join(F.broadcast(hot), same, "left_semi").select("row", *key, F.floor(F.rand(seed) * buckets).alias("bucket")))
        plain = plain.join(F.broadcast(hot), same, "left_anti").union(often)
        sizes = counted.join(F.broadcast(hot), same, "left_anti").select(bucket, "n").union(often.groupBy("bucket").agg(F.count("*").alias("n")))

    sizes = sizes.groupBy("bucket").agg(F.sum("n").alias("n"))
    offsets = cut(sizes.select("bucket", "n", F.coalesce(F.sum("n").over(_before()), F.lit(0)).alias("offset")))
    # Buckets are sorted before places are drawn: a repeated task then draws the same ones.
    places = offsets.repartition(buckets, "bucket").sortWithinPartitions("bucket").select("bucket", "offset", F.shuffle(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), seed).alias("places"))
    # Records that are alike in key and contents may take each other's place.
    mixed = F.xxhash64(*[F.col("row")[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"])
    order = Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(seed), *key), *key, mixed)
    dealt = plain.repartition(buckets, "bucket").withColumn("nth", F.row_number().over(order))
    # Both sides lie by bucket already. The places of all records are no table to broadcast, small as they look.
    at = dealt.join(places.hint("merge"), "bucket").select("row", (F.col("offset") + F.get("places", F.col("nth") - 1)).alias("at"))
    at = at.withColumn("to", F.expr(f"at * {shards} div {rows}").cast("int"))
    out = at.select("row.*", F.col("to").alias(names[0]), F.expr(f"at - (to * {rows}L + {shards - 1}) div {shards}").alias(names[1]))
    out.sortWithinPartitions(*names).write.partitionBy(names[0]).parquet(path)



def _before():
    return Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one small row for each bucket
