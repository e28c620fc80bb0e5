"""Exact order statistics and neighbours without a whole group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwatch.plans.cut import cut


def bucket_of(value: Column, splitters: Column, levels: int = 8) -> Column:
    """How many of the sorted `splitters` (fewer than 2 ** levels) are at most `value`, by halving."""
    step = F.array(*[F.lit(1 << k) for k in reversed(range(levels))])
    return F.aggregate(step, F.lit(0), lambda at, s: F.when(F.get(splitters, at + s - 1) <= value, at + s).otherwise(at))


def splitters(value: Column, buckets: int = 256) -> Column:
    """An aggregate: up to `buckets` - 1 sorted values that cut a group's rows into about equal parts, from Spark's quantile sketch.

    Outliers and infinities get no wider part than other values, as the cuts lie between rows and not between numbers.
    """
    return F.array_distinct(F.percentile_approx(value, [k / buckets for k in range(1, buckets)], 20 * buckets))


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, positions: Mapping[str, Column]) -> DataFrame:
    """Exact values at 0-based sorted positions per key.

    Each position is an expression over `n` (the group's row count). Three passes, each
    partially aggregated before its shuffle: splitters per key from a quantile sketch; row counts in the
    buckets between them, which locate every position; and value counts inside the buckets hit, a
    small share of the rows. The input is never shuffled as a whole or sorted by group.
    The splitters are written, as a sketch made anew from parts merged in another order gives other buckets.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_x"))
    span = cut(rows.groupBy(*keys).agg(splitters(F.col("_x")).alias("_cuts"), F.count("*").alias("n")))  # one row per group
    placed = rows.join(span, list(keys)).withColumn("_b", bucket_of(F.col("_x"), F.col("_cuts"))).drop("_cuts")
    per_bucket = placed.groupBy(*keys, "n", "_b").agg(F.count("*").alias("_bn"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.explode(
        F.array(*[F.struct(F.lit(k).alias("name"), e.cast("long").alias("pos")) for k, e in positions.items()])
    )
    hit = (
        per_bucket.withColumn("_before", F.coalesce(F.sum("_bn").over(w), F.lit(0)))
        .select(*keys, "_b", "_bn", "_before", wanted.alias("_p"))
        .filter((F.col("_p.pos") >= F.col("_before")) & (F.col("_p.pos") < F.col("_before") + F.col("_bn")))
        .groupBy(*keys, "_b", "_before")
        .agg(F.collect_list("_p").alias("_ps"))
    )
    inner = Window.partitionBy(*keys, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    counted = placed.join(hit.select(*keys, "_b"), [*keys, "_b"], "left_semi").groupBy(*keys, "_b", "_x").agg(
        F.count("*").alias("_n")
    )
    found = (
        counted.withColumn("_in", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
        .join(hit, [*keys, "_b"])
        .withColumn("_start", F.col("_before") + F.col("_in"))
        .select(*keys, "_x", "_n", "_start", F.explode("_ps").alias("_p"))
        .filter((F.col("_p.pos") >= F.col("_start")) & (F.col("_p.pos") < F.col("_start") + F.col("_n")))
    )
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_p.name") == k, F.col("_x"))).alias(k) for k in positions]
    )


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact median per key (mean of the two middle values for an even count)."""
    n = F.col("n")
    two = order_statistics(df, keys, value, {"_m1": F.floor((n - 1) / 2), "_m2": F.floor(n / 2)})
    return two.select(*keys, ((F.col("_m1") + F.col("_m2")) / 2).alias(name))


def with_previous(df: DataFrame, order: str, fields: Sequence[str], width: int = 65_536, group: int = 4_096) -> DataFrame:
    """Add `prev_<field>` from the row before in the order of a BIGINT id column.

    Rows are cut into id ranges; the first row of a range takes the tail of the last
    non-empty range before it. Tails are grouped again, so the only unpartitioned
    window sees one row per `width * group` ids.
    """
    row = F.struct(*fields)
    base = df.withColumn("_c", F.floor(F.col(order) / F.lit(width)).cast("long"))
    w = Window.partitionBy("_c").orderBy(order)
    local = base.withColumn("_pl", F.lag(row).over(w))
    tails = base.groupBy("_c").agg(F.max_by(row, F.col(order)).alias("_tail")).withColumn(
        "_g", F.floor(F.col("_c") / F.lit(group)).cast("long")
    )
    in_group = tails.withColumn("_tp", F.lag("_tail").over(Window.partitionBy("_g").orderBy("_c")))
    ends = tails.groupBy("_g").agg(F.max_by("_tail", "_c").alias("_end")).select(
        "_g", F.lag("_end").over(Window.orderBy("_g")).alias("_gp")
    )
    carry = in_group.join(ends, "_g").select("_c", F.coalesce("_tp", "_gp").alias("_carry"))
    out = local.join(carry, "_c").withColumn("_prev", F.coalesce("_pl", "_carry"))
    return out.select(*df.columns, *[F.col("_prev")[f].alias(f"prev_{f}") for f in fields])
