"""Ordered computations over a key's history that never put a whole key in one task.

A history is cut into chunks (a column that grows with the order, such as a time
bucket). Each (key, chunk) is scanned on its own; a small table of per-chunk totals,
combined in chunk order, carries the state across chunks. The totals are partially
aggregated before their shuffle, so a key that owns a third of the input costs no
more than the same rows spread over many keys.

Key columns must not be NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwatch.plans.cut import cut

Aggs = Mapping[str, tuple[str, Column]]


def time_chunk(ts_us: str | Column, width_us: int) -> Column:
    c = F.col(ts_us) if isinstance(ts_us, str) else ts_us
    return F.floor(c / F.lit(width_us)).cast("long")


def _over(kind: str, name: str, frame) -> Column:
    c = F.col(name)
    if kind == "last":
        return F.last(c, ignorenulls=True).over(frame)
    return getattr(F, kind)(c).over(frame)


def _total(kind: str, name: str, order_by: Sequence[str]) -> Column:
    c = F.col(name)
    if kind == "last":
        return F.max_by(c, F.when(c.isNotNull(), F.struct(*order_by)))
    return getattr(F, kind)(c)


def _combine(kind: str, local: Column, before: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before + local, local, before)
    if kind == "max":
        return F.greatest(local, before)
    if kind == "min":
        return F.least(local, before)
    return F.coalesce(local, before)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    chunk: Column,
    aggs: Aggs,
    *,
    peers: bool = False,
    exclusive: bool = False,
) -> DataFrame:
    """Add running `sum`, `max`, `min` or `last` (last non-null) columns per key.

    `peers` includes every row with the same order value (one numeric order column);
    `exclusive` stops before the current row.
    """
    base = df.select("*", chunk.alias("_chunk"), *[e.alias(f"_v_{n}") for n, (_, e) in aggs.items()])
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order_by)
    if peers:
        w = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    else:
        w = w.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    local = base.select("*", *[_over(k, f"_v_{n}", w).alias(f"_l_{n}") for n, (k, _) in aggs.items()])
    totals = base.groupBy(*keys, "_chunk").agg(
        *[_total(k, f"_v_{n}", order_by).alias(f"_t_{n}") for n, (k, _) in aggs.items()]
    )
    cw = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *keys, "_chunk", *[_over(k, f"_t_{n}", cw).alias(f"_p_{n}") for n, (k, _) in aggs.items()]
    )
    out = local.join(before, [*keys, "_chunk"], "left")
    cols = [c for c in df.columns if c not in aggs]
    return out.select(
        *cols, *[_combine(k, F.col(f"_l_{n}"), F.col(f"_p_{n}")).alias(n) for n, (k, _) in aggs.items()]
    )


def sliding_sums(
    df: DataFrame,
    keys: Sequence[str],
    ts_us: str,
    width_us: int,
    chunk_us: int,
    amounts: Mapping[str, Column],
    cumulative: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Sum of each amount over the key's rows in [ts - width, ts], for every row.

    Each contributing row enters at ts and leaves just after ts + width; a running
    sum over those marks gives the frame value. The work is linear in the rows,
    while a sliding window frame recomputes the frame for each row. Amounts must be
    exact types (integers or decimals). `cumulative` sums are over all rows up to ts.
    """
    cumulative = cumulative or {}
    touched = reduce(
        lambda a, b: a | b, [F.coalesce(e != F.lit(0), F.lit(False)) for e in amounts.values()]
    )
    enter = F.struct(F.lit(1).alias("sign"), F.col(ts_us).alias("at"))
    leave = F.struct(F.lit(-1).alias("sign"), (F.col(ts_us) + F.lit(width_us + 1)).alias("at"))
    marked = df.select(
        "*", F.explode(F.when(touched, F.array(enter, leave)).otherwise(F.array(enter))).alias("_m")
    ).select("*", F.col("_m.at").alias("_at"), F.col("_m.sign").alias("_sign"))
    aggs: dict[str, tuple[str, Column]] = {
        n: ("sum", F.when(F.col("_sign") == 1, F.coalesce(e, F.lit(0))).otherwise(-F.coalesce(e, F.lit(0))))
        for n, e in amounts.items()
    }
    aggs |= {
        n: ("sum", F.when(F.col("_sign") == 1, F.coalesce(e, F.lit(0))).otherwise(F.lit(0)))
        for n, e in cumulative.items()
    }
    out = running(marked, keys, ["_at"], time_chunk("_at", chunk_us), aggs, peers=True)
    return out.filter(F.col("_sign") == 1).drop("_m", "_at", "_sign")


def sliding_counts(df, keys, ts_us, width_us, chunk_us, flags: Mapping[str, Column], cumulative=None) -> DataFrame:
    """`sliding_sums` of boolean flags."""
    as_int = {n: F.coalesce(c, F.lit(False)).cast("int") for n, c in flags.items()}
    cum = {n: F.coalesce(c, F.lit(False)).cast("int") for n, c in (cumulative or {}).items()}
    return sliding_sums(df, keys, ts_us, width_us, chunk_us, as_int, cum)


def distinct_in_window(
    df: DataFrame,
    keys: Sequence[str],
    item: str,
    ts_us: str,
    tie: str,
    width_us: int,
    chunk_us: int,
    flag: Column,
    name: str,
) -> DataFrame:
    """Distinct `item` values among the key's flagged rows in [ts - width, ts], per row.

    A flagged row keeps its item in the frame for `width`; the part already covered
    by the item's previous flagged row is cut off, so the pieces of one item never
    overlap and their running count is the distinct count.
    """
    hits = df.filter(flag & F.col(item).isNotNull()).select(*keys, item, ts_us, tie)
    prev = running(
        hits, [*keys, item], [ts_us, tie], time_chunk(ts_us, chunk_us),
        {"_prev": ("max", F.col(ts_us))}, exclusive=True,
    )
    end = F.col(ts_us) + F.lit(width_us + 1)
    start = F.greatest(F.col(ts_us), F.col("_prev") + F.lit(width_us + 1))
    marks = prev.select(
        *keys,
        F.explode(
            F.array(
                F.struct(start.alias("at"), F.lit(1).alias("d")),
                F.struct(end.alias("at"), F.lit(-1).alias("d")),
            )
        ).alias("_m"),
    ).select(*keys, F.col("_m.at").alias("_at"), F.col("_m.d").alias("_d"), F.lit(False).alias("_row"))
    rows = df.select("*", F.col(ts_us).alias("_at"), F.lit(0).alias("_d"), F.lit(True).alias("_row"))
    u = rows.unionByName(marks, allowMissingColumns=True)
    out = running(u, keys, ["_at"], time_chunk("_at", chunk_us), {name: ("sum", F.col("_d"))}, peers=True)
    return out.filter("_row").drop("_at", "_d", "_row")


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    ts_us: str,
    chunk_us: int,
    value: str,
    *,
    lag_us: int = 0,
    within_us: int | None = None,
    tie: str | None = None,
) -> DataFrame:
    """Give each left row the latest right row of the same key at or before ts - lag.

    The matched right columns arrive as one struct column `value`.
    """
    payload = F.struct(*[c for c in right.columns if c not in keys])
    r = right.select(
        *keys, F.col(ts_us).alias("_at"), F.lit(0).alias("_side"),
        (F.col(tie) if tie else F.lit(0)).cast("string").alias("_tie"), payload.alias("_hit"),
    )
    lft = left.select(
        "*", (F.col(ts_us) - F.lit(lag_us)).alias("_at"), F.lit(1).alias("_side"), F.lit("").alias("_tie")
    )
    u = lft.unionByName(r, allowMissingColumns=True)
    out = running(
        u, keys, ["_at", "_side", "_tie"], time_chunk("_at", chunk_us), {value: ("last", F.col("_hit"))}
    ).filter(F.col("_side") == 1)
    if within_us is not None:
        hit = F.col(value)
        out = out.withColumn(
            value, F.when(hit[ts_us] >= F.col(ts_us) - F.lit(within_us), hit)
        )
    return out.drop("_at", "_side", "_tie", "_hit")


def positions(df: DataFrame, order_by: Sequence[str], name: str) -> DataFrame:
    """Number all rows from 0 in the order of `order_by`, whose values together must be distinct.

    Spark samples splitters and deals the rows out by ranges of about equal size; each range is sorted and numbered by
    itself, and the counts of the ranges before it are added. So the work spreads however the values
    lie, also if all rows have one time. The dealt rows are written with their own numbers, as a range belongs to one
    run of the sampling; the result reads them once and shuffles nothing, so it needs no further cut.
    """
    ranges = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    # Increasing ids are consecutive inside a partition.
    dealt = cut(ranges.withColumns({"_range": F.spark_partition_id(), "_own": F.monotonically_increasing_id()}))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_size"), F.min("_own").alias("_first"))  # a row for each range
    before = F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = cut(sizes.select("_range", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_start")))
    return dealt.join(starts, "_range").select(*df.columns, (F.col("_start") + F.col("_own")).cast("long").alias(name))
