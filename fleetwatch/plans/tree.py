"""Exact scans of recurrences whose steps compose: a tree of composed steps over chunks of each key's history.

Rows of a chunk are summed up as one map from the state before to the state after. Maps of FAN neighbouring chunks
compose to one, and so on up to a single map; going down again, each chunk gets its true start
and is replayed. No group holds more than one chunk's rows or FAN maps, whatever a key owns, and the
number of passes grows with the logarithm of the number of chunks only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatch.plans.cut import cut

FAN = 32
Row = tuple


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[Row, list[Row]]]:
    """Rows that share their first `width` values, which lie together; the last run of a batch may go on in the next one."""
    key, held = None, []
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns)))
        for k, run in groupby(rows, key=itemgetter(slice(0, width))):
            if k == key:
                held += run
                continue
            if held:
                yield key, held
            key, held = k, list(run)
    if held:
        yield key, held


def _mapped(df: DataFrame, fn: Callable[[Row, list[Row]], list[Row]], width: int, ddl: str) -> DataFrame:
    """`fn` over runs of rows that share their first `width` fields, which lie together."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[Row] = []

        def made() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * len(shape)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, shape)], schema=shape)

        for key, rows in _runs(batches, width):
            out += fn(key, rows)
            if len(out) > 10_000:
                yield made()
                out = []
        yield made()

    return df.mapInArrow(run, ddl)


def tree_scan(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    values: Sequence[str],
    chunk: Column,
    summed: Callable[[list[Row]], bytes],
    composed: Callable[[list[bytes]], bytes],
    applied: Callable[[bytes, bytes], bytes],
    replayed: Callable[[list[Row], bytes], list[Row]],
    start: bytes,
    out_schema: str,
) -> DataFrame:
    """Rows of every chunk as `replayed` from its true start, after the key columns.

    `summed` gives the map of a chunk's rows, `composed` that of maps in order, `applied`
    the state after a map from the state before it, and `start` is the state before a key's first row.
    Rows come as tuples of `order_by` and then `values`, in order.
    """
    keys, order_by, values = list(keys), list(order_by), list(values)
    n, rest = len(keys) + 1, [*order_by, *values]
    ids = [*keys, "_chunk"]
    data = cut(df.select(*keys, chunk.alias("_chunk"), *rest))
    types = dict(data.dtypes)
    ddl = ", ".join(f"`{c}` {types[c]}" for c in ids)
    owned = ", ".join(f"`{c}` {types[c]}" for c in keys)

    def dealt(frame: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
        return frame.select(*columns).repartition(*ids).sortWithinPartitions(*ids, *by)

    def leaf(key: Row, rows: list[Row]) -> list[Row]:
        return [(*key, summed([r[n:] for r in rows]))]

    def join(key: Row, rows: list[Row]) -> list[Row]:
        return [(*key, composed([r[n + 1] for r in rows]))]

    def down(key: Row, rows: list[Row]) -> list[Row]:
        state, out = rows[0][n + 2], []
        for r in rows:
            out.append((*key[:-1], r[n], state))
            state = applied(r[n + 1], state)
        return out

    def replay(key: Row, rows: list[Row]) -> list[Row]:
        return [(*key[:-1], *r) for r in replayed([r[n + 1 :] for r in rows], rows[0][n])]

    level = cut(_mapped(dealt(data, order_by, [*ids, *rest]), leaf, n, f"{ddl}, map binary"))
    low, high = level.agg(F.min("_chunk"), F.max("_chunk")).first()
    children, span = [], 0 if low is None else high - low + 1
    level = level.withColumn("_chunk", F.col("_chunk") - (low or 0))
    while True:  # a pass for each level of the tree
        children.append(level.withColumnRenamed("_chunk", "_child").withColumn("_chunk", F.floor(F.col("_child") / FAN)))
        span = -(-span // FAN)
        if span <= 1:
            break
        level = cut(_mapped(dealt(children[-1], ["_child"], [*ids, "_child", "map"]), join, n, f"{ddl}, map binary"))
    starts = children[-1].select(*ids).distinct().withColumn("state", F.lit(start))
    for level in reversed(children):
        at = level.join(starts, ids)
        starts = _mapped(dealt(at, ["_child"], [*ids, "_child", "map", "state"]), down, n, f"{ddl}, state binary")
    starts = cut(starts).withColumn("_chunk", F.col("_chunk") + (low or 0))
    return _mapped(dealt(data.join(starts, ids), order_by, [*ids, "state", *rest]), replay, n, f"{owned}, {out_schema}")
