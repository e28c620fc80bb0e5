"""Connected components: local contraction, and alternating large and small stars between tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.plans.cut import cut

#: Edges that one task contracts.
LOCAL = 500_000


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of one task as stars: each node with the smallest node it is linked with there."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist()):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    out = pd.DataFrame({"u": pd.Series(nodes, dtype="int64"), "v": pd.Series([find(x) for x in nodes], dtype="int64")})
    yield out[out["u"] != out["v"]]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v): each node hands its larger (or smaller) neighbours to its smallest one."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node it is linked with) for every node on an edge (u, v); no edges, no rows.

    Each task first contracts up to LOCAL edges of its own to stars; star steps join what
    several tasks hold. The number of rounds grows with the logarithm of the longest path.
    Minima are taken by partial aggregation, so that a node with very many neighbours is no
    group of one task.
    """
    now = cut(edges.where("u <> v").select("u", "v"))
    mark = None
    while True:
        parts = max(1, -(-now.count() // LOCAL))
        now = now.coalesce(parts).mapInPandas(_forest, "u long, v long")
        if parts > 1:
            now = cut(_star(_star(now, True), False).distinct())
            state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        else:
            now = cut(now)
        if parts == 1 or state == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = state
