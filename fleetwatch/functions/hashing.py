"""Hash expressions, Merkle roots, and bit-level comparisons."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZERO_HASH = "0" * 64  # 32 zero bytes, as hex


def sha256(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def chain_hash(data: Column, previous: Column) -> Column:
    """SHA-256 over payload bytes followed by the previous hash."""
    return sha256(F.concat(data, previous))


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))


def hmac_sha256(key: bytes, data: Column) -> Column:
    """HMAC composed from SHA-256, so it stays in generated code."""
    k = hashlib.sha256(key).digest() if len(key) > 64 else key
    k = k.ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in k))
    outer = F.lit(bytes(b ^ 0x5C for b in k))
    return sha256(F.concat(outer, sha256(F.concat(inner, data))))


def hmac_verify(key: bytes, data: Column, tag: Column) -> Column:
    return hmac_sha256(key, data) == tag


def _fold_pairs(leaves: Column) -> Column:
    """Root of at most 1024 leaves: ten rounds of pairing, an odd last node moves up."""
    def pair_up(nodes: Column, _: Column) -> Column:
        n = F.size(nodes)
        at = lambda i: F.get(nodes, i)
        paired = F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / 2).cast("int")),
            lambda i: F.when(i * 2 + 1 < n, sha256(F.concat(at(i * 2), at(i * 2 + 1)))).otherwise(at(i * 2)),
        )
        return F.when(n <= 1, nodes).otherwise(paired)

    return F.get(F.aggregate(F.sequence(F.lit(1), F.lit(10)), leaves, pair_up), 0)


def fold_pairs(nodes: list[bytes | None]) -> bytes | None:
    """As `_fold_pairs`, for a list inside a task; a missing node leaves all above it missing."""
    while len(nodes) > 1:
        paired = [None if a is None or b is None else hashlib.sha256(a + b).digest() for a, b in zip(nodes[::2], nodes[1::2])]
        nodes = paired + nodes[2 * len(paired):]
    return nodes[0]


def merkle_roots(df: DataFrame, keys: Sequence[str], position: str, leaf: str, rounds: int | None = None) -> DataFrame:
    """Merkle root per key over leaves in order (`position` counts from 0).

    Aligned blocks of 1024 leaves are whole subtrees, also with odd nodes moved up, so
    a root of roots is the root. Each round shrinks the data 1024-fold and no group
    exceeds 1024 rows, however large a key is. There are as many rounds as the largest
    position needs; that is measured unless `rounds` says it.
    """
    if rounds is None:
        last, rounds = df.agg(F.max(position)).first()[0] or 0, 1
        while last >= 1024**rounds:
            rounds += 1
    level = df.select(*keys, F.col(position).cast("long").alias("_p"), F.col(leaf).alias("_h"))
    for _ in range(rounds):
        level = (
            level.groupBy(*keys, F.floor(F.col("_p") / 1024).cast("long").alias("_b"))
            .agg(F.array_sort(F.collect_list(F.struct("_p", "_h"))).alias("_n"))
            .select(*keys, F.col("_b").alias("_p"), _fold_pairs(F.col("_n._h")).alias("_h"))
        )
    return level.select(*keys, F.col("_h").alias("merkle_root"))


def differing_bits(a: Column, b: Column) -> Column:
    """Bit positions (0 = lowest) where two 32-bit integers differ."""
    x = a.bitwiseXOR(b)
    return F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("getbit", x, i) == 1)


@F.pandas_udf(T.IntegerType())
def float_bits(v: pd.Series) -> pd.Series:
    return pd.Series(v.to_numpy(np.float32).view(np.int32), index=v.index)


@F.pandas_udf(T.LongType())
def _ordered_bits(v: pd.Series) -> pd.Series:
    bits = v.to_numpy(np.float32).view(np.int32).astype(np.int64)
    return pd.Series(np.where(bits < 0, -(bits & 0x7FFFFFFF), bits), index=v.index)


def ulp_distance(a: Column, b: Column) -> Column:
    """Steps between two float32 values; 0 for NaN with NaN and for +0 with -0; NULL
    where only one is NaN or the infinities differ."""
    inf = F.lit(float("inf"))
    odd = (F.isnan(a) != F.isnan(b)) | (((F.abs(a) == inf) | (F.abs(b) == inf)) & (a != b) & ~F.isnan(a))
    return F.when(F.isnan(a) & F.isnan(b), 0).when(odd, None).otherwise(F.abs(_ordered_bits(a) - _ordered_bits(b)))


def within_ulp(a: Column, b: Column, n: Column) -> Column:
    return F.coalesce(ulp_distance(a, b) <= n, F.lit(False))
