"""Vector columns. Short helpers are Spark expressions; the wide per-row statistics run
on whole Arrow batches in NumPy, which is far cheaper for vocabulary-sized arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ZERO = 0.0


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it inside `fn` (a lambda would redo it per element)."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(_ZERO), lambda s, x: s + x)


def softmax(a: Column) -> Column:
    def scaled(m: Column) -> Column:
        return let(F.transform(a, lambda x: F.exp(x - m)), lambda e: let(_sum(e), lambda s: F.transform(e, lambda x: x / s)))

    return let(F.array_max(a), scaled)


def kl_divergence(p: Column, q: Column) -> Column:
    """Nats, both clipped at 1e-30."""
    eps = F.lit(1e-30)

    def term(x: Column, y: Column) -> Column:
        a, b = F.greatest(x, eps), F.greatest(y, eps)
        return a * F.ln(a / b)

    return _sum(F.zip_with(p, q, term))


def jsd(p: Column, q: Column) -> Column:
    m = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return let(m, lambda mid: F.lit(0.5) * kl_divergence(p, mid) + F.lit(0.5) * kl_divergence(q, mid))


def entropy(logits: Column) -> Column:
    return let(softmax(logits), lambda p: -_sum(F.transform(p, lambda x: x * F.ln(F.greatest(x, F.lit(1e-30))))))


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(_ZERO), lambda s, x: s + x * x))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    n = l2_norm(a) * l2_norm(b)
    return F.when(n > 1e-12, dot(a, b) / n)


def relative_distance(a: Column, b: Column) -> Column:
    """|a - b| / |b|, absolute where |b| vanishes."""
    d = F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    return let(l2_norm(b), lambda n: F.when(n > 1e-12, d / n).otherwise(d))


def hf_energy_ratio(psd: Column, cutoff: float = 0.75) -> Column:
    total = _sum(psd)
    start = F.floor(F.size(psd) * F.lit(cutoff)).cast("int")
    high = _sum(F.slice(psd, start + 1, F.greatest(F.size(psd) - start, F.lit(0))))
    return let(total, lambda t: F.when(t < 1e-30, 0.0).otherwise(high / t))


def hamming128(a: Column, b: Column) -> Column:
    """Differing bits of two 16-byte fingerprints; NULL unless both are 16 bytes."""
    def half(x: Column, at: int) -> Column:
        return F.conv(F.hex(F.substring(x, at, 8)), 16, -10).cast("long")

    bits = F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))
    return F.when((F.octet_length(a) == 16) & (F.octet_length(b) == 16), bits)


def cosine_distance_estimate(hamming: Column) -> Column:
    return F.lit(1.0) - F.cos(F.lit(np.pi) * hamming / 128)


def top_tokens(logits: Column, k: int = 10) -> Column:
    """Indices of the k largest values, largest first."""
    ranked = F.sort_array(F.transform(logits, lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))), asc=False)
    return F.transform(F.slice(ranked, 1, k), lambda s: -s["i"])


def _by_length(s: pd.Series, fn: Callable[[np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """Apply `fn` to 2-D blocks of equal-length vectors; results by row position."""
    out: dict[int, np.ndarray] = {}
    lengths = s.map(lambda v: -1 if v is None else len(v)).to_numpy()
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        block = fn(np.stack([np.asarray(v, dtype=np.float64) for v in s.iloc[rows]]))
        out.update(zip(rows.tolist(), block, strict=True))
    return out


STATS = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("mean", "variance", "kurtosis", "minimum", "maximum", "entropy")]
)


@F.pandas_udf(STATS)
def logit_stats(logits: pd.Series) -> pd.DataFrame:
    """Mean, population variance, excess kurtosis, extremes and softmax entropy per row."""
    def block(x: np.ndarray) -> np.ndarray:
        mean = x.mean(axis=1)
        d = x - mean[:, None]
        var = (d**2).mean(axis=1)
        safe = np.where(var > 1e-15, var, 1.0)
        kurt = np.where(var > 1e-15, (d**4).mean(axis=1) / safe**2 - 3.0, 0.0)
        p = np.exp(x - x.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        ent = -(p * np.log(np.maximum(p, 1e-30))).sum(axis=1)
        return np.column_stack([mean, var, kurt, x.min(axis=1), x.max(axis=1), ent])

    found = _by_length(logits, block)
    names = STATS.fieldNames()
    empty = np.full(len(names), np.nan)
    return pd.DataFrame([found.get(i, empty) for i in range(len(logits))], columns=names)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def psd(x: pd.Series) -> pd.Series:
    """One-sided power spectrum: mean removed, Hann window, doubled inner bins."""
    def block(v: np.ndarray) -> np.ndarray:
        n = v.shape[1]
        s = np.abs(np.fft.rfft((v - v.mean(axis=1, keepdims=True)) * np.hanning(n), axis=1)) ** 2 / n
        s[:, 1 : -1 if n % 2 == 0 else None] *= 2.0
        return s

    found = _by_length(x, block)
    return pd.Series([found.get(i) for i in range(len(x))], index=x.index)


@F.pandas_udf(T.DoubleType())
def jsd_logits(a: pd.Series, b: pd.Series) -> pd.Series:
    """JSD of the softmax of two logit columns (blocks of equal length)."""
    return _pairwise(a, b, lambda p, q: 0.5 * _kl(p, (p + q) / 2) + 0.5 * _kl(q, (p + q) / 2))


@F.pandas_udf(T.DoubleType())
def kl_logits(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairwise(a, b, _kl)


def _kl(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    p, q = np.maximum(p, 1e-30), np.maximum(q, 1e-30)
    return (p * np.log(p / q)).sum(axis=1)


def _soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _pairwise(a: pd.Series, b: pd.Series, fn) -> pd.Series:
    out = np.full(len(a), np.nan)
    la, lb = a.map(len).to_numpy(), b.map(len).to_numpy()
    for n in np.unique(la[la == lb]):
        rows = np.flatnonzero((la == n) & (lb == n))
        out[rows] = fn(_soft(np.stack(a.iloc[rows].to_list())), _soft(np.stack(b.iloc[rows].to_list())))
    return pd.Series(out, index=a.index)


_PROJECTIONS: dict[tuple[int, int, int], np.ndarray] = {}


def _unit_projection(seed: int, rows: int, dim: int) -> np.ndarray:
    key = (seed, rows, dim)
    if key not in _PROJECTIONS:
        m = np.random.RandomState(seed ^ dim).randn(rows, dim).astype(np.float32)
        _PROJECTIONS[key] = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-10)
    return _PROJECTIONS[key]


def tensor_fingerprint(seed: int = 42) -> Callable[[Column], Column]:
    """16-byte fingerprint: 64 random projections, each cut to 2 bits, packed in order."""
    @F.pandas_udf(T.BinaryType())
    def fingerprint(x: pd.Series) -> pd.Series:
        def block(v: np.ndarray) -> np.ndarray:
            y = v.astype(np.float32) @ _unit_projection(seed, 64, v.shape[1]).T
            lo, hi = y.min(axis=1, keepdims=True), y.max(axis=1, keepdims=True)
            span = hi - lo
            flat = span < 1e-10
            q = np.where(flat, 0, np.clip(np.round((y - lo) / np.where(flat, 1, span) * 3), 0, 3)).astype(np.uint8)
            bits = np.stack([q >> 1, q & 1], axis=2).reshape(len(v), 128)
            return np.packbits(bits, axis=1)

        found = _by_length(x, block)
        return pd.Series([found[i].tobytes() if i in found else None for i in range(len(x))], index=x.index)

    return fingerprint


def partial_projection(dim: int, seed: int) -> Callable[[Column, Column], Column]:
    """Projection of one chunk of a long vector; sums over chunks project the whole.

    Each chunk draws its own block of the matrix from seed XOR chunk number, so no task
    ever needs the full matrix.
    """
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(values: pd.Series, chunk: pd.Series) -> pd.Series:
        out = []
        for v, c in zip(values, chunk, strict=True):
            key = (seed ^ int(c), dim, -len(v))
            if key not in _PROJECTIONS:
                if len(_PROJECTIONS) > 64:
                    _PROJECTIONS.clear()
                _PROJECTIONS[key] = np.random.RandomState(key[0]).randn(dim, len(v)).astype(np.float32)
            out.append(_PROJECTIONS[key] @ np.asarray(v, np.float32))
        return pd.Series([o.astype(np.float64) for o in out], index=values.index)

    return project


def vector_sum(groups, column: str, name: str, width: int):
    """Element-wise sum of a fixed-width array column per group (partial sums first)."""
    return groups.agg(F.array(*[F.sum(F.get(F.col(column), i)) for i in range(width)]).alias(name))


def sha256_of_floats(tolerance: float | None = None) -> Callable[[Column], Column]:
    """SHA-256 hex of the float32 bytes, after rounding to a tolerance if given."""
    @F.pandas_udf(T.StringType())
    def digest(x: pd.Series) -> pd.Series:
        import hashlib

        def one(v):
            a = np.asarray(v, np.float32)
            a = a if tolerance is None else (np.round(a / tolerance) * tolerance).astype(np.float32)
            return hashlib.sha256(a.tobytes()).hexdigest()

        return x.map(one)

    return digest
