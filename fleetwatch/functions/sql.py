"""The scalar functions as temporary SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from fleetwatch.config import BeliefConfig


def _let(value: str, name: str, body: str) -> str:
    """`body` with a name for a value that is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _sum(a: str) -> str:
    return f"aggregate({a}, 0D, (s, x) -> s + x)"


def _norm(a: str) -> str:
    return f"sqrt(aggregate({a}, 0D, (s, x) -> s + x * x))"


def _softmax(a: str) -> str:
    scaled = _let(f"transform({a}, x -> exp(x - m))", "e", _let(_sum("e"), "t", "transform(e, x -> x / t)"))
    return _let(f"array_max({a})", "m", scaled)


def _kl(p: str, q: str) -> str:
    return _sum(f"zip_with({p}, {q}, (x, y) -> greatest(x, 1e-30D) * ln(greatest(x, 1e-30D) / greatest(y, 1e-30D)))")


def _half(a: str, at: int) -> str:
    return f"CAST(conv(hex(substring({a}, {at}, 8)), 16, -10) AS BIGINT)"


def register(spark: SparkSession, cfg: BeliefConfig = BeliefConfig()) -> list[str]:
    """Create the functions and return their names. Bodies are inlined by the optimizer."""
    bodies = {
        "reliability_score(alpha DOUBLE, beta DOUBLE) RETURNS DOUBLE":
            "CASE WHEN alpha + beta > 0 THEN alpha / (alpha + beta) ELSE 0.5D END",
        "belief_variance(alpha DOUBLE, beta DOUBLE) RETURNS DOUBLE":
            "CASE WHEN alpha + beta > 0 THEN alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)) "
            "ELSE 1.7976931348623157E308D END",
        "tier(score DOUBLE) RETURNS STRING":
            f"CASE WHEN score < {cfg.condemn_below}D THEN 'CONDEMN' WHEN score < {cfg.quarantine_below}D THEN 'QUARANTINE' "
            f"WHEN score < {cfg.suspect_below}D THEN 'SUSPECT' WHEN score < {cfg.increased_probing_below}D "
            "THEN 'INCREASED_PROBING' ELSE 'HEALTHY' END",
        "chain_hash(data BINARY, previous BINARY) RETURNS BINARY": "unhex(sha2(concat(data, previous), 256))",
        "cosine_distance_estimate(hamming INT) RETURNS DOUBLE": "1 - cos(pi() * hamming / 128)",
        "month_key(ts TIMESTAMP) RETURNS STRING": "date_format(ts, 'yyyy_MM')",
        "softmax(a ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>": _softmax("a"),
        "kl_divergence(p ARRAY<DOUBLE>, q ARRAY<DOUBLE>) RETURNS DOUBLE": _kl("p", "q"),
        "jsd(p ARRAY<DOUBLE>, q ARRAY<DOUBLE>) RETURNS DOUBLE":
            _let("zip_with(p, q, (x, y) -> (x + y) / 2)", "mid", f"0.5D * {_kl('p', 'mid')} + 0.5D * {_kl('q', 'mid')}"),
        "logit_entropy(a ARRAY<DOUBLE>) RETURNS DOUBLE": "-" + _sum(f"transform({_softmax('a')}, x -> x * ln(greatest(x, 1e-30D)))"),
        "relative_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE":
            _let(_norm("b"), "n", f"{_norm('zip_with(a, b, (x, y) -> x - y)')} / CASE WHEN n > 1e-12D THEN n ELSE 1D END"),
        "hamming128(a BINARY, b BINARY) RETURNS INT":
            "CASE WHEN octet_length(a) = 16 AND octet_length(b) = 16 THEN "
            + " + ".join(f"bit_count({_half('a', at)} ^ {_half('b', at)})" for at in (1, 9)) + " END",
        "differing_bits(a INT, b INT) RETURNS ARRAY<INT>": "filter(sequence(0, 31), i -> getbit(a ^ b, i) = 1)",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in bodies]
