"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.llm.text import hex_unit
from fleetwatch.plans.cut import cut

#: A Poisson draw is a sum of draws with a mean of at most PART, each inverted on TERMS terms.
PART, TERMS = 16.0, 96


def rates(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5, rows: float | None = None) -> DataFrame:
    """Mean repetitions of each source: source, n_docs, rate.

    `weights`: the target share of each source, not necessarily summing to 1; sources that it
    doesn't name get none. Without it a source's share goes as its count to the power
    `exponent`. `rows`: expected rows in all (default: as many as there are now). A null
    source is a source of its own; in `weights` its key is None.
    """
    counted = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    if weights is None:
        share = F.pow(F.col("n_docs").cast("double"), F.lit(float(exponent)))
    else:
        share = F.lit(0.0)
        for k, v in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(k).cast("string")), F.lit(float(v))).otherwise(share)
    counted = cut(counted.withColumn("share", share))
    whole = counted.agg(F.sum("share"), F.sum("n_docs")).first()
    scale = (float(rows) if rows is not None else float(whole[1] or 0)) / (whole[0] or 1.0)
    return counted.select("source", "n_docs", (F.col("share") * F.lit(scale) / F.col("n_docs")).alias("rate"))


def distributions(rate: DataFrame) -> DataFrame:
    """Adds parts (how many draws are summed) and cdf (of one draw) to a table with a rate."""
    log_factorial = F.array(*[F.lit(math.lgamma(j + 1)) for j in range(TERMS)])
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    # Negative exponents first: a mean of zero gives all mass to zero.
    mass = F.transform(log_factorial, lambda f, j: F.when(F.col("mean") > 0, F.exp(-F.col("mean") + j * F.log("mean") - f)).otherwise((j == 0).cast("double")))
    sums = F.transform(F.sequence(F.lit(1), F.lit(TERMS)), lambda i: F.aggregate(F.slice("mass", 1, i), F.lit(0.0), lambda a, x: a + x))
    return rate.withColumn("parts", parts).withColumn("mean", F.col("rate") / F.col("parts")).withColumn("mass", mass).withColumn("cdf", sums).drop("mass", "mean")


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5, rows: float | None = None, seed: int = 7) -> DataFrame:
    """Every row of `docs` as often as its seeded Poisson draw says, in a global random order.

    All columns stay; `copy` (from 1), `n_copies` and `shuffle_key` come in addition and
    replace columns of these names. The draw depends on the seed and doc_id alone (rows that
    share an id share their draw; a null id counts as empty), so that a re-run repeats it.
    The rows are dealt out and sorted by `shuffle_key`, a hash of seed, id and copy.
    """
    docs = docs.drop("copy", "n_copies", "shuffle_key")
    # Written first: the size of the file, one row for each source, decides whether it is broadcast.
    table = cut(distributions(rates(docs, weights, exponent, rows))).select(F.col("source").alias("_source"), "parts", "cdf")
    draw = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda c: hex_unit(F.lit(seed), F.col("doc_id"), c))
    joined = docs.join(table, docs["source"].eqNullSafe(table["_source"])).withColumn("_u", draw)
    count = F.aggregate("_u", F.lit(0), lambda a, u: a + F.size(F.filter("cdf", lambda x: x <= u)))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed} order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    return (
        joined.withColumn("n_copies", count).where("n_copies > 0").select(*docs.columns, "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
        .withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    )


def mix_sql(exponent: float = 0.5, seed: int = 7, table: str = "documents") -> str:
    """The same rows in DuckDB's SQL, for shares by exponent."""
    unit = f"CAST(CAST('0x' || substr(md5(concat('{seed}|', coalesce(CAST(doc_id AS VARCHAR), ''), '|', part)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"
    return f"""
WITH rates AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), {float(exponent)}) AS share FROM {table} GROUP BY source),
means AS (SELECT source, share * (SUM(n) OVER () / SUM(share) OVER ()) / n AS rate FROM rates),
split AS (SELECT source, greatest(1, CAST(ceil(rate / {PART}) AS INTEGER)) AS parts, rate / greatest(1, CAST(ceil(rate / {PART}) AS INTEGER)) AS mean FROM means),
cdf AS (SELECT source, parts, j, sum(exp(-mean + j * ln(mean) - lgamma(j + 1))) OVER (PARTITION BY source ORDER BY j) AS c FROM split, range({TERMS}) t(j)),
tables AS (SELECT source, parts, list(c ORDER BY j) AS cdf FROM cdf GROUP BY ALL),
drawn AS (SELECT d.*, (SELECT sum(len(list_filter(t.cdf, lambda x: x <= {unit}))) FROM range(1, t.parts + 1) p(part)) AS k
  FROM {table} d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT * EXCLUDE (k), CAST(k AS INTEGER) AS n_copies, unnest(range(1, CAST(k AS BIGINT) + 1)) AS copy FROM drawn WHERE k > 0)
SELECT * EXCLUDE (copy), CAST(copy AS INTEGER) AS copy,
  CAST('0x' || substr(md5(concat('{seed} order|', coalesce(CAST(doc_id AS VARCHAR), ''), '|', copy)), 1, 15) AS BIGINT) AS shuffle_key FROM copies"""
