import hashlib

from fleetwatch.functions.sql import register


def test_functions_in_sql(spark):
    assert "tier" in register(spark)
    r = spark.sql(
        "SELECT reliability_score(a, b) AS r, tier(reliability_score(a, b)) AS t, chain_hash(CAST('x' AS BINARY), CAST('y' AS BINARY)) AS h, "
        "cosine_distance_estimate(64) AS c, month_key(TIMESTAMP '2024-02-03 00:00:00') AS m, belief_variance(1D, 1D) AS v "
        "FROM VALUES (90D, 10D) AS t(a, b)"
    ).first()
    assert (r.r, r.t, r.m) == (0.9, "CONDEMN", "2024_02")
    assert bytes(r.h) == hashlib.sha256(b"xy").digest()
    assert abs(r.c - 1) < 1e-12 and abs(r.v - 1 / 12) < 1e-12


def test_vector_functions_in_sql_equal_columns(spark):
    from pyspark.sql import functions as F

    from fleetwatch.functions import hashing as H
    from fleetwatch.functions import vectors as V

    register(spark)
    df = spark.sql("SELECT array(0.5D, 1D, -2D) AS a, array(0.2D, 0.7D, 0.1D) AS p, array(0.3D, 0.3D, 0.4D) AS q, unhex('00FF00FF00FF00FF8000000000000001') AS x, unhex('00FF00FF00FF00F00000000000000000') AS y, 5 AS i, -4 AS j, array(0D, 0D, 0D) AS z")
    both = df.select(
        F.expr("softmax(a)").alias("s1"), V.softmax(F.col("a")).alias("s2"), F.expr("kl_divergence(p, q)").alias("k1"), V.kl_divergence(F.col("p"), F.col("q")).alias("k2"),
        F.expr("jsd(p, q)").alias("j1"), V.jsd(F.col("p"), F.col("q")).alias("j2"), F.expr("logit_entropy(a)").alias("e1"), V.entropy(F.col("a")).alias("e2"),
        F.expr("relative_distance(p, q)").alias("r1"), V.relative_distance(F.col("p"), F.col("q")).alias("r2"), F.expr("relative_distance(p, z)").alias("z1"), V.relative_distance(F.col("p"), F.col("z")).alias("z2"),
        F.expr("hamming128(x, y)").alias("h1"), V.hamming128(F.col("x"), F.col("y")).alias("h2"), F.expr("differing_bits(i, j)").alias("d1"), H.differing_bits(F.col("i"), F.col("j")).alias("d2"),
    ).first()
    for k in "skjerzhd":
        assert both[f"{k}1"] == both[f"{k}2"], k
    assert both["h1"] == 6
