"""Largest inner products by low-dimensional stable projections.

Vectors are made equally long by one more coordinate, so that the largest inner product with a
query is the smallest distance to it. A few Gaussian projections then shrink them: the squared
projected distance of a vector over its true one follows a chi-square law. Projected vectors are
dealt out to the leaves of a kd-tree. A query goes through its leaves and, in a leaf, through
the vectors in order of their projected distance, verifies each on the original vectors,
and stops when the chi-square law says that a vector at least as near as the k-th best found
would have shown up before with the wanted confidence.

The tree is split on a bounded sample (`sample` rows); every vector is indexed. Leaves
with many vectors are cut into blocks, so no task holds more than a block and a chunk
of queries. Equal vectors are one entry that keeps the k + 1 smallest ids, which is all that any
answer can need.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetwatch.plans.cut import cut


@dataclass(frozen=True)
class SearchLimits:
    """dims: projections (even); confidence: of the stopping test; first: leaves that give a query its first bound."""

    k: int = 20
    dims: int = 8
    confidence: float = 0.98
    leaf: int = 2048
    leaves: int = 1024
    block: int = 8192
    queries: int = 4096
    first: int = 2
    sample: int = 16384
    step: int = 256
    seed: int = 5


def chi_square(x: float, dims: int) -> float:
    """The chi-square law's distribution function for an even number of dimensions."""
    term, total = 1.0, 0.0
    for j in range(dims // 2):
        total += term
        term *= x / 2 / (j + 1)
    return 1 - math.exp(-x / 2) * total


def quantile(p: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dims) < p else (low, mid)
    return high


class Index:
    """Projection and kd-tree. Splits are stored as a heap: dimension and value of each inner node."""

    def __init__(self, width: int, norm: float, limits: SearchLimits):
        self.width, self.norm, self.limits = width, norm, limits
        self.matrix = np.random.default_rng(limits.seed).standard_normal((width + 1, limits.dims))
        self.depth, self.split, self.value = 0, np.zeros(0, np.int64), np.zeros(0)
        self.low = self.high = np.zeros((0, limits.dims))
        self.blocks = np.zeros(0, np.int64)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Indexed vectors: with the coordinate that makes all of one length."""
        more = np.sqrt(np.maximum(0.0, self.norm**2 - (x * x).sum(axis=1)))
        return x @ self.matrix[:-1] + more[:, None] * self.matrix[-1]

    def project_query(self, q: np.ndarray) -> np.ndarray:
        return (q * (self.norm / np.sqrt((q * q).sum(axis=1)))[:, None]) @ self.matrix[:-1]

    def build(self, sample: np.ndarray, depth: int) -> None:
        """Split the sample `depth` times at the median of its widest dimension."""
        self.depth = depth
        self.split, self.value = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        parts = {0: sample}
        for node in range((1 << depth) - 1):
            x = parts.pop(node)
            if len(x):
                self.split[node] = int((x.max(axis=0) - x.min(axis=0)).argmax())
                self.value[node] = float(np.median(x[:, self.split[node]]))
            right = x[:, self.split[node]] > self.value[node]
            parts[2 * node + 1], parts[2 * node + 2] = x[~right], x[right]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.split[node]] > self.value[node])
        return node - ((1 << self.depth) - 1)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared projected distance from each query to the box around each leaf's vectors; infinite for empty leaves."""
        out = np.empty((len(x), len(self.low)))
        for i in range(0, len(x), 1024):
            part = x[i : i + 1024, None, :]
            away = np.maximum(0.0, np.maximum(self.low[None] - part, part - self.high[None]))
            out[i : i + 1024] = (away * away).sum(axis=2)
        return np.where(np.isfinite(self.low[:, 0])[None, :], out, np.inf)


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and vec (double) of rows that take part: an id, a vector without nulls, of finite numbers, not all zero."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    fine = F.col("vec_id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return rows.where(fine)


def _search(index: Index, low: bool):
    """Search a block of a leaf for a chunk of queries; low: only what beats a query's bound."""
    limits = index.limits
    reach = quantile(limits.confidence, limits.dims)

    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "entry": [], "ids": [], "score": []}
        if len(points) and len(queries):
            x, q = np.stack(points["vec"].to_numpy()), np.stack(queries["vec"].to_numpy())
            px, pq, length = index.project(x), index.project_query(q), np.sqrt((q * q).sum(axis=1))
            entries, ids = points["entry"].to_numpy(), points["ids"].to_numpy()
            near = (pq * pq).sum(axis=1)[:, None] - 2 * pq @ px.T + (px * px).sum(axis=1)[None, :]
            k = limits.k + 1
            for i, (name, bound) in enumerate(zip(queries["query_id"], queries["bound"])):
                order = np.argsort(near[i])
                best, found = np.zeros(0), np.zeros(0, np.int64)
                worst = bound if low else -np.inf
                for at in range(0, len(order), limits.step):
                    # The k-th best distance so far; nothing beyond `reach` times it can matter with the wanted confidence.
                    apart = 2 * index.norm * (index.norm - worst / length[i])
                    if near[i][order[at]] > reach * max(apart, 0.0):
                        break
                    these = order[at : at + limits.step]
                    value = x[these] @ q[i]
                    good = value >= worst
                    best, found = np.concatenate((best, value[good])), np.concatenate((found, these[good]))
                    if len(best) > k:
                        top = np.lexsort((entries[found], -best))[:k]
                        best, found = best[top], found[top]
                    if len(best) >= k:
                        worst = max(worst, best.min())
                out["query_id"] += [name] * len(found)
                out["entry"] += entries[found].tolist()
                out["ids"] += [ids[j] for j in found]
                out["score"] += best.tolist()
        out["ids"] = pd.Series(out["ids"], dtype=object)
        return pd.DataFrame(out).astype({"query_id": "int64", "entry": "int64", "score": "float64"})

    return run


def search(vectors: DataFrame, queries: DataFrame, limits: SearchLimits = SearchLimits(), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k largest inner products among all other vectors.

    Scores are inner products of the original vectors in double precision; ties go to the
    smaller vec_id. A query isn't its own answer. Rows without an id and vectors that are null,
    zero, of another width than most, or hold nulls or non-finite numbers take no part.
    Queries and vectors that repeat an id count once. Empty input, empty result.
    """
    spark = vectors.sparkSession
    every = usable(vectors, vec_id, vector)
    facts = every.groupBy(F.size("vec").alias("width")).agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")).orderBy(F.desc("n"), F.desc("width")).first()
    result = "query_id long, rank int, vec_id long, score double"
    if facts is None:
        return spark.createDataFrame([], result)
    width = facts["width"]
    every = every.where(F.size("vec") == width)
    index = Index(width, math.sqrt(facts["norm"]), limits)

    # An entry for each different vector: the smallest ids are all that can be asked for.
    same = Window.partitionBy("vec").orderBy("vec_id")
    entries = cut(every.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= limits.k + 1).groupBy("vec").agg(F.array_sort(F.array_distinct(F.collect_list("vec_id"))).alias("ids")).withColumn("entry", F.element_at("ids", 1)))
    count = entries.count()
    depth = max(0, min(int(math.log2(limits.leaves)), int(math.log2(max(1.0, count / limits.leaf)))))
    sample = entries.orderBy(F.xxhash64(F.lit(limits.seed), "entry"), "entry").limit(limits.sample).select("vec").toPandas()
    index.build(index.project(np.stack(sample["vec"].to_numpy())), depth)
    shell = spark.sparkContext.broadcast(index)

    @F.pandas_udf("struct<leaf:long,low:array<double>>")
    def place(vec: pd.Series) -> pd.DataFrame:
        p = shell.value.project(np.stack(vec.to_numpy()))
        return pd.DataFrame({"leaf": shell.value.leaf(p), "low": list(p)})

    placed = cut(entries.withColumn("_p", place("vec")).select("entry", "ids", "vec", F.col("_p.leaf").alias("leaf"), F.col("_p.low").alias("p")))
    boxes = placed.groupBy("leaf").agg(F.count("*").alias("n"), *[f(F.col("p")[d]).alias(f"{k}{d}") for d in range(limits.dims) for k, f in (("a", F.min), ("b", F.max))]).collect()  # a row for each leaf
    index.low, index.high = np.full((1 << depth, limits.dims), np.inf), np.full((1 << depth, limits.dims), np.inf)
    index.blocks = np.ones(1 << depth, np.int64)
    for b in boxes:
        index.low[b["leaf"]], index.high[b["leaf"]] = [b[f"a{d}"] for d in range(limits.dims)], [b[f"b{d}"] for d in range(limits.dims)]
        index.blocks[b["leaf"]] = -(-b["n"] // limits.block)
    shell = spark.sparkContext.broadcast(index)
    counts = F.array(*[F.lit(int(x)) for x in index.blocks])

    asked = cut(usable(queries, vec_id, vector).where(F.size("vec") == width).groupBy("vec_id").agg(F.min("vec").alias("vec")).withColumnRenamed("vec_id", "query_id"))
    chunks = max(1, -(-asked.count() // limits.queries))
    points = placed.select("entry", "ids", "vec", "leaf", F.pmod(F.xxhash64("entry"), counts[F.col("leaf").cast("int")]).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    chosen = "query_id long, bound double, vec array<double>, leaf long"
    reach = quantile(limits.confidence, limits.dims)

    def leaves(bounded: bool):
        """The leaves that a query goes to: its nearest ones, then all others that the test doesn't rule out."""

        def run(batches):
            ix = shell.value
            for batch in batches:
                q = np.stack(batch["vec"].to_numpy()) if len(batch) else np.zeros((0, ix.width))
                away = ix.distances(ix.project_query(q))
                order = np.argsort(away, axis=1, kind="stable")
                rank = np.empty_like(order)
                np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
                if bounded:
                    apart = 2 * ix.norm * (ix.norm - batch["bound"].to_numpy() / np.sqrt((q * q).sum(axis=1)))
                    go = (rank >= ix.limits.first) & (away <= reach * np.maximum(apart, 0.0)[:, None])
                else:
                    go = rank < ix.limits.first
                i, leaf = np.nonzero(go & np.isfinite(away))
                yield pd.DataFrame({"query_id": batch["query_id"].to_numpy()[i], "bound": batch["bound"].to_numpy()[i], "vec": batch["vec"].to_numpy()[i], "leaf": leaf})

        return run

    def visit(bounds: DataFrame, bounded: bool) -> DataFrame:
        sent = bounds.mapInPandas(leaves(bounded), chosen)
        sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), counts[F.col("leaf").cast("int")] - 1))).withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
        key = ["leaf", "block", "chunk"]
        return points.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(_search(index, bounded), "query_id long, entry long, ids array<long>, score double")

    near = cut(visit(asked.withColumn("bound", F.lit(float("-inf"))), False))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry")
    k_th = near.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= limits.k + 1).groupBy("query_id").agg(F.min("score").alias("score"), F.count("*").alias("n"))
    bounds = asked.join(k_th, "query_id", "left").select("query_id", "vec", F.when(F.col("n") > limits.k, F.col("score")).otherwise(float("-inf")).alias("bound"))
    every = near.unionByName(visit(bounds, True)).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= limits.k + 1)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = every.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= limits.k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
