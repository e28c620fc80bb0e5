"""Near-duplicate texts: the Jaccard join of their word n-grams, vertically partitioned.

1. Every text becomes its set of n-gram hashes. Texts with equal sets are one class; what
   follows works on classes. All n-grams have one global order, rare before frequent; the
   frequencies come from counts in a fixed number of cells over all classes (an order only,
   any order is right).
2. Two sets that reach the threshold share an n-gram among the first few of each in that order
   (the prefix). Prefix n-grams of one class only are dropped: what is left are the lists
   of classes that may be linked.
3. Inside a list, pairs are compared by parity maps: each n-gram flips one bit, so that the
   bits in which two maps differ never outnumber the n-grams in which the sets differ. Pairs
   that differ too much by that bound are out. Large lists are cut into blocks, so a
   task sees two blocks at a time.
4. A pair that is left is counted exactly: the n-gram order is cut into fragments, overlaps
   are counted in each fragment apart, and summed over the fragments of the pair.
5. Not all pairs of a group are needed to know its component. In each round every class
   proposes its nearest partner outside its component (as in Boruvka's algorithm); in the last,
   every pair across components that step 3 leaves is counted. No link between components can
   be missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetwatch.llm import cells
from fleetwatch.llm.components import components
from fleetwatch.llm.text import blocks, mix, shingle_sets
from fleetwatch.plans.cut import cut, dropping, shared_path


#: So many set ids or keys of texts are sent to all tasks at most, to choose the n-grams that a round needs and the texts that go.
SENT = 200_000


@dataclass(frozen=True)
class JoinLimits:
    """n: words in an n-gram; percent: least Jaccard similarity. The rest only divides the work."""

    n: int = 5
    percent: int = 80
    fragments: int = 4
    block: int = 512
    rounds: int = 2


def _set_id(s: np.ndarray) -> int:
    """A hash of a set; equal sets have equal ids. As a signed 64-bit number."""
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))]))[0].astype(np.int64))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _texts(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Slices of a batch and the sets of its texts, a few megabytes of text at a time."""
    texts = [x or b"" for x in batch.column("text").to_pylist()]
    for i, j in blocks(texts, 4 << 20):
        yield i, j, shingle_sets(texts[i:j], n)


def _read_sets(n: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(cells.CELLS, np.uint64), set()
        for batch in batches:
            for i, j, sets in _texts(batch, n):
                ids = [_set_id(s) for s in sets]
                for k, s in zip(ids, sets):
                    if k not in seen:
                        seen.add(k)
                        np.add.at(counts, (s & np.uint64(cells.CELLS - 1)).astype(np.int64), np.uint64(1))
                size = j - i
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")[i:j], "text_key": batch.column("text_key")[i:j], "set": pa.array(ids, pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()),
                                                  "block": pa.nulls(size, pa.int64()), "counts": pa.nulls(size, pa.binary())})
        found = list(cells.rows(counts))
        size = len(found)
        yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(size, pa.int64()), "text_key": pa.nulls(size, pa.int64()), "set": pa.nulls(size, pa.int64()), "n": pa.nulls(size, pa.int64()),
                                          "block": pa.array([b for b, _ in found], pa.int64()), "counts": pa.array([c for _, c in found], pa.binary())})

    return read


def prefix(s: np.ndarray, frequency: np.ndarray, percent: int) -> np.ndarray:
    """The first n-grams of a set in the global order, as many as a link needs; ties at the end come along."""
    count = len(s) - -(-percent * len(s) // 100) + 1
    key = (frequency[(s & np.uint64(cells.CELLS - 1)).astype(np.int64)] << np.uint64(40)) | (s >> np.uint64(24))
    return s[key <= np.partition(key, count - 1)[count - 1]]


def _read_prefixes(limits: JoinLimits, frequency):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        order = frequency.value
        for batch in batches:
            for _, _, sets in _texts(batch, limits.n):
                grams, owners, sizes = [], [], []
                for s in sets:
                    if len(s) and (i := _set_id(s)) not in seen:
                        seen.add(i)
                        grams.append(prefix(s, order, limits.percent))
                        owners.append(np.full(len(grams[-1]), i, np.int64))
                        sizes.append(np.full(len(grams[-1]), len(s), np.int64))
                if grams:
                    yield pa.RecordBatch.from_pydict({"gram": pa.array(_signed(np.concatenate(grams))), "set": pa.array(np.concatenate(owners)), "n": pa.array(np.concatenate(sizes))})

    return read


def parity(s: np.ndarray) -> np.ndarray:
    """A map of at least two bits for each n-gram, and 256 at least; each n-gram flips one bit."""
    width = max(256, 1 << int(2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8))


def _read_parts(limits: JoinLimits, wanted, maps: bool):
    """For texts whose id falls in a wanted cell: the parity map of their set, or its n-grams by fragment."""
    shift = np.uint64(64 - (limits.fragments - 1).bit_length())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, seen = wanted.value, set()
        for batch in batches:
            ids = batch.column("doc_id").fill_null(-1).to_numpy()
            chosen = np.flatnonzero(there[(mix(ids.view(np.uint64)) & np.uint64(cells.CELLS - 1)).astype(np.int64)])
            if not len(chosen):
                continue
            for _, _, sets in _texts(batch.take(pa.array(chosen)), limits.n):
                out = {"set": [], "n": [], "fragment": [], "data": []}
                for s in sets:
                    if not len(s) or (i := _set_id(s)) in seen:
                        continue
                    seen.add(i)
                    if maps:
                        parts = [(-1, parity(s).tobytes())]
                    else:
                        edges = np.searchsorted(s >> shift, np.arange(limits.fragments + 1, dtype=np.uint64))
                        parts = [(k, s[edges[k] : edges[k + 1]].tobytes()) for k in range(limits.fragments) if edges[k + 1] > edges[k]]
                    for k, data in parts:
                        for name, value in zip(out, (i, len(s), k, data)):
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict({"set": pa.array(out["set"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "fragment": pa.array(out["fragment"], pa.int32()), "data": pa.array(out["data"], pa.binary())})

    return read


def _cell_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(cells.CELLS, np.uint64)
    for batch in batches:
        at = (mix(batch["doc_id"].to_numpy(np.int64).view(np.uint64)) & np.uint64(cells.CELLS - 1)).astype(np.int64)
        counts += np.bincount(at, minlength=cells.CELLS).astype(np.uint64)
    yield pd.DataFrame(list(cells.rows(counts)), columns=["block", "counts"])


def _fold(maps: list[bytes]) -> np.ndarray:
    """Parity maps of one width, that of the narrowest: halves of wider ones are laid over each other."""
    width = min(map(len, maps))
    out = np.empty((len(maps), width // 8), np.uint64)
    for i, m in enumerate(maps):
        x = np.frombuffer(m, np.uint64)
        while len(x) * 8 > width:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[i] = x
    return out


def _compare(limits: JoinLimits, every: bool):
    """Pairs of two blocks of a list that may reach the threshold and lie in different components."""
    p = limits.percent

    def pairs(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        maps = _fold(a["data"].tolist() + b["data"].tolist())
        ma, mb = maps[: len(a)], maps[len(a) :]
        sa, sb, na, nb = a["set"].to_numpy(), b["set"].to_numpy(), a["n"].to_numpy(), b["n"].to_numpy()
        ca, cb, tried = a["root"].to_numpy(), b["root"].to_numpy(), a["tried"].tolist()
        step = max(1, (1 << 20) // max(1, maps.shape[1] * len(b)))
        for i in range(0, len(a), step):
            j = slice(i, i + step)
            apart = np.bitwise_count(ma[j, None, :] ^ mb[None, :, :]).sum(axis=2, dtype=np.int64)
            both = na[j, None] + nb[None, :]
            # |A - B| + |B - A| is at most (1 - t) / (1 + t) of the sizes together.
            fits = ((100 + p) * apart <= (100 - p) * both) & (ca[j, None] != cb[None, :]) & (100 * na[j, None] >= p * nb[None, :]) & (100 * nb[None, :] >= p * na[j, None])
            if every:
                x, y = np.nonzero(fits)
                yield pd.DataFrame({"set": sa[j][x], "partner": sb[y], "score": np.zeros(len(x)), "size": na[j][x], "other": nb[y]})
                continue
            for k, t in enumerate(tried[j]):
                if t is not None and len(t):
                    fits[k] &= ~np.isin(sb, t)
            score = np.where(fits, apart / np.maximum(both, 1), np.inf)
            best = score.argmin(axis=1)
            low = score[np.arange(len(best)), best]
            ok = np.isfinite(low)
            yield pd.DataFrame({"set": sa[j][ok], "partner": sb[best[ok]], "score": low[ok], "size": na[j][ok], "other": nb[best[ok]]})

    def group(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        low, high = rows["low"].iloc[0], rows["high"].iloc[0]
        a = rows[rows["block"] == low]
        if low == high:
            yield from pairs(a, a)
        else:
            b = rows[rows["block"] == high]
            if len(a) and len(b):
                yield from pairs(a, b)
                if not every:
                    yield from pairs(b, a)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            key = rows[["gram", "low", "high"]].to_numpy()
            starts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1)) if len(rows) else [0]
            for i, j in zip(starts[:-1], starts[1:]):
                yield from group(rows.iloc[i:j])
            rest = rows.iloc[starts[-1] :]
        if rest is not None and len(rest):
            yield from group(rest)

    return run


def _overlap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        count = [len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True)) for a, b in zip(batch["left"], batch["right"])]
        yield batch.drop(columns=["left", "right"]).assign(overlap=np.array(count, np.int64))


def count_overlaps(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """a, b and the size of their intersection: counted in each fragment, then summed. pairs: a, b; fragments: set, fragment, data."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    kinds = "".join(f", {c} long" for c in rest)
    wanted = cut(pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b").alias("set"))).distinct())
    few = wanted.count() <= SENT
    fragments = fragments.join(F.broadcast(wanted) if few else wanted, "set", "left_semi")
    left = fragments.select(F.col("set").alias("a"), F.col("fragment").alias("_f"), F.col("data").alias("left"))
    right = fragments.select(F.col("set").alias("b"), "fragment", F.col("data").alias("right"))
    # Both joins are by set alone, so that the fragments are dealt out once for both.
    parts = pairs.join(left, "a").join(right, (pairs["b"] == right["b"]) & (F.col("_f") - F.col("fragment") == 0)).select("a", pairs["b"], *rest, "fragment", "left", "right")
    parts = parts.mapInPandas(_overlap, f"a long, b long{kinds}, fragment int, overlap long")
    return parts.groupBy("a", "b", *rest).agg(F.sum("overlap").alias("overlap"))


def _proposals(lists: DataFrame, maps: DataFrame, known: tuple[DataFrame, DataFrame] | None, limits: JoinLimits, every: bool) -> DataFrame:
    """Pairs that may be linked, across the components known so far.

    lists: gram, set, n; maps: set, data; known: node, root and set, tried, or None at the start.
    Maps come in last, when the lists inside one component are gone.
    """
    if known is None:
        rows = lists.withColumn("root", F.col("set")).withColumn("tried", F.array().cast("array<long>"))
        spread = lists.groupBy("gram").agg(F.count("*").alias("size"))
    else:
        rows = lists.join(known[0].withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
        spread = rows.groupBy("gram").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("size")).where("r0 < r1").select("gram", "size")
    rows = rows.join(spread, "gram")
    if known is not None:
        rows = rows.join(known[1], "set", "left")
    last = F.floor((F.col("size") - 1) / limits.block)
    rows = rows.join(maps, "set").withColumn("block", F.pmod(F.xxhash64("set"), last + 1)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.select("gram", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "set", "n", "root", "tried", "data")
    key = ["gram", "low", "high"]
    return rows.repartition(*key).sortWithinPartitions(*key).mapInPandas(_compare(limits, every), "set long, partner long, score double, size long, other long")


def classes(docs: DataFrame, limits: JoinLimits = JoinLimits()) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_key (a hash of the text), set and n of each document; and node, root of the classes that are linked with another."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    keyed = texts.withColumn("text_key", F.xxhash64("text"))
    first = cut(keyed.mapInArrow(_read_sets(limits.n), "doc_id long, text_key long, set long, n long, block long, counts binary"))
    members = first.where("block IS NULL").select("doc_id", "text_key", "set", "n")
    frequency = spark.sparkContext.broadcast(np.minimum(cells.gather(first.where("block IS NOT NULL").select("block", "counts")), np.uint64((1 << 24) - 1)))

    grams = texts.select("text").mapInArrow(_read_prefixes(limits, frequency), "gram long, set long, n long")
    each = Window.partitionBy("gram")
    shared = grams.withColumn("lo", F.min("set").over(each)).withColumn("hi", F.max("set").over(each)).where("lo < hi").select("gram", "set", "n").distinct()
    # Of sets whose sizes alone rule a link out, the ones without a neighbour in size go.
    sized = Window.partitionBy("gram").orderBy("n", "set")
    near = (100 * F.lag("n").over(sized) >= limits.percent * F.col("n")) | (100 * F.col("n") >= limits.percent * F.lead("n").over(sized))
    shared = cut(shared.withColumn("near", near).where("near").select("gram", "set", "n"))
    # Lists of the same classes propose the same pairs: one of them is enough.
    one = shared.groupBy("gram").agg(F.bit_xor(F.xxhash64("set")).alias("x"), F.sum(F.col("set").cast("decimal(38,0)")).alias("s"), F.count("*").alias("c")).groupBy("x", "s", "c").agg(F.min("gram").alias("gram"))
    lists = cut(shared.join(one.select("gram"), "gram"))

    def read(named: DataFrame, maps: bool) -> DataFrame:
        """Parts of the sets of some classes, each once, read from the text with the smallest id; a few others come along."""
        chosen = members.join(named, "set").groupBy("set").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL")
        wanted = spark.sparkContext.broadcast(cells.gather(chosen.select("doc_id").mapInPandas(_cell_counts, "block long, counts binary")) > 0)
        # Copies of a text may all have been read, as may others whose ids fall in a wanted cell.
        return cut(texts.mapInArrow(_read_parts(limits, wanted, maps), "set long, n long, fragment int, data binary").dropDuplicates(["set", "fragment"]))

    maps = read(lists.select("set").distinct(), True).select("set", "data")
    roots = spark.createDataFrame([], "node long, root long")
    fragments = links = known = tried = None
    for turn in range(limits.rounds + 1):
        every = turn == limits.rounds
        found = _proposals(lists, maps, known, limits, every)
        if not every:
            found = found.groupBy("set").agg(F.min_by(F.struct("partner", "size", "other"), F.struct("score", "partner")).alias("p")).select("set", "p.*")
        found = cut(found)
        if found.isEmpty():  # all pairs across components that may be linked have been counted
            break
        if fragments is None:  # a set that proposes nothing here has no partner at all
            named = found.select("set").distinct()
            fragments = read(named, False).select("set", "fragment", "data")
            lists = cut(lists.join(named, "set", "left_semi"))
        if not every:
            tries = found.select("set", F.array("partner").alias("tried"))
            tried = tries if tried is None else cut(tried.union(tries).groupBy("set").agg(F.flatten(F.collect_list("tried")).alias("tried")))  # one for each round at most
        first = F.col("set") < F.col("partner")
        pairs = found.select(F.least("set", "partner").alias("a"), F.greatest("set", "partner").alias("b"), F.when(first, F.col("size")).otherwise(F.col("other")).alias("na"), F.when(first, F.col("other")).otherwise(F.col("size")).alias("nb")).distinct()
        pairs = cut(pairs)
        both = count_overlaps(pairs, fragments)
        linked = both.where(100 * F.col("overlap") >= limits.percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select(F.col("a").alias("u"), F.col("b").alias("v"))
        # What is joined already is a star for each component.
        links = linked if links is None else linked.union(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
        roots = components(links)
        known = roots, tried
    return members, roots


def near_duplicates(docs: DataFrame, limits: JoinLimits = JoinLimits()) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each of `docs`.

    Null and empty texts have no n-grams and are linked with nothing: their component is
    themselves. Rows with a null doc_id get a component but never name one, and make no class
    of their own comparable. Repeated rows get a row each. Other columns aren't used.
    """
    members, roots = classes(docs, limits)
    rooted = members.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    rooted = cut(rooted.select("doc_id", "n", "root"))
    least = rooted.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")).where("size > 1").select("root", "least")
    joined = rooted.join(least, "root", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, limits: JoinLimits = JoinLimits()) -> DataFrame:
    """One row of each component, all columns: that with the smallest id, and of texts with that id the one with the smallest hash.

    Rows without an id stay, whatever they repeat. Rows without words are components of their own. Of rows that
    repeat an id and a text one stays. Two texts with one id are two documents, each judged by its own component.
    """
    spark = docs.sparkSession
    places = {kind: shared_path(spark, kind) for kind in ("lost", "repeated")}
    with dropping(spark):  # what the join wrote goes here; the keys stay
        members, roots = classes(docs, limits)
        rooted = members.where("doc_id IS NOT NULL").join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
        found = cut(rooted.groupBy("doc_id", "text_key", "n", "root").agg(F.count("*").alias("rows")))
        row = F.struct("doc_id", "text_key")
        best = found.where("n > 0").groupBy("root").agg(F.min(row).alias("best"))
        judged = cut(found.join(best, "root", "left").withColumn("lost", F.coalesce((F.col("n") > 0) & (row != F.col("best")), F.lit(False))))
        for kind, which in (("lost", "lost"), ("repeated", "NOT lost AND rows > 1")):
            judged.where(which).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).write.parquet(places[kind])
    lost, repeated = (spark.read.schema("_id long, _key long").parquet(path) for path in places.values())
    gone = lost.union(repeated)
    if gone.count() <= SENT:  # else the texts are dealt out to meet the keys
        gone, repeated = F.broadcast(gone), F.broadcast(repeated)
    key = ["_id", "_key"]
    keyed = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_key": F.xxhash64(F.col("text").cast("binary"))})
    single = keyed.join(gone, key, "left_anti")
    return single.select(*docs.columns).union(keyed.join(repeated, key, "left_semi").dropDuplicates(key).select(*docs.columns))
