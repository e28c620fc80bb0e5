"""Which terms set a source apart from its language, and how far sources are from each other.

A group is a (lang, source); each group and each language gives every kept term of the language a
smoothed share in billionths: p = 1 + floor(10^9 * (count + 1) / (N + V)). Two shares p and q differ by
f = floor((p - q)^2 / q). All of this is in whole numbers.

Terms of a group with the same (group count, lang count) have the same f, so f is taken once for
such a cell. Cells are ranked by f with their numbers of terms summed up, cells of equal f being one; only those
that reach into the asked ranks are expanded to their terms, in order of UTF-8 bytes.

Between two sources, most terms lie in one of them or in none. What they add depends on the
term's share in one source only, so it is summed over cells (share, number of terms) too; only terms that
both have are met pair by pair, inside tasks that keep nothing but a matrix of sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetwatch.plans.cut import cut

#: Documents of a language that must have a term.
LEAST_DOCS = 3
#: Ranks of terms listed for each group.
RANKS = 200
UNIT = 1_000_000_000
#: Different (lang, source, term) that a task holds before it hands on their counts.
HELD = 1_000_000
#: Sources of a language whose pairs are summed in one matrix; more are cut to tiles.
TILE = 512
#: Pairs of entries worked on at once.
STEP = 1 << 18

#: Upper-case letters to lower-case ones, other ASCII that is no letter to a blank.
_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and of all bytes beyond ASCII; A-Z lower-cased."""
    return text.translate(_FOLD).split()


def _count(bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Occurrences and documents of each (lang, source, term), summed over as much as a task holds."""
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                names = list(n)
                for at in range(0, len(names), 50_000):
                    some = names[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())],
                        names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for (lang, source), text in zip(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()), texts):
                found = Counter(terms(text))
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                n.update(found)
                docs.update(found.keys())
                size += len(n)
                if size > bound:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return run


def share(n: Column, total: Column, kinds: Column) -> Column:
    """p of a term seen n times; null without terms. Decimals, so that no product is cut off."""
    whole = (n + 1).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.lit(1).cast("long") + _div(whole, (total + kinds).cast("decimal(19,0)"))


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def gap(p: Column, q: Column) -> Column:
    """f of two shares: below 2^63 at any counts, as shares are at most 10^9 + 1."""
    return _div((p - q) * (p - q), q)


class Audit:
    """The counts of a corpus: kept terms by group, and the groups' and languages' totals."""

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS):
        """Columns text, lang, source; null counts as ''. Repeated rows are documents of their own."""
        read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
        parts = read.mapInArrow(_count(HELD), "lang string, source string, term binary, n long, docs long")
        # One shuffle by (lang, term) serves both sums.
        counted = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        whole = Window.partitionBy("lang", "term")
        kept = counted.withColumn("lang_n", F.sum("n").over(whole)).withColumn("in_docs", F.sum("docs").over(whole)).where(F.col("in_docs") >= least_docs)
        #: lang, source, term (UTF-8), n, lang_n, once (true in one row of each term of a language)
        self.kept = cut(kept.select("lang", "source", "term", "n", "lang_n", (F.col("source") == F.min("source").over(whole)).alias("once")))
        # N of the groups and languages, V of the languages.
        sums = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
        langs = self.kept.where("once").groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("lang_n").alias("lang_total"))
        every = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
        full = every.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "held", "kinds", "lang_total"])
        full = full.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
        zero = F.when(F.col("kinds") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kinds")))
        #: lang, source, total (N), held (its kept terms), kinds (V), lang_total, place (its number in the language), p0 (share of a term it lacks)
        self.groups = cut(full.withColumn("p0", zero))

    def top_terms(self, ranks: int = RANKS) -> DataFrame:
        """lang, source, item, value, rank: the kept terms a group has more of than its language, by f, to `ranks`."""
        cell = ["lang", "source", "n", "lang_n"]
        sized = self.kept.groupBy(*cell).agg(F.count("*").alias("many"))
        mine = sized.join(self.groups.select("lang", "source", "total", "kinds", "lang_total"), ["lang", "source"])
        mine = mine.withColumn("p", share(F.col("n"), F.col("total"), F.col("kinds"))).withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("kinds")))
        valued = mine.where("p > q").select(*cell, "many", gap(F.col("p"), F.col("q")).alias("value"))
        valued = cut(valued)
        group = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
        # No more than `ranks` different values can be needed, as each has a term.
        merged = valued.groupBy("lang", "source", "value").agg(F.sum("many").alias("many")).withColumn("k", F.row_number().over(group)).where(F.col("k") <= ranks)
        before = F.sum("many").over(group.rowsBetween(Window.unboundedPreceding, -1))
        needed = merged.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < ranks).select("lang", "source", "value")
        chosen = cut(valued.join(needed, ["lang", "source", "value"]).select(*cell, "value"))
        listed = self.kept.select(*cell, "term").join(chosen, cell)
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
        out = listed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
        return out.select("lang", "source", F.col("term").cast("string").alias("item"), "value", "rank")

    def pairs(self) -> DataFrame:
        """lang, source, item, value, rank: all other sources of the language, by f summed over its kept terms."""
        groups = self.groups.select("lang", "source", "place", "total", "held", "kinds", "p0")
        tiles = Window.partitionBy("lang")
        groups = groups.withColumn("tiles", F.floor(F.max("place").over(tiles) / TILE).cast("int") + 1).withColumn("tile", F.floor(F.col("place") / TILE).cast("int"))
        groups = cut(groups)
        entries = self.kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kinds")))
        # Terms that both sources have, less what the other parts assume of them. Each entry goes to the pairs of tiles that its source is in: one, up to TILE sources.
        dealt = entries.select("lang", "term", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"), F.struct("place", "p", "p0").alias("entry"))
        dealt = dealt.select("lang", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "term", "entry")
        lists = dealt.groupBy("lang", "low", "high", "term").agg(F.collect_list("entry").alias("entries")).where(F.size("entries") > 1)
        both = lists.select("lang", "low", "high", "entries").sortWithinPartitions("lang", "low", "high").mapInArrow(_matrices(TILE, STEP), "lang string, x int, y int, value long")
        # Terms that one source has, as if the other lacked all of them: by cells of equal shares, with the sources of one tile at a time.
        cells = entries.groupBy("lang", "source", "tiles", "place", "p", "p0").agg(F.count("*").alias("many"))
        cells = cells.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        other = groups.select("lang", F.col("tile").alias("with"), F.col("place").alias("o_place"), F.col("p0").alias("o_p0"))
        met = cells.join(other, ["lang", "with"]).where("place <> o_place")
        ways = F.array(
            F.struct(F.col("place").alias("x"), F.col("o_place").alias("y"), gap(F.col("p"), F.col("o_p0")).alias("f")),
            F.struct(F.col("o_place").alias("x"), F.col("place").alias("y"), gap(F.col("o_p0"), F.col("p")).alias("f")))
        single = met.select("lang", "many", F.explode(ways).alias("w")).groupBy("lang", F.col("w.x").alias("x"), F.col("w.y").alias("y")).agg(F.sum(F.col("w.f") * F.col("many")).alias("value"))
        # Terms that neither has: those of both are taken off twice here, and put back once in their own part.
        a, b = groups.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).alias("a"), groups.alias("b")
        met = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.with") == F.col("b.tile"))).where("a.place <> b.place")
        rest = F.col("a.kinds") - F.col("a.held") - F.col("b.held")
        none = F.coalesce(gap(F.col("a.p0"), F.col("b.p0")) * rest, F.lit(0))
        base = met.select(F.col("a.lang").alias("lang"), F.col("a.place").alias("x"), F.col("b.place").alias("y"), none.alias("value"))
        sums = base.union(single.select("lang", "x", "y", "value")).union(both).groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
        names = groups.select("lang", "place", "source")
        named = sums.join(names.select("lang", F.col("place").alias("x"), "source"), ["lang", "x"]).join(names.select("lang", F.col("place").alias("y"), F.col("source").alias("item")), ["lang", "y"])
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return named.select("lang", "source", "item", "value", rank.alias("rank"))


def _matrices(tile: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over terms of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0) for each ordered pair of sources that have the term.

        Rows come sorted by language and tiles, so one matrix of at most two tiles a side is held. Whole
        numbers wrap in 64 bits, which leaves a right sum right.
        """
        now: tuple | None = None
        sums = np.zeros((0, 0), np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            if now is None:
                return
            x, y = np.nonzero(sums)
            lang, low, high = now

            def place(k: np.ndarray) -> np.ndarray:
                return np.where(k < tile, low * tile + k, high * tile + k - tile).astype(np.int32)

            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x), pa.string()), pa.array(place(x)), pa.array(place(y)), pa.array(sums[x, y])], names=["lang", "x", "y", "value"])

        for batch in batches:
            langs, lows, highs = (batch.column(c).to_pylist() for c in ("lang", "low", "high"))
            lists = batch.column("entries")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.flatten()
            place, p, p0 = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            offsets = offsets - offsets[0]
            keys = list(zip(langs, lows, highs))
            at = 0
            while at < len(keys):
                to = at
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                if keys[at] != now:
                    yield from flush()
                    now = keys[at]
                    side = tile if now[1] == now[2] else 2 * tile
                    sums = np.zeros((side, side), np.int64)
                _, low, high = now
                begin, end = offsets[at], offsets[to]
                local = np.where(place[begin:end] // tile == low, place[begin:end] - low * tile, tile + place[begin:end] - high * tile)
                _add(sums, local, p[begin:end], p0[begin:end], offsets[at : to + 1] - begin, low != high, tile, step)
                at = to
        yield from flush()

    return run


def _add(sums: np.ndarray, place: np.ndarray, p: np.ndarray, p0: np.ndarray, offsets: np.ndarray, crossed: bool, tile: int, step: int) -> None:
    """Adds all ordered pairs inside each list; between two tiles only pairs that lie in both."""
    sizes = np.diff(offsets)
    per_entry = np.repeat(sizes, sizes)
    first = np.repeat(offsets[:-1], sizes)
    upto = np.cumsum(per_entry)
    at = 0
    while at < len(place):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + step, "right")))
        n = per_entry[at:to]
        x = np.repeat(np.arange(at, to), n)
        y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:to], n)
        wanted = (place[x] < tile) != (place[y] < tile) if crossed else x != y
        x, y = x[wanted], y[wanted]

        def f(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            d = a - b
            return d * d // b

        np.add.at(sums, (place[x], place[y]), f(p[x], p[y]) - f(p[x], p0[y]) - f(p0[x], p[y]) + f(p0[x], p0[y]))
        at = to


def audit(docs: DataFrame, ranks: int = RANKS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank for every group of `docs`.

    Null text, lang and source count as ''. A language without kept terms has pairs of value 0 and no
    terms. An empty table has no rows; columns other than text, lang and source aren't read.
    """
    found = Audit(docs, least_docs)
    parts = [frame.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")) for name, frame in (("pair", found.pairs()), ("term", found.top_terms(ranks)))]
    return parts[0].union(parts[1])


def audit_sql(ranks: int = RANKS, least_docs: int = LEAST_DOCS) -> str:
    """The same rows in DuckDB's SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{upper}', '{lower}') AS text FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= {least_docs}),
mine AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
langs AS (SELECT lang, count(*) AS kinds, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM mine GROUP BY lang, source),
groups AS (SELECT DISTINCT lang, source FROM docs),
full_groups AS (SELECT g.lang, g.source, coalesce(t.total, 0) AS total, coalesce(l.kinds, 0) AS kinds, coalesce(l.total, 0) AS lang_total
  FROM groups g LEFT JOIN totals t ON g.lang = t.lang AND g.source = t.source LEFT JOIN langs l ON g.lang = l.lang),
shares AS (SELECT g.lang, g.source, k.term, coalesce(m.n, 0) AS n, 1 + ({UNIT}::HUGEINT * (coalesce(m.n, 0) + 1)) // (g.total + g.kinds) AS p, 1 + ({UNIT}::HUGEINT * (k.n + 1)) // (g.lang_total + g.kinds) AS q
  FROM full_groups g JOIN kept k ON g.lang = k.lang LEFT JOIN mine m ON m.lang = g.lang AND m.source = g.source AND m.term = k.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
ranked AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // q DESC, term) AS rank FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL SELECT lang, source, 'term' AS part, item, value, rank::INTEGER AS rank FROM ranked WHERE rank <= {ranks}
"""
