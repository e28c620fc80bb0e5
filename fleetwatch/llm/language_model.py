"""An interpolated modified Kneser-Ney model of word pairs.

Training: tasks count pairs (word before, word) of a slice of texts and pack the counts, cut by
the high bits of the first word's hash. Spark deals the packs out by cell; each cell is merged
into arrays sorted by hash and written to files of the shared folder. Cells in order are one
sorted array, so the cell of a hash tells the file and a binary search the place. There are as
many cells as keep each small enough for a task.

Use: workers map the files they need into memory and look up all distinct pairs of a slice of
texts at once. Nothing of the model goes through the driver but its totals.

A word that was never seen is one more word; every context's probabilities sum to one over
the vocabulary and that word. Texts begin with a mark that is only ever a context and end with
a mark that is only ever a word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatch.llm.files import local_path, opened
from fleetwatch.llm.text import blocks, joined, word_hashes
from fleetwatch.plans.cut import cut, shared_path

#: Hashes of the marks at the begin and end of a text.
BEGIN, END = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)
#: Bytes of text that a task counts or scores at a time, and bytes of text for each cell.
SLICE, CELL_BYTES = 6 << 20, 24 << 20
#: Counts are kept in a byte; larger ones beside them.
MANY = 255


@dataclass(frozen=True)
class Model:
    """Where a model's files are, and its totals."""

    folder: str
    bits: int
    tokens: int
    vocabulary: int
    pairs: int
    #: Texts that the model was trained on, so end marks.
    ends: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    #: Distinct pairs are the tokens of the lower order; of them so many words follow 1, 2, 3 or more contexts.
    word_kinds: tuple[int, int, int]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: the CRC-32 of its id's text modulo 7 is 2 (a null id counts as empty)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from how many counts are 1, 2, 3 and 4; usual values where those are too few."""
    if min(n) == 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(raw, 1))


def pairs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of (word before, word) for every word and the end of each text; and where each text's begin."""
    data, begin = joined(texts)
    start, hashes = word_hashes(data)
    edge = np.searchsorted(start, begin)
    counts = np.diff(edge)
    first = edge[:-1] + np.arange(len(texts))  # each text has an end mark more
    word = np.empty(len(hashes) + len(texts), np.uint64)
    last = first + counts
    inner = np.ones(len(word), bool)
    inner[last] = False
    word[inner], word[last] = hashes, END
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[first] = BEGIN
    return before, word, np.append(first, len(word))


def _distinct(before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and how often each occurs."""
    order = np.lexsort((word, before))
    b, w = before[order], word[order]
    new = np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]) | (w[1:] != w[:-1])))) if len(b) else np.zeros(0, np.int64)
    return b[new], w[new], np.diff(np.append(new, len(b)))


def _runs(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how many of each."""
    new = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
    return b[new], np.diff(np.append(new, len(b)))


def _small(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts in a byte each, and the places and values of larger ones."""
    large = np.flatnonzero(count >= MANY)
    return np.minimum(count, MANY).astype(np.uint8), large.astype(np.uint64), count[large].astype(np.uint64)


def _pack(*arrays: np.ndarray) -> bytes:
    return np.array([a.nbytes for a in arrays], np.uint64).tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpack(data: bytes, *types) -> list[np.ndarray]:
    at = 8 * len(types)
    out = []
    for size, kind in zip(np.frombuffer(data, np.uint64, len(types)).tolist(), types):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _full(small: np.ndarray, places: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = small.astype(np.uint64)
    out[places.astype(np.int64)] = values
    return out


def _cells(h: np.ndarray, bits: int) -> np.ndarray:
    """Where each cell begins in a sorted array of hashes."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate(([0], np.searchsorted(h, edges), [len(h)]))


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column("text").to_pylist()]
            del batch
            for i, j in blocks(texts, SLICE):
                before, word, count = _distinct(*pairs_of(texts[i:j])[:2])
                edge = _cells(before, bits)
                cell, data = [], []
                for c in np.flatnonzero(np.diff(edge)).tolist():
                    at = slice(edge[c], edge[c + 1])
                    cell.append(c)
                    values, sizes = _runs(before[at])
                    data.append(_pack(values, sizes.astype(np.uint32), word[at], *_small(count[at])))
                yield pa.RecordBatch.from_pydict({"cell": pa.array(cell, pa.int32()), "data": pa.array(data, pa.binary())})

    return run


_PACKED = (np.uint64, np.uint32, np.uint64, np.uint8, np.uint64, np.uint64)


def _each_cell(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[bytes]]]:
    """The packs of each cell, from batches sorted by cell."""
    cell, packs = None, []
    for batch in batches:
        for c, data in zip(batch["cell"].tolist(), batch["data"]):
            if c != cell and packs:
                yield cell, packs
                packs = []
            cell = c
            packs.append(data)
    if packs:
        yield cell, packs


def _save(folder: str, name: str, **arrays: np.ndarray) -> str:
    """Write arrays to files of their own; gives the name they share. A new one for each attempt."""
    system, path = opened(folder)
    name = f"{name}-{uuid.uuid4().hex}"
    for kind, a in arrays.items():
        with system.open_output_stream(f"{path}/{name}.{kind}", compression=None) as out:
            out.write(a.tobytes())
    return name


def _merge_pairs(folder: str, bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell, packs in _each_cell(batches):
            got = [_unpack(x, *_PACKED) for x in packs]
            before = np.concatenate([np.repeat(g[0], g[1]) for g in got])
            word = np.concatenate([g[2] for g in got])
            count = np.concatenate([_full(*g[3:]) for g in got])
            del got, packs
            order = np.lexsort((word, before))
            before, word, count = before[order], word[order], count[order]
            new = np.flatnonzero(np.concatenate(([True], (before[1:] != before[:-1]) | (word[1:] != word[:-1]))))
            count, before, word = np.add.reduceat(count, new), before[new], word[new]
            context, sizes = _runs(before)
            start = np.cumsum(sizes) - sizes
            total = np.add.reduceat(count, start).astype(np.uint64)
            name = _save(folder, f"pairs-{cell}", context=context, size=sizes.astype(np.uint32), total=total, once=np.add.reduceat(count == 1, start, dtype=np.uint32),
                         twice=np.add.reduceat(count == 2, start, dtype=np.uint32), word=word, **dict(zip(("count", "place", "value"), _small(count))))
            seen = context != BEGIN
            kinds = [int((count == k).sum()) for k in (1, 2, 3, 4)]
            yield pd.DataFrame({"cell": [cell], "name": [name], "facts": [[*kinds, len(count), int(seen.sum()), int(total[seen].sum()), int(count[word == END].sum())]]})

    return run


def _followers(model_folder: str, bits: int):
    """From the files of each cell: how many contexts each word follows there, cut by the word's own cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["name"]:
                word, contexts = np.unique(Files.mapped(f"{model_folder}/{name}.word", np.uint64), return_counts=True)
                edge = _cells(word, bits)
                found = np.flatnonzero(np.diff(edge)).tolist()
                yield pd.DataFrame({"cell": found, "data": [_pack(word[edge[c] : edge[c + 1]], *_small(contexts[edge[c] : edge[c + 1]])) for c in found]})

    return run


def _merge_words(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell, packs in _each_cell(batches):
            got = [_unpack(x, np.uint64, np.uint8, np.uint64, np.uint64) for x in packs]
            word, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
            contexts = np.bincount(at, weights=np.concatenate([_full(*g[1:]) for g in got]).astype(np.float64), minlength=len(word)).astype(np.uint64)
            name = _save(folder, f"words-{cell}", word=word, contexts=contexts)
            yield pd.DataFrame({"cell": [cell], "name": [name], "facts": [[*(int((contexts == k).sum()) for k in (1, 2, 3, 4)), int((contexts >= 3).sum()), len(word)]]})

    return run


def train(texts: DataFrame, folder: str | None = None) -> tuple[Model, DataFrame]:
    """A model of all `texts` (column text; null counts as empty) and the list of its files (kind, cell, name).

    The list is a table of one row for each cell and order.
    """
    spark = texts.sparkSession
    folder = folder or shared_path(spark, "model")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(1, int(-(-size // CELL_BYTES) - 1).bit_length())
    packs = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(_count(bits), "cell int, data binary")
    schema = "cell int, name string, facts array<long>"
    first = cut(packs.repartition(1 << bits, "cell").sortWithinPartitions("cell").mapInPandas(_merge_pairs(folder, bits), schema))
    followers = first.select("cell", "name").repartition(1 << bits, "cell").mapInPandas(_followers(folder, bits), "cell int, data binary")
    words = cut(followers.repartition(1 << bits, "cell").sortWithinPartitions("cell").mapInPandas(_merge_words(folder), schema))

    def total(table: DataFrame, n: int) -> list[int]:
        row = table.agg(*[F.coalesce(F.sum(F.col("facts")[k]), F.lit(0)).cast("long").alias(f"f{k}") for k in range(n)]).first()
        return list(row)

    n1, n2, n3, n4, pairs, contexts, after_words, ends = total(first, 8)
    w1, w2, w3, w4, w3_up, _ = total(words, 6)
    # Every word but the end mark is the context of what follows it, so contexts count the words.
    model = Model(folder, bits, after_words + ends, contexts + (1 if ends else 0), pairs, ends, discounts([n1, n2, n3, n4]), discounts([w1, w2, w3, w4]), (w1, w2, w3_up))
    listed = first.select(F.lit("pairs").alias("kind"), "cell", "name").union(words.select(F.lit("words").alias("kind"), "cell", "name"))
    return model, cut(listed)


class Files:
    """The files of a model, mapped on demand; those of a file system that isn't mounted are fetched once for each worker."""

    _TYPES = {"context": np.uint64, "size": np.uint32, "once": np.uint32, "twice": np.uint32, "total": np.uint64, "word": np.uint64, "count": np.uint8, "place": np.uint64, "value": np.uint64, "contexts": np.uint64}

    def __init__(self, model: Model, names: dict[tuple[str, int], str]):
        self.model, self.names, self.maps = model, names, {}

    def get(self, kind: str, cell: int, array: str) -> np.ndarray:
        key = kind, cell, array
        if key not in self.maps:
            name = self.names.get((kind, cell))
            self.maps[key] = np.zeros(0, self._TYPES[array]) if name is None else self.mapped(f"{self.model.folder}/{name}.{array}", self._TYPES[array])
        return self.maps[key]

    @staticmethod
    def mapped(uri: str, kind) -> np.ndarray:
        path = local_path(uri)
        if path is None:
            import tempfile

            system, remote = opened(uri)
            held = tempfile.NamedTemporaryFile()  # noqa: SIM115  gone when the worker ends
            with system.open_input_stream(remote, compression=None) as source:
                while part := source.read(8 << 20):
                    held.write(part)
            held.flush()
            path = held.name
            Files._held = [*getattr(Files, "_held", []), held]
        import os

        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)

    def _by_cell(self, h: np.ndarray) -> Iterator[tuple[int, slice]]:
        edge = _cells(h, self.model.bits)
        for c in np.flatnonzero(np.diff(edge)).tolist():
            yield c, slice(edge[c], edge[c + 1])

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each of sorted distinct words occurs (as a context; not the end mark), and after how many contexts."""
        count, contexts = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
        for cell, at in self._by_cell(h):
            for out, kind, key, value in ((count, "pairs", "context", "total"), (contexts, "words", "word", "contexts")):
                keys = self.get(kind, cell, key)
                if len(keys):
                    place = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
                    there = keys[place] == h[at]
                    out[at] = np.where(there, self.get(kind, cell, value)[place], 0)
        return count, contexts

    def pairs(self, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sorted distinct pairs: the pair's count, its context's total, and the mass that the context leaves to the lower order."""
        count, total, left = np.zeros(len(before), np.uint64), np.zeros(len(before), np.uint64), np.ones(len(before))
        d = self.model.pair_discounts
        for cell, at in self._by_cell(before):
            keys = self.get("pairs", cell, "context")
            if not len(keys):
                continue
            b, w = before[at], word[at]
            names, sizes = _runs(b)
            place = np.minimum(np.searchsorted(keys, names), len(keys) - 1)
            there = keys[place] == names
            words, small, totals = (self.get("pairs", cell, x) for x in ("word", "count", "total"))
            ends = self._ends(cell)
            high = ends[place]
            low = high - self.get("pairs", cell, "size")[place]
            once, twice = self.get("pairs", cell, "once")[place].astype(np.int64), self.get("pairs", cell, "twice")[place].astype(np.int64)
            mass = (d[0] * once + d[1] * twice + d[2] * (high - low - once - twice)) / totals[place]
            left[at] = np.repeat(np.where(there, mass, 1.0), sizes)
            total[at] = np.repeat(np.where(there, totals[place], 0), sizes)
            # All pairs of known contexts at once: halve the range of each until it is empty.
            lo, hi = np.repeat(np.where(there, low, 0), sizes), np.repeat(np.where(there, high, 0), sizes)
            end = hi.copy()
            live = np.flatnonzero(lo < hi)
            while len(live):
                mid = (lo[live] + hi[live]) >> 1
                less = words[mid] < w[live]
                lo[live[less]] = mid[less] + 1
                hi[live[~less]] = mid[~less]
                live = live[lo[live] < hi[live]]
            found = np.flatnonzero(lo < end)
            found = found[words[lo[found]] == w[found]]
            value = small[lo[found]].astype(np.uint64)
            large = np.flatnonzero(value == MANY)
            if len(large):
                value[large] = self.get("pairs", cell, "value")[np.searchsorted(self.get("pairs", cell, "place"), lo[found[large]].astype(np.uint64))]
            part = np.zeros(len(b), np.uint64)
            part[found] = value
            count[at] = part
        return count, total, left

    def _ends(self, cell: int) -> np.ndarray:
        """Where the followers of each context end."""
        key = "pairs", cell, "end"
        if key not in self.maps:
            self.maps[key] = np.cumsum(self.get("pairs", cell, "size"), dtype=np.int64)
        return self.maps[key]


def _word_mass(model: Model) -> float:
    """The share that the words' order leaves to all words alike."""
    return sum(d * k for d, k in zip(model.word_discounts, model.word_kinds)) / model.pairs if model.pairs else 1.0


def word_probability(model: Model, contexts: np.ndarray) -> np.ndarray:
    """Lower-order probabilities of words that follow so many contexts; 0 for words never seen."""
    d = np.array([0.0, *model.word_discounts])[np.minimum(contexts, 3).astype(np.int64)]
    return np.maximum(contexts - d, 0) / max(model.pairs, 1) + _word_mass(model) / (model.vocabulary + 1)


def pair_probability(model: Model, count: np.ndarray, total: np.ndarray, left: np.ndarray, lower: np.ndarray) -> np.ndarray:
    d = np.array([0.0, *model.pair_discounts])[np.minimum(count, 3).astype(np.int64)]
    return np.maximum(count - d, 0) / np.maximum(total, 1) + left * lower


def _score(model: Model, held):
    kept: list[Files] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(Files(model, held.value))
        files = kept[0]
        for batch in batches:
            texts = [x or b"" for x in batch.column("_text").to_pylist()]
            for i, j in blocks(texts, SLICE // 2):
                before, word, first = pairs_of(texts[i:j])
                names, at = np.unique(word, return_inverse=True)
                count, contexts = files.words(names)
                count[names == END] = model.ends
                plain = np.log10((count + 1.0) / (model.tokens + 1.0 * (model.vocabulary + 1)))[at]
                order = np.lexsort((word, before))
                b, w = before[order], word[order]
                new = np.concatenate(([True], (b[1:] != b[:-1]) | (w[1:] != w[:-1])))
                one = np.flatnonzero(new)
                lower = word_probability(model, contexts)[at[order[one]]]
                p = np.log10(pair_probability(model, *files.pairs(b[one], w[one]), lower))
                fine = np.empty(len(word))
                fine[order] = p[np.cumsum(new) - 1]
                cells = (first[:-1],)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k)[i:j] for k in batch.schema.names if k != "_text"), pa.array(np.diff(first)), pa.array(np.add.reduceat((count > 0)[at], *cells, dtype=np.int64)),
                     pa.array(np.add.reduceat(plain, *cells)), pa.array(np.add.reduceat(fine, *cells))],
                    names=[*(k for k in batch.schema.names if k != "_text"), "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, keep: list[str], trained: tuple[Model, DataFrame], text: str = "text") -> DataFrame:
    """The columns `keep` of `docs` and of each text: n_tokens (words and the end), n_known (seen in training), base_score, score, perplexity.

    base_score: log10 probability under add-one word counts; score: under the model;
    perplexity: 10 to the power of -score / n_tokens. A null text counts as empty: one token,
    its end. Columns of `docs` that clash with the new ones aren't kept.
    """
    model, listed = trained
    spark = docs.sparkSession
    names: dict = {(r["kind"], r["cell"]): r["name"] for r in listed.collect()}  # a name for each cell
    held = spark.sparkContext.broadcast(names)
    kept = [k for k in keep if k not in {"n_tokens", "n_known", "base_score", "score", "perplexity"}]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    out = docs.select(*kept, F.col(text).cast("binary").alias("_text")).mapInArrow(_score(model, held), f"{schema}{', ' if schema else ''}n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))

