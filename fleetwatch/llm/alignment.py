"""Alignment of two tokenizers' tokens over a corpus, by their byte ranges.

A token of A and one of B are linked where their bytes overlap. Offsets at which tokens of both
end cut a text into groups. Most groups hold one token of each side with the same bytes; which B
token that is depends on the A token alone, so a task counts them in one vector over A's
vocabulary (the identity map). Only the links of all other groups are counted as pairs and shuffled,
summed within each task first.

The table of pair counts is bounded by the two vocabularies, not by the corpus. It is kept as
sorted arrays in files of the shared folder, cut by A id, which workers map into memory.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.llm.files import mapped, save
from fleetwatch.llm.text import blocks
from fleetwatch.plans.cut import cut, shared_path

#: Pairs that a task holds before it hands on their sums.
HELD = 2_000_000
#: Pairs in one file of the table.
FILE = 2_000_000
#: Bytes of text encoded at once.
SLICE = 1 << 20

# Fixed value: how byte-level BPE splits a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_BLANK = re.compile(r"\s{500}")

MEASURES = ["n_a", "n_b", "n_groups", "n_links"]


@dataclass(frozen=True)
class Pair:
    """The two tokenizers: a byte-level BPE as JSON and a SentencePiece model, each as its file's bytes."""

    a: bytes
    b: bytes

    @staticmethod
    def load(a: str, b: str) -> Pair:
        with open(a, "rb") as one, open(b, "rb") as two:
            return Pair(one.read(), two.read())


def default_paths() -> tuple[str, str]:
    """Where the installed public vocabularies lie."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of_symbol() -> dict[str, int]:
    """The bytes that the symbols of byte-level vocabularies stand for: printable ones themselves, the others numbered from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}


class Encoder:
    """Both tokenizers with their tokens' bytes, as one worker holds them."""

    def __init__(self, pair: Pair):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(pair.a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pair.b)
        symbols = byte_of_symbol()
        spec = json.loads(pair.a)
        extra = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        vocabulary = {i: bytes(symbols[c] for c in s) for s, i in spec["model"]["vocab"].items()} | extra
        self.a_bytes = [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)]
        size = self.b.get_piece_size()
        names = [self.b.id_to_piece(i) for i in range(size)]
        fallback = [self.b.is_byte(i) for i in range(size)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if f else p.replace("▁", " ").encode() for p, f in zip(names, fallback)]
        own = {self.b_bytes[i]: i for i in range(size) if fallback[i]}
        own |= {self.b_bytes[i]: i for i in reversed(range(size)) if not (fallback[i] or self.b.is_control(i) or self.b.is_unknown(i))}
        #: For each A id the B id of the same bytes (a piece before a single byte), or -1.
        self.same = np.array([-1 if i in extra else own.get(x, -1) for i, x in enumerate(self.a_bytes)], np.int64)
        self.ranked = self._ranked(spec, symbols)
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.base = size

    @staticmethod
    def _ranked(spec: dict, symbols: dict[str, int]):
        """A's vocabulary in a faster encoder, where its merges stand in the order of their ids; else None."""
        first, model = spec["pre_tokenizer"] or {}, spec["model"]
        ids = {bytes(symbols[c] for c in s): i for s, i in model["vocab"].items()}
        made = [ids.get(bytes(symbols[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))) for m in model["merges"]]
        plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not spec["normalizer"] and not model.get("ignore_merges")
        if not plain or made != list(range(256, 256 + len(made))):
            return None
        import tiktoken

        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={})

    def _encode_a(self, text: str) -> list[int]:
        # The faster encoder's stack doesn't hold very long runs of blanks.
        if self.ranked is None or LONG_BLANK.search(text):
            return self.a.encode(" " + text, add_special_tokens=False).ids
        return self.ranked.encode_ordinary(" " + text)

    def encode(self, texts: list[bytes]) -> list[tuple[list[int], list[int]]]:
        """A and B ids of each text; none for an empty one or one that either side's tokens don't give back."""
        out: list[tuple[list[int], list[int]]] = [([], [])] * len(texts)
        full = [k for k, t in enumerate(texts) if t]
        plain = [texts[k].decode("utf-8", "replace") for k in full]
        for k, ids, other in zip(full, map(self._encode_a, plain), self.b.encode(plain, num_threads=1)):
            whole = b" " + texts[k]
            if b"".join(map(self.a_bytes.__getitem__, ids)) == whole and b"".join(map(self.b_bytes.__getitem__, other)) == whole:
                out[k] = ids, other
        return out


class Aligned:
    """Groups and links of some texts, all texts laid end to end."""

    def __init__(self, encoder: Encoder, encoded: list[tuple[list[int], list[int]]]):
        self.a = np.concatenate([np.array(x, np.int64) for x, _ in encoded]) if encoded else np.zeros(0, np.int64)
        self.b = np.concatenate([np.array(x, np.int64) for _, x in encoded]) if encoded else np.zeros(0, np.int64)
        a_end, b_end = np.cumsum(encoder.a_size[self.a]), np.cumsum(encoder.b_size[self.b])
        #: Where each text's tokens begin.
        self.a_first = np.cumsum([0, *(len(x) for x, _ in encoded)])
        self.b_first = np.cumsum([0, *(len(x) for _, x in encoded)])
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(both, a_end), np.searchsorted(both, b_end)
        ends = np.concatenate(([0], a_end))[self.a_first]
        self.n_groups = np.diff(np.searchsorted(both, ends, "right"))
        # Every stretch between neighbouring ends of either side is one link.
        stretch = np.union1d(a_end, b_end)
        self.n_links = np.diff(np.searchsorted(stretch, ends, "right"))
        self.link_a, self.link_b = np.searchsorted(a_end, stretch), np.searchsorted(b_end, stretch)
        one = (np.bincount(self.group_a, minlength=len(both)) == 1) & (np.bincount(self.group_b, minlength=len(both)) == 1)
        a, b = self.a[self.link_a], self.b[self.link_b]
        self.code = a * encoder.base + b
        #: Links of groups of one A token and its identity-mapped B token.
        self.plain = one[self.group_a[self.link_a]] & (encoder.same[a] == b) if len(a) else np.zeros(0, bool)
        self.text = np.repeat(np.arange(len(encoded)), self.n_links)

    def group_strings(self) -> list[bytes]:
        """Each text's groups, as `a1,a2|b1;a3|b2,b3`."""
        n = len(self.a) + len(self.b)
        if not n:
            return [b""] * (len(self.a_first) - 1)
        # A group's A tokens stand before its B tokens, and after all tokens of earlier groups.
        at_a = np.arange(len(self.a)) + np.searchsorted(self.group_b, self.group_a, "left")
        at_b = np.arange(len(self.b)) + np.searchsorted(self.group_a, self.group_b, "right")
        ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        mark[at_a[np.diff(self.group_a, append=-1) != 0]] = ord("|")
        mark[at_b[np.diff(self.group_b, append=-1) != 0]] = ord(";")
        width = len(str(int(ids.max())))
        power = 10 ** np.arange(width - 1, -1, -1, dtype=np.int64)
        cells = np.empty((n, width + 1), np.uint8)
        cells[:, :width] = ids[:, None] // power % 10 + ord("0")
        cells[:, width] = mark
        shown = np.ones((n, width + 1), bool)
        shown[:, : width - 1] = ids[:, None] >= power[:-1]
        data = cells[shown].tobytes()
        begin = np.concatenate(([0], np.cumsum(shown.sum(axis=1))))[self.a_first + self.b_first]
        return [data[i : max(i, j - 1)] for i, j in zip(begin.tolist(), begin[1:].tolist())]


def _sums(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, count = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, count = code[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return code[first], np.add.reduceat(count, first)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(held) -> Encoder:
    pair = held.value
    key = hashlib.sha256(pair.a + pair.b).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(pair)
    return _ENCODERS[key]


def _align(held, schema: pa.Schema, names: list[str], with_groups: bool, bound: int, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held)
        base = encoder.base
        vector = np.zeros(len(encoder.a_bytes), np.int64)
        codes: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def rows(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        def flush(code: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(code), 100_000):
                c = code[at : at + 100_000]
                yield rows(len(c), {"a": pa.array(c // base), "b": pa.array(c % base), "n": pa.array(count[at : at + 100_000])})

        for batch in batches:
            texts = [x or b"" for x in batch.column("_text").to_pylist()]
            for i, j in blocks(texts, slice_bytes):
                encoded = encoder.encode(texts[i:j])
                found = Aligned(encoder, encoded)
                # Each text's different links, in order of their codes, with how often it has them and whether an identity group is among these.
                order = np.lexsort((found.code, found.text))
                text, code = found.text[order], found.code[order]
                first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (text[1:] != text[:-1])))) if len(code) else np.zeros(0, np.int64)
                times = np.diff(first, append=len(code))
                plain = np.logical_or.reduceat(found.plain[order], first) if len(first) else np.zeros(0, bool)
                code, text = code[first], text[first]
                vector += np.bincount(code[plain] // base, minlength=len(vector))
                if not plain.all():
                    other, n = np.unique(code[~plain], return_counts=True)
                    codes.append(other)
                    counts.append(n)
                    if sum(map(len, codes)) > 2 * bound:
                        c, n = _sums(codes, counts)
                        codes, counts = [c], [n]
                        if len(c) > bound:
                            yield from flush(c, n)
                            codes, counts = [], []
                strings = found.group_strings()
                edge = np.searchsorted(text, np.arange(j - i + 1))
                columns = {
                    **{name: batch.column(name).slice(i, j - i) for name in names},
                    "n_a": pa.array(np.diff(found.a_first)), "n_b": pa.array(np.diff(found.b_first)), "n_groups": pa.array(found.n_groups), "n_links": pa.array(found.n_links),
                    "groups_sha256": pa.array([hashlib.sha256(s).hexdigest() if s else "" for s in strings]),
                    "codes": pa.array([code[x:y].tobytes() for x, y in zip(edge.tolist(), edge[1:].tolist())], pa.binary()),
                    "times": pa.array([times[x:y].astype(np.uint32).tobytes() for x, y in zip(edge.tolist(), edge[1:].tolist())], pa.binary()),
                }
                if with_groups:
                    columns["groups"] = pa.array([s.decode() for s in strings])
                yield rows(j - i, columns)
        mine = np.flatnonzero((vector > 0) & (encoder.same >= 0))
        codes.append(mine * base + encoder.same[mine])
        counts.append(vector[mine])
        yield from flush(*_sums(codes, counts)) if sum(map(len, codes)) else ()

    return run


def _write_part(folder: str, base: int):
    def run(table: pa.Table) -> pa.Table:
        code = table.column("a").to_numpy().astype(np.int64) * base + table.column("b").to_numpy()
        order = np.argsort(code)
        code, count = code[order], table.column("n").to_numpy()[order]
        a = code // base
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        most = np.repeat(np.maximum.reduceat(count, first), np.diff(first, append=len(code)))
        name = save(folder, "pairs", code=code, count=count, best=count == most)
        return pa.table({"part": table.column("part").slice(0, 1), "name": pa.array([name])})

    return run


class Counts:
    """The pair table's files, mapped on demand."""

    def __init__(self, folder: str, names: dict[int, str], parts: int, base: int):
        self.folder, self.names, self.parts, self.base, self.maps = folder, names, parts, base, {}

    def _get(self, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if part not in self.maps:
            at = f"{self.folder}/{self.names[part]}"
            self.maps[part] = mapped(f"{at}.code", np.int64), mapped(f"{at}.count", np.int64), mapped(f"{at}.best", bool)
        return self.maps[part]

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of pairs that the table holds, and whether they are their A id's highest."""
        count, best = np.empty(len(code), np.int64), np.empty(len(code), bool)
        part = code // self.base % self.parts
        for p in np.unique(part).tolist():
            at = np.flatnonzero(part == p)
            codes, counts, bests = self._get(p)
            place = np.searchsorted(codes, code[at])
            count[at], best[at] = counts[place], bests[place]
        return count, best


def _look_up(folder: str, held, parts: int, base: int, schema: pa.Schema):
    kept: list[Counts] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(Counts(folder, held.value, parts, base))
        for batch in batches:
            packed = batch.column("codes").to_pylist()
            many = [np.frombuffer(x, np.uint32).astype(np.int64) for x in batch.column("times").to_pylist()]
            n_best, total = np.zeros(len(packed), np.int64), np.zeros(len(packed), np.int64)
            for i, j in blocks(packed, SLICE):
                code, times = np.frombuffer(b"".join(packed[i:j]), np.int64), np.concatenate(many[i:j])
                names, at = np.unique(code, return_inverse=True)
                count, best = kept[0].find(names)
                row = np.repeat(np.arange(i, j), [len(x) for x in many[i:j]])
                np.add.at(n_best, row, times * best[at])
                np.add.at(total, row, times * count[at])
            out = {"n_best": pa.array(n_best), "count_sum": pa.array(total)}
            yield pa.RecordBatch.from_arrays([out[f.name] if f.name in out else batch.column(f.name) for f in schema], schema=schema)

    return run


def _arrow(frame: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(frame.schema)


def _fields(frame: DataFrame, names: list[str]) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*names).schema.fields]


@dataclass(frozen=True)
class Corpus:
    """An aligned corpus: its documents with their different links, and the pairs' counts by task."""

    documents: DataFrame
    pairs: DataFrame
    base: int


def align(docs: DataFrame, keep: list[str], pair: Pair, text: str = "text", groups: bool = False) -> Corpus:
    """Encode every text of `docs` by both tokenizers and find its groups and links.

    documents: the columns `keep`, n_a, n_b, n_groups, n_links, groups_sha256, `groups` if asked
    for, and the document's different links (codes, times: packed arrays). Texts that are null,
    empty, no UTF-8, or that either tokenizer's tokens don't give back byte for byte have no tokens: zeros and
    ''. Rows are documents: repeated rows count once each. Columns of `docs` whose names clash
    with these aren't kept.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(pair)  # two vocabulary files
    taken = {*MEASURES, "groups_sha256", "groups", "codes", "times", "a", "b", "n", "n_best", "count_sum", "_text"}
    names = [c for c in keep if c not in taken]
    own = [*(f"{m} long" for m in MEASURES), "groups_sha256 string", *(["groups string"] if groups else []), "codes binary", "times binary", "a int", "b int", "n long"]
    schema = ", ".join([*_fields(docs, names), *own])
    shape = _arrow(spark.createDataFrame([], schema))
    chosen = docs.select(*names, F.col(text).cast("binary").alias("_text"))
    done = cut(chosen.mapInArrow(_align(held, shape, names, groups, HELD, SLICE), schema))
    return Corpus(done.where("a IS NULL").drop("a", "b", "n"), done.where("a IS NOT NULL").select("a", "b", "n"), Encoder(pair).base)


def pair_counts(corpus: Corpus) -> DataFrame:
    """a, b and n: in how many documents an A id and a B id are linked."""
    return corpus.pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def score(corpus: Corpus) -> DataFrame:
    """The documents with n_best (links whose pair has the highest count of its A id, ties included) and count_sum (counts of all links); no packed links."""
    docs = corpus.documents
    spark = docs.sparkSession
    folder = shared_path(spark, "alignment")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    totals = cut(pair_counts(corpus))
    parts = max(1, -(-totals.count() // FILE))
    placed = totals.withColumn("part", (F.col("a") % parts).cast("long"))
    listed = cut(placed.groupBy("part").applyInArrow(_write_part(folder, corpus.base), "part long, name string"))
    held = spark.sparkContext.broadcast({r["part"]: r["name"] for r in listed.collect()})  # a name for each file of FILE pairs
    names = [c for c in docs.columns if c not in {"codes", "times"}]
    schema = ", ".join([*_fields(docs, names), "n_best long", "count_sum long"])
    return docs.mapInArrow(_look_up(folder, held, parts, corpus.base, _arrow(spark.createDataFrame([], schema))), schema)
