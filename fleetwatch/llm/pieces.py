"""N-best segmentation of texts into the pieces of a given vocabulary, and back.

The lattice of a text has a node between any two characters and an edge for every piece; a
path's score is the sum of its pieces' scores. A forward Viterbi pass gives the best score up
to every node. Those scores are exact heuristics for an A-star search from the end backwards:
its agenda gives complete paths in order of their score, as many as are asked for.

No piece has a space inside or goes over a line end, so the lattice of a text is a chain of
the lattices of its segments (spaces and the word after them). Best paths are found once for
each distinct segment of a batch, for all of them at the same time; the N best paths of a text
are the N best combinations of its segments' paths. Only the N - 1 segments whose second best
path costs least can differ in them, and only those are searched.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
SEGMENT = re.compile(rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
#: Segments longer than this are searched one by one.
LONG = 48
#: What an unknown character costs beyond the worst piece.
UNKNOWN = 10.0
#: Segments and characters that a worker keeps.
KEPT, KEPT_CHARS = 400_000, 8_000_000
_MULT = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id (None for ids that aren't text), their scores, and the id of each byte's piece."""

    pieces: tuple
    scores: tuple
    byte_ids: tuple

    @staticmethod
    def load(path: str) -> Vocabulary:
        """From a SentencePiece model file with byte pieces."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        text = [None if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) else sp.id_to_piece(i) for i in range(n)]
        byte = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
        for p in text:
            if p is not None and (SPACE in p.lstrip(SPACE) or "\n" in p):
                raise ValueError(f"piece {p!r} goes over a space or a line end")
        return Vocabulary(tuple(text), tuple(float(sp.get_score(i)) for i in range(n)), tuple(byte[f"<0x{i:02X}>"] for i in range(256)))


def default_path() -> str:
    """Where the installed public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """Paths through the lattices of segments."""

    def __init__(self, vocabulary: Vocabulary):
        self.ids = {p: i for i, p in enumerate(vocabulary.pieces) if p is not None}
        self.scores = np.array(vocabulary.scores)
        self.byte_ids = np.array(vocabulary.byte_ids)
        self.longest = max(map(len, self.ids))
        usual = [self.scores[i] for i in self.ids.values() if self.scores[i] > -1e8]
        self.unknown = min(usual, default=0.0) - UNKNOWN
        hashes = np.array([self._hash(p) for p in self.ids], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.hash_ids = hashes[order], np.array(list(self.ids.values()))[order]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces have one hash")
        self.likely = np.zeros(1 << 20, bool)  # by the top bits of a hash: whether any piece has them
        self.likely[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = (h + np.uint64(ord(c))) * _MULT
            h ^= h >> np.uint64(29)
        return h[0]

    def edges_to(self, text: str, end: int) -> Iterator[tuple[int, int, float]]:
        """start, id (-1 for an unknown character) and score of the edges into a node."""
        for start in range(end - 1, max(-1, end - self.longest - 1), -1):
            i = self.ids.get(text[start:end])
            if i is not None:
                yield start, i, float(self.scores[i])
            elif start == end - 1:
                yield start, -1, self.unknown

    def forward(self, text: str) -> list[float]:
        """The best score up to each node."""
        best = [0.0] + [-np.inf] * len(text)
        for end in range(1, len(text) + 1):
            best[end] = max(best[s] + v for s, _, v in self.edges_to(text, end))
        return best

    def expand(self, text: str, path: list[tuple[int, int]]) -> list[int]:
        """Ids of a path of (start, id), unknown characters as bytes."""
        out = []
        for start, i in path:
            out += [i] if i >= 0 else [int(self.byte_ids[b]) for b in text[start].encode("utf-8", "surrogatepass")]
        return out

    def search(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best paths, best first: score and ids. Fewer if there are fewer.

        Of equal scores the path that has come furthest goes first. A node is passed n times at most, as the forward
        scores are exact: a later path through it is no better than the n that end before it. So work is in
        proportion to the text, however many paths are tied.
        """
        best = self.forward(text)
        order, found, passed = itertools.count(), [], [0] * (len(text) + 1)
        agenda = [(-best[-1], len(text), next(order), 0.0, None)]
        while agenda and len(found) < n:
            _, node, _, behind, path = heapq.heappop(agenda)
            if passed[node] == n:
                continue
            passed[node] += 1
            if node == 0:
                steps = []
                while path is not None:
                    steps.append(path[0])
                    path = path[1]
                found.append((behind, self.expand(text, steps)))
                continue
            for start, i, v in self.edges_to(text, node):
                heapq.heappush(agenda, (-(behind + v + best[start]), start, next(order), behind + v, ((start, i), path)))
        return found

    def best(self, segments: list[str]) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        """Best path, its score, and what the second best path costs more (infinite if there is none), for each segment."""
        ids: list = [None] * len(segments)
        score, gap = np.zeros(len(segments)), np.full(len(segments), np.inf)
        groups: dict[int, list[int]] = {}
        for i, s in enumerate(segments):
            if len(s) > LONG:
                two = self.search(s, 2)
                ids[i], score[i] = two[0][1], two[0][0]
                if len(two) > 1:
                    gap[i] = two[0][0] - two[1][0]
            else:
                groups.setdefault(len(s), []).append(i)
        for length, members in groups.items():
            for at in range(0, len(members), 4096):
                part = members[at : at + 4096]
                got, score[part], gap[part] = self._together([segments[i] for i in part], length)
                for i, x in zip(part, got):
                    ids[i] = x
        return ids, score, gap

    def _together(self, segments: list[str], length: int):
        """`best` for segments of one length. Arrays have a row for each place and a column for each segment."""
        w, reach = len(segments), min(length, self.longest)
        code = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(w, length).T.astype(np.uint64)
        edges: list = [None] * (reach + 1)  # by number of characters: scores and ids by start, or None if there is no edge
        h = np.zeros((length, w), np.uint64)
        for n in range(1, reach + 1):
            h = (h[: length - n + 1] + code[n - 1 :]) * _MULT
            h ^= h >> np.uint64(29)
            maybe = np.flatnonzero(self.likely[(h >> np.uint64(44)).view(np.int64)])
            wanted = h.ravel()[maybe]
            at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
            there = self.hashes[at] == wanted
            if n > 1 and not there.any():
                continue
            value, piece = np.full(h.shape, self.unknown if n == 1 else -np.inf), np.full(h.shape, -1, np.int32)
            value.ravel()[maybe[there]], piece.ravel()[maybe[there]] = self.scores[self.hash_ids[at[there]]], self.hash_ids[at[there]]
            edges[n] = value, piece
        sizes = [n for n in range(1, reach + 1) if edges[n] is not None]
        ahead, back = np.full((length + 1, w), -np.inf), np.zeros((length + 1, w), np.int8)
        ahead[0] = 0
        for end in range(1, length + 1):
            for n in sizes:
                if n > end:
                    break
                v = ahead[end - n] + edges[n][0][end - n]
                better = v > ahead[end]
                np.copyto(ahead[end], v, where=better)
                np.copyto(back[end], n, where=better)
        behind = np.full((length + 1, w), -np.inf)
        behind[length] = 0
        for start in range(length - 1, -1, -1):
            for n in sizes:
                if n > length - start:
                    break
                np.maximum(behind[start], edges[n][0][start] + behind[start + n], out=behind[start])
        # The best path, edge by edge from the end; then the best path through any other edge.
        node = np.full(w, length)
        used = np.zeros((length, w), np.int8)  # the size of the best path's edge from a start
        steps = []
        while len(live := np.flatnonzero(node > 0)):
            n = back[node[live], live].astype(np.int64)
            start = node[live] - n
            used[start, live] = n
            step = np.full(w, -2)
            for size in np.unique(n).tolist():
                here = n == size
                step[live[here]] = edges[size][1][start[here], live[here]]
            steps.append(step)
            node[live] = start
        other = np.full(w, -np.inf)
        for n in sizes:
            v = ahead[: length - n + 1] + edges[n][0] + behind[n:]
            v[used[: length - n + 1] == n] = -np.inf
            np.maximum(other, v.max(axis=0), out=other)
        paths = np.stack(steps[::-1], axis=1)
        known = (paths != -1).all(axis=1)
        out = []
        for k in range(w):
            p = paths[k]
            if known[k]:
                out.append(p[p >= 0].tolist())
            else:
                at, path = 0, []
                for i in p[p > -2].tolist():
                    path.append((at, i))
                    at += 1 if i < 0 else len(self._piece(i))
                out.append(self.expand(segments[k], path))
        return out, ahead[length], ahead[length] - other

    def _piece(self, i: int) -> str:
        if not hasattr(self, "_by_id"):
            self._by_id = {i: p for p, i in self.ids.items()}
        return self._by_id[i]


class Encoder:
    """Texts to ids with the best paths of segments kept between batches, up to a bound."""

    def __init__(self, vocabulary: Vocabulary, n_best: int):
        self.lattice, self.n_best = Lattice(vocabulary), n_best
        self.bytes = [b"" if p is None else p.replace(SPACE, " ").encode() for p in vocabulary.pieces]
        for b, i in enumerate(vocabulary.byte_ids):
            self.bytes[i] = bytes([b])
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.sizes = np.array(list(map(len, self.bytes)))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.names: list[str] = []
        self.ids, self.offset = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.score, self.gap, self.chars = np.zeros(0), np.zeros(0), 0
        self.paths: dict[int, list] = {}

    def _learn(self, segments: set[str]) -> None:
        new = [s for s in segments if s not in self.index]
        if not new:
            return
        if len(self.index) + len(new) > KEPT or self.chars > KEPT_CHARS:
            self._clear()
            new = list(segments)
        ids, score, gap = self.lattice.best(new)
        self.index.update(zip(new, range(len(self.names), len(self.names) + len(new))))
        self.names += new
        self.chars += sum(map(len, new))
        self.ids = np.concatenate((self.ids, np.fromiter(itertools.chain.from_iterable(ids), np.int32)))
        self.offset = np.concatenate((self.offset, self.offset[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))))
        self.score, self.gap = np.concatenate((self.score, score)), np.concatenate((self.gap, gap))

    def _alternatives(self, at: np.ndarray) -> list[tuple[float, list[tuple[int, list[int]]]]]:
        """What the 2nd to N-th best paths of a text cost, and the (segment, ids) they change."""
        gaps = self.gap[at]
        n = self.n_best - 1
        few = np.flatnonzero(np.isfinite(gaps))
        if n < 1 or not len(few):
            return []
        few = few[np.argsort(gaps[few], kind="stable")[:n]] if len(few) <= 4 * n else few[self._least(gaps[few], n)]
        choices = []
        for k in few.tolist():
            name = int(at[k])
            if name not in self.paths:
                own = self.ids[self.offset[name] : self.offset[name + 1]].tolist()
                found = self.lattice.search(self.names[name], self.n_best)
                # Of tied best paths the one in use is the first, so no alternative repeats it.
                self.paths[name] = [(found[0][0], own), *(x for x in found if x[1] != own)][: self.n_best]
            choices.append([(self.paths[name][0][0] - v, ids) for v, ids in self.paths[name]])
        start = (0,) * len(choices)
        agenda, seen, out = [(0.0, start)], {start}, []
        while agenda and len(out) < self.n_best:
            loss, state = heapq.heappop(agenda)
            out.append((loss, [(int(few[i]), choices[i][x][1]) for i, x in enumerate(state) if x]))
            for i, x in enumerate(state):
                after = (*state[:i], x + 1, *state[i + 1 :])
                if x + 1 < len(choices[i]) and after not in seen:
                    seen.add(after)
                    heapq.heappush(agenda, (loss - choices[i][x][0] + choices[i][x + 1][0], after))
        return out[1:]

    @staticmethod
    def _least(values: np.ndarray, n: int) -> np.ndarray:
        near = np.flatnonzero(values <= np.partition(values, n - 1)[n - 1])
        return near[np.argsort(values[near], kind="stable")[:n]]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, list[float], list]]:
        """Ids, scores of the N best paths, and the changes of the 2nd to N-th, for each text."""
        split = [SEGMENT.findall((SPACE + t).replace(" ", SPACE)) if t else [] for t in texts]
        self._learn(set(itertools.chain.from_iterable(split)))
        for segments in split:
            at = np.fromiter(map(self.index.__getitem__, segments), np.int64, len(segments))
            sizes = self.offset[at + 1] - self.offset[at]
            ends = np.cumsum(sizes)
            ids = self.ids[np.repeat(self.offset[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
            best = float(self.score[at].sum())
            other = self._alternatives(at) if len(at) else []
            yield ids, [best, *(best - loss for loss, _ in other)], [changes for _, changes in other]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the pieces; the space that encoding puts first goes again."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        out = self.flat[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        return out[1:] if out[:1] == b" " else out


_KEPT: dict[tuple[int, int], Encoder] = {}


def _encoder(vocabulary, n_best: int) -> Encoder:
    key = (vocabulary.id if hasattr(vocabulary, "id") else id(vocabulary), n_best)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Encoder(vocabulary.value, n_best)
    return _KEPT[key]


def _lists(rows: list, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rows]))), pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0), kind))


SCHEMA = "n_pieces int, scores array<double>, pieces array<int>, changes array<array<struct<segment:int,pieces:array<int>>>>, restored boolean"
_CHANGES = pa.list_(pa.list_(pa.struct([("segment", pa.int32()), ("pieces", pa.list_(pa.int32()))])))


def encode(docs: DataFrame, keep: list[str], vocabulary: Vocabulary, n_best: int = 4, text: str = "text") -> DataFrame:
    """The columns `keep` of `docs` and, for each text, its N best segmentations.

    pieces: ids of the best path; n_pieces: how many; scores: of the N best paths, best first
    (fewer, if there are fewer); changes: for the 2nd to N-th, which segments have other
    pieces, and which; restored: whether `decode` of pieces gives the text (U+2581 in a text
    comes back as a space). Null and empty texts have no pieces and a score of 0. Columns of
    `docs` that clash with the new ones aren't kept. Memory is bounded by a batch of texts.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(vocabulary)
    names = [k for k in keep if k not in {"n_pieces", "scores", "pieces", "changes", "restored"}]
    chosen = docs.select(*names, F.col(text).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = _encoder(held, n_best)
        for batch in batches:
            whole = batch.column("_text")
            sizes = np.cumsum([len(x) if x is not None else 0 for x in whole.to_pylist()])
            at = 0
            while at < batch.num_rows:  # about four million characters at a time
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (4 << 20), "right")))
                part = batch.slice(at, to - at)
                texts = [x or "" for x in part.column("_text").to_pylist()]
                ids, scores, changes, same = [], [], [], []
                for t, (i, s, c) in zip(texts, maker.encode(texts)):
                    ids.append(i)
                    scores.append(s)
                    changes.append([[{"segment": k, "pieces": x} for k, x in one] for one in c])
                    same.append(maker.decode(i) == t.replace(SPACE, " ").encode())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in names), pa.array([len(i) for i in ids], pa.int32()), _lists(scores, pa.float64()), _lists(ids, pa.int32()), pa.array(changes, _CHANGES), pa.array(same)],
                    names=[*names, "n_pieces", "scores", "pieces", "changes", "restored"])
                at = to

    return chosen.mapInArrow(run, f"{kept}{', ' if kept else ''}{SCHEMA}")


def decode(encoded: DataFrame, vocabulary: Vocabulary, pieces: str = "pieces") -> DataFrame:
    """All columns of `encoded` and `decoded`, the text of its pieces (null for null). Bytes that are no UTF-8 become U+FFFD."""
    held = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    rest = encoded.drop("decoded")
    names = rest.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = _encoder(held, 1)
        for batch in batches:
            texts = [None if x is None else maker.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column(names.index(pieces)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return rest.mapInArrow(run, f"{schema}, decoded string")
