"""A quality classifier by co-training.

Two classifiers see two views of a document: one its text, the other what is known about it
(source, language, length). Both start from a sample of labelled documents. In each
round both score all documents; documents of which one is confident, and that have no label, go
with its verdict into the training rows of the other. In the end each view is calibrated on
labelled rows that neither was fitted to, and the calibrated odds are multiplied.

Bounded: the labelled sample (`max_labels` rows), and the pseudo-labels of a round
(`per_round` rows for each view), drawn from all confident documents by a seeded hash. All
documents are scored in every round. Features are small and written once for the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.llm.text import blocks, grams, joined, mix, word_hashes
from fleetwatch.plans.cut import cut

BUCKETS, KINDS = 512, 12
_BUCKET = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
_KIND = np.full(256, 11, np.int64)
for _k, _bytes in enumerate((b" \t", b"\n", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"#*$%&", b"|<>", b"'\"()-", bytes(range(128, 256)))):
    _KIND[list(_bytes)] = _k
#: Width of each view.
TEXT, META = BUCKETS + KINDS + 7, 64 + 16 + 3


@dataclass(frozen=True)
class CoTraining:
    """`confident`: a calibrated probability of at least this, or at most 1 less this, makes a pseudo-label."""

    max_labels: int = 4000
    rounds: int = 2
    per_round: int = 400
    confident: float = 0.95
    ridge: float = 1.0
    threshold: float = 0.5
    seed: int = 11


def text_view(texts: list[bytes]) -> np.ndarray:
    """Features of UTF-8 texts: hashed pairs of bytes, shares of kinds of characters, sizes and repetition of words."""
    out = np.zeros((len(texts), TEXT), np.float32)
    for i, j in blocks(texts, 4 << 20):
        data, begin = joined(texts[i:j])
        n, size = j - i, np.diff(begin)
        owner = np.repeat(np.arange(n), size)
        within = np.ones(len(data), bool)
        within[begin[1:] - 1] = False  # no pair goes over the end of a text
        within = np.flatnonzero(within)
        code = (data[within].astype(np.int64) << 8) | data[within + 1]
        pairs = np.log1p(np.bincount(owner[within] * BUCKETS + _BUCKET[code], minlength=n * BUCKETS).reshape(n, BUCKETS))
        out[i:j, :BUCKETS] = pairs / np.maximum(1e-9, np.sqrt((pairs**2).sum(axis=1, keepdims=True)))
        kinds = np.bincount(owner * KINDS + _KIND[data], minlength=n * KINDS).reshape(n, KINDS)
        out[i:j, BUCKETS : BUCKETS + KINDS] = kinds / size[:, None]
        start, hashes = word_hashes(data)
        edge = np.searchsorted(start, begin)
        words = np.diff(edge)
        place = np.repeat(np.arange(n), words)

        def shares(h: np.ndarray, where: np.ndarray, count: np.ndarray) -> np.ndarray:
            """Distinct items as a share of each text's."""
            key = np.sort((where.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
            new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
            return np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=n) / np.maximum(count, 1)

        three = grams(hashes, 3)
        inside = place[: len(three)] == place[2:] if len(three) else np.zeros(0, bool)
        same = (hashes[1:] == hashes[:-1]) & (place[1:] == place[:-1])
        columns = (np.log1p(size - 1.0), np.log1p(words), (size - 1 - kinds[:, 0] - kinds[:, 1] + 1) / np.maximum(words, 1) / 10, shares(hashes, place, words),
                   shares(three[inside], place[: len(three)][inside], np.maximum(words - 2, 0)), np.bincount(place[1:][same], minlength=n) / np.maximum(words, 1), words < 20)
        out[i:j, BUCKETS + KINDS :] = np.stack([np.asarray(c, np.float64) for c in columns], axis=1)
    return out


def _hash(values: list, buckets: int) -> np.ndarray:
    import zlib

    return np.array([buckets - 1 if v is None else zlib.crc32(str(v).encode("utf-8", "surrogatepass")) % (buckets - 1) for v in values], np.int64)


def meta_view(source: list, lang: list, length: list) -> np.ndarray:
    """Features of metadata: hashed source and language (null a bucket of its own), and length."""
    n = len(source)
    out = np.zeros((n, META), np.float32)
    out[np.arange(n), _hash(source, 64)] = 1
    out[np.arange(n), 64 + _hash(lang, 16)] = 1
    size = np.log1p(np.array([max(0, x) if x is not None else 0 for x in length], np.float64))
    out[:, 80], out[:, 81], out[:, 82] = size, size**2 / 10, [x is None for x in length]
    return out


@dataclass
class Linear:
    """A logistic model on standardised features, then a line that calibrates its output."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) * self.scale) @ self.weight + self.bias

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(x) + self.shift, -12, 12)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 12) -> np.ndarray:
    """Weights of a logistic regression; the last column of x is one and isn't shrunk."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = _sigmoid(x @ w)
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float) -> Linear:
    x = x.astype(np.float64)
    mean, spread = x.mean(axis=0), x.std(axis=0)
    scale = np.where(spread > 1e-6, 1 / np.maximum(spread, 1e-6), 0.0)
    w = _newton(np.column_stack(((x - mean) * scale, np.ones(len(x)))), y, ridge)
    return Linear(mean, scale, w[:-1], float(w[-1]))


def calibrate(model: Linear, x: np.ndarray, y: np.ndarray) -> None:
    """Platt's line from held-out rows, with his smoothed targets; falling lines become flat."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    w = _newton(np.column_stack((model.raw(x.astype(np.float64)), np.ones(len(x)))), target, 1e-3)
    if w[0] > 0:
        model.slope, model.shift = float(w[0]), float(w[1])
    else:
        model.slope, model.shift = 0.0, float(np.log(max(good, 0.5) / max(bad, 0.5)))


@dataclass
class Views:
    """Both calibrated views and the share of good documents; text is None where there was nothing to learn from."""

    text: Linear | None
    meta: Linear | None
    prior: float

    def scores(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of being good: by text, by metadata, by both."""
        if self.text is None:
            same = np.full(len(x), self.prior)
            return same, same, same
        a, b = self.text.logit(x.astype(np.float64)), self.meta.logit(m.astype(np.float64))
        return _sigmoid(a), _sigmoid(b), _sigmoid(a + b - np.log(self.prior / (1 - self.prior)))


def _columns(docs: DataFrame, source: str, lang: str, length: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("binary").alias("_text"), F.col(source).cast("string").alias("_source"), F.col(lang).cast("string").alias("_lang"), F.col(length).cast("long").alias("_length"))


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return text_view([x or b"" for x in batch.column("_text").to_pylist()]), meta_view(*(batch.column(k).to_pylist() for k in ("_source", "_lang", "_length")))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            x, m = _views(part)
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary()), pa.array([r.tobytes() for r in m.astype(np.float16)], pa.binary())], names=["doc_id", "x", "m"])


def _arrays(x: list[bytes], m: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(x), np.float16).reshape(-1, TEXT).astype(np.float32), np.frombuffer(b"".join(m), np.float16).reshape(-1, META).astype(np.float32)


def _confident(held, turn: int, cfg: CoTraining, wanted: tuple[int, int]):
    """Per task and list (text good, text bad, metadata good, metadata bad) the confident unlabelled rows with the smallest hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        views, labelled = held.value
        best: list[pd.DataFrame] = [pd.DataFrame() for _ in range(4)]
        for batch in batches:
            batch = batch[batch["doc_id"].notna()]
            if not len(batch):
                continue
            p, q, _ = views.scores(*_arrays(batch["x"].tolist(), batch["m"].tolist()))
            ids = batch["doc_id"].to_numpy(np.int64)
            h = (mix(ids.view(np.uint64) ^ mix(np.array([cfg.seed * 1000 + turn], np.uint64))) >> np.uint64(1)).astype(np.int64)
            free = ~np.isin(ids, labelled)
            for k, sure in enumerate((p >= cfg.confident, p <= 1 - cfg.confident, q >= cfg.confident, q <= 1 - cfg.confident)):
                at = np.flatnonzero(sure & free)
                at = at[np.argsort(h[at], kind="stable")[: wanted[k % 2]]]
                rows = pd.DataFrame({"list": k, "h": h[at], "doc_id": ids[at], "x": batch["x"].to_numpy()[at], "m": batch["m"].to_numpy()[at]})
                best[k] = pd.concat([best[k], rows]).nsmallest(wanted[k % 2], ["h", "doc_id"]) if len(best[k]) else rows
        for rows in best:
            if len(rows):
                yield rows

    return run


def fit(docs: DataFrame, labels: DataFrame, cfg: CoTraining = CoTraining(), source: str = "source", lang: str = "lang", length: str = "n_chars") -> Views:
    """Co-trained views from documents and labels (doc_id, quality 0 or 1).

    Labels that repeat a document are averaged, null labels and labels without a document
    ignored. With fewer than 20 usable labels, or labels of one kind only, there is nothing to
    learn: every document then gets the share of good labels (1 without any).
    """
    spark = docs.sparkSession
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).alias("good"))
    order = F.xxhash64(F.lit(cfg.seed), "doc_id")
    sample = known.orderBy(order, "doc_id").limit(cfg.max_labels)  # bounded, so it may be broadcast
    features = cut(_columns(docs, source, lang, length).mapInArrow(_featurise, "doc_id long, x binary, m binary"))
    # Rows that repeat an id count once.
    found = features.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.first("good").alias("good"), F.min("x").alias("x"), F.min("m").alias("m"))
    rows = sorted(found.collect(), key=lambda r: r["doc_id"])  # at most max_labels
    y = np.array([r["good"] for r in rows], np.float64)
    prior = float(y.mean()) if len(y) else 1.0
    if len(y) < 20 or min(y.sum(), len(y) - y.sum()) < 4:
        return Views(None, None, prior)
    x, m = _arrays([bytes(r["x"]) for r in rows], [bytes(r["m"]) for r in rows])
    ids = np.array([r["doc_id"] for r in rows], np.int64)
    held = mix(ids.view(np.uint64) ^ np.uint64(cfg.seed)) % np.uint64(4) == 0
    for part in (held, ~held):
        if min(y[part].sum(), part.sum() - y[part].sum()) < 1:
            held = np.arange(len(y)) % 4 == 0
    more: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]  # pseudo-labelled rows of the text view and of the metadata view

    def refit() -> Views:
        out = []
        for mine, extra in ((x, more[0]), (m, more[1])):
            model = fit_linear(np.concatenate([mine[~held], *(a for a, _ in extra)]), np.concatenate([y[~held], *(b for _, b in extra)]), cfg.ridge)
            calibrate(model, mine[held], y[held])
            out.append(model)
        return Views(*out, min(max(prior, 1e-3), 1 - 1e-3))

    views = refit()
    good = max(1, round(cfg.per_round * prior))
    wanted = good, max(1, cfg.per_round - good)
    for turn in range(cfg.rounds):
        given = spark.sparkContext.broadcast((views, ids))
        chosen = cut(features.mapInPandas(_confident(given, turn, cfg, wanted), "list int, h long, doc_id long, x binary, m binary"))
        for k in range(4):
            got = chosen.where(F.col("list") == k).dropDuplicates(["doc_id"]).orderBy("h", "doc_id").limit(wanted[k % 2]).collect()
            if got:
                a, b = _arrays([bytes(r["x"]) for r in got], [bytes(r["m"]) for r in got])
                # What one view is sure of teaches the other.
                more[0 if k >= 2 else 1].append((a if k >= 2 else b, np.full(len(got), 1.0 - k % 2)))
        views = refit()
    return views


def score(docs: DataFrame, keep: list[str], views: Views, cfg: CoTraining = CoTraining(), source: str = "source", lang: str = "lang", length: str = "n_chars", only_kept: bool = False) -> DataFrame:
    """The columns `keep` of all `docs` with p_text, p_meta, p_good (both together) and kept (p_good at least the threshold).

    Null texts count as empty, null metadata as values of their own. Columns of `docs` that
    clash with the new ones aren't kept. only_kept: leave out the rows that aren't.
    """
    held = docs.sparkSession.sparkContext.broadcast(views)
    names = [k for k in keep if k not in {"p_text", "p_meta", "p_good", "kept"}]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)
    rows = docs.select(*names, F.col("text").cast("binary").alias("_text"), F.col(source).cast("string").alias("_source"), F.col(lang).cast("string").alias("_lang"), F.col(length).cast("long").alias("_length"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                p, q, both = held.value.scores(*_views(part))
                out = pa.RecordBatch.from_arrays([*(part.column(k) for k in names), pa.array(p), pa.array(q), pa.array(both), pa.array(both >= cfg.threshold)], names=[*names, "p_text", "p_meta", "p_good", "kept"])
                yield out.filter(out.column("kept")) if only_kept else out

    return rows.mapInArrow(run, f"{schema}{', ' if schema else ''}p_text double, p_meta double, p_good double, kept boolean")
