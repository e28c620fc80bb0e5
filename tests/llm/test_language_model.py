import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from fleetwatch.llm import language_model as lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END = ("end",)


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), END]


class Brute:
    """The same model in dictionaries."""

    def __init__(self, texts):
        self.count, self.pairs = Counter(), Counter()
        for t in texts:
            self.count.update(tokens(t))
            self.pairs.update(zip(["begin", *tokens(t)], tokens(t)))
        self.total, self.kinds, self.contexts = Counter(), defaultdict(Counter), Counter()
        for (h, w), k in self.pairs.items():
            self.total[h] += k
            self.kinds[h][min(k, 3)] += 1
            self.contexts[w] += 1
        self.d2, self.d1 = self.discounts(self.pairs.values()), self.discounts(self.contexts.values())

    @staticmethod
    def discounts(values):
        n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        return {0: 0, **dict(enumerate(lm.discounts(n), 1))}

    def word(self, w):
        kinds = Counter(min(v, 3) for v in self.contexts.values())
        left = sum(self.d1[k] * kinds[k] for k in (1, 2, 3)) / len(self.pairs)
        c = self.contexts[w]
        return max(c - self.d1[min(c, 3)], 0) / len(self.pairs) + left / (len(self.count) + 1)

    def pair(self, h, w):
        if h not in self.total:
            return self.word(w)
        c, left = self.pairs[h, w], sum(self.d2[k] * self.kinds[h][k] for k in (1, 2, 3)) / self.total[h]
        return max(c - self.d2[min(c, 3)], 0) / self.total[h] + left * self.word(w)

    def score(self, text):
        t = tokens(text)
        n, v = sum(self.count.values()), len(self.count)
        return len(t), sum(w in self.count for w in t), sum(math.log10((self.count[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(self.pair(h, w)) for h, w in zip(["begin", *t], t))


@pytest.mark.parametrize("cell_bytes", [1 << 20, 2000])
def test_scores_equal_brute_force(awkward, monkeypatch, cell_bytes):
    monkeypatch.setattr(lm, "CELL_BYTES", cell_bytes)
    rows = awkward.collect()
    learn = awkward.where("doc_id IS NULL OR doc_id % 3 <> 0")
    brute = Brute([r["text"] for r in learn.collect()])
    assert sum(brute.pair("one", w) for w in brute.count) + brute.pair("one", "unseen") == pytest.approx(1)
    trained = lm.train(learn)
    assert (trained[0].tokens, trained[0].vocabulary, trained[0].pairs) == (sum(brute.count.values()), len(brute.count), len(brute.pairs))
    want = {r["doc_id"]: brute.score(r["text"]) for r in rows}
    got = lm.score(awkward, ["doc_id", "score"], trained).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_tokens"], r["n_known"]) == want[r["doc_id"]][:2]
        assert (r["base_score"], r["score"]) == pytest.approx(want[r["doc_id"]][2:])


def test_empty_training_and_empty_input(awkward, no_docs):
    trained = lm.train(no_docs)
    rows = lm.score(awkward, ["doc_id"], trained).collect()
    assert all(r["score"] == 0.0 and r["n_known"] == 0 for r in rows)  # one unseen word is all there is
    assert lm.score(no_docs, ["doc_id"], lm.train(awkward)).count() == 0


def test_held_out_rule(spark):
    rows = spark.range(60).selectExpr("id AS doc_id")
    got = {r["doc_id"]: r["h"] for r in rows.select("doc_id", lm.held_out(rows["doc_id"]).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(60)}
