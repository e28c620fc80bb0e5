import hashlib
from collections import Counter

import pytest

from fleetwatch.llm import alignment

A_PATH, B_PATH = alignment.default_paths()


def tokens(encoder, text):
    """(id, bytes) of both sides, straight from the tokenizers."""
    if not text:
        return [], []
    a = [(i, encoder.a_bytes[i]) for i in encoder.a.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in encoder.b.encode(text):
        piece = encoder.b.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if encoder.b.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = b" " + text.encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return [], []
    return a, b


def spans(side):
    at, out = 0, []
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(encoder, texts):
    held, counts = [], Counter()
    for text in texts:
        a, b = map(spans, tokens(encoder, text))
        links = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]
        common = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for high in common:
            groups.append(",".join(str(i) for i, s, e in a if low <= s and e <= high) + "|" + ",".join(str(i) for i, s, e in b if low <= s and e <= high))
            low = high
        held.append((len(a), len(b), groups, links))
        counts.update(set(links))
    most = {}
    for (i, _), n in counts.items():
        most[i] = max(most.get(i, 0), n)
    return [
        (a, b, len(g), len(x), sum(counts[p] == most[p[0]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for a, b, g, x in held
    ], counts


TEXTS = [
    None, "", " ", "a", "The quick brown fox.", "The quick brown fox.", "naïve 漢字 \U0001F600 café", "<|endoftext|> and <s> and <unk>", "under▁score", "x" * 700, "a b " * 300,
    "tabs\tand\n\nlines\r\n  end ", "1234567890 3.14159", "ﬁne ½ Ⅷ", "\x00\x07 control", "don't we'll", "Größe Ñandú çé", "the the the th e",
]


@pytest.mark.parametrize("bound", [None, 40])
def test_equals_brute_force(spark, monkeypatch, bound):
    if bound:
        monkeypatch.setattr(alignment, "FILE", bound)
        monkeypatch.setattr(alignment, "HELD", bound)
        monkeypatch.setattr(alignment, "SLICE", 100)
    pair = alignment.Pair.load(A_PATH, B_PATH)
    want, counts = brute(alignment.Encoder(pair), TEXTS)
    docs = spark.createDataFrame([(k, t, "clash", 7) for k, t in enumerate(TEXTS)], "doc_id long, text string, n_best string, code int").repartition(3)
    corpus = alignment.align(docs, ["doc_id", "code", "n_best"], pair, groups=True)
    got = sorted(alignment.score(corpus).collect())
    assert [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in got] == want
    assert all(r["code"] == 7 for r in got)
    assert {(r["a"], r["b"]): r["n"] for r in alignment.pair_counts(corpus).collect()} == dict(counts)
    assert got[8]["n_a"] == 0 and got[7]["n_a"] > 0


def test_faster_encoder_gives_the_same_ids():
    """Every code point of the first planes in several places, and very long runs."""
    encoder = alignment.Encoder(alignment.Pair.load(A_PATH, B_PATH))
    assert encoder.ranked is not None
    points = [c for c in [*range(0x3100), *range(0xA000, 0xAC00), *range(0xF900, 0x10400), *range(0x1F000, 0x1FB00)] if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{chr(c)}b 1{chr(c)}2 .{chr(c)}, {chr(c)}a  {chr(c)}{chr(c)}x {chr(c)}1" for c in points]
    texts += ["x" * 100_000, "ab1" * 50_000, " " * 200_000 + "a", "\n" * 3000 + "b \t" * 2000, ".,'s" * 30_000, "\u00a0" * 600]
    want = [e.ids for e in encoder.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
    assert [encoder._encode_a(t) for t in texts] == want


def test_identity_map():
    encoder = alignment.Encoder(alignment.Pair.load(A_PATH, B_PATH))
    for i, j in enumerate(encoder.same.tolist()):
        assert j < 0 or encoder.a_bytes[i] == encoder.b_bytes[j]
    assert (encoder.same >= 0).sum() > 10_000


def test_awkward_rows_and_empty_table(awkward, no_docs):
    pair = alignment.Pair.load(A_PATH, B_PATH)
    rows = awkward.collect()
    got = alignment.score(alignment.align(awkward, awkward.columns, pair)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    want, _ = brute(alignment.Encoder(pair), [r["text"] for r in sorted(rows, key=key)])
    assert [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in sorted(got, key=key)] == want
    assert alignment.score(alignment.align(no_docs, ["doc_id"], pair)).collect() == []
