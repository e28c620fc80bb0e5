import random
import time

import pytest

from fleetwatch.llm import pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(pieces.default_path())


def every_path(lattice, vocabulary, text):
    out = []

    def go(at, score, ids):
        if at == len(text):
            out.append((score, ids))
            return
        for end in range(at + 1, min(len(text), at + lattice.longest) + 1):
            i = lattice.ids.get(text[at:end])
            if i is not None:
                go(end, score + vocabulary.scores[i], [*ids, i])
            elif end == at + 1:
                go(end, score + lattice.unknown, [*ids, *(vocabulary.byte_ids[b] for b in text[at].encode())])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


def test_n_best_equal_brute_force(vocabulary):
    rng = random.Random(1)
    encoder = pieces.Encoder(vocabulary, 4)
    texts = ["a", " a", "a  b", "the\nend", "é 漢\U0001F600", "\n\n", " ", *("".join(rng.choice("abeth é\n") for _ in range(rng.randint(1, 9))) for _ in range(40))]
    for text, (ids, scores, changes) in zip(texts, encoder.encode(texts)):
        best = every_path(encoder.lattice, vocabulary, ("▁" + text).replace(" ", "▁"))[:4]
        assert scores == pytest.approx([s for s, _ in best])
        assert len(changes) == len(scores) - 1
        assert encoder.decode(ids).decode() == text


def test_changes_are_the_other_paths(vocabulary):
    encoder = pieces.Encoder(vocabulary, 4)
    text = "and the other thing"
    ids, scores, changes = next(iter(encoder.encode([text])))
    segments = pieces.SEGMENT.findall(("▁" + text).replace(" ", "▁"))
    plain = [encoder.lattice.search(s, 1)[0][1] for s in segments]
    for score, change in zip(scores[1:], changes):
        path = dict(enumerate(plain)) | dict(change)
        flat = [i for k in range(len(segments)) for i in path[k]]
        assert sum(vocabulary.scores[i] for i in flat) == pytest.approx(score)
        assert encoder.decode(pieces.np.array(flat)).decode() == text


def test_long_segments_take_the_single_search(vocabulary):
    encoder = pieces.Encoder(vocabulary, 3)
    for length in (47, 48, 49, 400):
        text = ("abcdefgh" * 60)[:length]
        (ids, scores, _), = encoder.encode([text])
        assert scores == pytest.approx([s for s, _ in encoder.lattice.search("▁" + text, 3)])
        assert encoder.decode(ids).decode() == text


def test_round_trip_of_awkward_rows(awkward, no_docs, vocabulary):
    out = pieces.encode(awkward, ["doc_id", "score", "text"], vocabulary)
    rows = pieces.decode(out, vocabulary).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert r["restored"] and r["decoded"] == (r["text"] or "").replace("▁", " ")
        assert r["n_pieces"] == len(r["pieces"]) and r["score"] in (0.5, None)
    assert pieces.encode(no_docs, ["doc_id"], vocabulary).count() == 0


def test_dropping_kept_segments_changes_nothing(vocabulary, monkeypatch):
    texts = [f"some words number {i} here" for i in range(60)]
    want = [(i.tolist(), s) for i, s, _ in pieces.Encoder(vocabulary, 3).encode(texts)]
    monkeypatch.setattr(pieces, "KEPT", 20)
    encoder = pieces.Encoder(vocabulary, 3)
    got = [(i.tolist(), s) for at in range(0, 60, 7) for i, s, _ in encoder.encode(texts[at : at + 7])]
    assert got == want


def test_long_tied_segments_end_soon(vocabulary):
    """Scores are whole ranks, so runs of one letter have very many best paths; none is lost and none is repeated."""
    encoder = pieces.Encoder(vocabulary, 4)
    texts = ["a" * 100_000, "ab" * 3000, "a" * 30]
    before = time.process_time()
    for text, (ids, scores, changes) in zip(texts, encoder.encode(texts)):
        assert encoder.decode(ids).decode() == text and scores == sorted(scores, reverse=True) and len(scores) == 4
        alternatives = [tuple(c[0][1]) for c in changes]
        assert len({tuple(ids.tolist()), *alternatives}) == 4
        rank = lambda path: sum(vocabulary.scores[i] for i in path)
        assert [rank(ids.tolist()), *map(rank, alternatives)] == pytest.approx(scores)
    assert time.process_time() - before < 60
    short = "▁" + "a" * 12
    assert [s for s, _ in encoder.lattice.search(short, 6)] == pytest.approx([s for s, _ in every_path(encoder.lattice, vocabulary, short)[:6]])
