"""A small table of awkward documents for all operators."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string, set long, copy string"


def awkward_rows():
    """Nulls, empty and very long texts, repeated rows, near and exact copies; columns that clash with results."""
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    base = [rng.choice(words) + str(rng.randrange(50)) for _ in range(120)]
    near = [*base[:60], "changed", *base[61:]]
    texts = {1: " ".join(base), 2: " ".join(base).upper(), 3: "\t".join(near), 4: None, 5: "", 6: " \n\t ", 7: "one two three", 8: "one two  three", 9: "x" * 5000,
             10: "word " * 3000, 11: "line a b c\nline a b c\n\nother \x0b line\n", 12: "naïve 漢字 \U0001F600 ▁ ok", 13: "*** $$ ## | <b> && %%", 14: " ".join(base[:30] * 3), 15: "The! The!! SHOUTING TEXT ALL CAPS " * 4}
    rows = [(k, t, None if k == 5 else "en", None if k == 7 else f"s{k % 2}", None if t is None else len(t), 0.5, "x", 9, "y") for k, t in texts.items()]
    return [*rows, rows[0], rows[3], (None, "a row without an id " * 3, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
