"""Small document tables for the training-data operators."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs."""

    def docs(pairs, parts=3):
        rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in pairs]
        return spark.createDataFrame(rows, SCHEMA).repartition(parts)

    return docs


@pytest.fixture(scope="session")
def prose():
    """Invented texts with shared passages, near copies, copies and odd white space."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(("ba", "de", "li", "mo", "ru", "é", "ß")) for _ in range(rng.randint(1, 4)))
    passage = [[word() for _ in range(70)] for _ in range(3)]
    out = []
    for _ in range(60):
        words = [word() for _ in range(rng.randint(0, 160))]
        if rng.random() < 0.4:
            p = rng.choice(passage)
            a, at = rng.randint(0, 15), rng.randint(0, len(words))
            words[at:at] = p[a:]
        out.append("".join(w + rng.choice((" ", " ", "  ", "\n", "\t")) for w in words))
    for k in range(20):
        t = out[k].split(" ")
        if len(t) > 4:
            t[rng.randrange(len(t))] = word()
        out.append(" ".join(t))
    return out + [out[3], out[3], "", "   \n"]
