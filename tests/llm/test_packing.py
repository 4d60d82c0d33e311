import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from matrixloom.llm import packing

ODD = ["", "a<|endoftext|>b <|endoftext|>", " \t\n\n x", "日本語 😀👩‍👧 é ß", "\x00\x01 a\r\n", "don't WE'LL 're", " " * 60 + "x   ", "１２３ ½ ٣٤", "\u0085x y"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def test_ids_equal_the_file_s_own_library(tokenizer, prose):
    for t in [*ODD, *prose, " " * 600_000 + "a", "x" * 20_000]:
        assert packing.token_ids(t, public_tokenizers.path(packing.VOCABULARY)).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("kind,n", [("even", 1), ("even", 40), ("even", 3000), ("short", 2000), ("full", 50), ("half", 31), ("none", 0)])
def test_plans_hold_every_length(kind, n):
    rng = np.random.default_rng(n)
    lengths = {"even": rng.integers(1, 129, n), "short": rng.integers(1, 9, n), "full": np.full(n, 128), "half": np.full(n, 64), "none": np.empty(0, int)}[kind]
    counts = np.bincount(lengths, minlength=129)
    plan = packing.plan(counts, 128)
    used = np.zeros(129, int)
    for p, k in plan:
        assert sum(p) <= 128
        np.add.at(used, p, k)
    assert (used == counts).all()
    least = -(-int(lengths.sum()) // 128)
    assert sum(k for _, k in plan) <= max(least * 1.15 + 2, least)


def test_fitted_patterns_do_most_of_the_packing():
    counts = np.bincount(np.random.default_rng(1).integers(1, 129, 60_000), minlength=129)
    assert sum(k for _, k in packing.plan(counts, 128)) <= 1.01 * -(-int((counts * np.arange(129)).sum()) // 128)


def test_pieces_lie_gapless_and_hold_the_ids(spark, make, tokenizer, prose):
    texts = [*prose, None, "w " * 3000, *ODD]
    docs = make([*enumerate(texts), (None, "null key"), (0, prose[0])])
    rows = packing.packed(docs, length=64).select("row.*", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").toPandas()
    assert list(rows.columns)[:4] == ["doc_id", "lang", "source", "n_chars"]
    g = rows.sort_values(["sequence_id", "offset"])
    assert (g.groupby("sequence_id")["length"].cumsum() - g["length"] == g["offset"]).all()
    assert g.groupby("sequence_id")["length"].sum().max() <= 64
    for k, t in list(enumerate(texts))[1:]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        mine = rows[rows.doc_id == k].sort_values("piece")
        assert mine["piece"].tolist() == list(range(len(mine))) and mine["length"].sum() == len(ids)
        assert (mine["length"].iloc[1:] == 64).all()
        for s, n, c in zip(mine["start"], mine["length"], mine["ids_crc32"]):
            assert zlib.crc32(ids[s : s + n].tobytes()) == c
    assert len(rows[rows.doc_id == 0]) == 2 * len(rows[(rows.doc_id == 0)].drop_duplicates("piece"))
    assert rows["doc_id"].isna().sum() == 1


def test_empty_table(make):
    assert packing.packed(make([])).isEmpty()


def test_columns_that_clash_stay_in_the_row(make):
    docs = make([(1, "a b"), (2, None)])
    docs = docs.withColumns({c: docs["lang"] for c in ("piece", "length", "number", "batch", "nth", "sequence_id", "row")})
    rows = packing.packed(docs, length=64).collect()
    assert sorted((r["row"]["doc_id"], r["row"]["length"], r["piece"], r["length"]) for r in rows) == [(1, "en", 0, 3), (2, "en", 0, 1)]
