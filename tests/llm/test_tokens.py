import random
import time

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from matrixloom.llm import bpe, token_counts

ODD = ["", "<|endoftext|> <s></s>", "日本語 😀👩‍👧 é ß", "\x00\x01 a\r\n", "a" * 5000, "abcabd" * 400, " " * 3000, "ñ" * 999, "don't WE'LL", "▁▁a ▁ b" * 50, "  x  " * 200, "a\n" * 900]


@pytest.fixture(scope="module")
def sp():
    return token_counts._model(public_tokenizers.path(token_counts.MODEL))


def test_spliced_counts_equal_whole_ones(sp, prose):
    path = public_tokenizers.path(token_counts.MODEL)
    for t in [*ODD, *prose, " ".join(prose), "x" * 4000 + " " + "yz " * 500]:
        for chunk, overlap in ((40, 4), (300, 16), (5000, 64)):
            assert token_counts.spliced(t, path, chunk, overlap) == len(sp.encode(t))


def test_counts_of_rows(spark, make, sp, prose):
    texts = [*ODD, *prose, None]
    docs = make([*enumerate(texts), (None, "a b"), (0, "")]).withColumn("n_bytes", F.lit("clash"))
    got = sorted((tuple(r) for r in token_counts.token_counts(docs, huge=500, chunk=200, overlap=8, limit=100).collect()), key=str)
    one = lambda k, t: (k, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 100)
    assert got == sorted([one(k, t) for k, t in [*enumerate(texts), (None, "a b"), (0, "")]], key=str)
    assert token_counts.token_counts(docs.limit(0)).isEmpty()


@pytest.fixture(scope="module")
def known():
    coder = bpe.Coder(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    return coder, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def test_bpe_ids_equal_the_library_s(known, prose):
    coder, library = known
    texts = [*ODD, *prose, "x" * 50_000]
    for t, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == library.encode_ordinary(t)
        assert coder.decode(ids) == t.encode()


def test_long_words_merge_as_short_ones_do(known, monkeypatch):
    coder, library = known
    monkeypatch.setattr(bpe, "LONG", 3)
    words = ["abababab", "aaaaa", "mississippi", "zzzzzzzzz", "hellohello"]
    for w, ids in zip(words, bpe.encode_words(coder.table, [w.encode() for w in words])):
        assert ids.tolist() == library.encode_ordinary(w)


def test_bpe_rows_and_a_dropped_memory(spark, make, known, prose, monkeypatch):
    _, library = known
    docs = make([*enumerate(prose), (None, None), (0, prose[0])])
    for r in bpe.coded(docs).collect():
        text = prose[r["doc_id"]] if r["doc_id"] is not None else ""
        assert list(memoryview(r["ids"]).cast("I")) == library.encode_ordinary(text) and r["decoded"] == text.encode()
    small = bpe.Coder(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN, kept=5)
    assert [small.encode([t])[0].tolist() for t in prose[:20]] == [library.encode_ordinary(t) for t in prose[:20]]
    assert bpe.digests(docs.limit(0)).isEmpty()


def test_long_words_take_the_short_way_only_where_it_is_proven(known):
    coder, _ = known
    assert coder.table.ordered
    single = {bytes([b]): b for b in range(256)}
    falling = bpe.merges_of(single | {b"abc": 256, b"ab": 257})  # ab is made before abc, whose rank is lower
    assert not falling.ordered and bpe.merges_of(single | {b"ab": 256, b"abc": 257}).ordered
    word = b"ab" * 700 + b"abcab"
    assert bpe.encode_words(falling, [word])[0].tolist() == [257] * 700 + [256, 257]


def test_a_megabyte_of_letters_is_quick(known):
    """One word of a million random letters; ids equal the library's, in seconds."""
    coder, _ = known
    rng = random.Random(8)
    whole = tiktoken.Encoding("one", pat_str=r"[\s\S]+", mergeable_ranks=coder.ranks, special_tokens={})
    for alphabet, n in (("abcdefghijklmnopqrstuvwxyz", 1_000_000), ("ab", 100_001), ("thein ", 100_000), ("éàß", 60_000), ("a", 99_999)):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        began = time.process_time()
        ids = bpe.encode_words(coder.table, [text.encode()])[0]
        assert time.process_time() - began < 10
        assert ids.tolist() == whole.encode_ordinary(text)


def test_columns_that_clash(make):
    docs = make([(1, "a b"), (2, None)]).withColumns({"n_tokens": F.lit("x"), "ids": F.lit(3), "ids_sha256": F.lit("y"), "decoded": F.lit("z"), "decoded_sha256": F.lit(1)})
    assert sorted((r["doc_id"], r["n_tokens"]) for r in bpe.digests(docs).collect()) == [(1, 2), (2, 0)]
    assert sorted((r["doc_id"], r["decoded"]) for r in bpe.coded(docs).collect()) == [(1, b"a b"), (2, b"")]
