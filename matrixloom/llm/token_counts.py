"""Operator 6, token counts: huge documents are encoded in overlapping chunks, spliced where boundaries are proven stable."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, slices

MODEL = "piece_bpe_32k.model"
#: Characters of text beyond which a document is encoded in chunks, of a chunk, and of the first overlap.
HUGE, CHUNK, OVERLAP = 1 << 16, 1 << 15, 1 << 8
LIMIT = 4096
_MARK = "▁"


@lru_cache(2)
def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(2)
def _breakable(path: str) -> bool:
    """Whether no piece has a space mark after another character.

    Merges join neighbours into a piece of the vocabulary, so then none ever spans the place
    between a character and a following space, and what stands on either side is encoded alike with or without the other.
    """
    model = _model(path)
    inner = (model.id_to_piece(i).lstrip(_MARK) for i in range(model.get_piece_size()))
    return not any(_MARK in p for p in inner)


def _cuts(text: str, lo: int, hi: int) -> list[int]:
    """Places in text[lo:hi] at a space or space mark after another character: no token ever spans them."""
    blank = (" ", _MARK)
    return [i for i in range(max(lo, 1), hi) if text[i] in blank and text[i - 1] not in blank]


def _boundaries(text: str, path: str, at: int, lead: bool) -> tuple[list[int], np.ndarray]:
    """Ids of a chunk that begins at `at` in its document, and where each token begins in the document.

    The encoder sets a space before its input; a chunk inside a document (`lead`) is read after a line
    break that is then left out, so that the space isn't counted.
    """
    proto = _model(path).encode(("\n" if lead else "") + text, return_type="proto")
    own = [p for p in proto.pieces if not lead or p.end > 1]
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass") + b" ", np.uint8)
    place = np.cumsum((raw & 0xC0) != 0x80) - 1  # of the character that holds each byte
    begin = np.array([p.begin for p in own], np.int64) - (1 if lead else 0)
    return [p.id for p in own], place[begin] + at


def spliced(text: str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, from chunks whose overlaps hold a boundary that both encode and that is proven stable.

    Where an overlap holds none it is widened, twofold each time, up to the rest of the text: a text
    without such a boundary is encoded whole. The count is the whole text's either way.
    """
    if not _breakable(path):
        return len(_model(path).encode(text))
    total, lo, wide = 0, 0, overlap
    size = chunk
    while True:
        hi = min(len(text), lo + size + wide)
        ids, begin = _boundaries(text[lo:hi], path, lo, lo > 0)
        if hi == len(text):
            return total + len(ids)
        ahead, ahead_begin = _boundaries(text[hi - wide : hi + wide], path, hi - wide, True)
        common = np.intersect1d(np.intersect1d(begin, ahead_begin), np.array(_cuts(text, hi - wide + 1, hi), np.int64))
        if len(common):
            cut = int(common[-1])
            total += int(np.searchsorted(begin, cut, side="left"))
            lo, wide = cut, overlap
        else:
            wide *= 2


def counted(texts: list[str | None], path: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Tokens of each text; a null one has none."""
    short = [t for t in texts if t and len(t) <= huge]
    counts = iter([len(x) for x in _model(path).encode(short, num_threads=1)] if short else [])
    return [0 if not t else next(counts) if len(t) <= huge else spliced(t, path, chunk, overlap) for t in texts]


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens and over_limit of every row; null texts count as empty. Repeated rows and null keys stay."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [x for texts in slices(b.column(2)) for x in counted(texts, path, huge, chunk, overlap)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["key", "n_bytes", "n_tokens"])

    rows = lean(docs).select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole document; see `token_counts`."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
