"""Operator 5, substring dedup: difference-cover anchors find where long matches can be, whole windows confirm them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, lean, run_hashes, size_in_bytes, whole_row, words_of

#: Words in a window.
WINDOW = 50
#: A perfect difference cover: the differences of these positions give each remainder modulo the period.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Bytes of text that one chunk of documents holds on average.
CHUNK = 4 << 20
_ABSENT = np.iinfo(np.int64).max


def _texts(column: pa.ChunkedArray) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in column.to_pylist()]


def _placed(w: Words, length: int) -> np.ndarray:
    """Whether a window of `length` words that starts at each word ends in the same text."""
    last = np.repeat(w.first[1:], np.diff(w.first))
    return np.arange(len(w.h)) + length <= last


def _anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of anchors: window - period + 1 words that start at cover positions of a text.

    Two equal windows hold an equal anchor at the same place of each: one of `period` neighbouring
    shifts brings both starts to cover positions.
    """
    length = window - PERIOD + 1
    at_cover = np.zeros(PERIOD, bool)
    at_cover[list(COVER)] = True
    place = np.arange(len(w.h)) - np.repeat(w.first[:-1], np.diff(w.first))
    long_enough = np.repeat(np.diff(w.first) >= window, np.diff(w.first))
    at = np.flatnonzero(at_cover[place % PERIOD] & long_enough & _placed(w, length))
    return at, run_hashes(w.h, length)[at]


def _windows(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes (64 and 32 bits) of the window at every word, from words' two hashes that have nothing in common."""
    return run_hashes(w.hashes[0], window), run_hashes(w.hashes[1], window) >> np.uint64(32)


def _keyed(t: pa.Table) -> pa.Table:
    """The rows that have a key: the others neither give nor lose words."""
    return t.filter(pc.is_valid(t.column("doc")))


def _number(key: tuple) -> int:
    """The chunk of a group; a side of a cogroup that is empty may leave it without one."""
    return key[0].as_py() if key[0].is_valid else 0


def _anchor_rows(window: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        """Anchors of a chunk, each once, with 1 if one of its keys has it and 2 if more have."""
        t = _keyed(t)
        w = words_of(_texts(t.column("text")))
        at, h = _anchors(w, window)
        doc = t.column("doc").to_numpy()[w.text_of()[at]]
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        heads = np.flatnonzero(np.diff(h, prepend=~h[:1]) != 0)
        n = 1 + (doc[heads] != doc[np.append(heads[1:], len(h))[: len(heads)] - 1])
        return pa.table({"h": h[heads].view(np.int64), "chunk": np.full(len(heads), _number(key), np.int64), "n": n.astype(np.int8)})

    return run


def _candidate_rows(window: int):
    def run(key: tuple, t: pa.Table, shared: pa.Table) -> pa.Table:
        """Shared anchors of a chunk, extended on both sides to all windows that hold one; each window once, with the least document that has it and how far above it the greatest is."""
        t = _keyed(t)
        empty = np.empty(0, np.int64)
        h1, h2, low, span = empty, empty.astype(np.int32), empty, empty
        if shared.num_rows and t.num_rows:
            w = words_of(_texts(t.column("text")), 2)
            at, h = _anchors(w, window)
            at = at[np.isin(h.view(np.int64), shared.column("h").to_numpy())]
            near = np.zeros(len(w.h) + 1, np.int64)  # windows from period - 1 words before an anchor to the anchor itself
            np.add.at(near, np.maximum(at - PERIOD + 1, 0), 1)
            np.add.at(near, at + 1, -1)
            at = np.flatnonzero((np.cumsum(near[:-1]) > 0) & _placed(w, window))
            a, b = (x[at] for x in _windows(w, window))
            doc = t.column("doc").to_numpy()[w.text_of()[at]]
            order = np.lexsort((doc, b, a))
            a, b, doc = a[order], b[order], doc[order]
            heads = np.flatnonzero((np.diff(a, prepend=~a[:1]) != 0) | (np.diff(b, prepend=~b[:1]) != 0))
            h1, h2, low = a[heads].view(np.int64), b[heads].astype(np.uint32).view(np.int32), doc[heads]
            span = doc[np.append(heads[1:], len(doc))[: len(heads)] - 1] - low  # mostly 0, which the exchange compresses away
        return pa.table({"h1": h1, "h2": h2, "chunk": np.full(len(h1), _number(key), np.int64), "low": low, "span": span})

    return run


def _removal_rows(window: int):
    def run(key: tuple, t: pa.Table, hit: pa.Table) -> pa.Table:
        """Every text of a chunk without the words that windows of smaller documents cover."""
        texts = _texts(t.column("text"))
        w = words_of(texts, 2 if hit.num_rows else 1)
        doc = t.column("doc")
        gone = np.zeros(len(w.h) + 1, np.int64)
        if hit.num_rows and len(w.h) >= window:
            at = np.flatnonzero(_placed(w, window))
            a, b = (x[at] for x in _windows(w, window))
            mine = np.rec.fromarrays([a.view(np.int64), b.astype(np.uint32).view(np.int32)])
            known = np.rec.fromarrays([hit.column("h1").to_numpy(), hit.column("h2").to_numpy()])
            order = np.lexsort((known.f1, known.f0))
            known, first = known[order], hit.column("first").to_numpy()[order]
            i = np.searchsorted(known.f0, mine.f0)
            least = np.full(len(at), _ABSENT)
            for _ in range(len(known)):  # past equal first halves, of which there is hardly ever more than one
                live = (i < len(known)) & (known.f0[np.minimum(i, len(known) - 1)] == mine.f0) & (least == _ABSENT)
                if not live.any():
                    break
                same = live & (known.f1[np.minimum(i, len(known) - 1)] == mine.f1)
                least[same] = first[i[same]]
                i = i + (live & ~same)
            whose = w.text_of()[at]
            at = at[pc.is_valid(doc).to_numpy()[whose] & (least < pc.fill_null(doc, 0).to_numpy()[whose])]
            np.add.at(gone, at, 1)
            np.add.at(gone, at + window, -1)
        keep = np.cumsum(gone[:-1]) == 0
        n = np.diff(w.first)
        left = np.add.reduceat(np.append(keep, False).astype(np.int64), w.first[:-1]) * (n > 0) if t.num_rows else n
        if "row" in t.column_names:
            out = {"row": t.column("row")}
            kept = [text if n[k] == left[k] else w.kept(k, keep) for k, text in enumerate(texts)]
        else:
            out = {"doc": t.column("doc")}
            kept = [w.kept(k, keep) for k in range(t.num_rows)]
        return pa.table(out | {"n_words": n.astype(np.int64), "n_removed": (n - left).astype(np.int64), "kept": pa.array(kept, pa.binary())})

    return run


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, carry: bool = False, chunk: int = CHUNK) -> DataFrame:
    """n_words, n_removed and kept (words joined by one space, UTF-8) of every row, with the key as doc.

    With `carry` all columns but the text come along as row, and texts that lose no word stay as they were.

    A word goes if a window of `window` words covers it whose words also start in a row with a
    smaller key. Rows are dealt to chunks by their number once, so that copies of one row spread too; that exchange serves
    all three passes: anchors of each chunk, windows around anchors that several texts share, and
    removal. A chunk combines its own rows first: of an anchor or a window it sends one row, however many of its documents have it, and both meet by hash in one exchange each. So a passage that every
    document has costs 28 bytes for each CHUNK bytes of text, in a window that spills; an aggregation joined back
    would need a second exchange of all of them, which is over the disk that there is. Windows are compared by 96 bits of two
    independent hashes. Chunks grow in number with the text, not in size.

    Rows with a null key lose no word and take none from others; null texts are empty. Rows of equal keys take
    none from each other. `window` is at least the period plus 4 words; keys are integers. `docs` gives its rows in
    the same order when a task is run again, as stored tables do.
    """
    if window < PERIOD + 4:
        raise ValueError(f"window is at least {PERIOD + 4}")
    chunks = max(1, size_in_bytes(docs, text) // chunk)
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).alias("chunk")
    held = [whole_row(docs.drop(text)).alias("row")] if carry else []
    dealt = lean(docs).select(spread, F.col(key).cast("long").alias("doc"), F.col(text).alias("text"), *held).groupBy("chunk")
    anchors = dealt.applyInArrow(_anchor_rows(window), "h long, chunk long, n byte")
    shared = anchors.withColumn("keys", F.sum("n").over(Window.partitionBy("h"))).where("keys > 1").select("chunk", "h")
    found = dealt.cogroup(shared.groupBy("chunk")).applyInArrow(_candidate_rows(window), "h1 long, h2 int, chunk long, low long, span long")
    first = found.withColumn("first", F.min("low").over(Window.partitionBy("h1", "h2"))).where("first < low OR span <> 0").select("chunk", "h1", "h2", "first")
    named = docs.select(*held).schema["row"] if carry else T.StructField("doc", T.LongType())
    schema = T.StructType([named, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType())])
    return dealt.cogroup(first.groupBy("chunk")).applyInArrow(_removal_rows(window), schema)


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """`docs` with their columns in order and the text without removed words; other texts stay as they were, null ones as empty."""
    out = removals(docs, key, text, window, carry=True)
    new = F.decode("kept", "UTF-8")
    return out.select(*[new.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of whole documents, and how many of them lie in 50-word passages of a smaller document; see `removals`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = removals(docs)
    return out.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = """
WITH word AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS word,
         generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'), 1) AS pos
  FROM documents),
win AS (
  SELECT doc_id, pos, word, CASE WHEN lead(pos, 49) OVER d IS NOT NULL THEN
         md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) END AS w
  FROM word WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
judged AS (SELECT doc_id, pos, word, w IS NOT NULL AND min(doc_id) OVER (PARTITION BY w) < doc_id AS hit FROM win),
covered AS (
  SELECT doc_id, pos, word, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM judged),
summed AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
  FROM covered GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN summed s ON s.doc_id = d.doc_id
"""
