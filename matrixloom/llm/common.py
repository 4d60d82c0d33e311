"""Helpers that the training-data operators share: shared-folder tables, row wrapping, word arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Odd multipliers of hash steps, and the salts of a word's two hashes.
_LEFT, _RIGHT, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_SALTS = (0x5851F42D4C957F2D, 0xA0761D6478BD642F)
#: Bytes of a word that are hashed side by side with other words'; longer words are hashed one by one.
_LANES = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where the setting is absent, a local session gets a scratch folder of its own; a cluster
    session raises, since a machine-local folder would lose rows there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: a lineage cut that outlives executors.

    `discard` removes the folder; else Spark's Hadoop file system does when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/matrixloom-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    fs, where = _hadoop(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the files of a table that `written` made, once all that read it has been written itself."""
    fs, where = _hadoop(df.sparkSession, df._stored_at)
    fs.delete(where, True)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def whole_row(df: DataFrame) -> Column:
    """All columns of `df` as one struct, so that added columns can't clash with them."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns])


def lean(df: DataFrame) -> DataFrame:
    """`df`, after its session is set to pass texts to Python in batches of 4 MB at most: both sides hold a few batches of every task."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return df


def size_in_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes in a text column (0 for an empty table)."""
    return df.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0


def slices(column: pa.Array, rows: int = 256) -> Iterator[list]:
    """A column's values a few rows at a time, so that a batch of texts is never held twice over."""
    for lo in range(0, len(column), rows):
        yield column.slice(lo, rows).to_pylist()


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser over an array of hashes."""
    h = h ^ np.uint64(salt)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of several texts laid out in one buffer: byte span and hashes of each, and each text's first word."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: list[np.ndarray]

    @property
    def h(self) -> np.ndarray:
        return self.hashes[0]

    def text_of(self) -> np.ndarray:
        """The text's number for every word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def kept(self, text: int, keep: np.ndarray | None = None) -> bytes:
        """A text's words (or those that `keep` marks), joined by one space."""
        a, b = self.first[text], self.first[text + 1]
        at = range(a, b) if keep is None else (np.flatnonzero(keep[a:b]) + a).tolist()
        d, s, e = self.data, self.start, self.end
        return b" ".join([d[s[i] : e[i]] for i in at])


def words_of(texts: list[bytes], hashes: int = 1, block: int = 1 << 17, apart: np.ndarray = SPACE) -> Words:
    """Splits texts at ASCII white space, or at the bytes that `apart` marks (line feed among them), and gives every word one or two 64-bit hashes, a block of words at a time."""
    data = b"\n".join(texts) + b"\n" * 8
    edge = np.flatnonzero(np.diff(apart[np.frombuffer(data, np.uint8)], prepend=True))
    start, end = edge[0::2], edge[1::2]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(start, begins)
    out = [np.empty(len(start), np.uint64) for _ in range(hashes)]
    for lo in range(0, len(start), block):
        for h, salt in zip(out, _SALTS):
            h[lo : lo + block] = _word_hashes(data, start[lo : lo + block], end[lo : lo + block], salt)
    for i in np.flatnonzero(end - start > _LANES).tolist():
        both = xxhash.xxh3_128_intdigest(data[start[i] : end[i]])
        for k, h in enumerate(out):
            h[i] = both >> 64 * k & 0xFFFFFFFFFFFFFFFF
    return Words(data, start, end, first, out)


def _word_hashes(data: bytes, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    """A hash of every word of up to _LANES bytes: eight bytes a step go through a finaliser, which begins with length and salt."""
    lanes = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    size = end - start
    h = mixed(size.astype(np.uint64) * _STEP, salt)
    at = np.flatnonzero(size <= _LANES)
    done = 0
    while len(at):
        left = size[at] - done
        h[at] = mixed(h[at] * _STEP + (lanes[start[at] + done] & mask[np.minimum(left, 8)]), salt)
        at, done = at[left > 8], done + 8
    return h


def run_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of `length` neighbours in `h`; texts that follow each other aren't told apart.

    Runs of powers of two are joined from halves, and `length` from the powers that it is the sum of. A join isn't linear, so
    sequences whose sums cancel don't meet as they do under a polynomial.
    """
    n = len(h) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, at, size, level = None, 0, 1, h
    while True:
        if length & size:
            part = level[at : at + n]
            out = part if out is None else _joined(out, part)
            at += size
        if 2 * size > length:
            return mixed(out, length)
        level = _joined(level[:-size], level[size:])
        size *= 2


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _LEFT + b * _RIGHT
    x ^= x >> np.uint64(32)
    x *= _STEP
    return x


def distinct_shingles(texts: list[str | None], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(which text, hash) of every distinct run of `shingle` words, by text and hash. A-Z is lower-cased; a text of fewer words is one run, one without words has none."""
    w = words_of([t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts])
    n = np.diff(w.first)
    runs = run_hashes(w.h, shingle)
    whose = w.text_of()[: len(runs)]
    inside = np.arange(len(runs)) + shingle <= w.first[1:][whose]
    short = np.flatnonzero((n > 0) & (n < shingle))
    h = np.concatenate([runs[inside], *[run_hashes(w.h[w.first[k] : w.first[k + 1]], int(n[k])) for k in short.tolist()]])
    whose = np.concatenate([whose[inside], short])
    order = np.lexsort((h, whose))
    h, whose = h[order], whose[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (whose[1:] != whose[:-1])
    return whose[new], h[new]
