"""Readers of the other formats that score tables come in."""

from __future__ import annotations

import _hashlib
import ctypes
import io
import json
import lzma
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import stored

#: Bytes up to which a file is read whole for its digest, bytes of a longer one that a task adds in one round, and bytes of a stored piece.
WHOLE, ROUND, PIECE = 128 << 20, 256 << 20, 1 << 20
#: Files that Spark's reader of lines would unpack; they are read whole.
PACKED = r"\.(gz|gzip|bz2|zst|lz4|snappy|deflate)$"
#: What the reader of lines leaves out at a file's start.
MARK = b"\xef\xbb\xbf"


def delimited(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A CSV or TSV, plain or gzipped, with header names stripped. Without a schema all columns are text, so the file is read once."""
    df = spark.read.csv(path, sep=sep, header=True, schema=schema, encoding=encoding)
    return df.toDF(*[c.strip() for c in df.columns])


def positional(df: DataFrame, first: int, last: int) -> DataFrame:
    """Columns by place; the scan reads no others."""
    return df.select(*[f"`{c}`" for c in df.columns[first:last]])


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON list of records."""
    return spark.read.json(path, schema=schema, multiLine=True, mode="FAILFAST")


def exactly_one(df: DataFrame, key: str, where: str) -> DataFrame:
    """Rows that meet a condition, after a check that each key has one."""
    from ..operators.contracts import unique

    return unique(df.where(where), [key])


def array_archive(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(name, row, x): rows of two-dimensional arrays in .npz files, read where the file's task runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    for n in names:
                        x = np.atleast_2d(held[n]).astype(float)
                        yield pd.DataFrame({"name": n, "row": np.arange(len(x)), "x": list(x)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "name string, row long, x array<double>")


def delimited_records(spark: SparkSession, path: str, end: str = "$$$$") -> DataFrame:
    """(path, number, record): records of xz-compressed or plain text files that end with a line of their own.

    A file's text is taken apart as a stream; one that doesn't end with the mark raises.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where, content in zip(b["path"], b["content"]):
                raw = io.BytesIO(content)
                lines = io.TextIOWrapper(lzma.open(raw) if where.endswith(".xz") else raw, "utf-8")
                held: list[str] = []
                number = 0
                for line in lines:
                    if line.rstrip("\r\n") == end:
                        yield pd.DataFrame({"path": [where], "number": [number], "record": ["".join(held)]})
                        held, number = [], number + 1
                    else:
                        held.append(line)
                if "".join(held).strip():
                    raise ValueError(f"{where} ends inside a record")

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, number long, record string")


def text_records(spark: SparkSession, path: str, end: str = "$$$$") -> DataFrame:
    """(record,): records of plain text files that end with a line of their own. Spark's reader cuts files at the mark, so that tasks share a large file; one that ends inside a record raises."""
    read = spark.read.text(path, lineSep=end + "\n").where(F.length(F.trim("value")) > 0)
    torn = F.raise_error(F.concat(F.lit("a file ends inside a record: "), F.substring("value", 1, 80)))
    return read.select(F.when(F.col("value").endswith("\n"), F.col("value")).otherwise(torn).alias("record"))


def fixed_width(lines: DataFrame, fields: dict[str, tuple[int, int]], text: str = "value") -> DataFrame:
    """Columns cut from text lines at (first, last) places from 0, trimmed."""
    return lines.select("*", *[F.trim(F.substring(text, a + 1, b - a)).alias(n) for n, (a, b) in fields.items()])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files; empty ones are left out, as Spark's reader does.

    Files of over WHOLE bytes are read as lines, which can be split, and stored as pieces. The digest is a chain, so a file's pieces go through it in rounds of
    ROUND bytes: a task takes the state that the round before left and adds one round's pieces. So no task reads a whole long file, and its size has no bound.
    Packed files (by their name) are read whole, as Spark has no other reader for them.
    """
    name = F.col("_metadata.file_path")
    long = (F.col("_metadata.file_size") > WHOLE) & ~name.rlike(PACKED)
    every = spark.read.format("binaryFile").load(path)
    whole = every.where(~long).select("path", "length", F.sha2("content", 256).alias("sha256"))
    sizes = every.where(long).select("path", "length", name.alias("name"))
    largest = sizes.agg(F.max("length")).first()[0]
    if largest is None:
        return whole
    lines = spark.read.text(path, lineSep="\n").where(long)
    pieces = stored(_pieces(lines.select(name.alias("name"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))), "digest-pieces")
    ends = pieces.groupBy("name").agg(F.sum(F.octet_length("bytes")).alias("n")).join(sizes.select("name", "length"), "name")
    # one line feed too many where the last line has none, and the mark too few
    state = ends.select("name", (F.pmod(F.col("n") - F.col("length"), F.lit(3)) == 1).alias("cut"), (F.col("n") < F.col("length")).alias("marked"), F.lit(None).cast("binary").alias("state"))
    for k in range(-(-largest // ROUND)):
        state = stored(_added(state, pieces.where(F.col("round") == k)), "digest-states")
    return whole.union(sizes.join(_ended(state), "name").select("path", "length", "sha256"))


def _pieces(lines: DataFrame) -> DataFrame:
    """(name, start, number, round, bytes): lines (name, start, line) of splits of files, a line feed after each, in pieces that are numbered within a split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, held, size = None, 0, [], 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"name": [at[0]], "start": [at[1]], "number": [number], "round": [at[1] // ROUND], "bytes": [b"\n".join([*held, b""])]}, schema=schema)

        for b in batches:
            for name, start, line in zip(*(c.to_pylist() for c in b.columns)):
                if held and (at != (name, start) or size >= PIECE):
                    yield piece()
                    number, held, size = (number + 1 if at == (name, start) else 0), [], 0
                at = name, start
                held.append(line)
                size += len(line) + 1
        if held:
            yield piece()

    schema = pa.schema([("name", pa.string()), ("start", pa.int64()), ("number", pa.int64()), ("round", pa.int64()), ("bytes", pa.binary())])
    return lines.mapInArrow(run, "name string, start long, number long, round long, bytes binary")


def _added(state: DataFrame, pieces: DataFrame) -> DataFrame:
    """(name, cut, marked, state): the states of files after one more round of pieces. The last byte seen waits, since the file may end before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, head = None, None
        for b in batches:
            for row in b.to_pylist():
                if row["start"] < 0:
                    if head:
                        yield of(head, chain)
                    head, chain = row, Chain(row["bytes"])
                    if row["bytes"] is None and row["marked"]:
                        chain.add(MARK)
                else:
                    chain.add(row["bytes"])
        if head:
            yield of(head, chain)

    def of(head: dict, chain: Chain) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"name": [head["name"]], "cut": [head["cut"]], "marked": [head["marked"]], "state": pa.array([chain.state()], pa.binary())})

    first = state.select("name", F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("number"), "cut", "marked", F.col("state").alias("bytes"))
    rows = first.union(pieces.select("name", "start", "number", F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), "bytes"))
    return rows.repartition("name").sortWithinPartitions("name", "start", "number").mapInArrow(run, "name string, cut boolean, marked boolean, state binary")


def _ended(state: DataFrame) -> DataFrame:
    """(name, sha256) of files whose pieces have all been added."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"name": b["name"], "sha256": [Chain(s).digest(cut) for s, cut in zip(b["state"], b["cut"])]})

    return state.mapInPandas(run, "name string, sha256 string")


class Chain:
    """SHA-256 whose state can go from task to task: OpenSSL's, which Python's hashlib is linked to, with the last byte held back."""

    _lib = None

    def __init__(self, state: bytes | None = None) -> None:
        if Chain._lib is None:
            Chain._lib = ctypes.CDLL(_hashlib.__file__)
        self._context = ctypes.create_string_buffer(128)
        self._last = b""
        if state is None:
            self._lib.SHA256_Init(self._context)
        else:
            self._context.raw, self._last = state[:128], state[128:]

    def add(self, data: bytes) -> None:
        if data:
            for x in (self._last, data[:-1]):
                self._lib.SHA256_Update(self._context, x, ctypes.c_size_t(len(x)))
            self._last = data[-1:]

    def state(self) -> bytes:
        return self._context.raw + self._last

    def digest(self, cut: bool = False) -> str:
        """The digest, of all but the last byte if it is cut."""
        end, out = Chain(self.state()), ctypes.create_string_buffer(32)
        if not cut:
            self._lib.SHA256_Update(end._context, self._last, ctypes.c_size_t(len(self._last)))
        self._lib.SHA256_Final(out, end._context)
        return out.raw.hex()


def gated(spark: SparkSession, path: str, sha256: str) -> str:
    """`path`, after a check that the file there has a digest."""
    found = [r["sha256"] for r in digests(spark, path).collect()]
    if found != [sha256]:
        raise ValueError(f"{path} isn't the file that was declared")
    return path


def strict_json(text: str):
    """A JSON document without NaN and infinities."""

    def refuse(x: str):
        raise ValueError(f"{x} in JSON")

    return json.loads(text, parse_constant=refuse)


def simulated(spark: SparkSession, entities: int, features: int, seed: int, factor: float = 1.0, interaction: float = 1.0) -> DataFrame:
    """Cells with entity and feature effects, a shared factor with feature loadings, and noise, all from hashes of the seed."""
    from ..operators.resample import uniform

    def normal(*key):
        return F.sqrt(-2 * F.log(uniform(seed, *key, 1))) * F.cos(2 * np.pi * uniform(seed, *key, 2))

    base = spark.range(entities).select(F.col("id").alias("entity"), F.explode(F.sequence(F.lit(0), F.lit(features - 1))).alias("feature"))
    e, t = F.col("entity"), F.col("feature")
    value = factor * normal("entity", e) + normal("feature", t) + normal("factor", e) * normal("loading", t) + interaction * normal("cell", e, t)
    return base.select("entity", "feature", value.alias("value"))
