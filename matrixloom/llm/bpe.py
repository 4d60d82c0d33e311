"""Operator 10, byte-level BPE: words in padded matrices, all rows merging one pair a round."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import lean, slices

RANKS = "byte_bpe_50k.tiktoken"
_NONE = np.iinfo(np.int64).max
#: Encoded words that a task keeps for later texts; the memory is dropped and begun anew beyond it.
KEPT_WORDS = 400_000
#: Texts that are encoded together, and cells of one matrix.
BLOCK, CELLS = 1000, 1 << 20
#: Bytes of a word beyond which its rounds merge all pairs of the least rank at once, where that is proven to give the same ids.
LONG = 1024


@dataclass(frozen=True)
class Merges:
    """Token bytes by id, ids of single bytes, and an open-addressed table from id pairs to the merged id.

    `ordered` says that merging the bytes of any token that a pair can make ends in that token, by ranks that never fall.
    """

    data: np.ndarray
    begin: np.ndarray
    single: np.ndarray
    keys: np.ndarray
    ids: np.ndarray
    shift: np.uint64
    probes: int
    ordered: bool = False

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of each pair, or the greatest integer where the pair doesn't merge. Ids are ranks."""
        key = (left << 32) | right
        at = _slot(key, self.shift)
        mask = len(self.keys) - 1
        out = np.full(key.shape, _NONE)
        seen = self.keys[at]
        out[seen == key] = self.ids[at][seen == key]
        todo = np.flatnonzero((seen != key) & (seen >= 0))
        at, key = at[todo], key[todo]
        for _ in range(self.probes):
            if not len(todo):
                break
            at = (at + 1) & mask
            seen = self.keys[at]
            hit = seen == key
            out[todo[hit]] = self.ids[at[hit]]
            go = ~hit & (seen >= 0)
            todo, at, key = todo[go], at[go], key[go]
        return out


def _slot(key: np.ndarray, shift: np.uint64) -> np.ndarray:
    return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)


def merges_of(ranks: dict[bytes, int]) -> Merges:
    """The pair table of a rank file: every way to halve a token into two tokens is a pair that merges into it."""
    size = max(ranks.values()) + 1
    by_id = [b""] * size
    for t, i in ranks.items():
        by_id[i] = t
    pairs = [((ranks[t[:k]] << 32) | ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    bits = max(4, (2 * len(pairs)).bit_length())
    key = np.array([p for p, _ in pairs], np.int64)
    ids = np.array([i for _, i in pairs], np.int64)
    shift = np.uint64(64 - bits)
    table, value = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE)
    longest = 0
    for k, i, at in zip(key.tolist(), ids.tolist(), (_slot(key, shift) if len(key) else key).tolist()):
        steps = 0
        while table[at] >= 0:
            at, steps = (at + 1) & ((1 << bits) - 1), steps + 1
        table[at], value[at] = k, i
        longest = max(longest, steps)
    made = Merges(
        np.frombuffer(b"".join(by_id), np.uint8), np.cumsum([0, *map(len, by_id)]), np.array([ranks[bytes([b])] for b in range(256)], np.int64), table, value, shift, longest
    )
    return replace(made, ordered=all(_settles(made, rows) for _, rows in _matrices(made, [by_id[i] for i in dict.fromkeys(ids.tolist())])))


def _settles(table: Merges, ids: np.ndarray) -> bool:
    """Whether every row ends as one id, by ranks that never fall."""
    fell = np.zeros(len(ids), bool)
    _, size = _merged(table, ids, fell)
    return bool((size == 1).all() and not fell.any())


@lru_cache(2)
def _loaded(path: str) -> tuple[Merges, dict[bytes, int]]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
    return merges_of(ranks), ranks


def _merged(table: Merges, ids: np.ndarray, fell: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Merges a matrix of ids, padded with -1 on the right, to the end: final ids and how many each row has.

    A round finds every row's leftmost pair of least rank, sets the merged id in its place and
    closes the gap; rows without a pair that merges leave the matrix. `fell`, if given, is set for rows whose rank was ever lower than the one before.
    """
    rows, width = ids.shape
    size = (ids >= 0).sum(1)
    final = ids.copy()
    live = np.arange(rows)
    rank = np.full((rows, max(width - 1, 1)), _NONE)
    if width > 1:
        both = ids[:, 1:] >= 0
        rank[both] = table.find(ids[:, :-1][both], ids[:, 1:][both])
    cols = np.arange(width)
    last = np.zeros(rows, np.int64)
    while len(live):
        at = rank.argmin(1)
        best = rank[np.arange(len(live)), at]
        going = best != _NONE
        if not going.all():
            final[live[~going]] = -1
            final[live[~going], : ids.shape[1]] = ids[~going]
            live, ids, rank, at, best = live[going], ids[going], rank[going], at[going], best[going]
            if not len(live):
                break
        if fell is not None:
            fell[live] |= best < last[live]
            last[live] = best
        k = np.arange(len(live))
        moved = np.minimum(cols[None, : ids.shape[1]] + (cols[None, : ids.shape[1]] > at[:, None]), ids.shape[1])
        padded = np.concatenate([ids, np.full((len(live), 1), -1)], 1)
        ids = np.take_along_axis(padded, moved, 1)
        ids[k, at] = best
        ranks = np.concatenate([rank, np.full((len(live), 1), _NONE)], 1)
        rank = np.take_along_axis(ranks, moved[:, : rank.shape[1]], 1)
        rank[k, at] = _NONE
        size[live] -= 1
        for side in (-1, 0):  # the pairs that the merged id now makes with its neighbours
            left = at + side
            ok = (left >= 0) & (left + 1 < ids.shape[1])
            r, c = k[ok], left[ok]
            both = ids[r, c + 1] >= 0
            r, c = r[both], c[both]
            rank[r, c] = table.find(ids[r, c], ids[r, c + 1])
        widest = int(size[live].max())
        ids, rank = ids[:, :widest], rank[:, : max(widest - 1, 1)]
        if widest == 1:
            rank = np.full((len(live), 1), _NONE)
    return final, size


def _merged_long(table: Merges, ids: np.ndarray) -> np.ndarray:
    """One long word by itself: a round merges all pairs of the least rank from left to right, for an `ordered` table.

    These are the merges that rounds of one pair each would make one after another. Ranks can't fall in those
    either: say that making a gives a pair (a, b) that merges to t of lower rank than a. No merge has crossed the ends of t's
    bytes so far, so within them the rounds were those of merging t by itself. These end in t by ranks that never fall, so none
    is above t's, but a's is. As they don't fall, all merges of one rank follow each other, and none of them makes another pair
    of that rank, since what it would merge to is longer. So they are the pairs that are there as the rank's turn
    comes, taken from the left, less those that overlap one taken.

    Places are kept in a linked list and wait in buckets by the rank of the pair that starts there, so a round costs what it merges: only pairs beside a merge get new ranks.
    """
    n = len(ids)
    if n < 2:
        return ids
    ids = np.append(ids, -1)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    rank = np.append(table.find(ids[: n - 1], ids[1:n]), [_NONE, _NONE])
    alive = np.ones(n + 1, bool)
    waiting: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def wait(places: np.ndarray) -> None:
        places = places[rank[places] != _NONE]
        places = places[np.argsort(rank[places], kind="stable")]
        own = rank[places]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        for r, some in zip(own[first].tolist(), np.split(places, first[1:]), strict=True) if len(first) else ():
            if r not in waiting:
                waiting[r] = []
                heapq.heappush(ranks, r)
            waiting[r].append(some)

    wait(np.arange(n))
    while ranks:
        best = heapq.heappop(ranks)
        at = np.unique(np.concatenate(waiting.pop(best)))
        at = at[alive[at] & (rank[at] == best)]
        if not len(at):
            continue
        overlap = np.append(False, after[at[:-1]] == at[1:])
        run = np.flatnonzero(~overlap)  # of overlapping pairs every other one merges
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
        gone = after[at]
        ids[at], alive[gone], rank[gone] = best, False, _NONE
        after[at] = after[gone]
        before[after[at]] = at
        beside = np.concatenate([at, before[at]])
        beside = np.unique(beside[beside >= 0])
        follows = after[beside]
        inside = follows < n
        rank[beside] = _NONE
        rank[beside[inside]] = table.find(ids[beside[inside]], ids[follows[inside]])
        wait(beside)
    return ids[:n][alive[:n]]


def _matrices(table: Merges, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of words of like length, and their single-byte ids as a padded matrix: widths double from bucket to bucket in two steps."""
    lengths = np.array([len(w) for w in words], np.int64)
    bucket = np.ceil(np.log2(np.maximum(lengths, 1)) * 2).astype(int)
    for b in np.unique(bucket):
        members = np.flatnonzero((bucket == b) & (lengths > 0))
        step = max(1, CELLS // max(1, int(lengths[members].max(initial=1))))
        for lo in range(0, len(members), step):
            some = members[lo : lo + step]
            width = int(lengths[some].max())
            raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in some.tolist()), np.uint8).reshape(len(some), width)
            yield some, np.where(np.arange(width) < lengths[some][:, None], table.single[raw], -1)


def encode_words(table: Merges, words: list[bytes]) -> list[np.ndarray]:
    """Ids of each word, words of like length together. Words over LONG bytes take a matrix of one row if the table isn't `ordered`."""
    out: list[np.ndarray] = [np.empty(0, "<u4")] * len(words)
    whole = [i for i, w in enumerate(words) if len(w) > LONG and table.ordered]
    for i in whole:
        out[i] = _merged_long(table, table.single[np.frombuffer(words[i], np.uint8)]).astype("<u4")
    apart = set(whole)
    for some, ids in _matrices(table, [b"" if i in apart else w for i, w in enumerate(words)]):
        final, size = _merged(table, ids)
        flat = final[final >= 0].astype("<u4")
        ends = np.cumsum(size)
        for i, e, n in zip(some.tolist(), ends.tolist(), size.tolist()):
            out[i] = flat[e - n : e]
    return out


class Coder:
    """Encodes texts word by word and decodes ids, with the ranks of a file and a split pattern."""

    def __init__(self, path: str, pattern: str, kept: int = KEPT_WORDS):
        self.table, self.ranks = _loaded(path)
        self.split = regex.compile(pattern).findall
        self.kept, self.number = kept, {}
        self.parts: list[bytes] = []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, unsigned 32-bit little-endian."""
        if len(self.number) > self.kept:
            self.number, self.parts = {}, []
        number = self.number
        split = [self.split(t) for t in texts]
        new = list(dict.fromkeys(w for words in split for w in words if w not in number))
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        rest = []
        for w, b in zip(new, raw):  # a word that is a token needs no merging
            number[w] = len(self.parts)
            known = self.ranks.get(b)
            self.parts.append(b"" if known is None else known.to_bytes(4, "little"))
            if known is None:
                rest.append((number[w], b))
        for (i, _), ids in zip(rest, encode_words(self.table, [b for _, b in rest])):
            self.parts[i] = ids.tobytes()
        parts = self.parts
        return [np.frombuffer(b"".join([parts[number[w]] for w in words]), "<u4") for words in split]

    def decode(self, ids: np.ndarray) -> bytes:
        begin, end = self.table.begin[ids], self.table.begin[ids.astype(np.int64) + 1]
        size = end - begin
        if not len(ids):
            return b""
        step = np.ones(int(size.sum()), np.int64)
        some = size > 0
        begin, end, size = begin[some], end[some], size[some]
        heads = np.cumsum(size) - size
        step[heads] = begin - np.concatenate(([0], end[:-1] - 1))
        return self.table.data[np.cumsum(step)].tobytes()


def coded(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """key, ids (binary, little-endian unsigned 32-bit) and decoded (binary) of every row.

    Null texts count as empty and have no ids. Every match of the pattern is encoded by itself.
    Repeated rows and null keys stay. Words met before in a task are looked up, at most KEPT_WORDS of them.
    """
    schema, run = _task(docs, key, text, path, pattern, lambda ids, back: (ids.tobytes(), back), [("ids", pa.binary()), ("decoded", pa.binary())])
    return lean(docs).select(key, text).mapInArrow(run, schema)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of every row; as `coded`, without carrying ids."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema, run = _task(docs, key, text, path, pattern, lambda ids, back: (len(ids), sha(ids.tobytes()), sha(back)), fields)
    return lean(docs).select(key, text).mapInArrow(run, schema)


def _task(docs, key, text, path, pattern, made, fields):
    import public_tokenizers

    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    kinds = {pa.binary(): "binary", pa.string(): "string", pa.int64(): "long"}
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} {kinds[k]}" for n, k in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path, pattern)
        for b in batches:
            out = [made(ids, coder.decode(ids)) for texts in slices(b.column(1), BLOCK) for ids in coder.encode([t or "" for t in texts])]
            columns = list(zip(*out)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, (_, k) in zip(columns, fields))], [key, *(n for n, _ in fields)])

    return schema, run


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text, and of what they decode to; see `digests`."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
