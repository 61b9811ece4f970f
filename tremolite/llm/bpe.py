"""Byte-level BPE: merges replayed in rank order over many distinct words at once, by an index from pair to places."""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

#: Words whose tokens a Python worker remembers before it starts a new table; it keeps the table before that one too.
CACHE_WORDS = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """A rank file as merges of integers: every pair of tokens that make up a third, and that one's rank (its id too)."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.shift = (max(ranks.values()) + 2).bit_length()
        self.none = (1 << self.shift) - 1  # a symbol that is no token: what ends a word, or was merged into its left neighbour
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs: dict[int, int] = {}
        self.of_bytes = np.full(1 << 16, -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.of_bytes[token[0] << 8 | token[1]] = rank
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    self.pairs[left << self.shift | right] = rank


def _initial_index(data: np.ndarray, ends: np.ndarray, merges: Merges) -> dict[int, list[int]]:
    """Rank to the places, in order, of every pair of neighbouring bytes that merges; pairs across a word's end don't."""
    rank = merges.of_bytes[data[:-1].astype(np.int64) << 8 | data[1:]]
    rank[ends[:-1]] = -1
    rank[ends[ends > 0] - 1] = -1
    at = np.flatnonzero(rank >= 0)
    at = at[np.argsort(rank[at], kind="stable")]
    cuts = np.flatnonzero(np.diff(rank[at], prepend=-1))
    return {int(rank[at[a]]): at[a:b].tolist() for a, b in zip(cuts, np.append(cuts[1:], len(at)), strict=True)}


def replay(words: list[bytes], merges: Merges) -> list[bytes]:
    """The token ids of each word, as little-endian unsigned 32-bit integers: every merge is applied in rank order, at
    all places of its pair, in all words at once.

    All words lie behind one another, each with a symbol behind it that never merges; each symbol knows its neighbours.
    An index has the places of each merge by rank. A merge takes its places from left to right and changes only the
    pairs on both sides. A merge may let a pair appear that has a lower rank than itself; that pair comes next in its
    word, before later places of the merge.
    """
    if not words:
        return []
    data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    start = merges.of_byte[data]
    start[ends] = merges.none
    symbols, after, before, stops = start.tolist(), list(range(1, len(data) + 1)), list(range(-1, len(data) - 1)), ends.tolist()
    index = _initial_index(data, ends, merges)
    queue = sorted(index)
    rank_of, shift, none = merges.pairs.get, merges.shift, merges.none
    while queue:
        rank = heapq.heappop(queue)
        places = index.pop(rank, None)
        if places is None:
            continue
        places.sort()
        wait: set[int] = set()  # words in which a lower rank comes first
        for i in places:
            j = after[i]
            if rank_of(symbols[i] << shift | symbols[j]) != rank:
                continue
            if wait and bisect_left(stops, i) in wait:
                index.setdefault(rank, []).append(i)
                continue
            symbols[i], symbols[j] = rank, none
            after[i] = k = after[j]
            before[k] = i
            for left, key in ((before[i], symbols[before[i]] << shift | rank), (i, rank << shift | symbols[k])):
                if (r := rank_of(key)) is not None:
                    if r in index:
                        index[r].append(left)
                    else:
                        index[r] = [left]
                        heapq.heappush(queue, r)
                    if r < rank:
                        wait.add(bisect_left(stops, i))
        if rank in index:
            heapq.heappush(queue, rank)
    ids = np.array(symbols)
    token = ids != none
    edges = np.concatenate([[0], np.cumsum(token)[ends]]) * 4
    buffer = ids[token].astype("<u4").tobytes()
    return [buffer[a:b] for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]


class Coder:
    """Encodes batches of texts and decodes ids by one rank file and one splitting pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        ranks = load_ranks(path)
        self.split = regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            self.tokens[r] = token
        self.whole = {token: struct.pack("<I", r) for token, r in ranks.items()}
        self.merges = Merges(ranks)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        """Remembers the ids of each word: a word that is a token is that token, all others are replayed together."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        new = []
        for w in words - self.known.keys():
            if (ids := self.older.get(w) or self.whole.get(w.encode())) is not None:
                self.known[w] = ids
            else:
                new.append(w)
        self.known.update(zip(new, replay([w.encode() for w in new], self.merges), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        self.learn(set().union(*split))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def _coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    _, offs = text_bytes(batch.column(1))
    for i, j in slices(offs):
        yield i, j, [t or "" for t in batch.column(1)[i:j].to_pylist()]


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            for i, j, texts in _slices(batch):
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in coder.encode(texts)]
                yield pa.record_batch([batch.column(0)[i:j], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def encode(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) for each row. Null text counts as empty and has no ids."""
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_encode(path, pattern), "doc_id long, ids array<int>")


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            texts = [coder.decode(np.array(x or [], "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text for each row; null ids give an empty text."""
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(_decode(path, pattern), "doc_id long, text string")


def _report(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            for i, j, texts in _slices(batch):
                ids = coder.encode(texts)
                yield pa.record_batch(
                    [batch.column(0)[i:j], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def bpe_report(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of each text's ids and of their decoded bytes, one row for each row.

    The rank file at ``path`` is read by each Python worker. No shuffle: a task replays the merges over the words
    that are new in a slice of its texts; its worker remembers the last ``CACHE_WORDS`` to twice as many of them.
    Null or empty text: no tokens, digests of nothing; a null doc_id stays null. Repeated rows: equal results. An empty
    table gives an empty table. Columns other than doc_id and text aren't read, whatever their names.
    """
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_report(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
