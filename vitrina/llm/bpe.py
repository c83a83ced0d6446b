"""Byte-level BPE encoding and decoding.

A pre-token is merged with a queue over merge ranks: each rank has a bucket of linked-list positions
whose pair has that rank, a three-level bitmap marks the ranks with a bucket, and find-first-set on
it picks the lowest rank. Entries whose pair has changed meanwhile are skipped when they come up. A
pre-token of n bytes costs O(n log n) at worst, so very long pre-tokens are no special case.

NULL texts count as empty and give no ids. Rows are independent: repeated rows give the same ids.
Other columns pass through.
"""

from __future__ import annotations

import base64
import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.llm.common import short_batches

#: Encoded pre-tokens that a worker keeps; the store is emptied when full, which affects speed only.
KEPT_PRETOKENS = 120_000
#: Pre-tokens beyond this many bytes get a queue of their own.
SHORT_BYTES = 64
#: Texts that are split and encoded together, in characters.
TOGETHER_CHARS = 8_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class RankQueue:
    """Positions by merge rank: a bucket per rank, and three levels of 64-bit words that mark the
    ranks whose bucket is not empty."""

    __slots__ = ("buckets", "top", "mid", "low")

    def __init__(self) -> None:
        self.buckets: dict[int, list] = {}
        self.top, self.mid, self.low = 0, {}, {}

    def mark(self, rank: int) -> None:
        word, group = rank >> 6, rank >> 12
        self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
        self.mid[group] = self.mid.get(group, 0) | 1 << (word & 63)
        self.top |= 1 << group

    def clear(self, rank: int) -> None:
        word, group = rank >> 6, rank >> 12
        self.low[word] ^= 1 << (rank & 63)
        if not self.low[word]:
            self.mid[group] ^= 1 << (word & 63)
            if not self.mid[group]:
                self.top ^= 1 << group

    def lowest(self) -> int:
        """The lowest marked rank, by find-first-set; -1 when the queue is empty."""
        if not self.top:
            return -1
        group = (self.top & -self.top).bit_length() - 1
        bits = self.mid[group]
        word = group << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[word]
        return word << 6 | (bits & -bits).bit_length() - 1

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
        else:
            self.buckets[rank] = [position]
            self.mark(rank)

    def pop(self) -> tuple[int, int] | None:
        """The leftmost position of the lowest rank."""
        rank = self.lowest()
        if rank < 0:
            return None
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            self.clear(rank)
        return rank, position

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Push runs of positions without order inside a bucket; negative ranks are left out."""
        keep = ranks >= 0
        ranks, positions = ranks[keep], positions[keep]
        if not ranks.size:
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist()]
        buckets = self.buckets
        for rank, start, end in zip(ranks[starts].tolist(), starts, [*starts[1:], ranks.size]):
            bucket = buckets.get(rank)
            if bucket:
                bucket.append(positions[start:end])
            else:
                buckets[rank] = [positions[start:end]]
                self.mark(rank)

    def pop_bucket(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank and all its positions."""
        rank = self.lowest()
        if rank < 0:
            return None
        self.clear(rank)
        runs = self.buckets.pop(rank)
        return rank, runs[0] if len(runs) == 1 else np.concatenate(runs)


class ByteBpe:
    """Encoder and decoder for one rank table and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.places: defaultdict[str, int] = defaultdict()  # pre-tokens seen, numbered as they come
        self.places.default_factory = self.places.__len__
        self.codes: list[bytes] = []  # and their packed ids
        self.byte_ids = np.array([ranks.get(bytes([x]), -1) for x in range(256)], np.int64)
    @cached_property
    def pair_table(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all token pairs that make a token, ascending, and the token's rank."""
        ranks = self.ranks
        keys, made = array("q"), array("q")
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    made.append(rank)
        keys, made = np.array(keys, np.int64), np.array(made, np.int64)
        order = np.argsort(keys)
        return np.append(keys[order], 1 << 62), np.append(made[order], -1)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two tokens make together, -1 if there is none."""
        key = left << 32 | right
        keys, made = self.pair_table
        at = np.searchsorted(keys, key)
        return np.where(keys[at] == key, made[at], -1)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [-1] * n  # rank of the pair that starts here; -1: none, or the part is gone
        queue = RankQueue()
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                pair[i] = rank
                queue.push(rank, i)
        while (entry := queue.pop()) is not None:
            rank, i = entry
            if pair[i] != rank:
                continue
            gone = ends[i]
            end = ends[i] = ends[gone]
            pair[gone] = -1
            if end < n:
                before[end] = i
                joined = ranks.get(piece[i : ends[end]])
                pair[i] = -1 if joined is None else joined
                if joined is not None:
                    queue.push(joined, i)
            else:
                pair[i] = -1
            left = before[i]
            if left >= 0:
                joined = ranks.get(piece[left:end])
                pair[left] = -1 if joined is None else joined
                if joined is not None:
                    queue.push(joined, left)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return ids

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many pre-tokens, which share one queue: a rank that comes up merges its
        leftmost live position in every pre-token at once, and the others of that rank wait."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n, last = int(sizes.sum()), np.cumsum(sizes) - 1
        owner = np.repeat(np.arange(len(pieces)), sizes)
        token = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[last], before[last - sizes + 1] = -1, -1
        pair = np.full(n, -1)
        starts = np.flatnonzero(after >= 0)
        pair[starts] = self.pair_rank(token[starts], token[starts + 1])
        queue, live = RankQueue(), np.ones(n, bool)
        queue.push_all(pair[starts], starts)
        while (entry := queue.pop_bucket()) is not None:
            rank, at = entry
            at = at[pair[at] == rank]
            if not at.size:
                continue
            if at.size > 1:
                at = np.unique(at)
                own = owner[at]
                first = np.ones(at.size, bool)
                np.not_equal(own[1:], own[:-1], out=first[1:])
                if not first.all():
                    rest = at[~first]
                    queue.push_all(np.full(rest.size, rank), rest)
                    at = at[first]
            gone = after[at]
            end = after[gone]
            token[at], after[at] = rank, end
            pair[gone], live[gone] = -1, False
            pair[at] = -1
            more = end >= 0
            inner, end = at[more], end[more]
            before[end] = inner
            joined = self.pair_rank(token[inner], token[end])
            pair[inner] = joined
            queue.push_all(joined, inner)
            left = before[at]
            more = left >= 0
            left = left[more]
            joined = self.pair_rank(token[left], token[at[more]])
            pair[left] = joined
            queue.push_all(joined, left)
        packed = token[live].astype("<u4").tobytes()
        ends = (4 * np.cumsum(live)[last]).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.codes) > KEPT_PRETOKENS:
            self.places.clear()
            self.codes.clear()
        split, place = self.split, self.places.__getitem__
        placed = [np.fromiter(map(place, split(text)), np.int32) for text in texts]  # strings go at once
        short = []
        for text in islice(self.places, len(self.codes), None):
            piece = text.encode()
            whole = self.ranks.get(piece)
            if whole is not None:
                self.codes.append(whole.to_bytes(4, "little"))
            elif len(piece) > SHORT_BYTES:
                self.codes.append(np.array(self.merge(piece), "<u4").tobytes())
            else:
                short.append((len(self.codes), piece))
                self.codes.append(b"")
        if short:
            for (at, _), code in zip(short, self.merge_all([piece for _, piece in short])):
                self.codes[at] = code
        code = self.codes.__getitem__
        return [b"".join(map(code, places.tolist())) for places in placed]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: Coders of this worker process by broadcast id, so that tasks after the first find them made.
_MADE: dict[int, ByteBpe] = {}


def _coder(spark: SparkSession, ranks: dict[bytes, int], pattern: str):
    """The rank table for the executors: its size is that of the vocabulary, whatever the corpus."""
    shipped, key = spark.sparkContext.broadcast(ranks), uuid.uuid4().int

    def coder() -> ByteBpe:
        if key not in _MADE:
            _MADE.clear()
            _MADE[key] = ByteBpe(shipped.value, pattern)
        return _MADE[key]

    return coder


def _portions(texts: pd.Series) -> Iterator[list[str]]:
    """A batch in runs of about ``TOGETHER_CHARS`` characters."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= TOGETHER_CHARS:
            yield run
            run, size = [], 0
    yield run


def token_ids(spark: SparkSession, text: Column, ranks: dict[bytes, int], pattern: str) -> Column:
    """Ids of a text column as packed little-endian unsigned 32-bit integers (binary)."""
    short_batches(spark)
    coder = _coder(spark, ranks, pattern)

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = coder()
        for batch in batches:
            yield pd.Series([ids for run in _portions(batch) for ids in bpe.encode_all(run)], dtype=object)

    return encode(F.coalesce(text, F.lit("")))


def token_bytes(spark: SparkSession, ids: Column, ranks: dict[bytes, int], pattern: str) -> Column:
    """Bytes that packed ids stand for; NULL ids give no bytes."""
    short_batches(spark)
    coder = _coder(spark, ranks, pattern)

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = coder()
        for batch in batches:
            yield pd.Series([bpe.decode(x) for x in batch], dtype=object)

    return decode(F.coalesce(ids, F.lit(b"")))


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, out: str = "token_ids") -> DataFrame:
    """``docs`` with the packed ids of ``text`` in column ``out`` (which replaces one of that name)."""
    return docs.withColumn(out, token_ids(docs.sparkSession, F.col("text"), ranks, pattern))
