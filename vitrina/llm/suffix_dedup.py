"""Repeated byte strings, by enhanced suffix arrays over shared anchors.

A string of ``length`` bytes that occurs twice holds a same k-gram at the same place both times: the
one whose hash is least (leftmost on ties) among those it holds. Only such k-grams that occur twice
anywhere matter, so the suffixes that start at them are the suffix array's only entries:

1. ``anchors``: the positions that are the minimum of some window, in each text.
2. Those whose hash occurs once drop out; the others meet their texts again and take the context a
   window through them can cover: ``length`` bytes onward, ``length - k`` bytes back.
3. Contexts of one hash form a sorted suffix array with its common-prefix array. A stack scan walks
   the intervals of its common-prefix tree. In every interval the occurrences are cut, by how far the
   texts agree to the left (again a stack scan, over the reversed left contexts), into groups that
   share at least ``length`` bytes; a group is given out when its left extensions differ, so that it
   is a maximal repeat, with all its occurrences. All but its first occurrence are marked.
4. The marks of a document are united; what they cover is removed.

Equal documents are one document in all this: of each text only the first copy takes part, and a later
copy is covered whole by the first. Occurrences of a hash whose whole contexts are equal are one
entry of its suffix array, so a periodic text or a line that many documents hold stays small. A hash with
over ``hot`` occurrences does not go to one task at all: its windows are compared as strings instead,
with minima combined map-side, which gives the same marks.

Texts are UTF-8 bytes; NULL is empty. "First" is by document id, then start; a NULL id comes last and
rows of equal ids are told apart by their text, equal rows by nothing (each is marked like the other,
as the first of them would be). Texts shorter than ``length`` lose nothing. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import short_batches, text_bytes

LENGTH, GRAM, HOT = 100, 32, 1_000_000
#: Windows that are hashed together, and bytes that a worker gathers before it does so.
SEGMENT, GATHERED = 1 << 18, 1 << 19
BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
PLACE_BITS = 24
KEY = ["doc_order", "tag"]


def packed(raw: Column) -> Column:
    """Bytes compressed by themselves: texts are shuffled once and read three times."""

    @F.pandas_udf("binary")
    def pack(batch: pd.Series) -> pd.Series:
        press = zstandard.ZstdCompressor(level=3, write_content_size=True)
        return pd.Series([press.compress(x) for x in batch], dtype=object)

    return pack(raw)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], done = 1, 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        out[done : 2 * done] = out[: min(done, n - done)] * step
        done *= 2
    return out


class Sampler:
    """Anchors of many texts at once."""

    def __init__(self, length: int, gram: int) -> None:
        self.length, self.gram = length, gram
        size = SEGMENT + GATHERED + 2 * length
        self.powers, self.inverse = _powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size)

    def grams(self, data: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each k-gram: a polynomial, then mixed."""
        sums = np.zeros(data.size + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: data.size], out=sums[1:])
        n = data.size - self.gram + 1
        value = (sums[self.gram :] - sums[:n]) * self.inverse[:n]
        value ^= value >> np.uint64(32)
        value *= np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(32)
        return value

    def pick(self, pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(document, position, hash)`` of the anchors of ``(document, offset, bytes)`` pieces. 48 bits
        of the hash are enough: it only brings suffixes together, their bytes are compared."""
        data = np.frombuffer(b"".join(raw for _, _, raw in pieces), np.uint8)
        sizes = np.array([len(raw) for _, _, raw in pieces])
        starts = np.cumsum(sizes) - sizes
        hashes = self.grams(data)
        places = np.arange(hashes.size, dtype=np.uint64)
        low = np.uint64((1 << PLACE_BITS) - 1)
        least = (hashes & ~low) | places  # by hash, then leftmost; both in one number
        span, width = self.length - self.gram + 1, 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if span > width:
            least = np.minimum(least[: least.size - (span - width)], least[span - width :])
        inside = np.zeros(least.size + 1, np.int64)  # windows that lie within one piece
        np.add.at(inside, starts, 1)
        np.add.at(inside, starts + sizes - self.length + 1, -1)
        place = (least[np.cumsum(inside[:-1]) > 0] & low).astype(np.int64)
        place = place[np.concatenate([[True], place[1:] != place[:-1]])] if place.size else place
        piece = np.searchsorted(starts, place, "right") - 1
        document = np.array([d for d, _, _ in pieces])[piece]
        position = place - starts[piece] + np.array([o for _, o, _ in pieces])[piece]
        return document, position, (hashes[place] >> np.uint64(16)).astype(np.int64)


def anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``(hash, doc_order, tag, at)`` of ``texts(doc_order, tag, packed)``."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = Sampler(length, gram)
        for batch in batches:
            order, tag = batch["doc_order"].to_numpy(), batch["tag"].to_numpy()
            pieces, size = [], 0

            def frame() -> pd.DataFrame:
                document, at, value = sampler.pick(pieces)
                made = pd.DataFrame({"hash": value, "doc_order": order[document], "tag": tag[document], "at": at.astype(np.int32)})
                return made.drop_duplicates()  # the pieces of a text overlap

            for i, raw in enumerate(map(unpacked, batch["packed"])):
                for start in range(0, len(raw) - length + 1, SEGMENT):
                    pieces.append((i, start, raw[start : start + SEGMENT + length - 1]))
                    size += len(pieces[-1][2])
                    if size >= GATHERED:
                        yield frame()
                        pieces, size = [], 0
            if pieces:
                yield frame()

    return texts.mapInPandas(find, "hash long, doc_order long, tag long, at int")


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def lcp_intervals(suffixes: list[bytes], order: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """``(lcp, first, last)`` of every interval of the sorted suffixes whose common prefix is at least
    ``least`` long and cannot be longer: a scan with a stack of the open intervals."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(order) + 1):
        lcp = common_prefix(suffixes[order[i - 1]], suffixes[order[i]]) if i < len(order) else -1
        first = i - 1
        while stack and stack[-1][0] > lcp:
            value, first = stack.pop()
            yield value, first, i - 1
        if lcp >= least and (not stack or stack[-1][0] < lcp):
            stack.append((lcp, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """``(left, right, members)``: groups of occurrences that agree on ``left`` bytes before and
    ``right`` bytes after their anchors, ``length`` or more in all, and on no more at either side.
    ``lefts`` are reversed, so that agreement is a common prefix."""
    if len(rights) == 2:
        left, right = common_prefix(*lefts), common_prefix(*rights)
        if left + right >= length:
            yield left, right, [0, 1]
        return
    by_right = sorted(range(len(rights)), key=rights.__getitem__)
    rank = {member: i for i, member in enumerate(by_right)}
    reach = max(map(len, lefts))
    for right, first, last in lcp_intervals(rights, by_right, max(1, length - reach)):
        by_left = sorted(by_right[first : last + 1], key=lefts.__getitem__)
        for left, a, b in lcp_intervals(lefts, by_left, max(0, length - right)):
            members = by_left[a : b + 1]
            ends = min(members, key=rank.__getitem__), max(members, key=rank.__getitem__)
            if common_prefix(rights[ends[0]], rights[ends[1]]) == right:  # else a deeper interval has them
                yield left, right, members


def context_rows(texts: DataFrame, shared: DataFrame, length: int, gram: int) -> DataFrame:
    """``(hash, doc_order, tag, at, left, right)`` of anchors ``(hash, doc_order, tag, at)``."""
    by_text = shared.groupBy(*KEY).agg(F.collect_list(F.struct("at", "hash")).alias("anchors"))
    met = texts.join(by_text, KEY).select(*KEY, "packed", *(F.col(f"anchors.{c}").alias(c) for c in ("at", "hash")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 200):
                part = batch.iloc[begin : begin + 200]
                sizes = part["at"].map(len).to_numpy()
                left, right = [], []
                for raw, places in zip(map(unpacked, part["packed"]), part["at"]):
                    for at in places:
                        left.append(raw[max(0, at + gram - length) : at][::-1])
                        right.append(raw[at : at + length])
                yield pd.DataFrame(
                    {
                        "hash": np.concatenate(part["hash"].to_list()),
                        **{c: np.repeat(part[c].to_numpy(), sizes) for c in KEY},
                        "at": np.concatenate(part["at"].to_list()),
                        "left": left,
                        "right": right,
                    }
                )

    return met.mapInPandas(cut, "hash long, doc_order long, tag long, at int, left binary, right binary")


Place = tuple[int, int, int]  # document order, tag, position


class Group:
    """Occurrences of one hash, in order: each distinct context once, with its first place. Later
    places with the same context repeat that first one and are not kept."""

    def __init__(self) -> None:
        self.firsts: dict[tuple[bytes, bytes], Place] = {}
        self.last: Place | None = None

    def add(self, place: Place, left: bytes, right: bytes, length: int) -> Place | None:
        """The place, if its whole context repeats an earlier one."""
        if place == self.last:  # repeated rows of a document are one
            return None
        self.last = place
        if self.firsts.setdefault((left, right), place) is place or len(left) + len(right) < length:
            return None
        return place

    def spans(self, length: int) -> Iterator[tuple[int, int, int, int]]:
        """What else repeats something earlier. All spans of an anchor hold the anchor, so the widest
        extensions on both sides stand for all."""
        if len(self.firsts) < 2:
            return
        places = list(self.firsts.values())
        reach: dict[int, tuple[int, int]] = {}
        for left, right, members in maximal_repeats([c[0] for c in self.firsts], [c[1] for c in self.firsts], length):
            first = min(members)  # contexts are numbered by their first places
            for i in members:
                if i != first:
                    a, b = reach.get(i, (0, 0))
                    reach[i] = max(a, left), max(b, right)
        for i, (left, right) in reach.items():
            order, tag, at = places[i]
            yield order, tag, at - left, at + right


def tree_spans(contexts: DataFrame, length: int) -> DataFrame:
    """``(doc_order, tag, start, end)`` of what repeats something earlier."""
    names = ["hash", *KEY, "at", "left", "right"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int, int, int]] = []
        held, group = None, Group()
        for batch in batches:
            for value, order, tag, at, left, right in zip(*(batch[c].tolist() for c in names)):
                if value != held:
                    out += group.spans(length)
                    held, group = value, Group()
                if group.add((order, tag, at), left, right, length):
                    out.append((order, tag, at - len(left), at + len(right)))
            yield pd.DataFrame(out, columns=[*KEY, "start", "end"])
            out = []
        yield pd.DataFrame([*group.spans(length)], columns=[*KEY, "start", "end"])

    placed = contexts.repartition("hash").sortWithinPartitions("hash", *KEY, "at")
    return placed.mapInPandas(scan, "doc_order long, tag long, start int, end int")


def window_spans(contexts: DataFrame, length: int) -> DataFrame:
    """The same for hot hashes: every window through an anchor is a string of its own, told by its
    MD5, and all but the first occurrence of a string are marked."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*KEY, "start", "string"]
        for batch in batches:
            out: list[tuple] = []
            for order, tag, at, left, right in zip(*(batch[c].tolist() for c in (*KEY, "at", "left", "right"))):
                whole, before = left[::-1] + right, len(left)
                for s in range(0, min(before, len(whole) - length) + 1):
                    out.append((order, tag, at - before + s, hashlib.md5(whole[s : s + length]).digest()))
            yield pd.DataFrame(out, columns=columns)

    strings = contexts.mapInPandas(cut, "doc_order long, tag long, start int, string binary")
    firsts = strings.groupBy("string").agg(F.min(F.struct(*KEY, "start")).alias("first"))
    marked = strings.join(firsts, "string").filter(F.struct(*KEY, "start") != F.col("first"))
    return marked.select(*KEY, "start", (F.col("start") + length).alias("end"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id``, ``n_bytes``, ``spans`` (array of removed start and
    end), ``kept`` (bytes that stay) and ``kept_sha256``."""
    short_batches(docs.sparkSession)
    raw = text_bytes(F.col("text"))
    digest = F.sha2(raw, 256)
    key = {"doc_order": F.coalesce("doc_id", F.lit((1 << 63) - 1)), "digest": digest, "tag": F.xxhash64(digest)}
    narrow = docs.select("doc_id", F.octet_length(raw).alias("n_bytes"), *(c.alias(n) for n, c in key.items()))
    firsts = narrow.groupBy("digest").agg(F.min("doc_order").alias("first"))
    reps = firsts.select(F.col("first").alias("doc_order"), F.xxhash64("digest").alias("tag"))
    keyed = docs.select(key["doc_order"].alias("doc_order"), key["tag"].alias("tag"), packed(raw).alias("packed"))
    texts = keyed.join(reps, KEY, "left_semi")
    found = anchor_rows(texts, length, gram)
    counts = found.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
    shared = found.join(counts, "hash").select("hash", (F.col("n") > hot).alias("hot"), *KEY, "at")
    contexts = context_rows(texts, shared.filter("not hot"), length, gram)
    hot_contexts = context_rows(texts, shared.filter("hot"), length, gram)
    spans = tree_spans(contexts, length).union(window_spans(hot_contexts, length))
    by_text = spans.groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    marked = texts.join(by_text, KEY).select(*KEY, "packed", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))

    def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [united(*x) for x in zip(map(unpacked, batch["packed"]), batch["starts"], batch["ends"])]
            yield pd.DataFrame(
                {
                    **{c: batch[c] for c in KEY},
                    "starts": [r[0] for r in rows],
                    "ends": [r[1] for r in rows],
                    "kept": [r[2] for r in rows],
                }
            )

    cut = marked.mapInPandas(drop, "doc_order long, tag long, starts array<int>, ends array<int>, kept binary")
    cut = cut.dropDuplicates(KEY).withColumn("cut_sha256", F.sha2("kept", 256))
    copy = (F.col("doc_order") > F.col("first")) & (F.col("n_bytes") >= length)
    joined = narrow.join(firsts, "digest").join(cut, KEY, "left")
    return joined.select(
        "doc_id",
        F.col("n_bytes").cast("long").alias("n_bytes"),
        F.when(copy, F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").alias("end"))))
        .when(F.col("starts").isNotNull(), F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")))
        .otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        .alias("spans"),
        F.when(copy, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("cut_sha256", "digest")).alias("kept_sha256"),
    )


def united(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int], bytes]:
    """Maximal covered runs, and the bytes outside them."""
    order = np.argsort(starts)
    starts, reach = np.asarray(starts)[order], np.maximum.accumulate(np.asarray(ends)[order])
    fresh = np.concatenate([[True], starts[1:] > reach[:-1]])
    heads = starts[fresh].tolist()
    tails = reach[np.append(np.flatnonzero(fresh)[1:] - 1, reach.size - 1)].tolist()
    kept = [raw[a:b] for a, b in zip([0, *tails], [*heads, len(raw)])]
    return heads, tails, b"".join(kept)
