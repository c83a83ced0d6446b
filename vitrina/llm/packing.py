"""Best-fit packing of token pieces into sequences, after Martello-Toth dominance reduction.

Documents become token ids with a closing id; only documents longer than a sequence are cut. Packing
looks at lengths alone, and there are at most ``capacity`` different ones: Spark counts the pieces of
each length, the packing is solved on those counts, and Spark deals the pieces to the places.

* *Reduction.* For the longest free length, a set of at most three pieces that dominates every other
  set with that piece is fixed for good: the piece alone if nothing fits beside it; with the longest
  fitting partner if the two fill the sequence, if no third piece can join, or if the partner is at
  least as long as the best pair; with the best pair if its longer half is that partner and no other
  pair has both halves longer than its shorter one. A fixed set stays the right choice while its
  pieces last, so it is fixed as often as they do. Passes go on until nothing is fixed any more.
* *Best fit.* What remains goes, longest first, into the fullest sequence that takes it.

Sequences of equal content are one run with a count, so the solution has a few rows per length, whatever
the corpus. A run gives each length a range of numbers; a piece is numbered within its length by its
task's first number (a running sum over tasks) plus its place in the task.

Defined cases: a NULL or empty text is the closing id alone. Repeated rows, and rows without an id, are
documents of their own. Equal lengths are dealt in the order of tasks and rows, so a rerun over other
partitions may deal them otherwise; the number of sequences is the same. Very long texts are cut into many
pieces. An empty table gives no rows. Only ``doc_id`` and ``text`` are read; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrina.llm.common import portions, short_batches, stored

CAPACITY = 2048
#: Encoded words that a worker keeps; the store is emptied when full, which affects speed only.
KEPT_WORDS, KEPT_LENGTH = 1_000_000, 48
#: Texts that are split and encoded together, in characters.
TOGETHER_CHARS = 8_000_000

#: ``[(length, copies), ...]`` of a sequence, and how many sequences have this content.
Run = tuple[list[tuple[int, int]], int]


# -- token pieces


#: Bytes that end a word, and ASCII capitals for tokenizers that fold them.
_SPACES = {0x09, 0x0A, 0x0D}
_CUT = bytes(0x20 if b in _SPACES else b for b in range(256))
_CUT_FOLD = bytes(0x20 if b in _SPACES else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Small Latin letters, which normalisation leaves alone and no pre-tokenizer parts, and ASCII marks behind
#: them, which it parts from them; but for the apostrophe, which can begin a suffix.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+([!-&(-/:-@\[-`{-~]+)?")
#: Where folding before the tokenizer would change what it sees: capitals that compose with a mark, and
#: strings that could become those of special tokens.
_KEEP_CAPITALS = re.compile(rb"[A-Z][\xcc-\xff]|<\|")


def _is_latin(text: str) -> bool:
    """Whether a text has no character beyond U+00FF, so no mark that composes."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space and never merges across it, word by word.

    Texts are split, and their words told apart and replaced by their ids, by Arrow functions. Words that
    were met before come from a store. New ones are encoded many at once, so that an encoding is not made for
    each: words of small Latin letters one after the other, told apart by the mark that ends a word; words
    that end in marks in two parts; most others with a word between them that holds a character of its own.
    """

    def __init__(self, tokenizer_json: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.kept: dict[bytes, bytes] = {}
        said = json.loads(tokenizer_json)
        suffix = said["model"].get("end_of_word_suffix")
        self.folds = '"Lowercase"' in json.dumps(said.get("normalizer"))
        between = self.tokenizer.encode("|", add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 else None
        self.plain = None
        if suffix and self.folds:
            self.plain = Tokenizer.from_str(tokenizer_json)
            self.plain.normalizer = None
            self.plain.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )
            entries = self.plain.get_vocab()
            self.ends = np.zeros(max(entries.values()) + 1, bool)
            self.ends[[i for entry, i in entries.items() if entry.endswith(suffix)]] = True

    def plain_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Words of small Latin letters, by the reduced tokenizer."""
        out: dict[bytes, bytes] = {}
        for at in range(0, len(words), 1_000):
            part = words[at : at + 1_000]
            ids = np.array(self.plain.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            packed = ids.tobytes()
            out.update(zip(part, [packed[a:b] for a, b in zip([0, *cuts], cuts)], strict=True))
        return out

    def any_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        out: dict[bytes, bytes] = {}
        apart = [w for w in words if self.between is None or not w or b"|" in w]
        for w, coded in zip(apart, self.tokenizer.encode_batch_fast([w.decode() for w in apart], add_special_tokens=False)):
            out[w] = array("I", coded.ids).tobytes()
        joined = [w for w in words if w not in out]
        for at in range(0, len(joined), 1_000):
            part = joined[at : at + 1_000]
            coded = self.tokenizer.encode_batch_fast([b" | ".join(part).decode()], add_special_tokens=False)[0]
            ids = np.array(coded.ids, "<u4")
            cuts = (4 * np.flatnonzero(ids == self.between)).tolist()
            packed = ids.tobytes()
            out.update(zip(part, [packed[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(packed)])], strict=True))
        return out

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of new words."""
        if self.plain is None:
            return self.any_words(words)
        kept = self.kept
        plain, ending, others = [], [], []
        for w, said in zip(words, map(_PLAIN.fullmatch, words)):
            if said is None:
                others.append(w)
            elif said[1] is None:
                plain.append(w)
            else:
                ending.append((w, said[1]))
        stems = {w[: -len(tail)] for w, tail in ending}
        found = self.plain_words([*plain, *stems.difference(plain, kept)])
        found |= self.any_words(list({*others, *(tail for _, tail in ending if tail not in kept)}))
        for w, tail in ending:
            stem = w[: -len(tail)]
            found[w] = (found.get(stem) or kept[stem]) + (found.get(tail) or kept[tail])
        return found

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Packed ids (unsigned 32-bit, little-endian) of each text."""
        cut = []
        for text in texts:
            raw = text.encode()
            fold = self.folds and not (b"<|" in raw if _is_latin(text) else _KEEP_CAPITALS.search(raw))
            cut.append(raw.translate(_CUT_FOLD if fold else _CUT))
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        words = pc.split_pattern(pa.array(cut, pa.large_binary()).cast(pa.large_string()), " ")
        each = words.values.cast(pa.large_binary()).dictionary_encode()
        different = each.dictionary.to_pylist()
        codes = list(map(self.kept.get, different))
        found = self.learn([w for w, code in zip(different, codes) if code is None])
        ids = pa.array([found[w] if code is None else code for w, code in zip(different, codes)], pa.large_binary()).take(each.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1][words.offsets.to_numpy()]
        packed = ids.buffers()[2].to_pybytes() if len(ids) and ids.buffers()[2] else b""
        self.kept.update(found)
        for w in [w for w in found if len(w) > KEPT_LENGTH]:
            del self.kept[w]
        for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
            yield packed[start:end]


_MADE: dict[int, WordEncoder] = {}

PIECE = "doc_id {id}, piece int, start long, length long, ids binary, part int, nth long"


def pieces(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, closing_id: int = 0) -> DataFrame:
    """``(doc_id, piece, start, length, ids, part, nth)``: every document's ids and the closing one, cut
    where they exceed ``capacity``. ``part`` and ``nth`` number the pieces of one length: the task that made
    the piece, and how many of its length that task made before."""
    spark = docs.sparkSession
    short_batches(spark, 500)
    shipped, key = spark.sparkContext.broadcast(tokenizer_json), uuid.uuid4().int
    last = np.array([closing_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _MADE:
            _MADE.clear()
            _MADE[key] = WordEncoder(shipped.value)
        encoder, part, made = _MADE[key], TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch["doc_id"], chain.from_iterable(map(encoder.encode, portions(batch["text"], TOGETHER_CHARS)))):
                ids += last
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    length = len(own) // 4
                    out.append((doc_id, piece, at // 4, length, own, part, made[length]))
                    made[length] += 1
            columns = ["doc_id", "piece", "start", "length", "ids", "part", "nth"]
            frame = pd.DataFrame(out, columns=columns)
            frame["doc_id"] = pd.Series([r[0] for r in out], dtype=batch["doc_id"].dtype)
            yield frame

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Ids travel as text where pandas would turn a column with NULLs into floats.
    return (
        read.withColumn("doc_id", F.col("doc_id").cast("string"))
        .mapInPandas(cut, PIECE.format(id="string"))
        .withColumn("doc_id", F.col("doc_id").cast(kind))
    )


# -- the packing, on counts of lengths


def _smallest(free: list[int], count: dict[int, int], taken: int, n: int) -> list[int]:
    """The ``n`` smallest free lengths besides one piece of length ``taken``."""
    out: list[int] = []
    for size in free:
        out += [size] * min(n - len(out), count[size] - (size == taken))
        if len(out) == n:
            break
    return out


def _best_pair(free: list[int], count: dict[int, int], taken: int, room: int) -> tuple[int, int] | None:
    """The pair ``(longer, shorter)`` of greatest sum within ``room``, besides one piece ``taken``; of
    equal sums that with the longest piece."""
    best, low, high = None, 0, bisect_left(free, room) - 1
    while low <= high:
        small, large = free[low], free[high]
        if small + large > room:
            high -= 1
            continue
        needed = 2 if small == large else 1
        if count[small] - (small == taken) >= needed and count[large] - (large == taken) >= 1:
            if best is None or small + large > sum(best):
                best = (large, small)
            low += 1
        elif count[large] - (large == taken) < 1:
            high -= 1
        else:
            low += 1
    return best


def _dominant(size: int, free: list[int], count: dict[int, int], capacity: int) -> tuple[int, ...] | None:
    """A set with a piece of length ``size``, the longest that is left to look at, that dominates all
    other sets with it, or None."""
    least = _smallest(free, count, size, 3)
    room = capacity - size
    if not least or least[0] > room:
        return (size,)
    at = bisect_left(free, room + 1) - 1
    while count[free[at]] - (free[at] == size) < 1:
        at -= 1
    partner = free[at]
    if partner == room or len(least) < 2 or least[0] + least[1] > room:
        return (size, partner)
    if len(least) == 3 and sum(least) <= room:
        return None  # sets of four or more are not looked at
    longer, shorter = _best_pair(free, count, size, room)
    if partner >= longer + shorter:
        return (size, partner)
    above = _smallest(free[bisect_left(free, shorter + 1) :], count, size, 2)
    if partner == longer and (len(above) < 2 or sum(above) > room):
        return (size, longer, shorter)
    return None


def reduce_counts(counts: dict[int, int], capacity: int) -> tuple[list[Run], dict[int, int]]:
    """The runs of sequences fixed by dominance, and the counts that remain."""
    count, fixed = dict(counts), []
    changed = True
    while changed:
        changed = False
        free = sorted(s for s in count if count[s])
        for size in reversed(free.copy()):
            while count[size] and (chosen := _dominant(size, free, count, capacity)):
                content = Counter(chosen)
                times = min(count[s] // n for s, n in content.items())
                for s, n in content.items():
                    count[s] -= times * n
                    if not count[s]:
                        free.remove(s)
                fixed.append((sorted(content.items(), reverse=True), times))
                changed = True
    return fixed, {s: n for s, n in count.items() if n}


def best_fit(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing on counts: the pieces of one length go to the fullest sequences that take
    them, each of which takes as many as it can."""
    by_room: dict[int, list[Run]] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        rooms = sorted(by_room)
        waiting = rooms[bisect_left(rooms, size) :]
        moved: list[tuple[int, Run]] = []
        for room in [*waiting, None]:
            if not left:
                break
            fits = (capacity if room is None else room) // size
            here = [([], -(-left // fits))] if room is None else by_room.pop(room)
            for n, (content, number) in enumerate(here):
                whole = min(number, left // fits)
                left -= whole * fits
                after = (capacity if room is None else room) - size * fits
                if whole:
                    moved.append((after, (content + [(size, fits)], whole)))
                if left and whole < number:
                    moved.append(((capacity if room is None else room) - size * left, (content + [(size, left)], 1)))
                    whole, left = whole + 1, 0
                if whole < number and room is not None:
                    moved.append((room, (content, number - whole)))
                if not left:
                    if room is not None:
                        moved += [(room, run) for run in here[n + 1 :]]
                    break
        for room, run in moved:
            by_room.setdefault(room, []).append(run)
    return [run for room in sorted(by_room) for run in by_room[room]]


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Runs of sequences that hold all pieces of ``counts`` (length to number)."""
    fixed, rest = reduce_counts(counts, capacity)
    return fixed + best_fit(rest, capacity)


def places(counts: dict[int, int], runs: list[Run]) -> dict[str, np.ndarray]:
    """Runs as ranges of piece numbers. Pieces are numbered by length and then within it (``bases``);
    the piece that is ``k``-th in a range goes to sequence ``sequence + k // copies``."""
    lengths = np.array(sorted(counts), np.int64)
    bases = np.concatenate([[0], np.cumsum([counts[s] for s in lengths.tolist()])[:-1]]).astype(np.int64) if lengths.size else lengths
    following = dict(zip(lengths.tolist(), bases.tolist()))
    rows, sequence = [], 0
    for content, number in runs:
        offset = 0
        for size, copies in content:
            rows.append((following[size], copies, sequence, offset))
            following[size] += copies * number
            offset += size * copies
        sequence += number
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    named = dict(zip(("number", "copies", "sequence", "offset"), table.T))
    return named | {"lengths": lengths, "bases": bases}


# -- dealing the pieces


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The columns of :func:`pieces` (but ``part`` and ``nth``), with ``sequence_id`` and ``offset``.

    Columns of ``cut`` that are not selected before are written to the shared folder, so select the
    needed ones (``part``, ``nth`` and ``length`` among them) first.
    """
    spark = cut.sparkSession
    cut, _ = stored(cut, "pieces")
    per_task = cut.groupBy("part", "length").agg(F.count("*").alias("made"))
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("made").alias("n")).collect()}
    if counts and max(counts) > capacity:
        raise ValueError(f"a piece of {max(counts)} tokens exceeds the capacity of {capacity}")
    shipped = spark.sparkContext.broadcast(places(counts, solve(counts, capacity)))  # a few rows per length

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        at = shipped.value
        size = length.to_numpy(np.int64)
        number = number.to_numpy(np.int64) + at["bases"][np.searchsorted(at["lengths"], size)]
        row = np.searchsorted(at["number"], number, "right") - 1
        place = number - at["number"][row]
        return pd.DataFrame(
            {
                "sequence_id": at["sequence"][row] + place // at["copies"][row],
                "offset": at["offset"][row] + place % at["copies"][row] * size,
            }
        )

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_task.select("part", "length", F.coalesce(F.sum("made").over(before), F.lit(0)).alias("_first"))
    dealt = cut.join(firsts, ["part", "length"]).withColumn("_place", placed("length", F.col("_first") + F.col("nth")))
    kept = [c for c in cut.columns if c not in ("part", "nth")]
    return dealt.select(*kept, "_place.sequence_id", "_place.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, length, ids, doc_ids)`` of packed pieces with their ids: the ids of each sequence in
    order of offset, and the documents in it. A group has at most ``capacity`` ids."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    joined = F.unhex(F.concat_ws("", F.transform("ordered", lambda x: F.hex(x["ids"]))))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), ordered.alias("ordered")).select(
        "sequence_id", "length", joined.alias("ids"), F.transform("ordered", lambda x: x["doc_id"]).alias("doc_ids")
    )
