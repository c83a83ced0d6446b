"""Alignment of the tokens of two tokenizers over the same text, by token spans.

``A`` is a byte-level BPE of the ``tokenizers`` library, ``B`` a ``sentencepiece`` model that adds a
leading space. Both give the character span of each token; the installed ``sentencepiece`` has replaced its
immutable proto by an offset mapping, which holds the same begin and end of each piece. The spans are
coarse cuts: where a token ends at a character's end and the next one begins there, its byte offset is
that character's. Inside a character that several tokens share (multi-byte characters, byte-fallback
pieces, which span nothing), the decoded bytes of the tokens since the last such cut refine it.

Byte offsets where tokens of both end cut the text into groups; a link joins the A and the B token
that end at one offset. A pair of ids counts as often as the corpus links it.

Neither tokenizer has tokens across a single space between other characters (a piece holds spaces at its
head only, which is checked; otherwise texts stay whole), so texts are cut there, and a cut is a group's end.
Words are aligned once, many of them in a row as one text, and kept; texts are put together from them.

The tokens are made once; each document's distinct pairs and their numbers are stored with it. Pair
counts are sums over the corpus. The counts go back to the documents in two ways: a pair with at least
one in ``FREQUENT`` of all links (so there are at most ``FREQUENT`` of these) is looked up in a table that
is sent to the tasks, and all others, none of which is a hot key, meet their counts in a join on the
pair. The result is the same for every ``FREQUENT``.

Defined cases: NULL and empty texts, and texts that the tokens of either side do not reproduce byte for
byte, have no tokens: zeros, and no groups. Texts of any length are aligned whole. Repeated rows, and rows
without an id, are documents of their own and all count. An empty table gives no rows. Only ``doc_id`` and
``text`` are read; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.llm.common import portions, short_batches, stored

#: Pairs with at least one in ``FREQUENT`` of all links are sent to the tasks, at 17 bytes each.
FREQUENT = 500_000


# -- tokenizers


def byte_level_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable bytes for themselves,
    the others, in order, from U+0100 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Tokens:
    """A text's tokens: ids, and the span of each in characters."""

    ids: np.ndarray
    begin: np.ndarray
    end: np.ndarray


class ByteLevelSide:
    """A byte-level BPE; strings of special tokens are plain text."""

    def __init__(self, tokenizer_json: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer, processors

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)  # spans with their spaces
        byte = byte_level_alphabet()
        entries = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()

    def encode(self, texts: list[str]) -> Iterator[Tokens]:
        for coded in self.tokenizer.encode_batch(texts, add_special_tokens=False):
            ids = np.array(coded.ids, np.int64)
            spans = np.fromiter(chain.from_iterable(coded.offsets), np.int64, 2 * ids.size)
            yield Tokens(ids, spans[::2], spans[1::2])


class PieceSide:
    """A sentencepiece model that puts a space before the text: spans are those in space and text."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = [
            bytes([int(piece[3:5], 16)]) if self.model.IsByte(i) else piece.replace("▁", " ").encode()
            for i, piece in ((i, self.model.IdToPiece(i)) for i in range(self.model.GetPieceSize()))
        ]

    def encode(self, texts: list[str]) -> Iterator[Tokens]:
        for coded in self.model.encode([x[1:] for x in texts], num_threads=1, return_type="offset_mapping"):
            ids = np.array(coded["ids"], np.int64)
            spans = np.fromiter(chain.from_iterable(coded["offsets"]), np.int64, 2 * ids.size) + 1
            if ids.size:
                spans[0] = 0  # the first piece begins with the added space
            yield Tokens(ids, spans[::2], spans[1::2])


# -- one text


def byte_ends(tokens: Tokens, lengths: np.ndarray, char_ends: np.ndarray) -> np.ndarray:
    """Byte offset of each token's end. ``lengths`` are the decoded lengths of the tokens; ``char_ends[i]`` is
    the byte offset behind the first ``i`` characters."""
    decoded = np.cumsum(lengths)
    following = np.append(tokens.begin[1:], char_ends.size - 1)
    clean = (tokens.end == following) & (tokens.end > tokens.begin)
    at = np.where(clean, char_ends[np.clip(tokens.end, 0, char_ends.size - 1)], 0)
    last = np.maximum.accumulate(np.where(clean, np.arange(clean.size), -1))  # last coarse cut at or before
    base = np.where(last >= 0, at[last] - decoded[last], 0)
    return base + decoded


@dataclass
class Aligned:
    """Groups of a text: where each ends, the group of each token, and the linked positions in A and in B."""

    ends: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray

    @property
    def n_groups(self) -> int:
        return self.ends.size


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> Aligned:
    """Groups and links of two lists of byte ends, both sorted. Every text ends both lists at one offset."""
    first = np.searchsorted(ends_a, ends_b, "left")
    number = np.searchsorted(ends_a, ends_b, "right") - first
    link_b = np.repeat(np.arange(ends_b.size), number)
    link_a = np.repeat(first - np.cumsum(number) + number, number) + np.arange(link_b.size)
    common = ends_a[link_a]  # in order
    common = common[np.append(np.ones(min(common.size, 1), bool), common[1:] != common[:-1])]
    return Aligned(common, np.searchsorted(common, ends_a, "left"), np.searchsorted(common, ends_b, "left"), link_a, link_b)


class Aligner:
    """Both tokenizers, and the tables of what their ids stand for."""

    def __init__(self, tokenizer_json: str, model: bytes) -> None:
        self.sides = ByteLevelSide(tokenizer_json), PieceSide(model)
        self.lengths = [np.array([len(x) for x in side.bytes], np.int64) for side in self.sides]
        most = max(len(side.bytes) for side in self.sides)
        self.written = [f"{i}{mark}" for mark in ",|;" for i in range(most)]
        self.most = most
        self.b_size = len(self.sides[1].bytes)
        #: A pair of ids is ``a * b_size + b``, packed as this type.
        self.pair_type = "<u4" if len(self.sides[0].bytes) * self.b_size <= 1 << 32 else "<i8"

    def reproduced(self, side: int, ids: np.ndarray, raw: bytes) -> bool:
        if int(self.lengths[side][ids].sum()) != len(raw):
            return False
        return b"".join(map(self.sides[side].bytes.__getitem__, ids.tolist())) == raw

    def texts(self, texts: Iterable[str | None]) -> Iterator[tuple[Tokens, Tokens, Aligned] | None]:
        """The tokens of both sides and their alignment; None where a text has no tokens. The tokens are
        those of space and text."""
        spaced = [" " + x if x else None for x in texts]
        given = [x for x in spaced if x is not None]
        coded = zip(given, self.sides[0].encode(given), self.sides[1].encode(given))
        for x in spaced:
            if x is None:
                yield None
                continue
            _, *both = next(coded)
            raw = x.encode()
            if not all(self.reproduced(side, tokens.ids, raw) for side, tokens in enumerate(both)):
                yield None
                continue
            widths = np.frombuffer(x.encode("utf-32-le"), "<u4")
            widths = 1 + (widths > 0x7F) + (widths > 0x7FF).astype(np.int64) + (widths > 0xFFFF)
            char_ends = np.concatenate([[0], np.cumsum(widths)])
            ends = [byte_ends(t, self.lengths[side][t.ids], char_ends) for side, t in enumerate(both)]
            yield (*both, align(*ends))

    def groups_parts(self, a: Tokens, b: Tokens, aligned: Aligned) -> list[str]:
        """The tokens of each group, those of A before those of B, with the mark behind each."""
        a_before = np.cumsum(np.bincount(aligned.group_a, minlength=aligned.n_groups))  # up to a group's end
        b_before = np.concatenate([[0], np.cumsum(np.bincount(aligned.group_b, minlength=aligned.n_groups))[:-1]])
        rows = np.empty(a.ids.size + b.ids.size, np.int64)
        for tokens, groups, mark, at in (
            (a, aligned.group_a, 1, np.arange(a.ids.size) + b_before[aligned.group_a]),
            (b, aligned.group_b, 2, np.arange(b.ids.size) + a_before[aligned.group_b]),
        ):
            ends_group = np.append(groups[1:] != groups[:-1], True)
            rows[at] = tokens.ids + np.where(ends_group, mark, 0) * self.most
        return list(map(self.written.__getitem__, rows.tolist()))

    def groups_text(self, a: Tokens, b: Tokens, aligned: Aligned) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group, those of A before those of B."""
        return "".join(self.groups_parts(a, b, aligned))[:-1]


#: What is kept of a word: tokens of A and of B, groups, packed pairs of linked ids, and its groups with a ";" behind
#: each. A word that the tokens do not reproduce has no groups.
Word = tuple[int, int, int, bytes, bytes]
NO_TOKENS: Word = (0, 0, 0, b"", b"")


class WordAligner:
    """Alignments of texts from those of their words."""

    #: Words of one generation; a worker keeps two, and words of the older one that are met again. Affects
    #: speed only.
    KEPT_WORDS, KEPT_LENGTH = 250_000, 48
    #: New words that are aligned in a row, in characters.
    TOGETHER_CHARS = 100_000

    _wide, _cut = re.compile(r"\s\s"), re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, aligner: Aligner) -> None:
        self.aligner = aligner
        self.kept: dict[str, Word] = {}
        self.older: dict[str, Word] = {}
        pieces = aligner.sides[1].bytes
        self.cuts = not any(b" " in piece.lstrip(b" ") for piece in pieces)

    def words(self, text: str) -> list[str]:
        """The text cut at single spaces between other characters. The added space is that of the first."""
        if not self.cuts:
            return [text]
        if self._wide.search(text) or text[0].isspace() or text[-1].isspace():
            return self._cut.split(text)
        return text.split(" ")

    def align_words(self, words: list[str]) -> Iterator[tuple[str, Word]]:
        """Words in a row as one text; where that is not reproduced, in halves."""
        found = next(self.aligner.texts([" ".join(words)]))
        if found is None:
            if len(words) == 1:
                yield words[0], NO_TOKENS
                return
            for half in (words[: len(words) // 2], words[len(words) // 2 :]):
                yield from self.align_words(half)
            return
        a, b, aligned = found
        text_ends = np.cumsum([1 + len(w.encode()) for w in words])
        groups = np.concatenate([[0], np.searchsorted(aligned.ends, text_ends, "right")])
        if (aligned.ends[groups[1:] - 1] != text_ends).any():
            raise ValueError("a token spans words")
        parts = self.aligner.groups_parts(a, b, aligned)
        linked = (a.ids[aligned.link_a] * self.aligner.b_size + b.ids[aligned.link_b]).astype(self.aligner.pair_type)
        packed, width = linked.tobytes(), linked.itemsize
        of_a = np.searchsorted(aligned.group_a, groups)
        of_b = np.searchsorted(aligned.group_b, groups)
        of_links = np.searchsorted(aligned.group_b[aligned.link_b], groups) * width
        bounds = np.stack([of_a, of_b, groups, of_links, of_a + of_b], axis=1).tolist()
        for word, low, high in zip(words, bounds, bounds[1:]):
            yield word, (
                high[0] - low[0],
                high[1] - low[1],
                high[2] - low[2],
                packed[low[3] : high[3]],
                "".join(parts[low[4] : high[4]]).encode(),
            )

    def learn(self, words: list[str]) -> dict[str, Word]:
        found: dict[str, Word] = {}
        run, size = [], 0
        for word in words:
            run.append(word)
            size += len(word) + 1
            if size > self.TOGETHER_CHARS:
                found.update(self.align_words(run))
                run, size = [], 0
        if run:
            found.update(self.align_words(run))
        return found

    def texts(self, texts: list[str]) -> Iterator[Word]:
        """What is kept of words, for whole texts (links repeated, and none of an empty text)."""
        cut = [self.words(x) if x else [] for x in texts]
        if len(self.kept) > self.KEPT_WORDS:
            self.kept, self.older = {}, self.kept
        each = pa.array(chain.from_iterable(cut), pa.large_string()).dictionary_encode()
        different = each.dictionary.to_pylist()
        known = {w: row for w in different if (row := self.kept.get(w) or self.older.get(w))}
        found = known | self.learn([w for w in different if w not in known])
        rows = [found[w] for w in different]
        self.kept.update((w, row) for w, row in found.items() if len(w) <= self.KEPT_LENGTH)
        places = each.indices.to_numpy()
        ends = np.cumsum([0] + [len(x) for x in cut])
        numbers = np.array([row[:3] for row in rows], np.int64).reshape(-1, 3)[places]
        sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(numbers, axis=0)])[ends]
        lost = np.concatenate([[0], np.cumsum(numbers[:, 2] == 0)])[ends]
        taken = [_taken([row[k] for row in rows], places, ends) for k in (3, 4)]
        for n, bad, pairs, groups in zip(np.diff(sums, axis=0).tolist(), np.diff(lost).tolist(), *taken):
            yield NO_TOKENS if bad or not groups else (*n, pairs, groups[:-1])


def _taken(values: list[bytes], places: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
    """The values at ``places``, joined from each of ``ends`` to the next."""
    taken = pa.array(values, pa.large_binary()).take(pa.array(places))
    offsets, joined = taken.buffers()[1:] if len(taken) else (None, None)
    cuts = np.frombuffer(offsets, np.int64)[ends].tolist() if offsets else [0] * ends.size
    for low, high in zip(cuts, cuts[1:]):
        yield joined[low:high].to_pybytes() if high > low else b""


# -- documents


_MADE: dict[int, WordAligner] = {}


def _aligner(spark: SparkSession, tokenizer_json: str, model: bytes) -> Callable[[], WordAligner]:
    """The two tokenizers for the executors: their size is that of the vocabularies."""
    shipped, key = spark.sparkContext.broadcast((tokenizer_json, model)), uuid.uuid4().int

    def aligner() -> WordAligner:
        if key not in _MADE:
            _MADE.clear()
            _MADE[key] = WordAligner(Aligner(*shipped.value))
        return _MADE[key]

    return aligner


def token_groups(docs: DataFrame, tokenizer_json: str, model: bytes) -> DataFrame:
    """``(doc_id, groups)``: per document the groups ``(start, end, a_ids, b_ids)``, with byte offsets in space
    and text; an empty list for a document without tokens."""
    spark = docs.sparkSession
    short_batches(spark, 200)
    aligner = _aligner(spark, tokenizer_json, model)

    @F.pandas_udf("array<struct<start:long,end:long,a_ids:array<int>,b_ids:array<int>>>")
    def grouped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sides = aligner().aligner
        for batch in batches:
            out = []
            for found in chain.from_iterable(map(sides.texts, portions(batch, 500_000))):
                rows: list[dict] = []
                if found is not None:
                    a, b, aligned = found
                    cuts_a = np.searchsorted(aligned.group_a, np.arange(aligned.n_groups + 1))
                    cuts_b = np.searchsorted(aligned.group_b, np.arange(aligned.n_groups + 1))
                    offsets = np.concatenate([[0], np.cumsum(sides.lengths[0][a.ids])])[cuts_a]
                    rows = [
                        {
                            "start": int(offsets[g]),
                            "end": int(offsets[g + 1]),
                            "a_ids": a.ids[cuts_a[g] : cuts_a[g + 1]].astype(np.int32),
                            "b_ids": b.ids[cuts_b[g] : cuts_b[g + 1]].astype(np.int32),
                        }
                        for g in range(aligned.n_groups)
                    ]
                out.append(rows)
            yield pd.Series(out, dtype=object)

    return docs.select("doc_id", grouped(F.coalesce("text", F.lit(""))).alias("groups"))


FACTS = (
    "row long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs binary, numbers binary"
)


def document_links(docs: DataFrame, tokenizer_json: str, model: bytes) -> DataFrame:
    """Per row of ``docs(row, doc_id, text)`` its counts, the digest of its groups, and its distinct pairs (packed)
    with how often it links each (packed 32-bit)."""
    spark = docs.sparkSession
    short_batches(spark, 500)
    aligner = _aligner(spark, tokenizer_json, model)
    names = [c.split()[0] for c in FACTS.split(", ")]

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = aligner()
        pair_type = words.aligner.pair_type
        for batch in batches:
            out = []
            found = chain.from_iterable(map(words.texts, portions(batch["text"], 4_000_000)))
            for row, doc_id, (n_a, n_b, n_groups, links, groups) in zip(batch["row"].tolist(), batch["doc_id"], found):
                linked = np.frombuffer(links, pair_type)
                pairs, numbers = np.unique(linked, return_counts=True)
                digest = hashlib.sha256(groups).hexdigest() if groups else ""
                packed = pairs.tobytes(), numbers.astype("<u4").tobytes()
                out.append((row, doc_id, n_a, n_b, n_groups, linked.size, digest, *packed))
            yield pd.DataFrame(out, columns=names)

    # Ids travel as text where pandas would turn a column with NULLs into floats.
    read = docs.select("row", F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).alias("text"))
    linked = read.mapInPandas(link, FACTS)
    return linked.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def _unpacked(batch: pd.DataFrame, pair_type: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row position in the batch, pair and number of every packed pair."""
    pairs = np.frombuffer(b"".join(batch["pairs"]), pair_type).astype(np.int64)
    numbers = np.frombuffer(b"".join(batch["numbers"]), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(batch)), batch["numbers"].map(len).to_numpy(np.int64) // 4)
    return owner, pairs, numbers


def pair_counts(linked: DataFrame, sides: Aligner) -> DataFrame:
    """``(pair, count, best)``: how many links of the corpus have the pair, and whether no pair with its B id
    has more. Numbers are added up per batch of documents before they are shuffled."""

    pair_type = sides.pair_type

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            _, pairs, numbers = _unpacked(batch, pair_type)
            each, place = np.unique(pairs, return_inverse=True)
            sums = np.zeros(each.size, np.int64)
            np.add.at(sums, place, numbers)
            yield pd.DataFrame({"pair": each, "number": sums})

    added = linked.select("pairs", "numbers").mapInPandas(add, "pair long, number long")
    counts, _ = stored(added.groupBy("pair").agg(F.sum("number").alias("count")), "pair-counts")
    each = counts.withColumn("b", F.col("pair") % sides.b_size)
    highest = each.groupBy("b").agg(F.max("count").alias("highest"))  # a row per B id at most
    return each.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def with_counts(linked: DataFrame, counts: DataFrame, pair_type: str, frequent: int = FREQUENT) -> DataFrame:
    """``(row, n_best, count_sum)`` of the documents that have links."""
    spark = linked.sparkSession
    total = counts.agg(F.sum("count")).first()[0] or 0
    often = F.col("count") * frequent >= total
    # At most ``frequent`` rows: their counts add up to no more than ``total``.
    table = counts.filter(often).select("pair", "count", F.col("best").cast("byte")).orderBy("pair").toArrow()
    shipped = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in table.column_names))

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, count, best = shipped.value
        for batch in batches:
            owner, pairs, numbers = _unpacked(batch, pair_type)
            at = np.minimum(np.searchsorted(known, pairs), max(known.size - 1, 0))
            hit = known[at] == pairs if known.size else np.zeros(pairs.size, bool)
            n_best, count_sum = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            np.add.at(count_sum, owner[hit], numbers[hit] * count[at[hit]])
            np.add.at(n_best, owner[hit], numbers[hit] * best[at[hit]])
            row = batch["row"].to_numpy(np.int64)
            rare = ~hit
            yield pd.DataFrame(
                {
                    "row": np.concatenate([row, row[owner[rare]]]),
                    "pair": np.concatenate([np.full(row.size, -1), pairs[rare]]),
                    "n_best": np.concatenate([n_best, np.zeros(rare.sum(), np.int64)]),
                    "amount": np.concatenate([count_sum, numbers[rare]]),
                }
            )

    # A row per document (pair -1) with what the table gave, and a row per pair that is not in it.
    looked, _ = stored(
        linked.select("row", "pairs", "numbers").mapInPandas(look_up, "row long, pair long, n_best long, amount long"),
        "pairs-looked-up",
    )
    known = looked.filter("pair = -1").select("row", "n_best", F.col("amount").alias("count_sum"))
    rare = looked.filter("pair <> -1").join(counts.filter(~often), "pair").select(
        "row",
        F.when(F.col("best"), F.col("amount")).otherwise(F.lit(0)).alias("n_best"),
        (F.col("amount") * F.col("count")).alias("count_sum"),
    )
    return known.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_documents(docs: DataFrame, tokenizer_json: str, model: bytes, frequent: int = FREQUENT) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` per document: ``n_best`` links
    whose pair has the highest count of its B id, and the sum of the counts over the links."""
    sides = Aligner(tokenizer_json, model)
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    linked, _ = stored(document_links(numbered, tokenizer_json, model), "links")  # row numbers are fixed with it
    totals = with_counts(linked, pair_counts(linked, sides), sides.pair_type, frequent)
    return linked.join(totals, "row", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"),
        "groups_sha256",
    )
