"""Lexical search, token alignment and packing against brute force."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vitrina.llm import alignment, lexical, packing, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def read(name, mode="r"):
    with open(public_tokenizers.path(name), mode, **({} if "b" in mode else {"encoding": "utf-8"})) as file:
        return file.read()


# -- lexical search


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_search(docs, items, top=50):
    counts = [(i, Counter(TERM.findall(folded(t)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        terms = set(TERM.findall(folded(text)))
        scored = []
        for doc, c in counts:
            m = 50 + (50 * c.total() * n) // length
            score = sum(
                math.floor(1000 * math.log((2.0 * n + 2) / (2.0 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
                for t in terms & c.keys()
            )
            if score > 0:
                scored.append((-score, doc is None, doc, score))
        ranked = sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top]
        out += [(item, rank, doc, score) for rank, (_, _, doc, score) in enumerate(ranked, 1)]
    return sorted(out, key=repr)


def ranked(frame):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()), key=repr)


def test_terms_of():
    assert lexical.terms_of("A-b_c ñÑ x 9Z`{|}~\x7f\x00 日本") == TERM.findall(folded("A-b_c ñÑ x 9Z`{|}~\x7f\x00 日本"))
    assert lexical.terms_of("") == lexical.terms_of(" .,") == []


def made_corpus(seed):
    """Frequent and rare terms, ties, copies, empty and NULL texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (1 + k) for k in range(60)], k=rng.randint(1, 40)))) for i in range(150)]
    docs += [(200 + i, docs[7][1]) for i in range(30)] + [(300, None), (301, ""), (302, "...")]
    items = [(k, " ".join(rng.sample(words, rng.randint(1, 25)))) for k in range(12)] + [(50, None), (51, "!"), (52, "nowhere"), (53, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("top", [1, 5, 50])
def test_search_equals_brute_force(spark, top):
    docs, items = made_corpus(top)
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, row int")
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    assert ranked(lexical.search(frame, asked, top)) == brute_search(docs, items, top)


def test_search_repeats_and_missing_ids(spark):
    docs = [(4, "alpha beta"), (4, "alpha beta"), (None, "alpha beta"), (2, "alpha"), (9, "gamma")]
    items = [(1, "alpha beta"), (1, "alpha beta"), (None, "Alpha")]
    found = ranked(lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 3))
    assert found == brute_search(docs, items, 3)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(docs, items.limit(0)).count() == lexical.search(docs.limit(0), items).count() == 0


def test_search_beyond_the_bounds(spark, monkeypatch):
    """Items whose terms are not sent to the tasks, and so many of them that layers share a place."""
    monkeypatch.setattr(lexical, "VOCABULARY_BYTES", 0)
    monkeypatch.setattr(lexical, "LAYERS", tuple(i / 12 for i in range(1, 12)) + (1.0,))
    docs, items = made_corpus(3)
    docs += [(1_000 + i, f"extra{i} w3 w{i % 60}") for i in range(40)]
    items += [(99, " ".join(f"extra{i}" for i in range(40)) + " " + " ".join(f"w{i}" for i in range(60)))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert ranked(lexical.search(frame, asked, 10)) == brute_search(docs, items, 10)


def test_search_stops_when_resolved(spark, monkeypatch):
    """Rare terms alone decide the first item: the layers of the common one are not read."""
    read = []
    layer = lexical.Search.layer
    monkeypatch.setattr(lexical.Search, "layer", lambda self, r, *a: read.append(r) or layer(self, r, *a))
    docs = [(i, "common " * 3 + f"rare{i // 20} r{i}") for i in range(400)]
    found = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "rare3")], "item_id long, text string"), 5)
    assert [r.doc_id for r in found.orderBy("rank").collect()] == [60, 61, 62, 63, 64]
    assert read == [0]


# -- token alignment


TEXTS = [
    "Hello world, naïve 日本語 ☃ 𝒳𝒴 and\n\n  spaces  ",
    "a",
    " ",
    "▁already ▁▁ there",
    "<|endoftext|> and <s> </s> <unk> <0x41>",
    "\u0000 null, ́ combining, é, ‍ zero width",
    "ﬁ ligature Å   no-break　ideographic",
    "x" * 3_000,
    "don't they'll 123 4567 ñandú ¿qué? straße",
    None,
    "",
]


def brute_alignment(docs):
    a_side = Tokenizer.from_str(read("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    names = {i: t for t, i in a_side.get_vocab().items()}
    byte = alignment.byte_level_alphabet()
    facts, counts = [], Counter()
    for doc_id, text in docs:
        tokens = None
        if text:
            a = [(i, bytes(byte[c] for c in names[i])) for i in a_side.encode(" " + text, add_special_tokens=False).ids]
            pieces = [(i, b_side.IdToPiece(i)) for i in b_side.encode(text)]
            b = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()) for i, p in pieces]
            raw = (" " + text).encode()
            if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b):
                tokens = a, b
        if tokens is None:
            facts.append((doc_id, 0, 0, [], ""))
            continue
        ends = [list(itertools.accumulate(len(x) for _, x in side)) for side in tokens]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, links, start = [], [], 0
        for cut in common:
            ids = [[i for (i, _), e in zip(side, ends[k]) if start < e <= cut] for k, side in enumerate(tokens)]
            groups.append(",".join(map(str, ids[0])) + "|" + ",".join(map(str, ids[1])))
            links.append((ids[0][-1], ids[1][-1]))
            start = cut
        counts.update(links)
        facts.append((doc_id, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    highest = Counter()
    for (_, b_id), n in counts.items():
        highest[b_id] = max(highest[b_id], n)
    return sorted(
        (
            (i, n_a, n_b, len(links), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), digest)
            for i, n_a, n_b, links, digest in facts
        ),
        key=repr,
    )


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("frequent", [0, 3, 40, 500_000])
def test_alignment_equals_brute_force(spark, frequent):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0]), (0, TEXTS[0])]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, row int").repartition(3)
    found = alignment.align_documents(frame, read("byte_bpe_50k.json"), read("piece_bpe_32k.model", "rb"), frequent)
    assert sorted((tuple(r[c] for c in ALIGNED) for r in found.collect()), key=repr) == brute_alignment(docs)


def test_alignment_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op12_token_alignment(spark, sf_dir)
    assert sorted((tuple(r[c] for c in ALIGNED) for r in found.collect()), key=repr) == brute_alignment(docs)


def test_groups_are_spans_of_the_text(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    aligner = alignment.Aligner(read("byte_bpe_50k.json"), read("piece_bpe_32k.model", "rb"))
    for r in alignment.token_groups(docs, read("byte_bpe_50k.json"), read("piece_bpe_32k.model", "rb")).collect():
        raw = (" " + (TEXTS[r.doc_id] or "")).encode()
        for g in r.groups:
            for side, ids in enumerate((g.a_ids, g.b_ids)):
                assert b"".join(aligner.sides[side].bytes[i] for i in ids) == raw[g.start : g.end]
        assert [g.end for g in r.groups[:-1]] == [g.start for g in r.groups[1:]]


def test_refined_ends_inside_characters():
    """The spans alone cannot place ends inside a character: the decoded bytes do."""
    aligner = alignment.Aligner(read("byte_bpe_50k.json"), read("piece_bpe_32k.model", "rb"))
    a, b, found = next(aligner.texts(["日 𝒳"]))
    assert a.ids.size > 3 and (a.begin[1:] < a.end[:-1]).any() and (b.begin == b.end).any()
    assert aligner.groups_text(a, b, found).count(";") == found.n_groups - 1


def test_alignment_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_documents(none, read("byte_bpe_50k.json"), read("piece_bpe_32k.model", "rb")).count() == 0


# -- packing


def fewest(sizes, capacity):
    """Exact bin packing of a few pieces."""
    best = [(len(sizes) + 1, 0)] * (1 << len(sizes))
    best[0] = (1, 0)
    for held in range(1 << len(sizes)):
        bins, fill = best[held]
        for i, size in enumerate(sizes):
            if not held >> i & 1:
                after = (bins, fill + size) if fill + size <= capacity else (bins + 1, size)
                best[held | 1 << i] = min(best[held | 1 << i], after)
    return best[-1][0] if sizes else 0


def spread(counts):
    return list(itertools.chain.from_iterable([s] * n for s, n in counts.items()))


def test_reduction_keeps_the_optimum():
    rng = random.Random(1)
    reduced = 0
    for _ in range(300):
        capacity = rng.choice([10, 20, 50, 100])
        least = rng.choice([1, capacity // 5 + 1, capacity // 4])
        sizes = Counter(rng.randint(least, capacity) for _ in range(rng.randint(0, 9)))
        fixed, rest = packing.reduce_counts(sizes, capacity)
        held = Counter(rest)
        for content, times in fixed:
            assert times > 0 and sum(s * n for s, n in content) <= capacity
            held.update({s: n * times for s, n in content})
        assert held == sizes
        reduced += bool(fixed)
        assert sum(times for _, times in fixed) + fewest(spread(rest), capacity) == fewest(spread(sizes), capacity)
    assert reduced > 200


def test_best_fit_equals_piece_by_piece():
    rng = random.Random(2)
    for _ in range(300):
        capacity = rng.choice([20, 100, 300])
        sizes = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 80)))
        bins = []
        for size in sorted(spread(sizes), reverse=True):
            fits = [b for b in bins if b[0] >= size]
            if fits:
                min(fits, key=lambda b: b[0])[0] -= size
            else:
                bins.append([capacity - size])
        runs = packing.best_fit(sizes, capacity)
        assert sum(times for _, times in runs) == len(bins)
        held = Counter()
        for content, times in runs:
            assert sum(s * n for s, n in content) <= capacity
            held.update({s: n * times for s, n in content})
        assert +held == sizes


def check_packed(rows, documents, capacity):
    """``rows`` of (doc_id, piece, start, length, crc, sequence, offset) hold all ids, gapless and within capacity."""
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter()
    for doc_id, text in documents:
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            own = ids[start : start + capacity]
            expected[doc_id, piece, start, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))] += 1
    assert Counter(tuple(r[:5]) for r in rows) == expected
    in_order = sorted((r[5], r[6], r[3]) for r in rows)
    filled = Counter()
    for sequence, offset, length in in_order:
        assert offset == filled[sequence]
        filled[sequence] += length
    assert max(filled.values(), default=0) <= capacity
    return len(filled), -(-sum(filled.values()) // capacity)


PACKED = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_packing_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = [tuple(r[c] for c in PACKED) for r in queries.op13_packing(spark, sf_dir).collect()]
    made, bound = check_packed(rows, docs, 2048)
    assert made <= bound + 1


def test_packing_of_odd_rows(spark):
    docs = [(1, None), (1, ""), (None, "one two\tthree\r\nfour five ́x"), (7, "<|endoftext|> Σας İ ΑΣ"), (7, "lang " * 500), (9, "wörter" * 300)]
    frame = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, part int").repartition(3)
    cut = packing.pieces(frame, read("word_bpe_49k.json"), capacity=64)
    packed = packing.pack(cut, 64)
    rows = [(r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids), r.sequence_id, r.offset) for r in packed.collect()]
    check_packed(rows, docs, 64)
    for r in packing.sequences(packed).collect():
        assert r.length * 4 == len(r.ids) <= 256
        held = sorted((x[6], x[0]) for x in rows if x[5] == r.sequence_id)
        assert r.doc_ids == [d for _, d in held]


def test_packing_of_nothing(spark):
    cut = packing.pieces(spark.createDataFrame([], "doc_id long, text string"), read("word_bpe_49k.json"))
    assert packing.pack(cut).count() == 0
