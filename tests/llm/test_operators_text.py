"""Quality rules, BPE, personal data, secrets: brute force, round trips, odd rows."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from vitrina.llm import bpe, pii, quality, queries, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\r\n"),
    (4, "ä" * 3_000 + " " + "1" * 5_000 + "@" * 2_000),
    (5, "x y " * 400),
    (5, "x y " * 400),
    (None, "Nothing to see here,   really.\n\nNothing to see here,   really."),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1) for i, t in rows], "doc_id long, text string, lang string, private int")


def table(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


# -- quality rules


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 3)}
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        again += line in seen and bool(WORD.search(line))
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_base_counts(spark, sf_dir):
    docs = [d for d in table(spark, sf_dir) if len(d[1]) < 4_000]
    for _, text in [*docs, *ODD[:3], ODD[6], (0, "a b c a b c a b c\na b c")]:
        assert quality.TextFacts(text).base == brute_base(text)


def test_quality_query(spark, sf_dir):
    found = {r.doc_id: r for r in queries.op4_quality_rules(spark, sf_dir).collect()}
    docs = dict(table(spark, sf_dir))
    assert set(found) == set(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    for doc_id, r in found.items():
        n, repeated = r.n_words, r.n_repeat_words
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert not (r.base_failed and r.kept)
    good = [found[x.doc_id] for x in labels if x.quality == 1]
    assert all(r.kept for r in good if not r.base_failed)
    bad = [found[x.doc_id] for x in labels if x.quality == 0]
    assert sum(r.kept for r in bad) < len(bad) / 2


def test_js_distance_and_guards():
    assert quality.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1
    assert quality.js_distance(np.array([2.0, 2]), np.array([1.0, 1])) == 0


def test_quality_of_odd_rows(spark):
    got = quality.judge_documents(frame(spark, ODD), out="private")
    assert got.columns == ["doc_id", "text", "lang", "private"]
    assert not any(r.private.kept for r in got.collect())
    assert quality.judge_documents(frame(spark, []), out="q").count() == 0
    words = " ".join(f"word{i} the new{i} of other{i} and" for i in range(60))
    unknown = spark.createDataFrame([(1, words, None), (2, words, "xx"), (3, words, "en")], "doc_id long, text string, lang string")
    assert [r.quality.kept for r in quality.judge_documents(unknown).collect()] == [True] * 3


# -- byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path(queries.RANK_FILE))


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_bpe_query(spark, sf_dir, reference):
    docs = dict(table(spark, sf_dir))
    for r in queries.op6_byte_bpe(spark, sf_dir).collect():
        raw, ids = docs[r.doc_id].encode(), reference.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(packed(ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(raw).hexdigest()


def test_bpe_of_odd_texts(ranks, reference):
    rng = random.Random(8)
    texts = ["", " ", "<|endoftext|>", "a" * 20_000, "ab" * 8_000, "\x00\x1f﻿", "日本語 текст 🙂🙂🙂", "don't I'LL 12345"]
    texts += ["".join(rng.choice("abcdeéü日 \n") for _ in range(rng.randint(1, 3_000))) for _ in range(40)]
    texts += ["".join(rng.choice("aeinrst") for _ in range(5_000))]
    coder = bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    for text, ids in zip(texts, coder.encode_all(texts)):
        assert ids == packed(reference.encode_ordinary(text))
        assert coder.decode(ids) == text.encode()
    pieces = [w.encode() for t in texts[-42:] for w in coder.split(t)]
    assert [packed(coder.merge(p)) for p in pieces] == coder.merge_all(pieces)


def test_bpe_columns(spark, ranks):
    got = bpe.encode_documents(frame(spark, ODD), ranks, public_tokenizers.PATTERN, out="private")
    rows = got.collect()
    assert got.columns == ["doc_id", "text", "lang", "private"]
    assert bytes(rows[0].private) == b"" and rows[4].private == rows[5].private
    assert bpe.encode_documents(frame(spark, []), ranks, public_tokenizers.PATTERN).count() == 0


def test_rank_queue_order():
    queue, rng = bpe.RankQueue(), random.Random(1)
    entries = [(rng.choice([0, 1, 63, 64, 4095, 4096, 50_000]), p) for p in range(300)]
    for e in entries:
        queue.push(*e)
    assert [queue.pop() for _ in entries] == sorted(entries) and queue.pop() is None


# -- personal data

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_private(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card":
                luhn = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
                if not 12 <= len(digits) <= 19 or luhn % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), list(BASE).index(kind), m.end()))
    return ",".join(f"{list(BASE)[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_private_query(spark, sf_dir):
    docs = dict(table(spark, sf_dir))
    for r in queries.op8_pii(spark, sf_dir).collect():
        base = brute_private(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(base.count(f"{k}:") for k in BASE)
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_plain_spans_equal_the_patterns():
    rng = random.Random(6)
    for _ in range(3_000):
        text = "".join(rng.choice("a.@-_+ 0123455()é") for _ in range(rng.randint(0, 60)))
        assert pii.written(pii.plain_spans(text)) == brute_private(text)
    digits = "4539 5787-6362 1486 and 4539578763621486 or 12.1.1.1.2.3.4.5, a@b.c_d@e.f"
    assert pii.written(pii.plain_spans(digits)) == brute_private(digits)


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("mail bob [at] example (dot) com now", "email", "bob [at] example (dot) com"),
        ("write to bob at example dot com today", "email", "bob at example dot com"),
        ("x ＡＢ＠ex．com y", "email", "ＡＢ＠ex．com"),
        ("jоhn@example.com", "email", "jоhn@example.com"),
        ("call plus one two three four five six seven eight nine zero ok", "phone", "plus one two three four five six seven eight nine zero"),
        ("ruf null eins sieben zwei drei vier fünf sechs sieben acht an", "phone", "null eins sieben zwei drei vier fünf sechs sieben acht"),
        ("bob[at]example dot com", "email", "bob[at]example dot com"),
        ("to bob @ example . com now", "email", "bob @ example . com"),
        ("bob&#64;example&#46;com", "email", "bob&#64;example&#46;com"),
        ("pay 4539\u00a05787\u00a06362\u00a01486 now", "card", "4539\u00a05787\u00a06362\u00a01486"),
        ("at １９２.168.0.1 there", "ip", "１９２.168.0.1"),
        ("a​b@exa​mple.com", "email", "a​b@exa​mple.com"),
    ],
)
def test_disguised_spans_map_back(text, kind, part):
    found = pii.disguised_spans(text, pii.plain_spans(text))
    assert [(k, text[s:e]) for k, s, e in found] == [(kind, part)]


def test_clean_prose_has_no_spans():
    for text in ("We met at noon. Dot com firms fell.", "one two three four five", "zéro un deux et puis six", "Привет, как дела?", "Look @ this. Then go.", "He is at work. Dot came.", "1990–2000 et\u00a0: 12"):
        assert pii.disguised_spans(text, pii.plain_spans(text)) == []


def test_private_of_odd_rows(spark):
    got = pii.find_private(frame(spark, ODD))
    assert got.columns == ["doc_id", "text", "lang", "private"]
    assert all(r.private.spans == "" for r in got.collect())
    masked = pii.mask_private(frame(spark, [(1, "a@b.de und +49 170 1234567"), (2, None), (3, "clean")]))
    assert [r.text for r in masked.collect()] == ["[email] und [phone]", None, "clean"]
    assert pii.find_private(frame(spark, [])).count() == 0


# -- secrets

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 16]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_secrets_query(spark, sf_dir):
    docs = dict(table(spark, sf_dir))
    for r in queries.op10_secrets(spark, sf_dir).collect():
        base = brute_secrets(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(filter(None, r.spans.split(",")))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(base.count(f"{k}:") for k in secrets.KINDS[:3])


def scanned(spark, rows, clear):
    got = secrets.find_secrets(frame(spark, rows), clear, out="private").select("doc_id", secrets.written(queries.F.col("private")))
    return dict(tuple(r) for r in got.collect())


def test_secret_spans(spark):
    rng = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    token = "".join(rng.choice(alphabet) for _ in range(44))
    rows = [(i, "".join(rng.choice(["secret", "é", "=", ": ", '"', "AKIA", "0123456789ab", "Z9", "token", "a", " "]) for _ in range(30))) for i in range(200)]
    rows += [(500, f"é key {token} end"), (501, "secret: token = abcdefghijklmnop"), (502, "AbCd1" * 9)]
    clear = {k: 60 for k in range(len(secrets.LENGTHS))}
    found = scanned(spark, rows, clear)
    for i, text in rows[:200]:
        kept = [s for s in found[i].split(",") if not s.startswith("random")]
        assert ",".join(kept) == brute_secrets(text)
    assert found[500] == f"random:6:{6 + len(token)}"
    assert found[501] == "" and found[502] == ""
    assert all(v == "" for v in scanned(spark, ODD[:3], {}).values())


def test_battery_tells_random_from_regular(spark):
    rng = random.Random(9)
    base64 = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(48, 58)])) + "+/"
    rows = [("".join(rng.choice(base64) for _ in range(40)), 1) for _ in range(60)]
    rows += [("".join(rng.choice("0123456789abcdef") for _ in range(40)), 1) for _ in range(60)]
    rows += [("Aa1" * 14, 0), ("0a" * 20, 0), ("abcdefghijABCDEFGHIJ0123456789abcdefghij", 0)]
    got = spark.createDataFrame(rows, "token string, random int").select("random", secrets.combined_p(queries.F.col("token")).alias("p")).collect()
    high = [r.p for r in got if r.random and r.p is not None]
    assert np.mean(np.array(high) > 0.01) > 0.9 and 0.3 < np.mean(high) < 0.7
    assert all(r.p < 1e-3 for r in got if not r.random)


def test_no_documents(spark):
    empty = frame(spark, [])
    assert secrets.clearing_bins(empty) == {}
    assert secrets.find_secrets(empty, {}).count() == 0
