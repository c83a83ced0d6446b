"""Verdicts of the quality rules against brute force, and languages that are not given."""

import math
import random
from collections import Counter

from vitrina.llm import quality, queries

CLASS_CHARS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "\t\n\x0b\x0c\r ", ".,;:!?'\"()-"]


def classes(text):
    out = [0] * 7
    for b in text.encode():
        out[6 if b > 127 else next((k for k, chars in enumerate(CLASS_CHARS) if chr(b) in chars), 5)] += 1
    return out


def common(text, listed):
    plain = Counter(w.decode().strip(".,;:!?\"'()").lower() for w in text.encode().split() if len(w) < 14)
    found = [plain[w] for w in listed]
    return [*found, len(text.encode().split()) - sum(found)]


def distance(a, b):
    p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
    m = [(x + y) / 2 for x, y in zip(p, q)]
    part = sum(x * math.log2(x / z) for x, z in zip(p, m) if x) + sum(y * math.log2(y / z) for y, z in zip(q, m) if y)
    return math.sqrt(max(0, part / 2))


def added(histograms):
    return [sum(x) for x in zip(*histograms)]


def test_verdicts_equal_brute_force(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = {r.doc_id: r for r in queries.op4_quality_rules(spark, sf_dir).collect()}
    passing = [d for i, d in docs.items() if not found[i].base_failed]
    references = {}
    for lang in {d.lang for d in passing}:
        texts = [d.text for d in passing if d.lang == lang]
        listed = list(dict.fromkeys(quality.COMMON_WORDS[lang].split()))
        references[lang] = added(map(classes, texts)), listed, added(common(t, listed) for t in texts)
    kept = Counter()
    for d in passing:
        by_class, listed, by_word = references[d.lang]
        size, words = len(d.text.encode()), len(d.text.encode().split())
        far = size >= 200 and distance(classes(d.text), by_class) > 0.315 + 0.06 * max(0, 1 - size / 1_000)
        odd = words >= 100 and distance(common(d.text, listed), by_word) > 0.33 + 0.03 * max(0, 1 - words / 300)
        assert found[d.doc_id].kept == (not far and not odd), d.doc_id
        kept[found[d.doc_id].kept] += 1
    assert kept[True] and kept[False]


def prose(rng, words, n):
    return " ".join(rng.choices(words, weights=[1 / (1 + k) for k in range(len(words))], k=n)) + "."


def test_languages_of_the_corpus_are_measured(spark):
    """Clean Russian and Greek documents stay, junk among them goes; a language with a handful of documents
    and texts of unknown language are judged by the base rules."""
    rng = random.Random(8)
    scripts = {"ru": "абвгдежзиклмнопрстуя", "el": "αβγδεζηθικλμνοπρστυω", "xx": "ابتثجحخدذرزسشصضطظعغ"}
    rows, expected = [], []
    for lang, letters in scripts.items():
        vocabulary = ["".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(800)]
        for _ in range(20 if lang == "xx" else 250):
            rows.append((len(rows), prose(rng, vocabulary, rng.randint(120, 300)), lang))
            expected.append(True)
        for _ in range(0 if lang == "xx" else 10):
            junk = " ".join("".join(rng.choices("0123456789|#=_<>", k=6)) for _ in range(200))
            salad = " ".join("".join(rng.choices(letters, k=6)) for _ in range(300))
            rows += [(len(rows), junk, lang), (len(rows) + 1, salad, lang)]
            expected += [False, False]
    vocabulary = ["".join(rng.choices("אבגדהוזחטיכלמנסעפצקרשת", k=4)) for _ in range(300)]
    rows += [(len(rows), prose(rng, vocabulary, 200), None)]
    expected.append(True)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    references = quality.language_references(docs)
    assert set(references) == {"ru", "el"} and all(len(r.index) == quality.FREQUENT_WORDS for r in references.values())
    found = {r.doc_id: r.quality.kept for r in quality.judge_documents(docs).collect()}
    wrong = [(i, rows[i][2], e) for i, e in enumerate(expected) if found[i] != e]
    assert not [w for w in wrong if w[2]], wrong  # no clean document goes
    assert len(wrong) <= 2, wrong


def test_frequent_words_equal_a_count(spark):
    rng = random.Random(9)
    words = [f"слово{i % 40}" if i % 3 else f"и{i}" for i in range(300)]
    texts = [prose(rng, words, 150) for _ in range(3 * quality.MIN_DOCUMENTS)]
    docs = spark.createDataFrame([(i, t, "uk") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(4)
    reference = quality.language_references(docs)["uk"]
    passing = [t for t in texts if not quality.base_fails(quality.TextFacts(t).base, quality.Rules())]
    plain = Counter(w.decode().strip(".,;:!?\"'()").lower() for t in passing for w in t.encode().split() if len(w) < 14)
    listed = [w for w, _ in sorted(plain.items(), key=lambda x: (-x[1], x[0]))[: quality.FREQUENT_WORDS]]
    assert list(reference.index) == listed
    assert reference.words.tolist() == added(common(t, listed) for t in passing)
