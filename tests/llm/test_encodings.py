"""Recall of the randomness battery on every encoding."""

import random
import time
from collections import Counter

from vitrina.llm import secrets
from vitrina.llm.queries import F

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


KINDS = [
    (DIGITS + "abcdef", 0), (DIGITS + "ABCDEF", 0), (DIGITS + "abcdef", 4), (UPPER + "234567", 0), (LOWER + "234567", 0),
    (LOWER + DIGITS, 0), (UPPER + DIGITS, 0), (UPPER + DIGITS, 4), (LOWER, 0), (UPPER, 0), (LOWER + UPPER, 0),
    (LOWER + UPPER + DIGITS + "+/", 0), (LOWER + UPPER + DIGITS + "-_", 0),
]


def test_random_strings_are_found(spark):
    rng, rows = random.Random(7), []
    for kind, (alphabet, dashes) in enumerate(KINDS):
        for length in (20, 44):
            for _ in range(100):
                t = "".join(rng.choice(alphabet) for _ in range(length))
                rows.append(((kind, length), "-".join(t[i : i + dashes] for i in range(0, length, dashes)) if dashes else t))
    docs = spark.createDataFrame([(i, f"see {t} here") for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = secrets.find_secrets(docs, {k: 60 for k in range(len(secrets.LENGTHS))})
    spans = dict(tuple(r) for r in found.select("doc_id", secrets.written(F.col("secrets"))).collect())
    hit = Counter(key for i, (key, t) in enumerate(rows) if any(s.endswith(f":4:{4 + len(t)}") for s in spans[i].split(",")))
    assert len(hit) == 2 * len(KINDS) and min(hit.values()) >= 95, hit


def test_regular_runs_are_cleared(spark):
    tokens = ["-" * 30, "a" * 25, "ab" * 15, "a" + "=" * 30, "=" * 30, "abcdefghijklmnopqrstuvwxyz", "0" * 24, "/usr/share/lib/python/site/packages"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "doc_id long, text string")
    found = secrets.find_secrets(docs, {k: 40 for k in range(len(secrets.LENGTHS))})
    assert [len([s for s in r.secrets if s["kind"] == 3]) for r in found.orderBy("doc_id").collect()] == [0] * len(tokens)


AROUND = ["see {} here", "aws_secret_access_key={}", "https://x.io/cb?sig={}&v=2", 'key="{}"', "a_rather_long_name_of_a_setting={}\n", "x={}=="]


def test_secrets_in_settings_and_urls_with_thresholds_of_the_corpus(spark):
    """Thresholds come from the corpus: prose, paths and names, and random strings of every encoding."""
    rng, rows = random.Random(11), []
    words = ["the", "station", "garden", "morning", "yellow", "between", "history", "of", "market"]
    for i in range(400):
        names = ["-".join(rng.choices(words, k=6)), "/".join(rng.choices(words, k=5)), "_".join(rng.choices(words, k=5))]
        rows.append((None, 0, " ".join([*rng.choices(words, k=20), rng.choice(names), "0" * 24, "-" * 30])))
    for kind, (alphabet, dashes) in enumerate(KINDS):
        for n in range(120):
            t = "".join(rng.choice(alphabet) for _ in range(40))
            t = "-".join(t[i : i + dashes] for i in range(0, 40, dashes)) if dashes else t
            around = AROUND[n % len(AROUND)]
            rows.append(((kind, around), around.index("{}") + len(t), around.format(t)))
    docs = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    clear = secrets.clearing_bins(docs)
    assert clear, "nothing is cleared"
    found = secrets.find_secrets(docs, clear).select("doc_id", "secrets").collect()
    ends = {r.doc_id: {s["end"] for s in r.secrets} for r in found}
    hit, all_of = Counter(), Counter()
    for i, (key, end, text) in enumerate(rows):
        if key is not None:
            padded = end + (2 if text.endswith("==") else 0)
            all_of[key] += 1
            hit[key] += bool({end, padded} & ends[i])
    for part in (0, 1):  # by encoding and by what stands around
        for value in {k[part] for k in all_of}:
            keys = [k for k in all_of if k[part] == value]
            assert sum(hit[k] for k in keys) >= 0.95 * sum(all_of[k] for k in keys), value
    prose = [r for r in found if rows[r.doc_id][0] is None]
    assert sum(any(s["kind"] == 3 for s in r.secrets) for r in prose) <= 0.1 * len(prose)


def test_many_hits_in_one_text(spark):
    rng = random.Random(3)
    tokens = ["".join(rng.choices(UPPER + LOWER + DIGITS, k=24)) for _ in range(16_000)]
    text = " ".join(f"token={t}" if i % 2 else t for i, t in enumerate(tokens))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    clear = {k: 60 for k in range(len(secrets.LENGTHS))}
    secrets.find_secrets(docs.limit(0), clear).collect()
    began = time.time()
    found = secrets.find_secrets(docs, clear).select("secrets").first().secrets
    assert time.time() - began < 15
    kinds = Counter(s["kind"] for s in found)
    assert kinds[0] == 8_000 and kinds[3] >= 7_800
    assert all(text[s["start"] : s["end"]].startswith("token=") for s in found if s["kind"] == 0)
