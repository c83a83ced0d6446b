"""Maximal repeats with all occurrences, against all substrings of small texts."""

import hashlib
import random
from collections import defaultdict

import pytest

from vitrina.llm import repeat_groups


def brute_groups(docs, length):
    places = defaultdict(list)
    raws = [(text or "").encode() for _, text in docs]
    for d, raw in enumerate(raws):
        for a in range(len(raw)):
            for b in range(a + length, len(raw) + 1):
                places[raw[a:b]].append((d, a))
    out = []
    for string, found in places.items():
        if len(found) < 2:
            continue
        n = len(string)
        before = {raws[d][a - 1] if a else ("start", d, i) for i, (d, a) in enumerate(found)}
        behind = {raws[d][a + n] if a + n < len(raws[d]) else ("end", d, i) for i, (d, a) in enumerate(found)}
        if len(before) > 1 and len(behind) > 1:
            out += [(hashlib.sha256(string).hexdigest(), docs[d][0], a, n) for d, a in found]
    return sorted(out, key=repr)


def groups(spark, docs, length, gram, hot=10**6):
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, context string")
    return sorted((tuple(r) for r in repeat_groups.repeat_groups(frame, length, gram, hot).collect()), key=repr)


@pytest.mark.parametrize("hot", [10**6, 2])
def test_groups_equal_brute_force(spark, hot):
    rng = random.Random(11)
    parts = ["".join(rng.choice("ab é") for _ in range(rng.choice([6, 11, 30, 70]))) for _ in range(9)] + ["a" * 40]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 5)))) for i in range(22)]
    # Copies, a copy within a longer text, a repeat over several rounds, missing ids and texts, equal rows.
    long = "".join(rng.choice("cdefgh") for _ in range(260))
    docs += [(100, docs[3][1]), (101, None), (102, ""), (103, long), (104, "q" + long[:-3]), (105, long), (None, "zz" + long), (105, long)]
    expected = brute_groups(docs, 14)
    assert len(expected) > 500 and max(r[3] for r in expected) >= 257
    assert groups(spark, docs, 14, 5, hot) == expected


def test_groups_of_few_rows(spark):
    assert groups(spark, [], 20, 7) == []
    assert groups(spark, [(1, "short"), (2, "short"), (3, None)], 20, 7) == []
    text = "a sentence that is there once more"
    key = hashlib.sha256(text.encode()).hexdigest()
    assert groups(spark, [(1, text), (2, text)], 20, 7) == [(key, 1, 0, 34), (key, 2, 0, 34)]
    assert groups(spark, [(1, text), (2, "x" + text + "y")], 20, 7) == [(key, 1, 0, 34), (key, 2, 1, 34)]
