"""Suffix-array, embedding and SimHash dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from vitrina.llm import embedding_dedup, queries, simhash, suffix_dedup
from vitrina.llm.components import connected_components


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_repeats(spark):
    random.seed(3)
    links = [(i, i + 1) for i in range(50, 90)] + [(7, i) for i in range(8, 40)] + [(7, 8), (8, 7), (5, 5)]
    random.shuffle(links)
    found = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    expected = components({n for e in links for n in e}, links)
    assert found == {n: r for n, r in expected.items() if n != r}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(docs, length):
    seen, out = set(), []
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        raw = (text or "").encode()
        covered = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            window = raw[p : p + length]
            if window in seen:
                covered[p : p + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, c in zip(raw, covered) if not c)
        spans = sum(c and (k == 0 or not covered[k - 1]) for k, c in enumerate(covered))
        out.append((doc_id, len(raw), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repeats(spark, docs, length, gram, hot):
    found = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), length, gram, hot)
    return sorted(
        ((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in found.collect()),
        key=repr,
    )


@pytest.mark.parametrize("hot", [10**6, 3])
def test_repeats_equal_brute_force(spark, hot):
    random.seed(5)
    parts = ["".join(random.choice("ab é") for _ in range(random.choice([8, 15, 30, 60]))) for _ in range(12)] + ["a" * 50]
    docs = [(i, "".join(random.choice(parts) for _ in range(random.randint(0, 9)))) for i in range(50)]
    docs += [(100, docs[3][1]), (101, None), (102, ""), (103, "x" * 400)]
    assert repeats(spark, docs, 20, 7, hot) == sorted(brute_repeats(docs, 20), key=repr)


def test_repeats_in_whole_table_equal_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted(tuple(r) for r in queries.op1_suffix_dedup(spark, sf_dir).collect())
    assert found == brute_repeats(docs, 100)


def test_repeats_of_equal_rows_and_missing_ids(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef ") for _ in range(300))
    found = repeats(spark, [(1, text), (1, text), (None, text), (2, text[:90])], 50, 16, 100)
    assert sorted((d, removed) for d, _, removed, _, _ in found if d is not None) == [(1, 0), (1, 0), (2, 90)]
    assert [r[2] for r in found if r[0] is None] == [300]
    assert repeats(spark, [], 50, 16, 100) == []


def test_text_longer_than_a_segment(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 256)
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh") for _ in range(3_000))
    sampler = suffix_dedup.Sampler(100, 32)
    whole = sampler.pick([(0, 0, long.encode())])
    pieces = [(0, s, long.encode()[s : s + 256 + 99]) for s in range(0, 3_000 - 99, 256)]
    parts = sampler.pick(pieces)
    assert set(zip(*(x.tolist() for x in whole))) == set(zip(*(x.tolist() for x in parts)))


def test_maximal_repeats_have_all_occurrences():
    rights = [b"abcdeX", b"abcdeY", b"abcdZZ", b"qq"]
    lefts = [b"12", b"12", b"13", b"12"]
    groups = {(left, right): sorted(m) for left, right, m in suffix_dedup.maximal_repeats(lefts, rights, 5)}
    assert groups == {(2, 5): [0, 1], (1, 4): [0, 1, 2]}


def brute_vectors(rows, cosine=0.98):
    good = {}
    for i, (_, vector, label) in enumerate(rows):
        if label is not None and vector and all(x is not None and np.isfinite(x) for x in vector) and any(vector):
            good[i] = np.array(vector, np.float64) / np.linalg.norm(np.array(vector, np.float64))
    links = [
        (a, b)
        for a in good
        for b in good
        if a < b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= cosine
    ]
    n = [sum(i in link for link in links) for i in range(len(rows))]
    root = components(range(len(rows)), links)
    lowest = {}
    for i, r in root.items():
        lowest[r] = min(lowest.get(r, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], n[i], lowest[root[i]], rows[i][0] == lowest[root[i]]) for i in range(len(rows))), len(links)


def test_vectors_equal_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    found = sorted(tuple(r) for r in queries.op5_embedding_dedup(spark, sf_dir).collect())
    assert found == brute_vectors(rows)[0]


def test_vectors_of_a_dense_group_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    middle = rng.standard_normal(16)
    rows = [(i, [float(x) for x in middle + 0.05 * rng.standard_normal(16)], 1) for i in range(300)]
    rows += [(300 + i, rows[0][1], 1) for i in range(5)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [None] + [1.0] * 15, 1)]
    rows += [(404, rows[0][1], None), (405, rows[0][1], 2), (406, [], 1), (407, [1.0, 2.0], 1), (408, [float("inf")] * 16, 1)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    found = sorted(tuple(r) for r in embedding_dedup.near_duplicates(frame, window=8).collect())
    assert found == brute_vectors(rows)[0]
    members = [(1, i, 1, rows[i][1]) for i in range(300)]
    blocks = embedding_dedup.counted_links(
        spark.createDataFrame(members, "root long, node long, copies long, vector array<double>"), 0.98, block=40
    )
    assert sorted(tuple(r) for r in blocks.collect()) == [(i, n) for i, n, *_ in brute_vectors(rows[:300])[0]]
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(docs):
    prints = [brute_fingerprint(t) for _, t in docs]
    links = [(a, b) for a in range(len(docs)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = components(range(len(docs)), links)
    lowest = {}
    for i, r in root.items():
        lowest[r] = min(lowest.get(r, docs[i][0]), docs[i][0])
    return sorted((docs[i][0], f"{prints[i]:016x}", lowest[root[i]]) for i in range(len(docs)))


def test_classes_equal_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.op9_simhash(spark, sf_dir).collect()) == brute_classes(docs)


@pytest.mark.parametrize("small", [1024, 2])
def test_links_of_planted_fingerprints(spark, small, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL_CELL", small)
    rng = random.Random(4)
    prints = {0, 1, 3, (1 << 64) - 1}
    for _ in range(40):
        f = rng.getrandbits(64)
        prints |= {f, *(f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(12))}
    prints = sorted(prints)
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    links = [(signed[a], signed[b]) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    if small == 2:  # the way for large cells, in process
        cells = np.array(prints, np.uint64)
        found = [(a, b) for x, y in simhash._large_links(cells) for a, b in zip(x.view(np.int64).tolist(), y.view(np.int64).tolist())]
    else:
        frame = spark.createDataFrame([(f,) for f in signed], "fp long")
        found = [tuple(r) for r in simhash.fingerprint_links(frame).collect()]
    assert components(signed, found) == components(signed, links)


def test_odd_documents(spark):
    docs = [(3, None), (1, ""), (2, " \t\n"), (5, "A b"), (4, "a B"), (7, "one two three"), (7, "one two three"), (None, "a b")]
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, fp int")
    found = sorted((r.doc_id or 0, r.fp, r.component_id) for r in simhash.classes(frame).collect())
    assert [(d, c) for d, _, c in found] == [(0, 4), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (7, 7), (7, 7)]
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 7]
    assert simhash.classes(frame.limit(0)).count() == 0


def test_neighbours_across_partition_cuts(spark):
    """Pairs next to each other in the order are found whatever the partitions."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((1_500, 16))
    rows = []
    for i, v in enumerate(base):
        rows += [(0, "l", 16, 2 * i, 2 * i, v.tolist()), (0, "l", 16, 2 * i + 1, 2 * i + 1, (v + 0.01).tolist())]
    frame = spark.createDataFrame(rows, "pass int, label string, size int, key long, node long, vector array<double>")
    for parts in (1, 7, 20):
        placed = frame.repartitionByRange(parts, "key").sortWithinPartitions(*embedding_dedup.PLACE)
        found = {(r.a, r.b) for r in embedding_dedup.window_links(placed, 64, 0.98).collect()}
        assert {(2 * i + 1, 2 * i) for i in range(1_500)} <= found


def test_recall_over_many_partitions(spark):
    """Isolated pairs at a cosine of about 0.985, with many more partitions than the data needs."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((2_000, 32))
    noise = rng.standard_normal((2_000, 32))
    near = base + 0.17 * noise * (np.linalg.norm(base, axis=1) / np.linalg.norm(noise, axis=1))[:, None]
    vectors = np.concatenate([base, near])
    frame = spark.createDataFrame([(i, v.tolist(), "l") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label string")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.vec_id: r.component_id for r in embedding_dedup.near_duplicates(frame).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    cosine = (vectors[:2_000] * vectors[2_000:]).sum(1) / np.linalg.norm(vectors[:2_000], axis=1) / np.linalg.norm(vectors[2_000:], axis=1)
    pairs = [i for i in range(2_000) if cosine[i] >= 0.98]
    assert len(pairs) > 1_000
    assert sum(found[i + 2_000] == found[i] for i in pairs) >= 0.99 * len(pairs)
