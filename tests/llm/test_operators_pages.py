"""WARC archives, URL filter, mixing and the pipeline."""

import base64
import gzip
import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.test_operators_dedup import brute_classes
from vitrina.llm import bpe, mixing, pii, quality, queries, url_filter, warc


def sql(sf_dir, query):
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    result = con.execute(query)
    return [d[0] for d in result.description], result.fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    columns, rows = sql(sf_dir, queries.ORACLES[name])
    found = queries.QUERIES[name](spark, sf_dir).select(columns).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, rows))


# -- WARC


def brute_records(pages):
    payloads = [(i, (html or "").encode()) for i, _, html in pages]
    first = {}
    for i, p in payloads:
        if i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, p in payloads:
        revisit = i is not None and i > first[p]
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out.append((i, len(p), digest, "revisit" if revisit else "response", first[p] if revisit else None))
    return sorted(out, key=repr)


FIELDS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
PAGES = [
    (5, "http://a/x y\r\nz", "same"),
    (3, "http://b", "same"),
    (3, "http://b", "same"),
    (8, None, None),
    (9, "u", ""),
    (None, "v", "same"),
    (None, "w", "own é 日本"),
    (10, "w", "line\r\n\r\nWARC/1.1\r\n\r\n\x1f\u008b\x08" + "x" * 50_000),
]


def test_warc_query(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    found = [tuple(r) for r in queries.op2_warc(spark, sf_dir).select(FIELDS).collect()]
    assert sorted(found, key=repr) == brute_records(pages)


@pytest.mark.parametrize("split", [64, 1_000, 1 << 20])
def test_warc_round_trip(spark, split):
    frame = spark.createDataFrame([(*p, 0) for p in PAGES], "page_id long, url string, html string, payload int").coalesce(2)
    archives = warc.write_archives(frame)
    back = warc.read_archives(spark, archives, split_bytes=split)
    rows = back.collect()
    assert sorted((tuple(r[f] for f in FIELDS) for r in rows), key=repr) == brute_records(PAGES)
    texts = sorted(bytes(r.payload).decode() for r in rows if r.record_type == "response")
    assert texts == sorted([PAGES[1][2], PAGES[2][2], "", PAGES[5][2], PAGES[6][2], PAGES[7][2]])
    assert {r.url for r in rows} == {"http://a/x%20y%0D%0Az", "http://b", None, "u", "v", "w"}


def test_archives_are_plain_gzip_members(spark):
    archive = warc.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)).first()
    raw = open(archive.archive.removeprefix("file://"), "rb").read()
    assert len(raw) == archive.bytes and archive.records == len(PAGES)
    assert gzip.decompress(raw).count(b"WARC/1.1\r\nWARC-Type: ") == len(PAGES)


def test_chance_magic_is_passed_over(tmp_path):
    members = [warc.record(i, "u", f"page {i}".encode(), None, False) for i in range(3)]
    junk = warc.MAGIC + bytes(range(40)) + gzip.compress(b"no record") + b"\x1f\x8b"
    path = tmp_path / "x.warc.gz"
    path.write_bytes(junk + members[0] + junk + members[1] + members[2] + members[2][:60])
    with path.open("rb") as file:
        for size in (1, 7, 50, 10_000):
            found = [
                block.split(b"\r\n\r\n")[1]
                for start in range(0, path.stat().st_size, size)
                for _, _, block in warc.records_in(warc.Window(file), start, start + size)
            ]
            assert found == [b"page 0", b"page 1", b"page 2"]


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    archives = warc.write_archives(none)
    assert warc.read_archives(spark, archives).count() == 0


# -- URL filter


def test_url_parts_and_rules(spark):
    rows = [
        ("http://EXAMPLE.org/es/1?x#y", "example.org", "/es/1", "example.org/es/", "block"),
        ("http://a.example.org/en/1", "a.example.org", "/en/1", "example.org/en/1", "block"),
        ("https://b.org/en/2", "b.org", "/en/2", "org/", "allow"),
        ("https://b.org", "b.org", "", None, None),
        ("http://x.com/fr/?q=://", "x.com", "/fr/", "com/fr/", "allow"),
        ("http://x.com/FR/", "x.com", "/FR/", None, None),
        ("http://notorg/", "notorg", "/", None, None),
        ("x.com/de/", "", "", None, None),
        (None, "", "", None, None),
        ("http://Ä.COM?/de/", "Ä.com", "", None, None),
        ("http://c.com/de/#/", "c.com", "/de/", "com/de/", "block"),
    ]
    frame = spark.createDataFrame([(i, r[0], "k") for i, r in enumerate(rows)] * 2, "page_id int, url string, judged_url string")
    got = url_filter.filter_urls(frame)
    assert got.columns == ["page_id", "url", "judged_url", "host", "path", "rule", "verdict"]
    found = got.collect()
    assert len(found) == 2 * len(rows)
    for r in found:
        _, host, path, rule, verdict = rows[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.judged_url == "k"
        assert r.verdict in ("allow", "block") and verdict in (None, r.verdict)


def test_url_model_learns(spark):
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    good = [f"http://{word('aeioulmn')}.org/{word('aeioulmn')}" for _ in range(150)]
    bad = [f"http://{word('xzqkw09')}.com/de/{word('xzqkw09')}" for _ in range(150)]
    new = [(f"http://{word('aeioulmn')}.net/{word('aeioulmn')}", "allow") for _ in range(30)]
    new += [(f"http://{word('xzqkw09')}.net/{word('xzqkw09')}", "block") for _ in range(30)]
    frame = spark.createDataFrame([(u,) for u in [*good, *bad, *(u for u, _ in new)]], "url string")
    verdicts = {r.url: r.verdict for r in url_filter.filter_urls(frame).collect()}
    assert np.mean([verdicts[u] == v for u, v in new]) > 0.95


def test_urls_without_training(spark):
    frame = spark.createDataFrame([("http://a.net/",), (None,)], "url string")
    assert [r.verdict for r in url_filter.filter_urls(frame).collect()] == ["allow", "allow"]
    assert url_filter.filter_urls(frame.limit(0)).count() == 0


# -- mixing


def test_mixing_meets_the_weights(spark):
    rows = [(i, "x" * 100, "big" if i < 6_000 else "small" if i < 7_000 else None, "k") for i in range(8_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, _at string")
    mixed = mixing.mix(frame, exponent=0.0)
    assert mixed.columns == ["doc_id", "text", "source", "_at", "replica", "place"]
    counts = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert all(abs(n - 8_000 / 3) < 5 * (8_000 / 3) ** 0.5 for n in counts.values()) and len(counts) == 3
    weighted = mixing.mix(frame, weights={"small": 3.0, "big": 1.0}).groupBy("source").count().collect()
    counts = {r.source: r["count"] for r in weighted}
    assert set(counts) == {"small", "big"} and abs(counts["small"] - 6_000) < 500 and abs(counts["big"] - 2_000) < 250
    again = mixing.mix(frame, exponent=0.0).repartition(3)
    key = lambda df: sorted((r.doc_id, r.replica, r.place) for r in df.collect())
    assert key(mixed) == key(again)


def test_large_means_are_sums_of_parts(spark):
    frame = spark.createDataFrame([(i, "x", "a" if i < 300 else "b") for i in range(20_300)], "doc_id long, text string, source string")
    n = [r["count"] for r in mixing.mix(frame, weights={"a": 1.0}).groupBy("doc_id").count().collect()]
    mean = 20_300 / 300
    assert abs(np.mean(n) - mean) < 5 * (mean / 300) ** 0.5 and 0.7 < np.var(n) / mean < 1.4


def test_mixing_of_odd_rows(spark):
    rows = [(1, None, "a"), (1, None, "a"), (None, "", None), (None, "x", None), (2, "long" * 1000, "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n = {}
    for r in mixing.mix(frame).collect():
        n[r.doc_id, r.text] = n.get((r.doc_id, r.text), 0) + 1
    assert n.get((None, ""), 0) == n.get((None, "x"), 0) and n.get((1, None), 0) % 2 == 0
    assert mixing.mix(frame.limit(0)).count() == 0
    assert mixing.mix(frame, weights={"z": 1.0}).count() == 0


# -- pipeline


def test_stages():
    assert [name.split()[0] for name, _ in corpus_pipeline.STAGES] == ["quality", "SimHash", "PII", "mixing", "byte-level"]


def test_pipeline_equals_brute_force(spark, sf_dir):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    references = quality.language_references(frame)
    kept = []
    for d in docs:
        facts = quality.TextFacts(d["text"])
        if quality.base_fails(facts.base, quality.Rules()):
            continue
        classes, index, words = (getattr(references[d["lang"]], x) for x in ("classes", "index", "words"))
        far = len(facts.raw) >= 200 and quality.js_distance(quality.class_histogram(facts.raw), classes) > 0.315 + 0.06 * max(0, 1 - len(facts.raw) / 1_000)
        odd = facts.base[0] >= 100 and quality.js_distance(quality.common_word_histogram(facts, index), words) > 0.33 + 0.03 * max(0, 1 - facts.base[0] / 300)
        if not (far or odd):
            kept.append(d)
    component = {i: c for i, _, c in brute_classes([(d["doc_id"], d["text"]) for d in kept])}
    kept = [d | {"text": pii.masked(d["text"])} for d in kept if component[d["doc_id"]] == d["doc_id"]]
    rows = [(d["doc_id"], d["text"], d["lang"], d["source"], len(d["text"])) for d in kept]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    n = {r.doc_id: r.copies for r in mixing.copies(spark.createDataFrame(rows, columns), mixing.source_rates(spark.createDataFrame(rows, columns)), "mix-1").collect()}
    ranks = bpe.read_ranks(public_tokenizers.path(corpus_pipeline.RANK_FILE))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for d in kept:
        ids = reference.encode_ordinary(d["text"])
        digest = hashlib.sha256(d["text"].encode()).hexdigest()
        expected += [(d["doc_id"], d["source"], len(ids), np.array(ids, "<u4").tobytes(), digest)] * n[d["doc_id"]]
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.source, r.n_tokens, bytes(r.token_ids), r.decoded_sha256) for r in found) == sorted(expected)


def test_stages_of_odd_and_no_documents(spark, sf_dir):
    rows = [(1, None, None, None, None, "q", 1), (None, "", "en", "s", 0, "q", 2), (1, None, None, None, None, "q", 1)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, quality string, fp int"
    for docs in (spark.createDataFrame(rows, columns), spark.createDataFrame([], columns)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            out.collect()
            assert name.startswith("byte") or out.columns == docs.columns
