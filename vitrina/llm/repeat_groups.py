"""Maximal repeats of a corpus with all their occurrences, as rows ``(group_id, doc_id, start, n_bytes)``.

A repeat is a byte string of ``length`` bytes or more that occurs twice, in one document or several. It is maximal
where neither all its occurrences are preceded by one same byte nor all followed by one; the ends of a document
are unlike anything. It is found from an anchor (``suffix_dedup``) within its first ``length`` bytes, which
all its occurrences hold at the same place:

1. The anchors of one hash form a suffix array; the stack scans of its common-prefix tree give the groups
   that agree on ``left`` bytes before and ``right`` bytes after the anchor. Those with ``left`` over
   ``length - gram`` have an earlier anchor and are left to it, so a long repeat is followed from few anchors.
2. Contexts reach a bounded number of bytes to the right. Groups that agree on all of them are not given out
   but followed: their members form a new suffix array with a context four times as long, round by round
   until none is left.
3. A scan sees distinct contexts, never places. Places meet the groups of their context in a join, which
   adaptive execution splits where many places share a context.
4. Equal documents take part once; their copies get the occurrences at the end, and a text with copies is
   itself a repeat.

Anchors of a hash with over ``hot`` occurrences are told apart by the ``length``-byte window in which a repeat
would start, and of what is before that window one byte is kept. What one task sorts are the distinct contexts of
one hash, or of one such window; it holds them, so a passage in very many *different* surroundings of up to
``reach`` bytes is the most that a task has to hold.

The result can be much larger than the corpus: repeats nest, and a text of one byte ``n`` times has all its
runs as repeats. ``group_id`` is the SHA-256 of the string in lowercase hex; starts and lengths count UTF-8 bytes.
NULL texts are empty. Every row of ``docs`` counts as a document, rows of equal ids and texts too; NULL ids stay
NULL. Empty tables and texts shorter than ``length`` give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import discard, short_batches, stored, text_bytes
from vitrina.llm.suffix_dedup import GRAM, HOT, KEY, LENGTH, anchor_rows, maximal_repeats, packed, unpacked

#: How far contexts reach in the first round, in lengths; each round reaches ``GROWTH`` times as far.
FIRST_REACH, GROWTH = 2, 4
#: Bytes of contexts that a worker gathers before it hands them on.
GATHERED = 16 << 20
ANY, SPLIT = -1, -2
PLACE = "doc_order long, tag long, at int"


def context_rows(texts: DataFrame, entries: DataFrame, length: int, gram: int, reach: int) -> DataFrame:
    """``(node, exact, doc_order, tag, at, left, right, context)`` of entries ``(node, exact, doc_order, tag, at)``: the
    bytes before an anchor (reversed) and from it on. An entry to be split becomes one per window through
    its anchor, ``exact`` bytes of which lie before it."""
    by_text = entries.groupBy(*KEY).agg(F.collect_list(F.struct("node", "exact", "at")).alias("entries"))
    met = texts.join(by_text, KEY).select(*KEY, "packed", "entries")
    columns = ["node", "exact", *KEY, "at", "left", "right", "context"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for batch in batches:
            for order, tag, raw, found in zip(batch["doc_order"].tolist(), batch["tag"].tolist(), map(unpacked, batch["packed"]), batch["entries"]):
                for e in found:
                    at, node, exact = e["at"], bytes(e["node"]), e["exact"]
                    left, right = raw[max(0, at - (length - gram + 1)) : at][::-1], raw[at : at + reach]
                    rows = [(node, exact, left)]
                    if exact == SPLIT:
                        starts = range(max(0, length - len(right)), min(len(left), length - gram) + 1)
                        rows = [
                            (hashlib.md5(b"%d:" % s + left[:s] + right[: length - s]).digest(), s, left[: s + 1]) for s in starts
                        ]
                    elif exact != ANY:
                        rows = [(node, exact, left[: exact + 1])]
                    for n, s, before in rows:
                        context = hashlib.md5(n + b"%d:" % len(before) + before + right).digest()
                        out.append((n, s, order, tag, at, before, right, context))
                        size += len(before) + len(right) + 64
                    if size >= GATHERED:
                        yield pd.DataFrame(out, columns=columns)
                        out, size = [], 0
        yield pd.DataFrame(out, columns=columns)

    return met.mapInPandas(cut, f"node binary, exact int, {PLACE}, left binary, right binary, context binary")


def tree_groups(contexts: DataFrame, length: int, gram: int, reach: int) -> DataFrame:
    """``(group, node, exact, context, left, n_bytes)``: the contexts of every group whose repeat ends within reach
    (``group`` is set), and those that are followed further (``node`` is set)."""
    distinct = contexts.groupBy("context").agg(
        F.min(F.struct("node", "exact", "left", "right")).alias("c"), (F.count("*") > 1).alias("several")
    )
    columns = ["group", "node", "exact", "context", "left", "n_bytes"]

    def groups(node: bytes, exact: int, held: list[tuple[bytes, bytes, bytes]]) -> Iterator[tuple]:
        if len(held) < 2:
            return
        lefts, rights = [h[0] for h in held], [h[1] for h in held]
        followed = set()
        for left, right, members in maximal_repeats(lefts, rights, length):
            if left > length - gram or (exact != ANY and left != exact):
                continue
            one = members[0]
            if right == reach:
                followed.add(rights[one])
                continue
            group = hashlib.sha256(lefts[one][:left][::-1] + rights[one][:right]).digest()
            for context in {held[m][2] for m in members}:
                yield group, None, exact, context, left, left + right
        for right, context in {(right, context) for _, right, context in held if right in followed}:
            yield None, hashlib.md5(node + right).digest(), exact, context, 0, 0

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for batch in batches:
            out = []
            for node, exact, left, right, context, several in zip(*(batch[c].tolist() for c in ("node", "exact", "left", "right", "context", "several"))):
                if (node, exact) != key:
                    out += groups(*key, held) if key else ()
                    key, held = (node, exact), []
                held += [(left, right, context)] * (1 + several)  # two places stand for several
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame([*groups(*key, held)] if key else [], columns=columns)

    placed = distinct.select("c.*", "context", "several").repartition("node").sortWithinPartitions("node", "exact", "right")
    return placed.mapInPandas(scan, "group binary, node binary, exact int, context binary, left int, n_bytes int")


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``(group_id, doc_id, start, n_bytes)``: every occurrence of every maximal repeat of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    short_batches(spark)
    raw = text_bytes(F.col("text"))
    digest = F.sha2(raw, 256)
    order = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    narrow = docs.select("doc_id", F.octet_length(raw).alias("size"), order.alias("doc_order"), digest.alias("digest"))
    firsts = narrow.groupBy("digest").agg(F.min("doc_order").alias("doc_order"), F.max("size").alias("size"), F.count("*").alias("copies"))
    firsts = firsts.filter(F.col("size") >= length).withColumn("tag", F.xxhash64("digest"))
    keyed = docs.select(order.alias("doc_order"), F.xxhash64(digest).alias("tag"), packed(raw).alias("packed"))
    texts, texts_path = stored(keyed.join(firsts, KEY, "left_semi").dropDuplicates(KEY), "repeat-texts")

    found, found_path = stored(anchor_rows(texts, length, gram), "repeat-anchors")
    found = found.distinct()
    counts = found.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
    entries = found.join(counts, "hash").select(
        F.col("hash").cast("string").cast("binary").alias("node"),
        F.when(F.col("n") > hot, F.lit(SPLIT)).otherwise(F.lit(ANY)).alias("exact"),
        *KEY,
        "at",
    )
    reach, parts, paths = FIRST_REACH * length, [], []
    while True:
        contexts, contexts_path = stored(context_rows(texts, entries, length, gram, reach), "repeat-contexts")
        groups, groups_path = stored(tree_groups(contexts, length, gram, reach), "repeat-trees")
        places = contexts.select(*KEY, "at", "context")
        members = groups.filter(F.col("group").isNotNull()).select("group", "context", "left", "n_bytes")
        here = places.join(members, "context").select("group", *KEY, (F.col("at") - F.col("left")).alias("start"), "n_bytes")
        parts.append(stored(here.distinct(), "repeat-places")[0])
        more = groups.filter(F.col("node").isNotNull()).select("node", "exact", "context")
        ended = more.isEmpty()
        if not ended:
            entries, entries_path = stored(places.join(more, "context").select("node", "exact", *KEY, "at"), "repeat-open")
            paths.append(entries_path)
        discard(spark, contexts_path)
        discard(spark, groups_path)
        if ended:
            break
        reach *= GROWTH
    for path in (found_path, texts_path, *paths):
        discard(spark, path)

    # Of several anchors near its start, each has given out the repeat.
    occurrences = parts[0]
    for part in parts[1:]:
        occurrences = occurrences.unionByName(part)
    inside = occurrences.join(firsts.select("digest", *KEY), KEY).select("group", "digest", "start", "n_bytes")
    whole = firsts.filter("copies > 1").select(F.unhex("digest").alias("group"), "digest", F.lit(0).alias("start"), F.col("size").alias("n_bytes"))
    of_texts = inside.unionByName(whole).distinct()
    return of_texts.join(narrow.select("doc_id", "digest"), "digest").select(
        F.lower(F.hex("group")).alias("group_id"), "doc_id", F.col("start").cast("long").alias("start"), F.col("n_bytes").cast("long").alias("n_bytes")
    )
