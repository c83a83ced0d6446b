"""Ranked lexical search by NRA: impact-sorted reads with score intervals and no random access.

A term is a maximal run of characters other than ASCII punctuation, controls and space, with ASCII letters
in lower case. A document's score for an item sums, over the item's terms, ``weight(term) * saturation``,
all in 64-bit integers; one addend is the *impact* of a posting. The postings of the items' terms are
written in layers of falling impact and read layer by layer: each goes on, in all lists at once, down to a
frontier impact ``x``. Within a layer, which is always read whole, the postings of a document stay together,
so that they are added up before they are shuffled. After a layer every document seen for an item has a
score interval:

* lower: the impacts read so far,
* upper: lower, and for each unseen term whose list is not read out ``min(x - 1, the term's highest impact)``.

A seen term has an impact of ``x`` or more, so its share of the item's total bound is ``x - 1`` exactly:
the interval needs the number of seen terms only, by the layer in which their lists end (packed into one
long; where items have so many terms that the layers do not fit, later ones share a place, which widens
intervals before the last layer). The 50th best lower end (ties by document id) is an item's threshold. Documents that cannot reach it leave; when the bound of a
document not seen so far cannot either, the item is closed and only its candidates are read on; when all
candidates have intervals of one point, it is resolved and read no more. Reading goes on until every
item is resolved or the lists end, so membership, ties and scores are exact.

The state of a search is a table of (item, document) intervals in the shared folder; per layer the driver
sees one count. A frequent term's postings are spread over tasks by document. The threshold
is taken in two steps of bounded groups. The items' terms are sent to the tasks that read documents while
they have at most ``VOCABULARY_BYTES``, and joined with all terms beyond that.

Defined cases: NULL and empty texts, and texts without a term, are no documents and match nothing; an item
without a term has no results. Every row of the documents and of the items counts: repeated rows are
ranked (or answered) each. Equal scores go by document id, NULL ids last, then by row. An empty table on
either side gives no rows. Only ``doc_id`` and ``item_id`` and the texts are read; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrina.llm.common import discard, fresh_path, short_batches, stored

TOP = 50
VOCABULARY_BYTES = 8 << 20
#: Shares of all postings that have been read after each layer.
LAYERS = (1 / 27, 1 / 9, 1 / 3, 1.0)
#: Candidates of closed items that are sent to the tasks to pick their postings, at some 50 bytes each.
CANDIDATES_SENT = 500_000
#: Partitions whose best documents meet in the first step of taking a threshold.
TOGETHER = 256

_SEPARATORS = {*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}
_FOLD = bytes(0x20 if b in _SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms_of(text: str) -> list[str]:
    """All terms of a text, in order."""
    return [t.decode() for t in text.encode().translate(_FOLD).split(b" ") if t]


def term_counts(texts: DataFrame, key: str, wanted: frozenset[str] | None = None) -> DataFrame:
    """``(row, key, n, terms, counts)`` per row of ``texts(key, text)``: the number of all its terms, and its
    distinct terms (those in ``wanted`` only, if given) with how often they occur. Rows without a term are
    left out."""
    spark = texts.sparkSession
    short_batches(spark)
    shipped = spark.sparkContext.broadcast(None if wanted is None else frozenset(t.encode() for t in wanted))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shipped.value
        for batch in batches:
            out = []
            for row, name, text in zip(batch["row"].tolist(), batch[key], batch["text"]):
                found = Counter(filter(None, text.encode().translate(_FOLD).split(b" ")))
                if not found:
                    continue
                kept = found if known is None else {t: c for t, c in found.items() if t in known}
                out.append((row, name, found.total(), [t.decode() for t in kept], list(kept.values())))
            yield pd.DataFrame(out, columns=["row", key, "n", "terms", "counts"])

    # Ids travel as text where pandas would turn a column with NULLs into floats.
    read = texts.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("string"), F.coalesce("text", F.lit("")).alias("text")
    )
    made = read.mapInPandas(count, f"row long, `{key}` string, n long, terms array<string>, counts array<long>")
    return made.withColumn(key, F.col(key).cast(texts.schema[key].dataType))


def vocabulary(item_terms: DataFrame) -> frozenset[str] | None:
    """The items' distinct terms, or None where they exceed ``VOCABULARY_BYTES``."""
    distinct = item_terms.select("term").distinct()
    size = distinct.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    return frozenset(r.term for r in distinct.collect()) if size <= VOCABULARY_BYTES else None


def impact_index(counted: DataFrame, item_terms: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """``(postings, terms, frontiers)``: the stored postings ``(layer, tid, impact, row, doc_id)``, a folder per layer;
    ``(term, tid, high, low)`` with the highest and lowest impact of each item term that a document has; and
    the impacts down to which the layers read."""
    spark = counted.sparkSession
    total = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
    docs, length = F.lit(total.docs).cast("long"), F.lit(total.length or 1).cast("long")
    each = (
        counted.withColumns({"docs": docs, "length": length})
        .withColumn("m", F.expr("50L + div(50L * n * docs, length)"))
        .select("row", "doc_id", "m", F.explode(F.arrays_zip("terms", "counts")).alias("p"))
        .select(
            "row",
            "doc_id",
            F.col("p.terms").alias("term"),
            F.expr("div(1000000000L * p.counts, 1000L * p.counts + 20L * m)").alias("saturation"),
        )
    )
    each = each.join(item_terms.select("term").distinct(), "term", "left_semi")
    weight = F.floor(1000 * F.log((F.lit(2.0) * docs + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    terms, _ = stored(
        each.groupBy("term")
        .agg(F.count("*").alias("df"), F.max("saturation").alias("most"), F.min("saturation").alias("least"))
        .withColumn("weight", weight)
        .select(
            "term",
            "weight",
            F.monotonically_increasing_id().alias("tid"),
            (F.col("weight") * F.col("most")).alias("high"),
            (F.col("weight") * F.col("least")).alias("low"),
        ),
        "terms",
    )
    postings = (
        each.join(terms.select("term", "tid", "weight"), "term")
        .select("tid", (F.col("weight") * F.col("saturation")).alias("impact"), "row", "doc_id")
        .filter("impact > 0")
    )
    cuts = frontiers(postings)
    layer = F.coalesce(*(F.when(F.col("impact") >= x, F.lit(r)) for r, x in enumerate(cuts)))
    path = fresh_path(spark, "postings")
    postings.withColumn("layer", layer).sortWithinPartitions("layer", "row").write.partitionBy("layer").parquet(path)
    schema = postings.withColumn("layer", layer).schema
    return spark.read.schema(schema).parquet(path), terms.select("term", "tid", "high", "low"), cuts


def frontiers(postings: DataFrame) -> list[int]:
    """The impacts down to which the layers read, highest first; the last is 1. A histogram of a few
    hundred classes reaches the driver."""
    classes = (
        postings.groupBy(F.floor(F.log2("impact") * 16).alias("class"))
        .agg(F.count("*").alias("n"), F.min("impact").alias("low"))
        .orderBy(F.desc("class"))
        .collect()
    )
    total, seen, cuts = sum(r.n for r in classes), 0, []
    for r in classes:
        seen += r.n
        while len(cuts) < len(LAYERS) - 1 and seen >= LAYERS[len(cuts)] * total:
            cuts.append(r.low)
    return sorted({*cuts, 1}, reverse=True)


def _order(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}doc_id").isNull(), F.col(f"{prefix}doc_id"), F.col(f"{prefix}row"))


def _best(state: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each item by lower end, then document, with their ``rank``. Each partition gives
    its own ``top`` per item, ``TOGETHER`` partitions theirs, and all the last."""
    by = (F.desc("lower"), _order())
    grouped = state.withColumn("together", F.floor(F.spark_partition_id() / TOGETHER))
    first = F.row_number().over(Window.partitionBy("item", "together").orderBy(*by))
    some = grouped.withColumn("rank", first).filter(F.col("rank") <= top).drop("together", "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).filter(F.col("rank") <= top)


class Search:
    """NRA over stored postings. ``item_terms`` is ``(item, tid, high, low)``."""

    def __init__(self, postings: DataFrame, item_terms: DataFrame, cuts: list[int], top: int) -> None:
        self.postings, self.cuts, self.top = postings, cuts, top
        self.paths: list[str] = []  # of the candidates of the last layers
        most = item_terms.groupBy("item").count().agg(F.max("count")).first()[0] or 1
        self.bits = most.bit_length()
        #: Places for the numbers of seen terms: that of a list is the layer that ends it.
        self.places = min(len(cuts), 62 // self.bits)
        ends = F.coalesce(*(F.when(F.col("low") >= x, F.lit(r)) for r, x in enumerate(cuts)))
        ends = F.when(ends < self.places - 1, ends).otherwise(F.lit(len(cuts) - 1))
        self.item_terms, _ = stored(item_terms.withColumn("ends", ends), "item-terms")

    def bounds(self, r: int) -> DataFrame:
        """``(item, bound)``: the most that a document not seen after layer ``r`` can score."""
        rest = F.when(F.col("ends") <= r, F.lit(0)).otherwise(F.least(F.lit(self.cuts[r] - 1).cast("long"), "high"))
        return self.item_terms.groupBy("item").agg(F.sum(rest).alias("bound"))

    def place(self, ends: Column) -> Column:
        return F.least(ends, F.lit(self.places - 1))

    def upper(self, r: int) -> Column:
        """The upper end after layer ``r``: seen terms whose lists go on are taken off the bound."""
        if r == len(self.cuts) - 1:
            return F.col("lower")
        mask = (1 << self.bits) - 1
        held = [p for p in range(self.places) if p > r or p == self.places - 1]
        seen = sum((F.shiftrightunsigned("seen", self.bits * p).bitwiseAND(F.lit(mask).cast("long")) for p in held), F.lit(0).cast("long"))
        return F.col("lower") + F.col("bound") - seen * (self.cuts[r] - 1)

    def layer(self, r: int, state: DataFrame | None, status: DataFrame | None) -> DataFrame:
        """Impacts of layer ``r`` as ``(item, row, doc_id, impact, ends)``, for documents that still matter."""
        read = self.postings.filter(F.col("layer") == r).drop("layer")
        terms = self.item_terms.select("item", "tid", "ends")
        if status is None:
            return read.join(terms, "tid").select("item", "row", "doc_id", "impact", "ends")
        # Semi-joins keep the items' few terms small in the planner's eyes, and the postings unshuffled.
        hits = [
            read.join(terms.join(status.filter(kind), "item", "left_semi"), "tid").select("item", "row", "doc_id", "impact", "ends")
            for kind in ("NOT closed", "closed AND NOT resolved")
        ]
        few, _ = stored(state.join(status.filter("closed AND NOT resolved"), "item", "left_semi").select("item", "row"), "closed")
        if few.count() <= CANDIDATES_SENT:
            hits[1] = hits[1].join(F.broadcast(few), ["item", "row"], "left_semi")
        return hits[0].unionByName(hits[1])  # others that are no candidates leave once they are added up

    def advance(self, r: int, state: DataFrame | None, status: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Candidates and item status after layer ``r``."""
        one = F.call_function("shiftleft", F.lit(1).cast("long"), self.place(F.col("ends")) * self.bits)
        read = self.layer(r, state, status).select("item", "row", "doc_id", F.col("impact").alias("lower"), one.alias("seen"))
        both = read.withColumn("known", F.lit(0))
        if state is not None:
            both = both.unionByName(state.select(*read.columns, F.lit(1).alias("known")))
        sums = [F.max("doc_id").alias("doc_id"), F.sum("lower").alias("lower"), F.sum("seen").alias("seen"), F.max("known").alias("known")]
        together = both.groupBy("item", "row").agg(*sums)
        if status is not None:
            shut = status.filter("closed").select("item", F.lit(1).alias("shut"))
            together = together.join(shut, "item", "left").filter("shut IS NULL OR known = 1").drop("shut")
        met, met_path = stored(together.drop("known"), "intervals")
        last = _best(met.select("item", "row", "doc_id", "lower"), self.top).filter(F.col("rank") == self.top)
        mark = last.select("item", F.col("lower").alias("mark"), F.col("doc_id").alias("mark_doc_id"), F.col("row").alias("mark_row"))
        marks, _ = stored(self.bounds(r).join(mark, "item", "left"), "marks")
        ahead = (F.col("upper") > F.col("mark")) | ((F.col("upper") == F.col("mark")) & (_order() <= _order("mark_")))
        kept, kept_path = stored(
            met.join(marks, "item").withColumn("upper", self.upper(r)).filter(F.col("mark").isNull() | ahead).select(*met.columns, "upper"),
            "candidates",
        )
        exact = kept.groupBy("item").agg(F.bool_and(F.col("upper") == F.col("lower")).alias("exact"))
        closed = (F.col("bound") == 0) | F.coalesce(F.col("bound") < F.col("mark"), F.lit(False))
        after, _ = stored(
            marks.join(exact, "item", "left").select("item", closed.alias("closed"), (closed & F.coalesce("exact", F.lit(True))).alias("resolved")),
            "status",
        )
        discard(met.sparkSession, met_path)
        self.paths.append(kept_path)
        return kept, after

    def run(self) -> DataFrame:
        """``(item, row, doc_id, lower, rank)`` of the best documents of every item."""
        state = status = None
        for r in range(len(self.cuts)):
            before = state
            state, status = self.advance(r, state, status)
            if before is not None:
                discard(before.sparkSession, self.paths.pop(0))
            if status.filter("NOT resolved").count() == 0:
                break
        return _best(state.select("item", "row", "doc_id", "lower"), self.top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of ``docs(doc_id, text)`` with the highest
    score above 0 for each row of ``items(item_id, text)``; all, where fewer match."""
    asked, _ = stored(term_counts(items.select("item_id", "text"), "item_id"), "items")
    item_terms = asked.select(F.col("row").alias("item"), F.explode("terms").alias("term"))
    counted, _ = stored(term_counts(docs.select("doc_id", "text"), "doc_id", vocabulary(item_terms)), "term-counts")
    postings, terms, cuts = impact_index(counted, item_terms)
    found = Search(postings, item_terms.join(terms, "term").drop("term"), cuts, top).run()
    names = asked.select(F.col("row").alias("item"), "item_id")
    return found.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", F.col("lower").alias("score"))
