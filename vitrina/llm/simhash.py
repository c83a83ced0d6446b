"""SimHash fingerprints and near-duplicate classes by a segment-popcount grid.

A fingerprint is cut into 16 segments of 4 bits and mapped to the 16 bit counts. The Manhattan
distance of two such vectors is at most the Hamming distance of the fingerprints, so partners within
2 bits lie within 2 in the grid. Each distinct fingerprint is entered in its own cell and in the
cells one step away: any two within 2 share a cell, and a cell of four segments' worth of bits holds
few others. Inside a cell pairs are verified on the bits. Only one link per fingerprint and cell
leaves it (to the first of its class there), which keeps all classes and no pair list.

Cells are read as sorted runs. A cell of up to ``SMALL_CELL`` fingerprints is compared in full; a
larger one (only very large groups of near copies do that) is linked through the values one bit
away from its members, exactly and in linear time, a slice of those values at a time.

Defined cases: NULL and empty texts, and texts of white space, have fingerprint zero and are linked
with each other like any others. Texts of fewer words than a shingle are one shingle. Equal texts
share a fingerprint. A class whose documents all have a NULL id has a NULL class id; otherwise NULL
ids are ignored in the minimum. Repeated rows stay repeated. Extra columns pass through
``fingerprints``; ``classes`` reads ``doc_id`` and ``text`` only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from vitrina.llm.common import fresh_name, short_batches, stored
from vitrina.llm.components import connected_components

SEGMENTS, SEGMENT_BITS = 16, 4
SHINGLE_WORDS, SEED = 3, 42
SMALL_CELL = 1024


def shingle_hashes(raw: bytes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of all word shingles, repeats included; ASCII case is folded. None for a text without words."""
    words = raw.lower().split()  # bytes: only ASCII letters and white space are meant
    if not words:
        return np.zeros(0, np.uint64)
    return np.fromiter(
        (xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(width)))))
        if len(words) >= width
        else [xxh64_intdigest(b" ".join(words), SEED)],
        np.uint64,
        max(1, len(words) - width + 1),
    )


def majority(hashes: np.ndarray) -> int:
    """Bit-wise majority: over half, ties 0."""
    n = hashes.size
    ones = np.zeros(64, np.int64)
    for start in range(0, n, 65_536):
        part = hashes[start : start + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint_of(raw: bytes, width: int = SHINGLE_WORDS) -> int:
    """Bit-wise majority of the XXH64 of all word shingles; zero for a text without words."""
    return majority(shingle_hashes(raw, width))


def fingerprint(text: Column) -> Column:
    """The 64-bit fingerprint as a signed long."""

    @F.pandas_udf("long")
    def digest(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(x.encode()) for x in texts], np.uint64).view(np.int64))

    return digest(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, out: str = "fingerprint") -> DataFrame:
    return docs.withColumn(out, fingerprint(F.col("text")))


def cells(distinct: DataFrame) -> DataFrame:
    """``(cell, fp)``: each fingerprint in its own grid cell and in those one step away. A cell is
    the 16 counts, plus one, at 3 bits each."""

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit = np.int64(1) << (3 * np.arange(SEGMENTS, dtype=np.int64))
        steps = np.concatenate([[0], unit, -unit])
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64)
            nibbles = (fp.view(np.uint64)[:, None] >> np.arange(0, 64, SEGMENT_BITS, dtype=np.uint64)) & np.uint64(15)
            own = ((np.bitwise_count(nibbles).astype(np.int64) + 1) * unit).sum(axis=1)
            for start in range(0, fp.size, 10_000):
                part = own[start : start + 10_000]
                yield pd.DataFrame(
                    {"cell": (part[:, None] + steps).ravel(), "fp": np.repeat(fp[start : start + 10_000], steps.size)}
                )

    return distinct.mapInPandas(enter, "cell long, fp long")


def _small_links(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Each member of a small cell with the first member of its class in the cell."""
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= distance
    root = np.arange(fp.size)
    while True:  # minimum over neighbours until nothing moves
        low = np.where(near, root[None, :], fp.size).min(axis=1)
        if (low == root).all():
            break
        root = low
    moved = np.flatnonzero(root != np.arange(fp.size))
    return fp[moved], fp[root[moved]]


def _large_links(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a large cell: two fingerprints are within 2 bits just when some value is within one
    bit of both. Values are taken by their low bits, so that few are held at a time."""
    one = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    parts = 1 << max(0, int(fp.size * 65 // 2_000_000)).bit_length()
    mix = np.uint64(0x9E3779B97F4A7C15)
    for part in range(parts):
        values, owners = [], []
        for start in range(0, fp.size, 20_000):
            near = (fp[start : start + 20_000, None] ^ one).ravel()
            mine = ((near * mix) >> np.uint64(40)) % np.uint64(parts) == part
            values.append(near[mine])
            owners.append((start + np.flatnonzero(mine) // one.size))
        values, owners = np.concatenate(values), np.concatenate(owners)
        order = np.lexsort((owners, values))
        values, owners = values[order], owners[order]
        first = np.ones(values.size, bool)
        np.not_equal(values[1:], values[:-1], out=first[1:])
        head = owners[np.flatnonzero(first)[np.cumsum(first) - 1]]
        moved = np.unique(np.stack([owners, head], axis=1)[owners != head], axis=0)
        yield fp[moved[:, 0]], fp[moved[:, 1]]


def cell_links(sorted_cells: DataFrame, distance: int) -> DataFrame:
    """``(a, b)`` links out of partitions that are sorted by cell; a cell is never cut by a batch."""

    def whole_cells(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held_cell, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            cell = np.concatenate([held_cell, batch["cell"].to_numpy()])
            fp = np.concatenate([held_fp, batch["fp"].to_numpy()])
            if not cell.size:
                continue
            cut = int(np.searchsorted(cell, cell[-1]))
            yield cell[:cut], fp[:cut]
            held_cell, held_fp = cell[cut:], fp[cut:]
        yield held_cell, held_fp

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell, fp in whole_cells(batches):
            fp = fp.view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if cell.size else np.zeros(0, int)
            sizes = np.diff(np.append(starts, cell.size))
            a, b = [], []
            two = starts[sizes == 2]
            close = np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance if two.size else np.zeros(0, bool)
            a.append(fp[two[close] + 1] if two.size else fp[:0])
            b.append(fp[two[close]] if two.size else fp[:0])
            for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                members = fp[start : start + size]
                for x, y in [_small_links(members, distance)] if size <= SMALL_CELL else _large_links(members):
                    a.append(x)
                    b.append(y)
            yield pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)}).drop_duplicates()

    return sorted_cells.mapInPandas(link, "a long, b long")


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints of ``distinct(fp)`` within 2 bits of each other."""
    entered = cells(distinct)
    return cell_links(entered.repartition("cell").sortWithinPartitions("cell", "fp"), 2)


def classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row of ``docs(doc_id, text)``: the smallest document id that
    links within 2 bits reach."""
    short_batches(docs.sparkSession)
    marked, _ = stored(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "fingerprints")
    firsts = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(fingerprint_links(firsts.select("fp"))).select(F.col("node").alias("fp"), "root")
    rooted = firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marked.join(rooted.join(lowest, "root").select("fp", "component_id"), "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class: that of the smallest id (a NULL id comes last, then the
    text decides). Of repeated rows one stays."""
    short_batches(docs.sparkSession)
    fp, text_hash = fresh_name(docs, "fp"), fresh_name(docs, "text_hash")
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    marked, _ = stored(
        docs.select("doc_id", hashed.alias("text_hash"), fingerprint(F.col("text")).alias("fp")), "fingerprints"
    )
    entry = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    firsts = marked.groupBy("fp").agg(F.min(entry).alias("entry"))
    roots = connected_components(fingerprint_links(firsts.select("fp"))).select(F.col("node").alias("fp"), "root")
    rooted = firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    chosen = rooted.groupBy("root").agg(F.min("entry").alias("entry")).select(
        F.col("entry.doc_id").alias(fp), F.col("entry.text_hash").alias(text_hash)
    )
    hashed_docs = docs.withColumn(text_hash, hashed)
    same = hashed_docs["doc_id"].eqNullSafe(chosen[fp]) & (hashed_docs[text_hash] == chosen[text_hash])
    return hashed_docs.join(chosen, same, "left_semi").dropDuplicates(["doc_id", text_hash]).drop(text_hash)
