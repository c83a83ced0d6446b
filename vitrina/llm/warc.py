"""WARC archives: writing pages as gzip members, and a splittable reader.

Every record is a gzip member of its own. The reader deals byte ranges of the archives to tasks. A task
scans its range for the gzip magic, takes each hit as a candidate and validates it by inflating the
start and decoding the record header (compressed bytes may hold the magic by chance), and owns the
records that start inside its range, reading past its end to finish the last. Between two records it
goes on at the end of the member it has just read, so it scans only to find its first.

Archives are written by the tasks into the shared folder, under a name of each attempt's own; the table
of names that a successful job leaves is what is read, so lost executors and repeated attempts leave no
double records. Only the payload of one record is held at a time.

Defined cases: a NULL payload is empty. Of rows with equal payloads of at least ``revisit_bytes`` bytes
the one with the smallest page id is the response and the others are revisits; a row without an id is a
response, and so is a repeated row of the smallest id. Line breaks and control characters in URLs are
percent-encoded; a NULL URL leaves the header out and reads back as NULL. Empty tables give no archive
and no records. Extra columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.llm.common import fresh_path, short_batches, stored, text_bytes

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 16 << 20
CHUNK, BUFFER = 16 << 10, 1 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = (
    "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, "
    "payload binary, archive string, offset long"
)


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{bare_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def with_records(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """``(page_id, url, payload, refers_to, revisit)`` of ``pages(page_id, url, html)``."""
    rows = pages.select("page_id", "url", text_bytes(F.col("html")).alias("payload")).withColumn("digest", F.sha1("payload"))
    firsts = (
        rows.filter(F.octet_length("payload") >= revisit_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "first")
    )
    revisit = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False))
    return rows.join(firsts, "digest", "left").select(
        "page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit")
    )


def write_archives(pages: DataFrame, folder: str | None = None, revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` and return ``(archive, bytes, records)``; each task writes one archive."""
    spark = pages.sparkSession
    short_batches(spark)
    folder = folder or fresh_path(spark, "warc")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = name = None
        size = count = 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    store, base = pyarrow.fs.FileSystem.from_uri(folder)
                    store.create_dir(base, recursive=True)
                    file = f"part-{uuid.uuid4().hex}.warc.gz"
                    name, out = f"{folder}/{file}", store.open_output_stream(f"{base}/{file}", compression=None)
                ids = [None if pd.isna(x) else int(x) for x in (row.page_id, row.refers_to)]
                member = record(ids[0], row.url, row.payload, ids[1], row.revisit)
                out.write(member)
                size, count = size + len(member), count + 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"archive": [name], "bytes": [size], "records": [count]})

    made, _ = stored(with_records(pages, revisit_bytes).mapInPandas(write, "archive string, bytes long, records long"), "warc-names")
    return made


class Window:
    """Bytes of a file by offset, through one buffer."""

    def __init__(self, file) -> None:
        self.file, self.start, self.held = file, 0, b""

    def read(self, at: int, size: int) -> bytes:
        """Up to ``size`` bytes from ``at``; fewer only at the end of the file."""
        if not self.start <= at or at + size > self.start + len(self.held):
            self.file.seek(at)
            self.start, self.held = at, self.file.read(max(size, BUFFER))
        return self.held[at - self.start : at - self.start + size]


class Member:
    """Inflates one gzip member out of a file, a chunk at a time."""

    def __init__(self, window: Window, start: int) -> None:
        self.window, self.at = window, start
        self.zip, self.failed = zlib.decompressobj(31), False
        self.out = bytearray()

    def pull(self) -> bool:
        """Inflate one more chunk; False at the member's end or when it is none."""
        if self.failed or self.zip.eof:
            return False
        chunk = self.window.read(self.at, CHUNK)
        try:
            self.out += self.zip.decompress(chunk)
        except zlib.error:
            self.failed = True
            return False
        self.at += len(chunk)
        if not chunk:
            self.failed = True  # cut off
        return bool(chunk)

    @property
    def end(self) -> int:
        return self.at - len(self.zip.unused_data)


def read_header(member: Member) -> dict[str, str] | None:
    """The record header, or None when the candidate is no record."""
    while (end := member.out.find(b"\r\n\r\n")) < 0:
        if len(member.out) >= 5 and member.out[:5] != b"WARC/" or not member.pull():
            break
    end = member.out.find(b"\r\n\r\n")
    if end < 0 or member.out[:5] != b"WARC/":
        return None
    lines = member.out[:end].decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    if not {"warc-type", "content-length"} <= fields.keys() or not fields["content-length"].isdigit():
        return None
    fields["header-bytes"] = str(end + 4)
    return fields


def find_magic(window: Window, start: int, end: int) -> int:
    """Offset of the first gzip magic that starts in ``[start, end)``, or -1."""
    at = start
    while at < end:
        chunk = window.read(at, min(CHUNK, end - at) + len(MAGIC) - 1)
        hit = chunk.find(MAGIC)
        if hit >= 0:
            return at + hit
        at += CHUNK
    return -1


def records_in(window: Window, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``(offset, header, block)`` of the records that start in ``[start, end)``."""
    at = start
    while (at := find_magic(window, at, end)) >= 0:
        member = Member(window, at)
        header = read_header(member)
        if header is not None:
            while member.pull():
                pass
        if header is None or not member.zip.eof:
            at += 1
            continue
        body = int(header["header-bytes"])
        yield at, header, bytes(member.out[body : body + int(header["content-length"])])
        at = member.end


def page_of(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def parsed(header: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next((x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"0")
    kind = header["warc-type"]
    digest = header.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and bare_digest(payload) != digest:
        raise ValueError(f"payload of {header.get('warc-record-id')} does not match its digest")
    return (
        page_of(header.get("warc-record-id")),
        header.get("warc-target-uri"),
        kind,
        digest,
        int(stated),
        page_of(header.get("warc-refers-to")),
        payload if kind == "response" else None,
    )


def read_archives(spark: SparkSession, archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of ``archives(archive, bytes)``: every file is cut into ranges of ``split_bytes``."""
    last = F.greatest(F.ceil(F.col("bytes") / split_bytes) - 1, F.lit(0)).cast("long")
    ranges = archives.select("archive", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("split")).select(
        "archive", (F.col("split") * split_bytes).alias("start"), ((F.col("split") + 1) * split_bytes).alias("stop")
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for batch in batches:
            for part in batch.itertuples(index=False):
                store, path = pyarrow.fs.FileSystem.from_uri(part.archive)
                with store.open_input_file(path) as file:
                    rows, held = [], 0
                    for offset, header, block in records_in(Window(file), part.start, part.stop):
                        rows.append((*parsed(header, block), part.archive, offset))
                        held += len(block)
                        if held > 16 << 20 or len(rows) >= 2_000:
                            yield frame(rows, names)
                            rows, held = [], 0
                    yield frame(rows, names)

    def frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=names)
        return made.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64", "offset": "int64"})

    # A stated number of partitions: the ranges are few bytes, and adaptive merging would give all of
    # them to one task.
    tasks = max(1, ranges.count())
    return ranges.repartition(tasks, "archive", "start").mapInPandas(read, RECORDS)
