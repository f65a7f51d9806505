"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: equal payloads (SHA-1) are found by an aggregate; the largest page of each group is a
response record, the others revisit it. Every task fits a dictionary on a bounded sample of its
first records, then writes archives of bounded size into the shared folder. An archive is
written under a temporary name and renamed when it is whole; its name is of that attempt alone,
and the manifest, which only attempts that succeed write, lists the archives that count.

Reading: the manifest's archives are dealt to tasks, and files beside them are never read. A task
loads the dictionary from the leading skippable frame, then decodes frame after frame; a frame
must hold exactly one record, with the version line, the mandatory headers, and a block of the
stated length. A breach, a missing archive or another number of records than the manifest's
raises ``WarcError``.

Defined cases: null payloads are empty, null URLs are written as an empty target; pages with a
null page_id take part (a null is the smallest id); of pages that repeat one page_id and payload
one is the response, and the others refer to that id; no rows give no archives and no records;
other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm import arrays, scratch

#: Fixed values of the formats.
SKIPPABLE_DICTIONARY = 0x184D2A5D
VERSION = b"WARC/1.1\r\n"
MANDATORY = (b"warc-type", b"warc-record-id", b"warc-date", b"content-length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of an archive that a frame's decompressor is given first.
FIRST_FED = 1 << 12
ARCHIVE_BYTES = 6 << 20  # compressed
SAMPLE_RECORDS = 200
SAMPLE_BYTES = 64 << 10  # of each sampled record
DICTIONARY_BYTES = 32 << 10
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive or a record that breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, sha1: str, refers_to: int | None, kind: str) -> bytes:
    """One uncompressed record."""
    block = payload if kind == "response" else b""
    name = lambda i: f"<urn:orderloom:page:{'null' if i is None else i}>"
    head = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """(headers, block) of one record; checks version, headers and lengths."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(VERSION) or not gap:
        raise WarcError("no version line or no end of headers")
    headers: dict[bytes, bytes] = {}
    for line in head[len(VERSION) :].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name or name.strip() != name or name.lower() in headers:
            raise WarcError(f"bad header line {line[:80]!r}")
        headers[name.lower()] = value.strip()
    if missing := [m for m in MANDATORY if m not in headers]:
        raise WarcError(f"headers missing: {missing}")
    length = headers[b"content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise WarcError("the block's length is not the stated one")
    return headers, rest[:-4]


def train(samples: list[bytes]):
    """A Zstandard dictionary of some records, or None if they are too few to train on."""
    import zstandard as z

    if len(samples) < 8 or sum(map(len, samples)) < 8 * DICTIONARY_BYTES:
        return None
    try:
        return z.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8, steps=1)
    except z.ZstdError:
        return None


def archive(records: list[bytes], dictionary) -> bytes:
    """A whole archive: skippable frame with the dictionary (may be empty), then a frame for each record."""
    import zstandard as z

    packer = z.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=True, write_checksum=True)
    stored = dictionary.as_bytes() if dictionary else b""
    head = SKIPPABLE_DICTIONARY.to_bytes(4, "little") + len(stored).to_bytes(4, "little") + stored
    return b"".join([head, *map(packer.compress, records)])


def read_archive(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(headers, block) of each record of an archive, one frame at a time."""
    import zstandard as z

    if len(data) < 8 or int.from_bytes(data[:4], "little") != SKIPPABLE_DICTIONARY:
        raise WarcError("no leading dictionary frame")
    at = 8 + int.from_bytes(data[4:8], "little")
    if at > len(data):
        raise WarcError("the dictionary frame is cut short")
    stored = data[8:at]
    if stored[:4] == b"\x28\xb5\x2f\xfd":  # the format allows a compressed dictionary
        stored = z.ZstdDecompressor().decompress(stored)
    unpacker = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(stored) if stored else None)
    whole = memoryview(data)
    while at < len(whole):
        one, begin, size, parts = unpacker.decompressobj(), at, FIRST_FED, []
        while not one.eof:
            if at == len(whole):
                raise WarcError("the last frame is cut short")
            fed = whole[at : at + size]  # what is fed beyond the frame's end is copied back, so it grows with the frame only
            try:
                parts.append(one.decompress(fed))
            except z.ZstdError as e:
                raise WarcError(f"bad frame: {e}") from e
            at += len(fed)
            size *= 2
        at -= len(one.unused_data)
        if at == begin:
            raise WarcError("an empty frame")
        yield parse(b"".join(parts))


def plan(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, sha1, refers_to, kind) of every page."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = scratch.numbered(pages.select("page_id", "url", "html"), "row")
    own = own.select("row", "page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    groups = own.filter(F.length("payload") >= least_bytes).groupBy("sha1").agg(F.max(F.struct("page_id", "row")).alias("first"), F.count("*").alias("n"))
    copies = scratch.stash(groups.filter("n > 1").select("sha1", "first"), "copies")  # so that the join meets plain shuffles, which adaptive execution can split
    other = F.col("first").isNotNull() & (F.col("row") != F.col("first.row"))
    return own.join(copies, "sha1", "left").select(
        "page_id", "url", "payload", "sha1", F.when(other, F.col("first.page_id")).alias("refers_to"), F.when(other, "revisit").otherwise("response").alias("kind")
    )


def write(pages: DataFrame, folder: str, *, least_bytes: int = 0) -> DataFrame:
    """Write archives of all pages below folder; (archive, records) for each, already written."""
    scratch.ship(pages.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        for held in _groups(batches):
            packed = archive(held, train([r[:SAMPLE_BYTES] for r in held[:SAMPLE_RECORDS]]))
            name = scratch.save_file(f"{folder}/archives", f"part-{task:05d}-{made:05d}-{scratch.token()}.warc.zst", packed)
            made += 1
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64())], ["archive", "records"])

    def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
        held, size = [], 0
        for batch in batches:
            for r in range(batch.num_rows):
                page_id, url, payload, sha1, refers_to, kind = (batch.column(c)[r].as_py() for c in range(6))
                bare = base64.b32encode(bytes.fromhex(sha1)).decode()
                held.append(record(page_id, url, payload, bare, refers_to, kind))
                size += len(held[-1])
                if size >= 4 * ARCHIVE_BYTES:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    rows = plan(pages, least_bytes=least_bytes).mapInArrow(work, "archive string, records long")
    rows.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema("archive string, records long").parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: (record_id, record_type, payload_bytes, payload_digest, refers_to, archive)."""
    scratch.ship(spark)
    wanted = spark.read.schema("archive string, records long").parquet(f"{folder}/manifest")
    schema = "record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string, archive string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n_records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = _rows_of(folder, name)
                if len(rows) != n_records:
                    raise WarcError(f"{name}: {len(rows)} records, {n_records} in the manifest")
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["record_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "archive"])

    n = wanted.count()
    tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, n // 16)))
    return wanted.repartition(tasks).mapInArrow(work, schema)


def _rows_of(folder: str, name: str) -> list[tuple[str, str, int, str, str | None, str]]:
    """What ``read`` returns of one archive."""
    try:
        data = scratch.load_file(f"{folder}/archives", name)
    except FileNotFoundError as e:
        raise WarcError(f"{name} is in the manifest and not in the folder") from e
    rows = []
    for h, block in read_archive(data):
        kind, stated, n = h[b"warc-type"].decode(), h[b"warc-payload-digest"].decode(), int(h[b"x-payload-length"])
        if kind == "response" and (n != len(block) or stated != f"sha1:{digest(block)}"):
            raise WarcError(f"{name}: a payload differs from its headers")
        to = h.get(b"warc-refers-to")
        rows.append((h[b"warc-record-id"].decode(), kind, n, stated.removeprefix("sha1:"), to.decode() if to else None, name))
    return rows


def round_trip(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Write all pages, read the archives back: one row per page."""
    folder = scratch.fresh(pages.sparkSession, "warc")
    write(pages, folder, least_bytes=least_bytes)
    kind = pages.schema["page_id"].dataType.simpleString()
    page = lambda c: F.nullif(F.regexp_extract(c, r"page:(null|-?\d+)>", 1), F.lit("null")).cast(kind)
    return read(pages.sparkSession, folder).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), page("refers_to")).alias("refers_to")
    )
