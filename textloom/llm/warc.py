"""WARC archives, compressed record by record with a dictionary of their own.

Every archive starts with a skippable frame that embeds a Zstandard dictionary
built from its own records; each record follows as one frame.  A payload that
several pages have is stored once: the page with the smallest page_id is the
``response``, the others are ``revisit`` records that name it.  Which page that
is comes from a partial aggregation by payload digest; payloads themselves are
dealt by page, so a payload that a third of the pages share is no hot spot.

Archives go to the shared folder through ``pyarrow.fs`` (local, HDFS, object
stores).  A task writes under a name of its own and renames when done, and its
output depends on its rows only, so a lost executor's tasks can be run again.

Defined results: a null payload is empty, and empty payloads are payloads like
others; a null url becomes ``urn:page:<page_id>``; rows without page_id come
last and are named by no revisit; of rows with equal page_id and payload one is
the response and the others revisit it; an empty table gives no archive and an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored

DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES = 32 * 1024
#: Records of an archive that its dictionary is built from.
SAMPLE_RECORDS = 256
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"

RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, path string"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One record; a revisit carries the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    name = lambda x: uuid.uuid5(uuid.NAMESPACE_URL, f"page:{x}:{digest}").urn
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {DATE}", f"WARC-Record-ID: <{name(page_id)}>"]
    lines.append("WARC-Target-URI: " + (url if url is not None else f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if first is not None:
            lines += [f"WARC-Refers-To: <{name(first)}>", f"X-Refers-To-Page-ID: {first}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive_frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The frames of one archive; its first records are held back until its dictionary is built."""
    held = [x for _, x in zip(range(SAMPLE_RECORDS), records)]
    dictionary = None
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, held, k=512, d=8)
    except zstandard.ZstdError:
        pass  # too few or too uniform records to learn from: an archive without dictionary
    if dictionary is not None:
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
        yield struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed
        dictionary.precompute_compress(level=LEVEL)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
    for x in held:
        yield packer.compress(x)
    for x in records:
        yield packer.compress(x)


def open_archive(raw) -> io.BufferedReader:
    """The records of an archive as one stream."""
    head = raw.read(8)
    dictionary = None
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_FRAME:
        packed = raw.read(struct.unpack("<II", head)[1])
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(packed))
    else:
        raw.seek(0)
    return io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(raw, read_across_frames=True), 1 << 18)


def read_records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record."""
    while line := stream.readline():
        if line.rstrip() != b"WARC/1.1":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            key, _, value = line.partition(b": ")
            headers[key.decode()] = value.decode()
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record ends before its length")
        yield headers, block


def _packed(rows: DataFrame) -> DataFrame:
    """The pages with their payloads compressed, for the way to their archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [packer.compress(x) for x in batch.column("html").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "digest")), pa.array(packed, pa.binary())], names=["page_id", "url", "digest", "packed"])

    return rows.select("page_id", "url", "digest", "html").mapInArrow(run, "page_id long, url string, digest string, packed binary")


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Writes the archives below ``path``; returns ``path, records`` of each, stored."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    size = rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    # Stored, so that the join by digest reads plain exchanges, whose large partitions Spark splits.
    firsts = stored(rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-firsts", small=True)
    shared = stored(rows.select("page_id", "digest").join(firsts, "digest").distinct().select(F.col("page_id").alias("of"), F.col("digest").alias("same"), "first", F.lit(True).alias("copied")), "warc-copies")
    dealt = _packed(rows).repartition(max(1, -(-size // (ARCHIVE_BYTES // 8))), "page_id", "digest")
    marked = dealt.join(shared, F.expr("page_id <=> of AND digest = same"), "left").select("page_id", "url", "packed", "digest", "first", "copied")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pyarrow.fs.FileSystem.from_uri(path)
        files.create_dir(base, recursive=True)
        task, last = TaskContext.get().partitionId(), None

        def all_records() -> Iterator[bytes]:
            nonlocal last
            for batch in batches:
                for page_id, url, packed, digest, first, copied in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "packed", "digest", "first", "copied"))):
                    revisit = bool(copied) and (page_id != first or (page_id, digest) == last)
                    last = (page_id, digest)
                    yield record(page_id, url, zstandard.decompress(packed), base64.b32encode(bytes.fromhex(digest)).decode(), first, revisit)

        rest, names, counts = all_records(), [], []
        while (head := next(rest, None)) is not None:
            name, used, count = f"part-{task:05d}-{len(names):03d}.warc.zst", 0, 0

            def one() -> Iterator[bytes]:
                nonlocal used, count
                x = head
                while x is not None:
                    used, count = used + len(x), count + 1
                    yield x
                    x = next(rest, None) if used < ARCHIVE_BYTES else None

            own = f"{base}/.{name}.{uuid.uuid4().hex}"
            with files.open_output_stream(own) as out:
                for frame in archive_frames(one()):
                    out.write(frame)
            files.move(own, f"{base}/{name}")
            names.append(f"{path}/{name}")
            counts.append(count)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["path", "records"])

    return stored(marked.sortWithinPartitions(F.asc_nulls_last("page_id"), "digest").mapInArrow(run, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives, payload digests checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, name = pyarrow.fs.FileSystem.from_uri(path)
                rows = []
                with files.open_input_file(name) as raw:
                    for headers, block in read_records(open_archive(raw)):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(head.rpartition(b"Content-Length: ")[2])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if headers["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"a payload in {path} differs from its digest")
                        number = lambda k: int(headers[k]) if k in headers else None
                        rows.append((number("X-Page-ID"), size, digest, headers["WARC-Type"], number("X-Refers-To-Page-ID"), path))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in RECORDS.split(", ")])

    paths = manifest.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(run, RECORDS)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Archives the pages in the shared folder and reads them back."""
    return read_archives(write_archives(pages, scratch(pages.sparkSession, "warc"))).drop("path")
