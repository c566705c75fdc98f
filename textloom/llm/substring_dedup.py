"""Substring deduplication: 13-word windows that an earlier document has are cut.

1. The texts are stored in chunks in the shared folder; exact copies of an
   earlier document are found by digest and need no windows.
2. Each chunk sends a sketch of its window hashes: for both rows of a count-min
   table, the cells it fills and whether once or more.  The table's width
   follows the input (``CELLS_PER_WINDOW``), and its blocks are merged apart,
   so no task holds more than a block.  Merged cells never underestimate, so a
   window in a cell with a count below two cannot repeat.
3. Each chunk gets back those of its cells that count two or more.  Only
   windows in such cells of both rows go on to an exact aggregation by a 96-bit
   hash of the window: the smallest doc_id of each window, then the places in
   documents with a larger one.  The minimum is aggregated before the shuffle
   and the places are a plain join, so a window that a third of the documents
   share is no hot spot.
4. The places go back to their chunks, which drop the words they cover.

Chunks find their parts by number in the shared folder, read through
``pyarrow.fs``; all identities are columns of stored tables, so tasks can be
run again anywhere.

Defined results: a null or empty text has no words; texts of fewer than 13
words lose nothing; rows with equal doc_id do not cut each other; rows without
doc_id lose nothing and cut nothing; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import read_part, scratch, stored

WORDS = 13
CELLS_PER_WINDOW = 16
BLOCK_BITS = 22
CHUNK_WINDOWS = 1_000_000
#: The part of a row id that numbers rows within a chunk.
ROW_BITS = 33

_CODES, _CODES2 = K.byte_codes(71), K.byte_codes(72)
_WORD, _WORD2, _WINDOW, _WINDOW2 = (K.Roller(s) for s in (73, 74, 75, 76))
_SECOND = np.uint64(0xA24BAED4963EE407)


def window_hashes(texts: K.Texts, second: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first word of each window, and the windows of each text."""
    words = texts.word_hashes(_WORD2 if second else _WORD, _CODES2 if second else _CODES)
    at, per = texts.windows(WORDS)
    roller = _WINDOW2 if second else _WINDOW
    return roller.ranges(roller.prefix(words), at, at + WORDS), at, per


def cell(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (K.mix(h ^ _SECOND) if row else h) >> np.uint64(64 - bits)


def pack(values: np.ndarray) -> bytes:
    """Sorted numbers below 2**32, as compressed planes of their differences."""
    gaps = np.diff(values.astype(np.uint32), prepend=np.uint32(0))
    return zstandard.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).reshape(-1), dtype=np.uint32)


def part_of(path: str, chunk: int, columns: list[str]) -> pa.Table | None:
    """The rows of a chunk in a table partitioned by chunk."""
    return read_part(path, f"chunk={chunk}", columns)


def by_chunk(df: DataFrame, name: str) -> str:
    """Writes a table with a column ``chunk`` so that part_of finds its parts; returns its path."""
    path = scratch(df.sparkSession, name)
    df.repartition("chunk").write.partitionBy("chunk").parquet(path)
    return path


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """The batches cut where the chunk changes: chunk, row ids, rows."""
    for batch in batches:
        uid = batch.column("uid").to_numpy()
        chunk = uid >> ROW_BITS
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1), len(uid)] if len(uid) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield int(chunk[a]), uid[a:b], batch.slice(a, b - a)


def copies_of(path: str, chunk: int) -> np.ndarray:
    """Sorted row ids of a chunk's exact copies."""
    found = part_of(path, chunk, ["uid"])
    return np.sort(found.column("uid").to_numpy()) if found is not None else np.zeros(0, np.int64)


def sketches(texts: DataFrame, copies: str, bits: int) -> DataFrame:
    """``chunk, row, block, cells``: each chunk's cells, twice their number plus one where it fills them more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(chunk: int, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            h = np.concatenate(parts)
            for row in (0, 1):
                cells = np.sort(cell(h, row, bits))
                first = np.concatenate([[True], cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, bool)
                at = np.flatnonzero(first)
                marked = (cells[at] << np.uint64(1)) | (np.diff(np.concatenate([at, [len(cells)]])) > 1).astype(np.uint64)
                blocks = (marked >> np.uint64(BLOCK_BITS + 1)).astype(np.int64)
                begins = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]])) if len(blocks) else np.zeros(0, np.int64)
                ends = np.concatenate([begins[1:], [len(blocks)]])
                low = (marked & np.uint64((2 << BLOCK_BITS) - 1)).astype(np.uint32)
                packed = [pack(low[a:b]) for a, b in zip(begins, ends)]
                n = len(packed)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.array(np.full(n, row, np.int32)), pa.array(blocks[begins]), pa.array(packed, pa.binary())], names=["chunk", "row", "block", "cells"])

        now, skip, parts, size = None, None, [], 0
        for chunk, uid, rows in runs(batches):
            if chunk != now:
                if parts:
                    yield from out(now, parts)
                now, skip, parts, size = chunk, copies_of(copies, chunk), [], 0
            for a, b, data, bounds in K.slices(rows.column("text")):
                h, _, per = window_hashes(K.Texts(data, bounds))
                parts.append(h[np.repeat(~K.in_sorted(uid[a:b], skip), per)])
                size += len(parts[-1])
                if size >= CHUNK_WINDOWS:
                    yield from out(now, parts)
                    parts, size = [], 0
        if parts:
            yield from out(now, parts)

    return texts.select("uid", "text").mapInArrow(run, "chunk long, row int, block long, cells binary")


def merged(parts: DataFrame) -> DataFrame:
    """``chunk, row, block, cells``: of each chunk's cells those that count two or more in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: tuple, held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            total = np.zeros(1 << BLOCK_BITS, np.uint8)
            for _, marked in held:
                at = marked >> np.uint32(1)
                total[at] = np.minimum(total[at] + 1 + (marked & np.uint32(1)), 2)
            left = [(c, at[total[at] > 1]) for c, marked in held for at in [marked >> np.uint32(1)]]
            left = [(c, pack(at)) for c, at in left if len(at)]
            n = len(left)
            return pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in left], pa.int64()), pa.array(np.full(n, key[0], np.int32)), pa.array(np.full(n, key[1])), pa.array([x for _, x in left], pa.binary())], names=["chunk", "row", "block", "cells"]
            )

        now, held = None, []
        for batch in batches:
            for chunk, row, block, cells in zip(*(batch.column(c).to_pylist() for c in ("chunk", "row", "block", "cells"))):
                if (row, block) != now:
                    if held:
                        yield out(now, held)
                    now, held = (row, block), []
                held.append((chunk, unpack(cells)))
        if held:
            yield out(now, held)

    return parts.repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(run, "chunk long, row int, block long, cells binary")


class Suspects:
    """The cells of a chunk that count two or more, as a table of bits that may hold a few others too."""

    def __init__(self, path: str, chunk: int, bits: int):
        self.bits, found = bits, part_of(path, chunk, ["row", "block", "cells"])
        cells: list[list[np.ndarray]] = [[], []]
        if found is not None:
            for row, block, packed in zip(*(found.column(c).to_pylist() for c in ("row", "block", "cells"))):
                cells[row].append(unpack(packed).astype(np.uint64) + np.uint64(block << BLOCK_BITS))
        self.tables = []
        for own in cells:
            both = np.concatenate(own) if own else np.zeros(0, np.uint64)
            shift = np.uint64(64 - min(25, max(16, (16 * len(both)).bit_length())))
            table = np.zeros(1 << int(64 - shift), bool)
            table[(K.mix(both) >> shift).astype(np.int64)] = True
            self.tables.append((shift, table))

    def among(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for row, (shift, table) in enumerate(self.tables):
            found &= table[(K.mix(cell(h, row, self.bits)) >> shift).astype(np.int64)]
        return found


def repeated_windows(texts: DataFrame, copies: str, suspects: str, bits: int) -> DataFrame:
    """``k1, k2, doc_id, uid, at`` of the windows that may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, skip, cells = None, None, None
        for chunk, uid, rows in runs(batches):
            if chunk != now:
                now, skip, cells = chunk, copies_of(copies, chunk), Suspects(suspects, chunk, bits)
            docs = rows.column("doc_id")
            known = np.array(docs.is_valid())
            ids = docs.fill_null(0).to_numpy()
            for a, b, data, bounds in K.slices(rows.column("text")):
                words = K.Texts(data, bounds)
                h, at, per = window_hashes(words)
                owner = np.repeat(np.arange(b - a), per)
                use = (known[a:b] & ~K.in_sorted(uid[a:b], skip))[owner] & cells.among(h)
                if not use.any():
                    continue
                second = window_hashes(words, True)[0][use] >> np.uint64(32)
                own = owner[use]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[use].view(np.int64)), pa.array(second.astype(np.uint32).view(np.int32)), pa.array(ids[a:b][own]), pa.array(uid[a:b][own]), pa.array((at[use] - words.first[own]).astype(np.int32))],
                    names=["k1", "k2", "doc_id", "uid", "at"],
                )

    return texts.select("uid", "doc_id", "text").mapInArrow(run, "k1 long, k2 int, doc_id long, uid long, at int")


def cut_texts(texts: DataFrame, copies: str, places: str, finish: Callable, schema: str) -> DataFrame:
    """``finish(words, kept)`` of each text as the last columns, after doc_id, n_words and n_removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, skip, gone = None, None, {}
        for chunk, uid, rows in runs(batches):
            if chunk != now:
                now, skip = chunk, copies_of(copies, chunk)
                found = part_of(places, chunk, ["uid", "places"])
                column = found.column("places").combine_chunks() if found is not None else None
                gone = {u: k for k, u in enumerate(found.column("uid").to_pylist())} if found is not None else {}
            copied = K.in_sorted(uid, skip)
            n_words, n_removed, last = [], [], []
            for k, (u, text) in enumerate(zip(uid.tolist(), rows.column("text").cast(pa.binary()).to_pylist())):
                words = (text or b"").split()
                n_words.append(len(words))
                if copied[k] and len(words) >= WORDS:
                    kept = []
                elif u in gone:
                    lost = K.covered(column[gone[u]].values.to_numpy(), WORDS, len(words))
                    kept = [w for w, x in zip(words, lost.tolist()) if not x]
                else:
                    kept = words
                n_removed.append(len(words) - len(kept))
                last.append(finish(kept))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(last, pa.string())], names=["doc_id", "n_words", "n_removed", "last"])

    return texts.mapInArrow(run, schema)


def dedup_substrings(docs: DataFrame, finish: Callable = lambda kept: b" ".join(kept).decode(), column: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed`` and what is left of each text, joined by single spaces."""
    texts = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("uid", F.monotonically_increasing_id()), "windows-texts")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(BLOCK_BITS + 1, (CELLS_PER_WINDOW * size // 6).bit_length())

    chunk = F.shiftright("uid", ROW_BITS).alias("chunk")
    keyed = texts.where("doc_id IS NOT NULL AND text IS NOT NULL").select("uid", "doc_id", F.md5("text").alias("digest"))
    # Small sides are stored, so that joins read plain exchanges, whose large partitions Spark splits.
    first = stored(keyed.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first"), "windows-digests")
    copies = by_chunk(keyed.join(first, "digest").where("doc_id > first").select("uid", chunk), "windows-copies")

    suspects = by_chunk(merged(sketches(texts, copies, bits)), "windows-cells")
    places = repeated_windows(texts, copies, suspects, bits)
    earliest = stored(places.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("k1", "k2", "first"), "windows-first")
    later = places.join(earliest, ["k1", "k2"]).where("doc_id > first")
    cut = by_chunk(later.groupBy("uid").agg(F.collect_list("at").alias("places")).select("uid", "places", chunk), "windows-places")
    return cut_texts(texts, copies, cut, finish, f"doc_id long, n_words long, n_removed long, {column} string")


def dedup_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""
    return dedup_substrings(docs, lambda kept: hashlib.sha256(b" ".join(kept)).hexdigest(), "kept_sha256")
