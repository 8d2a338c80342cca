"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is: one frame with the file's document index, one frame per document with its ids as
little-endian unsigned 32-bit integers, and the public seekable format's seek table (a
skippable frame with compressed size, decompressed size and checksum of every frame). A
reader finds a document's frame from the index and the seek table and decompresses nothing
else. Checksums are the low 32 bits of XXH64 over a frame's plain bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peneira.llm.common import partitions_for, prefix_sums, whole_text
from peneira.llm.encoding import VOCABULARY, encoder, texts
from peneira.session import stage

# Fixed values of the public seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80
ENTRY, FOOTER = struct.Struct("<III"), struct.Struct("<IBI")
LEVEL = 1
FILE_BYTES = 4 << 20
PART_ROWS, MAX_PARTS = 10_000, 20_000


def checksum(plain: bytes) -> int:
    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


def build_file(doc_ids: Sequence[int | None], frames: Sequence[bytes], sizes: Sequence[int], sums: Sequence[int]) -> bytes:
    """A whole file from finished frames, their plain sizes and checksums."""
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    index = struct.pack("<I", len(doc_ids)) + known.tobytes() + np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes()
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(index)
    entries = [ENTRY.pack(len(packed), len(index), checksum(index))]
    entries += [ENTRY.pack(len(f), n, s) for f, n, s in zip(frames, sizes, sums, strict=True)]
    table = b"".join(entries) + FOOTER.pack(len(entries), WITH_CHECKSUMS, SEEKABLE_MAGIC)
    return b"".join([packed, *frames, struct.pack("<II", SKIPPABLE_MAGIC, len(table)), table])


class FrameFile:
    """Random access to the documents of one file's bytes."""

    def __init__(self, content: bytes):
        self.content = memoryview(content)
        n, flags, magic = FOOTER.unpack(self.content[-FOOTER.size :])
        if magic != SEEKABLE_MAGIC or not flags & WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        end = len(content) - FOOTER.size
        self.entries = np.frombuffer(self.content[end - n * ENTRY.size : end], dtype="<u4").reshape(n, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries[:, 0], dtype=np.int64)])
        self.reader = zstandard.ZstdDecompressor()
        index = self.plain(0)
        (count,) = struct.unpack_from("<I", index)
        known = np.frombuffer(index, np.uint8, count, 4)
        ids = np.frombuffer(index, "<i8", count, 4 + count)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known, strict=True)]

    def plain(self, k: int) -> bytes:
        """Decompressed and verified bytes of frame ``k``; frame 0 is the index."""
        size, expected = int(self.entries[k, 1]), int(self.entries[k, 2])
        frame = self.content[self.offsets[k] : self.offsets[k + 1]]
        plain = self.reader.decompress(frame, max_output_size=max(size, 1))
        if len(plain) != size or checksum(plain) != expected:
            raise ValueError(f"frame {k} does not match its checksum")
        return plain

    def document(self, k: int) -> bytes:
        return self.plain(k + 1)


def encode_frames(docs: DataFrame, end_id: int, bounds: Sequence[float] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """``part, doc_id, size, checksum, frame`` per row: ids of the whole text and ``end_id``, compressed where they are made.

    ``part`` is the number of ``bounds`` below the ``doc_id``, 0 for null.
    """
    limits = np.array(bounds, dtype=np.float64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer = encoder(vocabulary), zstandard.ZstdCompressor(level=LEVEL)
        end = struct.pack("<I", end_id)
        for part, words in texts(batches):
            plain = [own.ids(t) + end for t in words]
            ids = part.column("doc_id")
            below = np.searchsorted(limits, ids.fill_null(0).to_numpy(zero_copy_only=False))
            parts = np.where(ids.is_valid().to_numpy(zero_copy_only=False), below, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(parts, pa.int32()),
                    ids,
                    pa.array([len(p) for p in plain], pa.int64()),
                    pa.array([checksum(p) for p in plain], pa.int64()),
                    pa.array([packer.compress(p) for p in plain], pa.binary()),
                ],
                ["part", "doc_id", "size", "checksum", "frame"],
            )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return chosen.mapInArrow(encode, "part int, doc_id long, size long, checksum long, frame binary")


def write_frames(
    docs: DataFrame, path: str, end_id: int = 0, vocabulary: str = VOCABULARY, file_bytes: int = FILE_BYTES, part_rows: int = PART_ROWS
) -> None:
    """Encode ``docs`` and write them in ascending ``doc_id`` order (null first; rows of one id by content).

    Ranges of ids are cut at quantiles of the ids alone, so each text is read and encoded
    once; what is shuffled are finished frames. A task assembles files of about
    ``file_bytes``, so memory is bounded by a file or the longest document. Spark's own text
    writer commits them: each row is one file without its last byte, and the line separator
    is that byte.
    """
    ids = docs.select(F.col("doc_id").cast("double").alias("doc_id"))
    parts = min(partitions_for(ids.count(), part_rows), MAX_PARTS)
    shares = [k / parts for k in range(1, parts)]
    bounds = ids.approxQuantile("doc_id", shares, 0.2 / parts) if shares else []
    frames = encode_frames(docs, end_id, bounds, vocabulary)
    ranged = frames.repartitionById(parts, F.col("part")).sortWithinPartitions("doc_id", "checksum", "size")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight = 0

        def built() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            content = build_file(columns[0], columns[3], columns[1], columns[2])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([content[:-1]], pa.binary())], ["content"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                weight += len(row[3])
                if weight >= file_bytes:
                    yield built()
                    weight = 0
        if held:
            yield built()

    last = struct.pack("<I", SEEKABLE_MAGIC)[-1:].decode("latin-1")
    files = ranged.select("doc_id", "size", "checksum", "frame").mapInArrow(assemble, "content binary")
    (
        files.select(F.col("content").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .option("compression", "none")
        .option("encoding", "ISO-8859-1")
        .option("lineSep", last)
        .text(path)
    )


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``part, file, content``: files in the order they were written."""
    name = F.element_at(F.split("path", "/"), -1)
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
        .where("length > 0")
        .select(
            F.regexp_extract(name, r"^part-(\d+)-", 1).cast("int").alias("part"),
            F.regexp_extract(name, r"-c(\d+)\.", 1).cast("int").alias("file"),
            "content",
        )
    )


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """``part, file, position, doc_id, ids``: every document, in file order, checksums verified."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                frames = FrameFile(content)
                yield from _document_rows(part, file, frames, range(len(frames.doc_ids)))

    return _files(spark, path).mapInArrow(decode, _DOCUMENT)


_DOCUMENT = "part int, file int, position int, doc_id long, ids binary"


def _document_rows(part: int, file: int, frames: FrameFile, chosen: Iterable[int], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    chosen = list(chosen)
    for start in range(0, len(chosen), rows):
        some = chosen[start : start + rows]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part] * len(some), pa.int32()),
                pa.array([file] * len(some), pa.int32()),
                pa.array(some, pa.int32()),
                pa.array([frames.doc_ids[k] for k in some], pa.int64()),
                pa.array([frames.document(k) for k in some], pa.binary()),
            ],
            ["part", "file", "position", "doc_id", "ids"],
        )


def read_documents(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The documents whose ``doc_id`` is in ``wanted``; no other frame is decompressed."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = FrameFile(content).doc_ids
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(ids), pa.int32()),
                        pa.array([file] * len(ids), pa.int32()),
                        pa.array(range(len(ids)), pa.int32()),
                        pa.array(ids, pa.int64()),
                    ],
                    ["part", "file", "position", "doc_id"],
                )

    files = _files(spark, path)
    places = files.mapInArrow(index, "part int, file int, position int, doc_id long")
    # A file holds a bounded number of documents, and so does the list of its chosen ones.
    chosen = (
        places.join(wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
        .groupBy("part", "file")
        .agg(F.sort_array(F.collect_list("position")).alias("positions"))
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file, content, positions in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _document_rows(part, file, FrameFile(content), positions)

    return files.join(chosen, ["part", "file"]).select("part", "file", "content", "positions").mapInArrow(decode, _DOCUMENT)


def document_table(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` adds up file totals first, one row per file, then the documents of a file.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                frames = FrameFile(content)
                plain = (frames.document(k) for k in range(len(frames.doc_ids)))
                lengths, sums = zip(*((len(p) // 4, zlib.crc32(p)) for p in plain), strict=True)
                ends = np.cumsum(lengths)
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * n, pa.int32()),
                        pa.array([file] * n, pa.int32()),
                        pa.array(frames.doc_ids, pa.int64()),
                        pa.array(ends - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    ["part", "file", "doc_id", "before", "n_tokens", "ids_crc32"],
                )

    rows = stage(
        _files(spark, path).mapInArrow(measure, "part int, file int, doc_id long, before long, n_tokens long, ids_crc32 long"),
        "frame-rows",
    )
    sums = rows.groupBy("part", "file").agg(F.sum("n_tokens").alias("tokens"))
    starts = prefix_sums(sums, "part", ["file"], "tokens", "file_start").drop("tokens")
    return rows.join(starts, ["part", "file"]).select(
        "doc_id", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
