"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds documents in ascending order of id. Layout:

* frames: whole documents' ids (little-endian unsigned 32-bit), up to ``FRAME_BYTES`` a
  frame unless one document is longer, each an independent zstandard frame;
* a skippable frame with the document index: per document its id (and whether it has one),
  frame number, offset in the frame and length, both in ids;
* a skippable frame with the seek table: per frame the compressed and decompressed size and
  the low 32 bits of XXH64 of the decompressed bytes; a footer with the number of frames
  and a magic number ends the file. Any zstandard reader can decompress the file as a whole.

A reader loads the two tables from the file's end, then only the frames of the documents
it is asked for, and checks each frame against its checksum.

Files are written by the tasks of a range-partitioned, sorted job, under a name that a
retried task overwrites as a whole; a manifest (one row per file) is written beside them.

Defined results: a null or empty text has the end id alone. Null ids come first. Rows of
equal id are ordered by a hash of their text, then by the text. An empty table gives no files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickweave.llm.common import materialise
from clickweave.llm.tokens import ROWS, encoder

FRAME_BYTES = 1 << 18
SKIPPABLE_INDEX = 0x184D2A50
#: The seek table's frame and footer numbers of the public seekable format.
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
_ENTRY = np.dtype([("compressed", "<u4"), ("size", "<u4"), ("check", "<u4")])
_INDEX = np.dtype([("has_id", "u1"), ("doc_id", "<i8"), ("frame", "<u4"), ("offset", "<u8"), ("n", "<u8")])
_FOOTER = struct.Struct("<IBI")
MANIFEST = "path string, first_id bigint, file_no int, n_docs bigint, n_tokens bigint"


class Writer:
    """Writes one file to an open binary stream."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES) -> None:
        self.out, self.frame_bytes = out, frame_bytes
        self.pending: list[bytes] = []
        self.size = 0
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple] = []
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > self.frame_bytes:
            self._flush()
        self.index.append((doc_id is not None, doc_id or 0, len(self.frames), self.size // 4, len(ids) // 4))
        self.pending.append(ids)
        self.size += len(ids)

    def _flush(self) -> None:
        data = b"".join(self.pending)
        packed = self.compressor.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.pending, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._flush()
        index = np.array(self.index, _INDEX).tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = np.array(self.frames, _ENTRY).tobytes()
        footer = _FOOTER.pack(len(self.frames), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table) + len(footer)) + table + footer)


class Reader:
    """Reads documents of one file; only their frames are loaded."""

    def __init__(self, source) -> None:
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - _FOOTER.size)
        n, _, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table at the end of the file")
        start = end - _FOOTER.size - n * _ENTRY.itemsize
        source.seek(start)
        self.frames = np.frombuffer(source.read(n * _ENTRY.itemsize), _ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.frames["compressed"], dtype=np.int64)])
        source.seek(int(self.starts[-1]) + 8)
        self.index = np.frombuffer(source.read(start - 8 - int(self.starts[-1]) - 8), _INDEX)
        self.held: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.held[0] != k:
            self.source.seek(int(self.starts[k]))
            packed = self.source.read(int(self.frames["compressed"][k]))
            data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.frames["size"][k]))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != int(self.frames["check"][k]):
                raise ValueError(f"frame {k} does not match its checksum")
            self.held = (k, data)
        return self.held[1]

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(id, ids as bytes) of all documents, or of those with the ``wanted`` ids."""
        for has_id, doc_id, frame, offset, n in self.index.tolist():
            if wanted is None or (has_id and doc_id in wanted):
                yield (doc_id if has_id else None), self.frame(frame)[4 * offset : 4 * (offset + n)]


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def _write_files(folder: str, tokenizer: str, end_id: int) -> Callable:
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), struct.pack("<I", end_id)
        number = TaskContext.get().partitionId()
        files, base = _filesystem(folder)
        path, temporary = f"{base}/tokens-{number:06d}.zst", f"{base}/.{uuid.uuid4().hex}"
        writer, n_docs, n_tokens, first = None, 0, 0, None
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            texts = encode.encode_all(batch.column(1).to_pylist())
            for doc_id, ids in zip(batch.column(0).to_pylist(), texts, strict=True):
                if writer is None:
                    files.create_dir(base, recursive=True)
                    stream = files.open_output_stream(temporary)
                    writer, first = Writer(stream), doc_id
                ids += end
                writer.add(doc_id, ids)
                n_docs, n_tokens = n_docs + 1, n_tokens + len(ids) // 4
        if writer is not None:
            writer.close()
            stream.close()
            files.move(temporary, path)  # a retried task writes the same bytes again
            row = {"path": f"{folder}/tokens-{number:06d}.zst", "first_id": first, "file_no": number}
            yield pa.RecordBatch.from_pylist(
                [row | {"n_docs": n_docs, "n_tokens": n_tokens}],
                pa.schema([("path", pa.string()), ("first_id", pa.int64()), ("file_no", pa.int32()),
                           ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )

    return write


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Writes the ids of all texts, each closed by ``end_id``, below ``folder``; the manifest."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie, "text")
    manifest = ordered.mapInArrow(_write_files(folder, tokenizer, end_id), MANIFEST)
    return materialise(manifest, "token-manifest")


def _read_files(wanted: set[int] | None) -> Callable:
    schema = pa.schema(
        [("doc_id", pa.int64()), ("file_no", pa.int32()), ("place", pa.int64()), ("n_tokens", pa.int64()),
         ("ids_crc32", pa.int64()), ("ids", pa.binary())]
    )

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, number, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, at = _filesystem(path)
                with files.open_input_file(at) as source:
                    rows, size, place = [], 0, before
                    for doc_id, ids in Reader(source).documents(wanted):
                        n = len(ids) // 4
                        rows.append(
                            {"doc_id": doc_id, "file_no": number, "place": place, "n_tokens": n,
                             "ids_crc32": zlib.crc32(ids), "ids": ids}
                        )
                        place, size = place + n, size + len(ids)
                        if size > 8_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read_tokens(manifest: DataFrame, wanted: set[int] | None = None) -> DataFrame:
    """``doc_id``, ``file_no``, ``place`` (ids read of earlier documents), ``n_tokens``, ``ids_crc32``,
    ``ids`` of all documents, or of the ``wanted`` ids (then ``place`` counts what is read)."""
    # One row per file; the window runs over files, not over documents.
    earlier = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", "file_no", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("before"))
    ddl = "doc_id bigint, file_no int, place bigint, n_tokens bigint, ids_crc32 bigint, ids binary"
    # A row of the manifest is a whole file to read, so adaptive execution must not join them by size.
    n_files = max(1, manifest.count())
    return files.repartition(n_files, "file_no").mapInArrow(_read_files(wanted), ddl)


def document_starts(manifest: DataFrame) -> DataFrame:
    """Every document with ``start``, the ids of all documents before it."""
    return read_tokens(manifest).drop("ids", "file_no").withColumnRenamed("place", "start")
