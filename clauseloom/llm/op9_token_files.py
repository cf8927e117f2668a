"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds whole documents in ascending id order. Frame: the ids of one or more
documents as little-endian unsigned 32-bit integers, compressed alone, with
zstandard's own content checksum; a document is never split over frames. After
the frames comes a skippable frame with the documents' ids, lengths,
frames and marks of null ids (compressed), then, last, the seek table of the published seekable zstandard
format: compressed size, decompressed size and XXH64 checksum of every frame, so
a reader seeks to the frames of the documents it is asked for, decompresses only
these and verifies each.

Files are written by tasks through pyarrow's file systems into a folder that the
cluster shares. Every attempt writes a name of its own and only the names that
successful tasks returned enter the manifest, so lost executors leave at most
unread files. Documents are dealt to files by ranges of (id, hash of text).

Defined cases: a null text is empty; every document ends with the end id, so none
has zero ids; null ids come first; rows with equal ids follow each other in the
order of their texts' hashes; an empty table gives no file; other columns are ignored.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseloom.llm.common import settle, small
from clauseloom.llm.tokens import only, task, word_level_ids
from clauseloom.plans.shared import fresh_path

# Fixed values of the seekable zstandard format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 256 * 1024
ROWS_PER_FILE = 10_000


class FrameWriter:
    """Writes documents' ids to a binary stream in the format above."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.out, self.limit = out, frame_bytes
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.table, self.lengths, self.keys, self.nulls, self.frames, self.held, self.size = [], [], [], [], [], [], 0

    def add(self, key: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > self.limit:
            self._flush()
        self.held.append(ids)
        self.size += len(ids)
        self.keys.append(-1 if key is None else key)
        self.nulls.append(key is None)
        self.lengths.append(len(ids) // 4)
        self.frames.append(len(self.table))

    def _flush(self) -> None:
        raw = b"".join(self.held)
        packed = self.zip.compress(raw)
        self.out.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        index = self.zip.compress(np.array([self.keys, self.lengths, self.frames, self.nulls], "<i8").tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        n = len(self.table)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, 12 * n + 9))
        self.out.write(np.array(self.table, "<u4").reshape(n, 3).tobytes() + struct.pack("<IBI", n, 1 << 7, SEEK_MAGIC))


class FrameReader:
    """Random access to the documents of one file; `frames_read` counts the frames it has decompressed."""

    def __init__(self, src):
        self.src, self.frames_read = src, 0
        end = src.seek(0, io.SEEK_END)
        src.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", src.read(9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table at the end of the file")
        src.seek(end - 9 - 12 * n)
        self.table = np.frombuffer(src.read(12 * n), "<u4").reshape(n, 3)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        src.seek(int(self.at[-1]))
        magic, size = struct.unpack("<II", src.read(8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("no document index behind the frames")
        self.zip = zstandard.ZstdDecompressor()
        self.keys, self.lengths, self.frames, nulls = np.frombuffer(self.zip.decompress(src.read(size)), "<i8").reshape(4, -1)
        self.nulls = nulls == 1  # their keys read -1, which is an id too
        ends = np.cumsum(self.lengths)
        self.starts = ends - self.lengths  # ids of this file before each document
        self.in_frame = self.starts - np.concatenate([[0], np.cumsum(self.table[:, 1] // 4, dtype=np.int64)])[self.frames]
        self.open = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.open[0] != k:
            self.src.seek(int(self.at[k]))
            raw = self.zip.decompress(self.src.read(int(self.table[k, 0])))
            if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} doesn't match its checksum")
            self.open, self.frames_read = (k, raw), self.frames_read + 1
        return self.open[1]

    def document(self, i: int) -> bytes:
        """The ids of the i-th document, as bytes."""
        a = 4 * int(self.in_frame[i])
        return self.frame(int(self.frames[i]))[a : a + 4 * int(self.lengths[i])]


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, rows_per_file: int = ROWS_PER_FILE
) -> DataFrame:
    """Write the files under `folder` (a URI all nodes share) and return the manifest: file_no, path, n_docs, n_ids."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    n_files = max(1, -(-docs.count() // rows_per_file), docs.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.repartitionByRange(n_files, "id", "tie").sortWithinPartitions("id", "tie")
    end = struct.pack("<I", end_id)

    @task
    def run(batches):
        from pyspark import TaskContext

        encode, writer, path, n_ids, out = only(word_level_ids(tokenizer)), None, None, 0, None
        for b in small(batches):
            for key, ids in zip(b.column(0).to_pylist(), encode.many(b.column(1)), strict=True):
                if writer is None:
                    fs, base = pafs.FileSystem.from_uri(folder)
                    fs.create_dir(base, recursive=True)
                    path = f"ids-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zst"
                    out = fs.open_output_stream(f"{base}/{path}", compression=None)
                    writer = FrameWriter(out)
                ids += end
                n_ids += len(ids) // 4
                writer.add(key, ids)
        if writer:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"file_no": pa.array([TaskContext.get().partitionId()], pa.int64()), "path": [path], "n_docs": pa.array([len(writer.keys)], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())}
            )

    return settle(dealt.mapInArrow(run, "file_no long, path string, n_docs long, n_ids long"), "manifest")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Every document from the files: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches):
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                fs, root = pafs.FileSystem.from_uri(folder)
                with fs.open_input_file(f"{root}/{path}") as src:
                    r = FrameReader(src)
                    crc = [zlib.crc32(r.document(i)) for i in range(len(r.keys))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r.keys, mask=r.nulls), pa.array(r.starts + base), pa.array(r.lengths), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"]
                )

    n = max(1, spark.sparkContext.defaultParallelism)
    return files.select("path", "base").repartition(n, "path").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def token_file_report(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Write docs' ids to files in a fresh shared folder and read every document back from them."""
    folder = fresh_path(docs.sparkSession, "token-files")
    folder = folder if "://" in folder or not folder.startswith("/") else f"file://{folder}"
    folder = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    manifest = write_token_files(docs, folder, tokenizer, id_col, text_col, **how)
    return read_token_files(docs.sparkSession, folder, manifest).withColumnRenamed("id", id_col)
