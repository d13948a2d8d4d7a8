"""Token-id files: independent zstandard frames with a trailing seek table.

A corpus is sorted by document id, cut into contiguous ranges, and each range
becomes one file: data frames that can be read alone, then a skippable frame
that maps documents to frames, then the seek table of the public seekable
zstandard format (sizes and a checksum for each frame). A reader that wants
some documents reads the two tables at the end and only the frames it needs.

Defined cases: a null text is empty, and a document always has at least its
end id; null ids sort first; rows that repeat an id are documents of their own,
kept in input order; an empty table gives no file and no row; extra columns are
not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import documents, shuffle_parts, text_buffer, write_table
from orderlens.llm.tokens import encoder, tokenizer_path
from orderlens.session import scratch_path

# Fixed values of the public seekable format.
SEEK_TABLE_MAGIC = 0x184D2A5E
SEEK_FOOTER_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
#: The skippable frame with the document index.
INDEX_MAGIC = 0x184D2A50

END_ID = 1
MANIFEST = (
    "file_no int, path string, frame int, at long, size int, raw_size int, checksum long, "
    "first_token long, n_tokens long, n_docs int"
)
READ_BACK = "_file int, _first long, doc_id long, _at long, n_tokens long, ids_crc32 long"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow file system and path for a folder named by path or URI."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return pafs.FileSystem.from_uri(path)


# --- one frame ---------------------------------------------------------------------


def pack_frame(doc_ids: np.ndarray, valid: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """Uncompressed frame: count, document ids, id flags, lengths, token ids."""
    return b"".join((
        struct.pack("<I", len(doc_ids)), doc_ids.astype("<i8").tobytes(), valid.astype("u1").tobytes(),
        lengths.astype("<u4").tobytes(), ids.astype("<u4").tobytes(),
    ))


def unpack_frame(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<I", raw)
    doc_ids = np.frombuffer(raw, "<i8", n, 4)
    valid = np.frombuffer(raw, "u1", n, 4 + 8 * n).astype(bool)
    lengths = np.frombuffer(raw, "<u4", n, 4 + 9 * n)
    return doc_ids, valid, lengths, np.frombuffer(raw, "<u4", -1, 4 + 13 * n)


def read_frame(handle, at: int, size: int, checksum: int) -> bytes:
    """One frame, decompressed alone and held against its checksum."""
    handle.seek(at)
    raw = zstandard.ZstdDecompressor().decompress(handle.read(size))
    if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
        raise ValueError(f"checksum of the frame at byte {at} does not match")
    return raw


# --- writing -----------------------------------------------------------------------


class _FileWriter:
    """Frames of one file, moved to its final name when all are written, so a
    task that is run again leaves one whole file."""

    def __init__(self, folder: str, file_no: int, frame_tokens: int, level: int):
        self.fs, base = file_system(folder)
        self.fs.create_dir(base, recursive=True)
        self.name = f"part-{file_no:06d}.zst"
        self.path, self.final = f"{folder.rstrip('/')}/{self.name}", f"{base.rstrip('/')}/{self.name}"
        task = TaskContext.get()
        self.temporary = f"{self.final}.{task.taskAttemptId() if task else 0}.tmp"
        self.out = self.fs.open_output_stream(self.temporary)
        self.file_no, self.frame_tokens, self.compressor = file_no, frame_tokens, zstandard.ZstdCompressor(level=level)
        self.at = self.tokens = self.pending_tokens = 0
        self.pending: list[tuple[int, bool, np.ndarray]] = []
        self.frames: list[tuple] = []
        self.index: list[tuple[np.ndarray, np.ndarray, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.pending and self.pending_tokens + len(ids) > self.frame_tokens:
            self.flush()
        self.pending.append((doc_id or 0, doc_id is not None, ids))
        self.pending_tokens += len(ids)

    def flush(self) -> None:
        if not self.pending:
            return
        doc_ids = np.array([d for d, _, _ in self.pending], np.int64)
        valid = np.array([v for _, v, _ in self.pending])
        lengths = np.array([len(x) for _, _, x in self.pending], np.int64)
        raw = pack_frame(doc_ids, valid, lengths, np.concatenate([x for _, _, x in self.pending]))
        packed = self.compressor.compress(raw)
        self.out.write(packed)
        self.index.append((doc_ids, valid, len(self.frames)))
        self.frames.append((self.file_no, self.path, len(self.frames), self.at, len(packed), len(raw),
                            xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF, self.tokens, self.pending_tokens, len(doc_ids)))
        self.at += len(packed)
        self.tokens += self.pending_tokens
        self.pending, self.pending_tokens = [], 0

    def close(self) -> list[tuple]:
        self.flush()
        ids = np.concatenate([d for d, _, _ in self.index]).astype("<i8")
        valid = np.concatenate([v for _, v, _ in self.index]).astype("u1")
        frame = np.repeat([k for _, _, k in self.index], [len(d) for d, _, _ in self.index]).astype("<u4")
        index = struct.pack("<Q", len(ids)) + ids.tobytes() + valid.tobytes() + frame.tobytes()
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        entries = b"".join(struct.pack("<III", f[4], f[5], f[6]) for f in self.frames)
        entries += struct.pack("<III", 8 + len(index), 0, 0)
        table = entries + struct.pack("<IBI", len(self.frames) + 1, CHECKSUM_FLAG, SEEK_FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_TABLE_MAGIC, len(table)) + table)
        self.out.close()
        self.fs.move(self.temporary, self.final)
        return self.frames


def write_token_files(df: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID,
                      frame_tokens: int = 1 << 18, level: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the corpus as token files; returns the manifest, a row for each frame.

    Files hold contiguous id ranges in ascending order of their number.
    ``frame_tokens`` bounds a frame; a longer document is a frame of its own.
    """
    path, spark = tokenizer or tokenizer_path(), df.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, encode = None, encoder(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            writer = writer or _FileWriter(folder, TaskContext.get().partitionId(), frame_tokens, level)
            doc_ids = batch.column(0).to_pylist()
            for first, ids, counts in encode.batches(*text_buffer(batch.column(1))):
                ends = np.cumsum(counts)
                for k, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)):
                    writer.add(doc_ids[first + k], np.append(ids[a:b], np.uint32(end_id)))
        if writer:
            rows = list(zip(*writer.close(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1]), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int32()), pa.array(rows[5], pa.int32())] + [pa.array(r, pa.int64()) for r in rows[6:9]] + [pa.array(rows[9], pa.int32())],
                                             names=[c.split()[0] for c in MANIFEST.split(", ")])

    ordered = documents(df, id_col, text_col).repartitionByRange(shuffle_parts(spark), "_id", "_row").sortWithinPartitions("_id", "_row")
    return write_table(ordered.select("_id", "_text").mapInArrow(write, MANIFEST), "token-manifest")


# --- reading -----------------------------------------------------------------------


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document's digest, from the frames that a manifest lists: doc_id,
    start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = manifest.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_path, handle = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != open_path:
                    fs, name = file_system(row["path"])
                    open_path, handle = row["path"], fs.open_input_file(name)
                doc_ids, valid, lengths, ids = unpack_frame(read_frame(handle, row["at"], row["size"], row["checksum"]))
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, row["file_no"], np.int32)), pa.array(np.full(n, row["first_token"], np.int64)),
                    pa.array(doc_ids.astype(np.int64), mask=~valid), pa.array(starts), pa.array(lengths.astype(np.int64)),
                    pa.array(crc, pa.int64()),
                ], names=[c.split()[0] for c in READ_BACK.split(", ")])

    rows = manifest.select("file_no", "path", "at", "size", "checksum", "first_token").repartition(shuffle_parts(spark)).mapInArrow(read, READ_BACK)
    files = manifest.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))  # one row a file
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(F.col("file_no").alias("_file"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return rows.join(files, "_file").select(
        "doc_id", (F.col("_before") + F.col("_first") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(path: str, wanted: set[int | None]) -> dict[int | None, list[np.ndarray]]:
    """Token ids of some documents of one file: the tables at its end are read,
    then only the frames that hold a wanted document."""
    fs, name = file_system(path)
    with fs.open_input_file(name) as handle:
        size = handle.size()
        handle.seek(size - 9)
        n_frames, flags, magic = struct.unpack("<IBI", handle.read(9))
        if magic != SEEK_FOOTER_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError(f"{path} has no seek table with checksums")
        table = size - 9 - 12 * n_frames
        handle.seek(table)
        entries = np.frombuffer(handle.read(12 * n_frames), "<u4").reshape(-1, 3).astype(np.int64)
        at = np.cumsum(entries[:, 0]) - entries[:, 0]
        handle.seek(int(at[-1]) + 8)
        index = handle.read(int(entries[-1, 0]) - 8)
        (n,) = struct.unpack_from("<Q", index)
        ids, valid = np.frombuffer(index, "<i8", n, 8), np.frombuffer(index, "u1", n, 8 + 8 * n).astype(bool)
        frame = np.frombuffer(index, "<u4", n, 8 + 9 * n)
        keys = [i if v else None for i, v in zip(ids.tolist(), valid.tolist(), strict=True)]
        out: dict[int | None, list[np.ndarray]] = {}
        for k in sorted({int(f) for key, f in zip(keys, frame, strict=True) if key in wanted}):
            d, v, lengths, tokens = unpack_frame(read_frame(handle, int(at[k]), int(entries[k, 0]), int(entries[k, 2])))
            ends = np.cumsum(lengths.astype(np.int64))
            for doc, ok, a, b in zip(d.tolist(), v.tolist(), (ends - lengths).tolist(), ends.tolist(), strict=True):
                if (doc if ok else None) in wanted:
                    out.setdefault(doc if ok else None, []).append(tokens[a:b])
        return out


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    """Write all documents as token files in the shared folder and read them back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, scratch_path(spark, "token-files")))
