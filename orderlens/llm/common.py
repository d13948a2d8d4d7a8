"""Helpers shared by the operators: text buffers, hashes, scratch tables, blob routing.

Text work runs on the UTF-8 bytes that Arrow already holds: a batch's text
column is one contiguous buffer, so words, hashes and windows are array
expressions over it, in segments of bounded size.
"""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from pathlib import Path
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import orderlens
from orderlens.session import delete_folder, release_shuffles, scratch_path

SEGMENT_BYTES = 2 << 20
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_POWERS: dict[str, np.ndarray] = {}


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """The two columns an operator reads, as ``(_row, _id, _text)``; the row
    number from ``row_col`` if the rows have one.

    Every input row is a document of its own, also when ids or whole rows
    repeat; ``_row`` tells them apart. Other columns are left out here, so
    their names cannot clash with an operator's own."""
    ship(df.sparkSession)
    return df.select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("_row"),
        F.col(id_col).cast("long").alias("_id"),
        F.col(text_col).cast("string").alias("_text"),
    )


def whole_rows(df: DataFrame) -> Column:
    """All columns of a caller's frame as one, so that their names cannot clash with an operator's own."""
    return F.struct(*[F.col("`{}`".format(c.replace("`", "``"))) for c in df.columns])


def ship(spark) -> None:
    """Let Spark hand this package to its Python workers (as --py-files does),
    once an application, so they can import it wherever they run."""
    sc = spark.sparkContext
    if _SHIPPED.get("app") == sc.applicationId:
        return
    package = Path(orderlens.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="orderlens-package-")) / "orderlens.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _SHIPPED["app"] = sc.applicationId


_SHIPPED: dict[str, str] = {}


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts the lineage, is
    computed once and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    for scope in _SCOPES:
        scope.append(path)
    return out


def write_bucketed(df: DataFrame, name: str, n_buckets: int, key: str = "block") -> DataFrame:
    """``write_table`` in buckets of ``key``: a join on it moves only the other side."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.option("compression", "zstd").option("path", path).bucketBy(n_buckets, key).saveAsTable(table, format="parquet")
    out = spark.read.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name only, the files stay
    _WRITTEN[out] = path
    for scope in _SCOPES:
        scope.append(path)
    return out


_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


_SCOPES: list[list[str]] = []


def drop_table(table: DataFrame) -> None:
    """Delete what ``write_table`` wrote, when no later step reads it."""
    delete_folder(table.sparkSession, _WRITTEN.pop(table))


def last_table_only(spark, write) -> DataFrame:
    """Call ``write``, which writes tables and returns the last of them, and
    delete the others: the last one's rows need no other table any more."""
    _SCOPES.append([])
    try:
        last = write()
    finally:
        written = _SCOPES.pop()
    for folder in written:
        if folder != _WRITTEN.get(last):
            delete_folder(spark, folder)
    release_shuffles(spark)
    return last


def give_back() -> None:
    """Return a worker's freed memory to the system: a worker that goes on with the
    next block or task, or waits for one, would keep it, and an executor has several."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def shuffle_parts(spark) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# --- text buffers -----------------------------------------------------------------


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, max_bytes: int = SEGMENT_BYTES):
    """Ranges of rows with at most ``max_bytes`` of text, or one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def sliced(batches, column: int, max_bytes: int = SEGMENT_BYTES // 2):
    """Arrow batches in slices with at most ``max_bytes`` of one text column, or one row."""
    for batch in batches:
        if batch.num_rows:
            for lo, hi in row_slices(text_buffer(batch.column(column))[1], max_bytes):
                yield batch.slice(lo, hi - lo)


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return _LOWER[data]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


def word_spans(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray):
    """Start, end and row of every maximal run of word bytes; rows part words."""
    inside = in_word[data]
    n = len(inside)
    if not n:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    opens[first] |= inside[first]
    closes[last] |= inside[last]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


# --- hashes -----------------------------------------------------------------------


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit finaliser."""
    x = x ^ U64(salt * 0xD6E8FEB86659FD93 & (2**64 - 1))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        inverse = U64(pow(int(_BASE), -1, 2**64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = U64(1)
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running polynomial hash of bytes or of 64-bit symbols (length + 1)."""
    symbols = _TABLE[values] if values.dtype == np.uint8 else values
    out = np.zeros(len(values) + 1, np.uint64)
    up, _ = _powers(len(values) + 1)
    np.cumsum(symbols * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the symbols in each span, the same wherever the span stands."""
    _, down = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def word_segments(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray, overlap: int = 0):
    """Words of lower-cased rows in segments of bounded size: ``(bytes, starts,
    ends, row, number)`` with each word's row and its number in the row. A row
    longer than a segment goes on in the next one, which repeats its last
    ``overlap`` words."""
    for lo, hi in row_slices(offsets):
        a, b = int(offsets[lo]), int(offsets[hi])
        if b - a <= 2 * SEGMENT_BYTES:
            part = ascii_lower(data[a:b])
            starts, ends, row = word_spans(part, offsets[lo : hi + 1] - a, in_word)
            number = numbered(row, hi - lo)
            yield part, starts, ends, row + lo, number
            continue
        begin, base = a, 0
        while True:  # one very long row
            end = min(begin + SEGMENT_BYTES, b)
            while end < b and in_word[data[end]]:
                end += 1
            part = ascii_lower(data[begin:end])
            starts, ends, row = word_spans(part, np.array([0, end - begin]), in_word)
            yield part, starts, ends, row + lo, np.arange(base, base + len(row))
            if end == b:
                break
            again = min(overlap, max(len(starts) - 1, 0))
            base += len(starts) - again
            begin = begin + int(starts[len(starts) - again]) if again else end


def numbered(rows: np.ndarray, n: int) -> np.ndarray:
    """How many entries of the same row stand before each; rows ascend below ``n``."""
    lengths = np.bincount(rows, minlength=n)
    return np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """True where a new value begins."""
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return new


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start + length."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


# --- routing of packed arrays -----------------------------------------------------


def routed(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts entries by bucket (stable), and the bucket bounds."""
    # few buckets in a small type, which numpy sorts by digits: a fraction of the time
    bucket = (mix(keys, 77) % U64(n_buckets)).astype(np.uint16 if n_buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n_buckets + 1))


def bucket_count(n_entries: int, per_bucket: int) -> int:
    """Buckets so that one holds about ``per_bucket`` entries, at any input size."""
    return max(1, -(-int(n_entries) // per_bucket))
