"""WARC archives of dictionary-compressed records.

Every page becomes a WARC 1.1 record. Of pages with equal payloads the one with
the smallest id is a ``response``; the others are ``revisit`` records that name
it and carry its HTTP header without the payload. A file begins with a skippable
frame that holds a Zstandard dictionary, trained once on a bounded sample of the
records; then follow a ``warcinfo`` record and the pages' records, each a
Zstandard frame of its own made with that dictionary, so a reader that has the
first frame can decompress any record alone. A manifest lists runs of records
(file, position, size), by which tasks share a file's reading.

Equal payloads are found by their SHA-1 and length. Payloads that more than
``HEAVY_SHARE`` of the pages have, of which there are at most 1 / ``HEAVY_SHARE``,
are joined as a broadcast, so their pages stay spread over all tasks; the others
meet by a shuffle on the digest.

Defined cases: a null html is an empty payload; a page without an id is later
than those with one; of pages that repeat an id and a payload one is the
response; a page without a url has ``urn:page:`` and its id for one, and control
characters and spaces of a url are percent-encoded; an empty table gives no file
and no row; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote
from uuid import NAMESPACE_URL, uuid5

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import ship, shuffle_parts, write_table
from orderlens.llm.token_files import file_system
from orderlens.session import scratch_path

#: The skippable frame that holds a file's dictionary, and the profile of revisits.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES = 112 << 10
#: The dictionary's sample: so many records, of so many bytes at most each.
SAMPLE_RECORDS = 2000
SAMPLE_RECORD_BYTES = 16 << 10
HEAVY_SHARE = 0.001
RUN_BYTES = 1 << 20
READ_BYTES = 4 << 10
MANIFEST = "path string, at long, size long, n_records long"
READ_BACK = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


# --- one record --------------------------------------------------------------------


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, row: int) -> str:
    """A UUID by name, the same when a task is run again."""
    return uuid5(NAMESPACE_URL, f"{page_id} {row}").urn


def target(url: str | None, page_id: int | None) -> str:
    """The url without characters that would end a header's line or value."""
    safe = "".join(quote(c) if c <= " " or c == "\x7f" else c for c in url or "")
    return safe or f"urn:page:{'' if page_id is None else page_id}"


def _lines(first: str, fields: list[tuple[str, object]]) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in fields if v is not None), "", ""]).encode()


def make_record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = _lines("WARC/1.1", [("WARC-Type", kind), *fields, ("Content-Length", len(block))])
    return head + block + b"\r\n\r\n"


def page_record(page: dict, date: str) -> bytes:
    """The record of a page: ``page_id``, ``row``, ``url``, ``payload``, ``digest``
    and, for a revisit, the first page's ``first_id`` and ``first_row``."""
    http = _lines("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", page["n_bytes"])])
    revisit = page["first_row"] is not None
    fields = [
        ("WARC-Record-ID", f"<{record_id(page['page_id'], page['row'])}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", target(page["url"], page["page_id"])),
        ("WARC-Payload-Digest", "sha1:" + page["digest"]),
        ("Content-Type", "application/http;msgtype=response"),
        ("X-Page-Id", page["page_id"]),
    ]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{record_id(page['first_id'], page['first_row'])}>"),
                   ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-Id", page["first_id"])]
    return make_record("revisit" if revisit else "response", fields, http if revisit else http + page["payload"])


def split_head(raw: bytes) -> tuple[str, dict[str, str], bytes]:
    """First line, fields and the rest of a WARC record or an HTTP message."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, rest


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block; raises on a record that is not whole."""
    version, fields, rest = split_head(raw)
    size = int(fields["content-length"])
    if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not one whole WARC record")
    return fields, rest[:size]


# --- dictionary ---------------------------------------------------------------------


def train_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary from sample records; too few of them give none."""
    total = sum(map(len, records))
    if len(records) < 8 or total < 8 << 10:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1 << 10, total // 8)), records).as_bytes()
    except zstandard.ZstdError:  # samples that have nothing in common
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def read_dictionary(handle) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """A file's dictionary, from its first frame, and where the records begin."""
    handle.seek(0)
    magic, size = struct.unpack("<II", handle.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the file does not begin with a dictionary")
    body = handle.read(size)
    return zstandard.ZstdCompressionDict(body) if body else None, 8 + size


# --- first pages ----------------------------------------------------------------------


def _keyed_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Pages with a number of their own and their payload's digest, written once
    (so that the numbers do not change when a task is run again)."""
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return write_table(rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("n_bytes", F.octet_length("html").cast("long")), "warc-pages")


def with_first(rows: DataFrame, least_bytes: int = 0, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Add ``first_id`` and ``first_row``: the page with the smallest id among
    those of equal payload, null for that page itself and for payloads under
    ``least_bytes``. Without ids, the one of the smallest row number."""
    rows = rows.withColumn("_long", F.col("n_bytes") >= least_bytes)
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row")
    first = (rows.where("_long").groupBy("sha", "n_bytes").agg(F.min(order).alias("first"), F.count("*").alias("n"))
             .where("n > 1").select("sha", "n_bytes", "n", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row")))
    first = write_table(first, "warc-firsts")
    heavy_from = max(2.0, heavy_share * rows.count())
    many, few = first.where(F.col("n") >= heavy_from).drop("n"), first.where(F.col("n") < heavy_from).drop("n")
    many = F.broadcast(many.withColumnsRenamed({"first_id": "_id", "first_row": "_row"}))  # at most 1 / heavy_share rows
    met = rows.join(many, ["sha", "n_bytes"], "left")
    spread = met.where(F.col("_row").isNotNull() | ~F.col("_long")).withColumns({"first_id": F.col("_id"), "first_row": F.col("_row")})
    rest = met.where(F.col("_row").isNull() & F.col("_long")).join(few, ["sha", "n_bytes"], "left")
    columns = ["row", "page_id", "url", "html", "sha", "n_bytes"]
    own = ~F.col("_long") | F.col("first_row").isNull() | (F.col("first_row") == F.col("row"))
    return spread.unionByName(rest).select(
        *columns, *[F.when(~own, F.col(c)).alias(c) for c in ("first_id", "first_row")])


# --- writing --------------------------------------------------------------------------


class _ArchiveWriter:
    """One file, moved to its final name when it is whole."""

    def __init__(self, folder: str, name: str, dictionary: bytes, level: int, date: str):
        self.fs, base = file_system(folder)
        self.fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        self.path, self.final = f"{folder.rstrip('/')}/{name}", f"{base.rstrip('/')}/{name}"
        self.temporary = f"{self.final}.{task.taskAttemptId() if task else 0}.tmp"
        self.out = self.fs.open_output_stream(self.temporary)
        own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=True, write_checksum=True)
        head = dictionary_frame(dictionary)
        self.out.write(head)
        self.at, self.runs, self.begin, self.n = len(head), [], len(head), 0
        info = _lines("software: orderlens", [("format", "WARC File Format 1.1")])
        self.add(make_record("warcinfo", [("WARC-Record-ID", f"<{record_id(None, task.partitionId() if task else 0)}>"), ("WARC-Date", date),
                                          ("Content-Type", "application/warc-fields")], info))

    def add(self, record: bytes) -> None:
        packed = self.compressor.compress(record)
        self.out.write(packed)
        self.at += len(packed)
        self.n += 1
        if self.at - self.begin >= RUN_BYTES:
            self.cut()

    def cut(self) -> None:
        if self.n:
            self.runs.append((self.path, self.begin, self.at - self.begin, self.n))
        self.begin, self.n = self.at, 0

    def close(self) -> list[tuple]:
        self.cut()
        self.out.close()
        self.fs.move(self.temporary, self.final)
        return self.runs


def _page(row: dict) -> dict:
    payload = row["html"].encode()
    return row | {"payload": payload, "digest": base64.b32encode(bytes.fromhex(row["sha"])).decode()}


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least_bytes: int = 0, level: int = 3, date: str | None = None) -> DataFrame:
    """Write all pages as archives in ``folder``; returns the manifest."""
    spark = pages.sparkSession
    ship(spark)
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    keyed = _keyed_pages(pages, id_col, url_col, html_col)
    rows = with_first(keyed, least_bytes)
    dictionary = train_dictionary([page_record(_page(r), date) for r in _sample(keyed).toArrow().to_pylist()])
    shared = spark.sparkContext.broadcast(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            for k in range(batch.num_rows):
                writer = writer or _ArchiveWriter(folder, f"part-{TaskContext.get().partitionId():06d}.warc.zst", shared.value, level, date)
                writer.add(page_record(_page({n: batch.column(n)[k].as_py() for n in batch.schema.names}), date))
        if writer:
            runs = list(zip(*writer.close(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(runs[0])] + [pa.array(r, pa.int64()) for r in runs[1:]], names=["path", "at", "size", "n_records"])

    return write_table(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def _sample(keyed: DataFrame) -> DataFrame:
    """The dictionary's sample: whole records of distinct payloads, in the order of
    their digests. Longer ones, which gain little from a dictionary, are not in it."""
    fit = keyed.where(F.col("n_bytes") <= SAMPLE_RECORD_BYTES).groupBy("sha").agg(F.min("row").alias("row"))
    few = F.broadcast(fit.orderBy("sha").limit(SAMPLE_RECORDS).select("row"))
    none = F.lit(None).cast("long")
    return keyed.join(few, "row").select(*keyed.columns, none.alias("first_id"), none.alias("first_row"))


# --- reading --------------------------------------------------------------------------


def records_of(handle, at: int, size: int, dictionary) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one run of frames."""
    handle.seek(at)
    data, begin = memoryview(handle.read(size)), 0
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while begin < len(data):
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            if begin >= len(data):
                raise ValueError("a record's frame is cut off")
            piece = data[begin : begin + READ_BYTES]
            parts.append(frame.decompress(piece))
            begin += len(piece)
        begin -= len(frame.unused_data)
        yield parse_record(b"".join(parts))


def read_file(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of a file, which needs nothing but itself."""
    fs, name = file_system(path)
    with fs.open_input_file(name) as handle:
        dictionary, at = read_dictionary(handle)
        yield from records_of(handle, at, handle.size() - at, dictionary)


def _digest_row(fields: dict[str, str], block: bytes) -> tuple | None:
    if fields["warc-type"] not in ("response", "revisit"):
        return None
    _, http, payload = split_head(block)
    number = lambda name: int(fields[name]) if name in fields else None
    stated = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (payload_digest(payload) != stated or len(payload) != int(http["content-length"])):
        raise ValueError(f"record {fields['warc-record-id']} does not hold the payload of its digest")
    return number("x-page-id"), int(http["content-length"]), stated, fields["warc-type"], number("x-refers-to-page-id")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every page's record, read from the files: page_id, payload_bytes,
    payload_digest, record_type, refers_to. Payloads are held against their digests."""
    ship(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_path = handle = dictionary = None
        for batch in batches:
            for run in batch.to_pylist():
                if run["path"] != open_path:
                    fs, name = file_system(run["path"])
                    open_path, handle = run["path"], fs.open_input_file(name)
                    dictionary, _ = read_dictionary(handle)
                seen = list(records_of(handle, run["at"], run["size"], dictionary))
                if len(seen) != run["n_records"]:
                    raise ValueError(f"{open_path} has other records than its manifest")
                rows = [row for fields, block in seen if (row := _digest_row(fields, block))]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in READ_BACK.split(", ")])

    return manifest.repartition(shuffle_parts(manifest.sparkSession), "path", "at").mapInArrow(read, READ_BACK)


def op13_warc(spark, sf_dir: str) -> DataFrame:
    """Write all pages as archives in the shared folder and read them back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(write_archives(pages, scratch_path(spark, "warc")))


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS nth,
    first(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS first_id
  FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN nth > 1 THEN first_id END AS refers_to
FROM p
"""
