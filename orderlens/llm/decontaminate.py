"""Benchmark decontamination by winnowing.

Texts are word sequences. Over every ``WINDOW`` = 13 consecutive words there
are ``WINDOW - GRAM + 1`` = 6 grams of 8 words; the smallest of their hashes
(the last one of equal ones) is kept as a fingerprint. Two equal windows keep
the same gram, so each shared span of 13 words or more has a common
fingerprint. Fingerprints of documents and items are joined, and each meeting
is extended word by word, on the words themselves, into the shared span.
An item of fewer than 13 words is one window, its own gram and fingerprint.

Before the join, document fingerprints pass a bitmap of fixed size made from
the items' fingerprints; it lets some others pass, and the join removes them.

Defined cases: null texts have no words; a document without words is clean; an
item without words never occurs; items without an id count as hits but aren't
listed; repeated documents and items are rows of their own, an item_id is
counted once; empty tables give empty results or clean documents; extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import U64, byte_class, documents, mix, prefix_hash, ship, span_hash, text_buffer, whole_rows, word_segments, write_table

WINDOW = 13
GRAM = 8
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing: digits, a-z, all beyond ASCII.
IN_WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
BITMAP_BITS = 1 << 23
#: Item fingerprints are broadcast up to this size of their rows, else shuffled.
BROADCAST_BYTES = 16 << 20
SALTS = 32
FOUND = "_row long, doc_id long, n_words long, fp long, gram int, pos long, before int, words string"


def winnow(grams: np.ndarray, row: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Positions of the fingerprints: the least gram hash, the last of equal
    ones, of each window of words that lies in one row."""
    n, width = len(grams) - window + 1 + (gram - 1), window - gram + 1
    n = min(n, len(row) - window + 1)
    if n <= 0:
        return np.empty(0, np.int64)
    least, at = grams[:n].copy(), np.arange(n)
    for j in range(1, width):
        later = grams[j : j + n]
        take = later <= least
        least[take] = later[take]
        at[take] = np.flatnonzero(take) + j
    return np.unique(at[row[:n] == row[window - 1 : window - 1 + n]])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, marked with k."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    prefix = prefix_hash(words)
    starts = np.arange(len(words) - k + 1)
    return mix(span_hash(prefix, starts, starts + k), k)


def _rows(found: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    kind = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    columns = list(zip(*found, strict=True)) if found else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kind[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _signed(x: np.ndarray) -> list[int]:
    return x.astype(np.int64).tolist()


def item_fingerprints(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all items, with the words around each."""
    ship(benchmark.sparkSession)
    schema = "fp long, gram int, item_id string, before int, words string"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for part, starts, ends, row, _ in word_segments(*text_buffer(batch.column(1)), IN_WORD, overlap=2 * WINDOW):
                hashes = span_hash(prefix_hash(part), starts, ends)
                for r in np.unique(row).tolist():
                    a, b = np.searchsorted(row, [r, r + 1]).tolist()
                    words = [part[x:y].tobytes().decode() for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                    gram = min(GRAM, b - a) if b - a >= WINDOW else b - a
                    grams = gram_hashes(hashes[a:b], gram)
                    at = winnow(grams, row[a:b], WINDOW, GRAM) if b - a >= WINDOW else np.zeros(1, np.int64)
                    side = WINDOW - GRAM if b - a >= WINDOW else 0
                    for p, h in zip(at.tolist(), _signed(grams[at]), strict=True):
                        lo = max(0, p - side)
                        out.append((h, gram, ids[r], p - lo, " ".join(words[lo : p + gram + side])))
            yield _rows(out, schema)

    return benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(make, schema)


def bitmap(fingerprints: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of fixed size: at most ``bits / 64`` words reach the driver."""
    bit = F.col("fp").bitwiseAND(F.lit(bits - 1))
    word = F.shiftright(bit, 6)
    one = F.expr(f"shiftleft(1L, cast((fp & {bits - 1}) & 63 as int))")
    out = np.zeros(bits // 64, np.int64)
    for row in fingerprints.groupBy(word.alias("w")).agg(F.bit_or(one).alias("m")).collect():
        out[row["w"]] = row["m"]
    return out.view(np.uint64)


def _document_fingerprints(df: DataFrame, grams: list[int], bits, id_col: str, text_col: str) -> DataFrame:
    """A row for each document (fp null) and one for each fingerprint that
    passes the bitmap, with up to five words before and after it."""
    short = [k for k in grams if k != -GRAM]
    long = -GRAM in grams

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = bits.value
        mask = U64(len(words_of) * 64 - 1)

        def passes(h: np.ndarray) -> np.ndarray:
            at = h & mask
            return (words_of[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1

        for batch in batches:
            rows, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            n_words = np.zeros(len(rows), np.int64)
            out = []
            for part, starts, ends, row, number in word_segments(*text_buffer(batch.column(2)), IN_WORD, overlap=3 * WINDOW):
                if not len(row):
                    continue
                np.maximum.at(n_words, row, number + 1)
                hashes = span_hash(prefix_hash(part), starts, ends)
                for gram, at, side in _candidates(hashes, row, short, long, passes):
                    lo = np.maximum(at[0] - side, np.searchsorted(row, row[at[0]]))
                    hi = np.minimum(at[0] + gram + side, np.searchsorted(row, row[at[0]], "right"))
                    for p, h, x, y in zip(at[0].tolist(), _signed(at[1]), lo.tolist(), hi.tolist(), strict=True):
                        text = " ".join(part[s:e].tobytes().decode() for s, e in zip(starts[x:y].tolist(), ends[x:y].tolist(), strict=True))
                        out.append((rows[row[p]], None, None, h, gram, int(number[p]), p - x, text))
            out += [(r, i, n, None, None, None, None, None) for r, i, n in zip(rows, ids, n_words.tolist(), strict=True)]
            yield _rows(out, FOUND)

    return documents(df, id_col, text_col).mapInArrow(make, FOUND)


def _candidates(hashes, row, short, long, passes):
    if long:
        grams = gram_hashes(hashes, GRAM)
        at = winnow(grams, row, WINDOW, GRAM)
        at = at[passes(grams[at])]
        yield GRAM, (at, grams[at]), WINDOW - GRAM
    for k in short:
        grams = gram_hashes(hashes, k)
        at = np.flatnonzero(passes(grams))
        at = at[row[at] == row[at + k - 1]]
        yield k, (at, grams[at]), 0


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Extend meetings of fingerprints; those that reach a window are spans."""
    for batch in batches:
        out = []
        for m in batch.to_pylist():
            d, i, gram = m["words"].split(" "), m["item_words"].split(" "), m["gram"]
            x, y = m["before"], m["item_before"]
            if d[x : x + gram] != i[y : y + gram]:
                continue
            left = right = 0
            while left < min(x, y) and d[x - left - 1] == i[y - left - 1]:
                left += 1
            while right < min(len(d) - x, len(i) - y) - gram and d[x + gram + right] == i[y + gram + right]:
                right += 1
            if left + gram + right >= WINDOW or m["item_short"]:
                out.append((m["_row"], m["pos"] - left, m["pos"] + gram + right, m["item_id"]))
        yield _rows(out, "_row long, start long, stop long, item_id string")


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Per document: doc_id, n_words, n_hit, n_items, items, contaminated; and
    the spans (``_row``, start, stop, item_id) that it rests on."""
    spark = df.sparkSession
    items = write_table(item_fingerprints(benchmark, item_col, text_col), "item-fingerprints")
    # an item's own gram of 8 words differs from a window's gram of 8 words
    short_item = F.size(F.split("words", " ")) == F.col("gram")
    items = items.withColumn("item_short", short_item)
    shape = items.agg(F.collect_set(F.when(F.col("item_short"), F.col("gram")).otherwise(-GRAM)).alias("grams"),
                      F.coalesce(F.sum(F.length("words") + 64), F.lit(0)).alias("bytes")).first()
    bits = spark.sparkContext.broadcast(bitmap(items))
    found = write_table(_document_fingerprints(df, sorted(shape["grams"]), bits, id_col, text_col), "fingerprints")

    right = items.select("fp", "gram", "item_id", F.col("before").alias("item_before"), F.col("words").alias("item_words"), "item_short")
    left = found.where("fp is not null").select("_row", "fp", "gram", "pos", "before", "words")
    if shape["bytes"] <= broadcast_bytes:
        met = left.join(F.broadcast(right), ["fp", "gram"])
    else:  # spread a fingerprint that many documents share
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
        met = left.withColumn("_salt", F.pmod(F.hash("_row", "pos"), F.lit(SALTS))).join(right.select("*", salts), ["fp", "gram", "_salt"]).drop("_salt")
    spans = write_table(met.mapInArrow(_shared, "_row long, start long, stop long, item_id string").distinct(), "shared-spans")

    by_start = Window.partitionBy("_row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("stop").over(by_start), F.lit(0))
    hit = (spans.select("_row", "start", "stop").distinct()
           .select("_row", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", reach)).alias("n"))
           .groupBy("_row").agg(F.sum("n").alias("n_hit")))
    listed = (spans.where("item_id is not null").select("_row", "item_id").distinct()
              .groupBy("_row").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("items")))
    result = (found.where("fp is null").select("_row", "doc_id", "n_words").join(hit, "_row", "left").join(listed, "_row", "left")
              .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items")))
    return result.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))), spans


def remove_contaminated(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The clean documents, with all columns. A document's fate depends on its
    text alone, so rows are matched by id and text hash."""
    docs = df.select(whole_rows(df).alias("whole"), F.col("text"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("key"))
    verdicts, _ = contamination(docs.select(F.col("key").alias("doc_id"), "text"), benchmark)
    found = verdicts.where("contaminated").select(F.col("doc_id").alias("key")).distinct()
    return docs.select("whole", "key").join(found, "key", "left_anti").select("whole.*")


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contamination of all documents by all benchmark items."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    result, _ = contamination(docs, benchmark)
    return result.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
h AS (SELECT doc_id, k, s, item_id FROM dw JOIN iw USING (k, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM h) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
