"""Ranked lexical search by norm buckets (LEMP).

A document is a sparse vector of impacts over the terms of the items, an item
the vector of its terms' weights; a score is their inner product. A term's
weight is shared out evenly: item coordinates are sqrt(w), document coordinates
sqrt(w) x impact. Document vectors are ordered by length, longest first, and cut
into buckets. For an item that needs the score ``t`` to change its best
documents,

* a bucket is skipped if item length x longest document length is under ``t``
  (Cauchy-Schwarz), and so are all shorter ones;
* inside a bucket, the item's heaviest terms are its focus coordinates: a
  document's normalised coordinate has to lie in the interval that a cosine of
  ``t`` / (lengths) leaves open, and the focus coordinates' own share plus the
  most that the others can add has to reach that cosine;
* the documents that are left are scored exactly, in 64-bit integers.

All bounds are held against ``t`` with a margin for rounding and let ties pass.

The query set goes in blocks of a bounded number of terms; a block's terms,
weights and thresholds are what tasks are sent. For each block one pass reads
all texts whole and keeps the items' terms; the corpus statistics are sums over
its rows. The longest ``HEAD`` of the vectors are searched first; their k-th
best scores are the first thresholds of all other tasks and the least length
that the second scan reads.

Defined cases: a null text has no terms and counts in no statistic; documents
that repeat an id, and items that do, are rows of their own; a document without
an id ranks after those of equal score; an item without terms, or whose terms
no document has, gives no row; empty tables give empty results; extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import byte_class, documents, expand, prefix_hash, shuffle_parts, sliced, span_hash, text_buffer, word_segments, write_table

#: [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F] after lower-casing A-Z.
IN_WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Items and terms (with repeats between items) of one block of the query set; an item is never cut.
BLOCK_ITEMS = 4096
BLOCK_TERMS = 1 << 19
BUCKET = 1024
FOCUS = 5
HEAD = 1 / 64
SALTS = 64
MARGIN = 1 + 1e-9
COUNTED = "doc_id long, n long, terms array<int>, tfs array<long>"
VECTORS = "doc_id long, length double, terms array<int>, impacts array<int>"
FOUND = "item long, doc_id long, score long"


# --- terms ---------------------------------------------------------------------------


def counted_terms(texts: pa.Array, vocabulary: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and (text, term, times) for the terms of a sorted
    vocabulary, which are numbered, or for all, by their hashes."""
    data, offsets = text_buffer(texts)
    n = np.zeros(len(offsets) - 1, np.int64)
    rows, terms, times = [], [], []
    for part, starts, ends, row, _ in word_segments(data, offsets, IN_WORD):
        if not len(row):
            continue
        n += np.bincount(row, minlength=len(n))
        word = span_hash(prefix_hash(part), starts, ends)
        if vocabulary is not None:
            at = np.minimum(np.searchsorted(vocabulary, word), len(vocabulary) - 1)
            known = vocabulary[at] == word
            row, word = row[known], at[known].astype(np.uint64)
        rows.append(row)
        terms.append(word)
        times.append(np.ones(len(row), np.int64))
        if len(rows) > 8:  # a very long text
            rows, terms, times = ([x] for x in _summed(rows, terms, times))
    return n, *_summed(rows, terms, times)


def _summed(rows: list, terms: list, times: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, term, time = (np.concatenate([np.empty(0, k), *x]) for x, k in ((rows, np.int64), (terms, np.uint64), (times, np.int64)))
    order = np.lexsort((term, row))
    row, term, time = row[order], term[order], time[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    first = np.flatnonzero(new)
    return row[first], term[first], np.add.reduceat(time, first) if len(first) else time


def _lists(row: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    bounds = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, kind))


class Block:
    """A bounded part of the query set: its items, their terms, and the terms'
    numbers in the block's vocabulary."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = np.array([i for i, _ in items], np.int64)
        self.vocabulary, number = np.unique(np.concatenate([t for _, t in items]), return_inverse=True)
        self.terms = np.split(number, np.cumsum([len(t) for _, t in items])[:-1])

    def weigh(self, n_docs: int, n_terms: int, df: np.ndarray) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        self.root = np.sqrt(self.weight.astype(np.float64))
        self.terms = [t[np.argsort(-self.weight[t], kind="stable")] for t in self.terms]  # heaviest first
        self.length = np.array([np.sqrt(self.weight[t].sum()) for t in self.terms])

    def impacts(self, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
        m = 100 - 90 + (90 * n * self.n_docs) // max(1, self.n_terms)
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def item_blocks(benchmark: DataFrame, text_col: str) -> Iterator[Block]:
    """The query set, read through once, in blocks."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 1):
            _, row, term, _ = counted_terms(part.column(1), None)
            terms = _lists(row, part.num_rows, term.view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), terms], names=["item", "terms"])

    pending, size = [], 0
    rows = benchmark.select("item", F.col(text_col).cast("string").alias("text")).mapInArrow(split, "item long, terms array<long>").where("size(terms) > 0")
    for row in rows.toLocalIterator():
        terms = np.array(row["terms"], np.int64).view(np.uint64)
        if pending and (size + len(terms) > BLOCK_TERMS or len(pending) == BLOCK_ITEMS):
            yield Block(pending)
            pending, size = [], 0
        pending.append((row["item"], terms))
        size += len(terms)
    if pending:
        yield Block(pending)


# --- search --------------------------------------------------------------------------


class Best:
    """The k best documents so far of each item, and the score that one needs."""

    def __init__(self, block: Block, k: int, least: np.ndarray):
        self.k, self.least = k, np.maximum(least, 1)
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * len(block.items)

    def add(self, item: int, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        enough = score >= self.least[item]
        if not enough.any():
            return
        s, d, z = (np.concatenate([old, new[enough]]) for old, new in zip(self.found[item], (score, doc, null), strict=True))
        order = np.lexsort((d, z, -s))[: self.k]
        self.found[item] = s[order], d[order], z[order]
        if len(order) == self.k:
            self.least[item] = max(self.least[item], s[order[-1]])

    def batch(self, block: Block) -> pa.RecordBatch:
        sizes = [len(s) for s, _, _ in self.found]
        score, doc, null = (np.concatenate(x) for x in zip(*self.found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(block.items, sizes)), pa.array(doc, mask=null), pa.array(score)], names=["item", "doc_id", "score"])


class Bucket:
    """Document vectors of similar length, by document and by term."""

    def __init__(self, block: Block, docs: np.ndarray, null: np.ndarray, length: np.ndarray, bounds: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        self.block, self.docs, self.null, self.length, self.bounds, self.terms, self.impacts = block, docs, null, length, bounds, terms, impacts
        row = np.repeat(np.arange(len(docs)), np.diff(bounds))
        order = np.argsort(terms, kind="stable")
        self.by_term, self.row = terms[order], row[order]
        self.coordinate = (block.root[self.by_term] * impacts[order]) / length[self.row]
        self.longest = length.max()

    def candidates(self, item: int, least: int) -> np.ndarray:
        """Documents that the coordinate bounds leave open."""
        block, size = self.block, self.block.length[item]
        cosine = least / (size * self.longest * MARGIN)
        n, focus = len(self.docs), block.terms[item][:FOCUS]
        open_, share, own = np.ones(n, bool), np.zeros(n), np.zeros(n)
        q = block.root[focus] / size
        a, b = np.searchsorted(self.by_term, focus), np.searchsorted(self.by_term, focus, "right")
        room = np.sqrt(max(0.0, 1 - cosine * cosine))
        for f in range(len(focus)):
            p = np.zeros(n)
            p[self.row[a[f] : b[f]]] = self.coordinate[a[f] : b[f]]
            side = np.sqrt(max(0.0, 1 - q[f] * q[f])) * room
            open_ &= p >= q[f] * cosine - side - 1e-9
            if q[f] < cosine:
                open_ &= p <= q[f] * cosine + side + 1e-9
            share += q[f] * p
            own += p * p
        rest = np.sqrt(max(0.0, 1 - (q * q).sum()) * np.maximum(0.0, 1 - own))
        open_ &= (share + rest) * (self.length * size * MARGIN) + 1 >= least
        return np.flatnonzero(open_)

    def scores(self, item: int, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores of some documents. ``weight``: zeros for all terms, and again when it returns."""
        terms = self.block.terms[item]
        weight[terms] = self.block.weight[terms]
        lengths = self.bounds[rows + 1] - self.bounds[rows]
        at = expand(self.bounds[rows], lengths)
        running = np.zeros(len(at) + 1, np.int64)
        np.cumsum(weight[self.terms[at]] * self.impacts[at], out=running[1:])
        weight[terms] = 0
        ends = np.cumsum(lengths)
        return running[ends] - running[ends - lengths]


def search(block: Block, batches: Iterator[pa.RecordBatch], best: Best) -> None:
    """All vectors, which come longest first, against all items of the block."""
    weight = np.zeros(len(block.vocabulary), np.int64)
    for batch in batches:
        docs, length, terms, impacts = (batch.column(c) for c in range(4))
        bounds = np.asarray(terms.offsets).astype(np.int64)
        terms, impacts = np.asarray(terms.values), np.asarray(impacts.values).astype(np.int64)
        null, docs, length = np.asarray(docs.is_null()), np.asarray(docs.fill_null(0)), np.asarray(length)
        for lo in range(0, len(docs), BUCKET):
            hi = min(lo + BUCKET, len(docs))
            near = np.flatnonzero(block.length * length[lo:hi].max() * MARGIN + 1 >= best.least)
            if not len(near):
                continue
            a, b = bounds[lo], bounds[hi]
            bucket = Bucket(block, docs[lo:hi], null[lo:hi], length[lo:hi], bounds[lo : hi + 1] - a, terms[a:b], impacts[a:b])
            for item in near.tolist():
                rows = bucket.candidates(item, int(best.least[item]))
                if len(rows):
                    best.add(item, bucket.scores(item, rows, weight), bucket.docs[rows], bucket.null[rows])


def _found(vectors: DataFrame, block: Block, k: int, least: np.ndarray) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast((block, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, least = shared.value
        best = Best(block, k, least.copy())
        search(block, batches, best)
        yield best.batch(block)

    found = write_table(vectors.mapInArrow(run, FOUND), "lexical-found")
    return _ranked(_ranked(found, k, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), k)


def _ranked(found: DataFrame, k: int, *salt) -> DataFrame:
    """The k best of each item (of each salt)."""
    order = Window.partitionBy("item", *salt).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.select("item", "doc_id", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def _vectors(counted: DataFrame, block: Block) -> DataFrame:
    """Impact vectors, longest first over all files."""
    shared = counted.sparkSession.sparkContext.broadcast(block)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            doc, n, terms, tfs = (batch.column(c) for c in range(4))
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(terms.offsets)))
            terms = np.asarray(terms.flatten())
            impact = block.impacts(np.asarray(n)[row], np.asarray(tfs.flatten()))
            use = (block.weight[terms] > 0) & (impact > 0)
            row, terms, impact = row[use], terms[use], impact[use]
            length = np.sqrt(np.bincount(row, block.weight[terms] * impact.astype(np.float64) ** 2, batch.num_rows))
            yield pa.RecordBatch.from_arrays([doc, pa.array(length), _lists(row, batch.num_rows, terms, pa.int32()), _lists(row, batch.num_rows, impact, pa.int32())],
                                             names=[c.split()[0] for c in VECTORS.split(", ")])

    rows = counted.where("size(terms) > 0").mapInArrow(weigh, VECTORS).where("length > 0")
    order = (F.desc("length"), F.col("doc_id"))
    return write_table(rows.repartitionByRange(shuffle_parts(rows.sparkSession), *order).sortWithinPartitions(*order), "lexical-vectors")


def _block_best(docs: DataFrame, block: Block, k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(block.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 1):
            n, row, term, tf = counted_terms(part.column(1), vocabulary.value)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), _lists(row, part.num_rows, term.astype(np.int64), pa.int32()), _lists(row, part.num_rows, tf, pa.int64())],
                                             names=[c.split()[0] for c in COUNTED.split(", ")])

    counted = write_table(docs.select("_id", "_text").mapInArrow(count, COUNTED), "lexical-terms")
    total = counted.agg(F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(block.vocabulary), np.int64)
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()  # a row for each term of the block
    df[np.asarray(held.column("term"))] = np.asarray(held.column("df"))
    block.weigh(total["docs"], total["terms"], df)
    vectors = _vectors(counted, block)
    cut = vectors.agg(F.percentile_approx("length", 1 - HEAD, 1000).alias("cut")).first()["cut"]
    if cut is None:
        return spark.createDataFrame([], FOUND + ", rank int")
    none = np.zeros(len(block.items), np.int64)
    head = write_table(_found(vectors.where(F.col("length") >= cut), block, k, none), "lexical-head")
    least = none.copy()
    place = {item: x for x, item in enumerate(block.items.tolist())}
    for row in head.where(F.col("rank") == k).select("item", "score").toLocalIterator():  # one an item of the block
        least[place[row["item"]]] = row["score"]
    weighty = block.length > 0
    shortest = float(((least - 1)[weighty] / (block.length[weighty] * MARGIN)).min(initial=np.inf))  # no shorter vector reaches any threshold
    tail = vectors.where((F.col("length") < cut) & (F.col("length") >= shortest))
    return write_table(_ranked(head.unionByName(_found(tail, block, k, least)), k), "lexical-best")


def search_items(docs: DataFrame, benchmark: DataFrame, k: int = 10, doc_id_col: str = "doc_id", doc_text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The k highest-scoring documents of every item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    corpus = documents(docs, doc_id_col, doc_text_col)
    items = write_table(documents(benchmark, item_id_col, item_text_col).withColumnsRenamed({"_row": "item", "_id": "item_id"}), "lexical-items")
    out = spark.createDataFrame([], FOUND + ", rank int")
    for block in item_blocks(items, "_text"):
        out = out.unionByName(_block_best(corpus, block, k))
    return out.join(items.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return search_items(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT CAST(count(*) FILTER (WHERE len(w) > 0) AS BIGINT) AS n_docs, CAST(coalesce(sum(len(w)), 0) AS BIGINT) AS n_terms FROM d),
i AS (SELECT DISTINCT q, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark)),
t AS (
  SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM i) GROUP BY r, term),
f AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, s GROUP BY term),
m AS (SELECT r, doc_id, 100 - 90 + (90 * CAST(len(w) AS BIGINT) * n_docs) // n_terms AS m FROM d, s WHERE len(w) > 0),
c AS (
  SELECT q, item_id, r, any_value(doc_id) AS doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM i JOIN f USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY q, item_id, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM c WHERE score > 0) WHERE rank <= 10
"""
