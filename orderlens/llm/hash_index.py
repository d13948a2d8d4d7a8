"""Nearest neighbours by multi-index hashing.

Vectors get binary codes of 64 bits: principal directions of a bounded sample,
turned by a learned rotation (iterative quantisation), and the signs. A code is
split into 8 substrings of 8 bits, each indexed by its value. If two codes
differ in at most R bits, some substring differs in at most R // 8 (pigeonhole),
so probing the values near each substring of a query finds every code within R;
the codes found are held against R, and the vectors that pass are ranked by
their true distance. R is learned from the sample: the distance in bits within
which 98 of 100 nearest neighbours of sample vectors lie. Queries that find too
few neighbours search once more with R = 64, that is exactly.

The index is cut into blocks of vectors by id hash and the stated query set into
blocks of queries; each pair of blocks is searched alone and gives at most k
rows a query. So no vector, however often it occurs, makes a large group.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, nor do those without an id or of another length than
most; of rows that repeat an id the least vector counts; with fewer than k
candidates all are returned; ties go to the smaller id; empty tables give empty
results; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import expand, ship, write_table

BITS, PARTS = 64, 8
SAMPLE = 8000
SAMPLE_QUERIES = 200
COVER = 0.98
INDEX_BLOCK = 8192
QUERY_BLOCK = 16384
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_DISTANCE = _POP[np.arange(256)[:, None] ^ np.arange(256)]
FOUND = "query_id long, vec_id long, score double"


class Coder:
    """Centre, rotated directions and search radius, learned from a sample."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 13):
        r = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.centre = sample.mean(axis=0)
        x = sample - self.centre
        _, directions = np.linalg.eigh(x.T @ x)
        directions = directions[:, ::-1][:, :BITS]
        if dim < BITS:  # more bits than dimensions: random directions on top
            directions = np.concatenate([directions, np.linalg.qr(r.normal(size=(BITS, BITS)))[0][:dim, : BITS - dim]], axis=1)
        v = x @ directions
        rotation = np.linalg.qr(r.normal(size=(BITS, BITS)))[0]
        for _ in range(30):
            u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
            rotation = (u @ w).T
        self.directions = directions @ rotation
        self.radius = self._radius(sample, k)

    def code(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.centre) @ self.directions >= 0, axis=1)

    def _radius(self, sample: np.ndarray, k: int) -> int:
        codes, bits = self.code(sample), []
        for q in range(0, len(sample), max(1, len(sample) // SAMPLE_QUERIES)):
            d = ((sample - sample[q]) ** 2).sum(axis=1)
            d[q] = np.inf
            near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
            bits.append(_DISTANCE[codes[near], codes[q]].sum(axis=1))
        bits = np.concatenate(bits) if bits else np.empty(0)
        return int(np.ceil(np.quantile(bits, COVER))) if len(bits) else BITS


class BlockIndex:
    """Codes of one block: for each substring, the vectors in order of its value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(PARTS)]
        self.bounds = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All vectors whose code differs in at most ``radius`` bits."""
        hit = np.zeros(len(self.codes), bool)
        for j in range(PARTS):
            values = np.flatnonzero(_DISTANCE[code[j]] <= radius // PARTS)
            at = expand(self.bounds[j][values], np.diff(self.bounds[j])[values])
            hit[self.order[j][at]] = True
        found = np.flatnonzero(hit)
        return found[_DISTANCE[self.codes[found], code].sum(axis=1, dtype=np.int64) <= radius]


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block; of rows that repeat an id the least vector."""
    ids = table.column("vec_id").combine_chunks().to_numpy(zero_copy_only=False)
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(ids):
        return ids, np.empty((0, 0))
    x = flat.reshape(len(ids), -1)
    order = np.lexsort((*x.T[::-1], ids))
    ids, x = ids[order], x[order]
    first = np.append(True, ids[1:] != ids[:-1])
    return ids[first], x[first]


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``vector`` of the rows that take part."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null")
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(finite & F.exists("vector", lambda v: v != 0))
    size = rows.groupBy(F.size("vector").alias("s")).count().orderBy(F.desc("count"), "s").select("s").first()
    return rows.where(F.size("vector") == (size["s"] if size else 0))


def nearest(df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", radius: int | None = None) -> DataFrame:
    """The ``k`` nearest of every query row (``is_query`` of its id) among all
    other rows: query_id, rank, vec_id, score."""
    rows = usable(df, id_col, vector_col)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "vector").toArrow()
    _, x = _vectors(sample)
    spark = df.sparkSession
    if len(x) < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    coder = Coder(x, k)
    shared = spark.sparkContext.broadcast(coder)
    total = rows.count()
    n_index, n_query = -(-total // INDEX_BLOCK), max(1, -(-rows.where(is_query(F.col("vec_id"))).count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_index)).cast("int")
    index = rows.select("vec_id", "vector", block.alias("block"))
    if n_query > 1:
        index = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))
    else:
        index = index.withColumn("part", F.lit(0))

    def search(queries: DataFrame, bits: int) -> DataFrame:
        part = F.pmod(F.hash("vec_id"), F.lit(n_query)).cast("int")
        sent = queries.select("vec_id", "vector", F.explode(F.sequence(F.lit(0), F.lit(n_index - 1))).alias("block"), part.alias("part"))

        def one(left: pa.Table, right: pa.Table) -> pa.Table:
            ids, x = _vectors(left)
            q_ids, q = _vectors(right)
            out = []
            if len(ids) and len(q_ids):
                model = shared.value
                own, codes = BlockIndex(model.code(x)), model.code(q)
                for i, name in enumerate(q_ids.tolist()):
                    found = own.within(codes[i], bits)
                    found = found[ids[found] != name]
                    d = np.sqrt(((x[found] - q[i]) ** 2).sum(axis=1))
                    best = np.lexsort((ids[found], d))[:k]
                    out.append((np.full(len(best), name, np.int64), ids[found[best]], d[best]))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
            return pa.table([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

        return index.groupBy("block", "part").cogroup(sent.groupBy("block", "part")).applyInArrow(one, FOUND)

    queries = rows.where(is_query(F.col("vec_id")))
    found = write_table(search(queries, coder.radius if radius is None else radius), "neighbours")
    enough = found.groupBy(F.col("query_id").alias("vec_id")).count().where(F.col("count") >= min(k, total - 1)).select("vec_id")
    short = write_table(queries.join(enough, "vec_id", "left_anti"), "short-queries")
    if short.limit(1).count():
        found = found.union(write_table(search(short, BITS), "neighbours")).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_hash_index(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector whose id is divisible by 100."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 100 == 0)
