"""Hard negatives from Hilbert-ordered blocks with zone maps.

Vectors become integers, floor(256 x). They are ordered by label and, within a
label, along a Hilbert curve through the leading principal directions of a
bounded sample, and cut into blocks of ``BLOCK`` rows of one label. A block's
zone map is the least and greatest value of each dimension and the greatest
length. ``GROUP`` consecutive blocks are one Parquet row: zone maps and ids in
columns of their own, so that they are read without the vectors.

Interval arithmetic on an anchor and a zone map bounds the inner products of all
the block's rows. An anchor's positives can only lie in blocks of its label
whose greatest product reaches its fifth best of the block that it lies in
itself; the negatives of a positive only in blocks of other labels whose
interval meets the window from 80 % to 100 % of the positive's score. Groups
none of whose blocks are chosen are not read, nor are other blocks scored. All
of a chosen block's rows are scored, in integers; no row is left out otherwise.

Anchors go in chunks of ``CHUNK``. Tasks meet a chunk and a group at a time, the
groups of a chunk one after the other, and keep the best rows so far, by which
later blocks are judged; so a hot label or a vector that many rows share is
spread over its blocks, and a task holds a chunk, a group and k rows an anchor.

Defined cases: rows with a null label, a null vector, or a null or non-finite
component take no part, nor do those without an id; components are cut off at
2^62 in size; a shorter vector counts as 0 in the dimensions that it lacks; rows
that repeat an id are rows of their own, also as anchors; ties go to the smaller
id; a positive with a score below 0 has an empty window; empty tables give empty
results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import ship, shuffle_parts, write_table
from orderlens.session import scratch_path

SCALE = 256
BLOCK = 256
GROUP = 16
CHUNK = 1024
#: Rows whose principal directions the curve runs through, its dimensions and bits.
SAMPLE = 8000
CURVE_DIMS, CURVE_BITS = 8, 8
#: Anchors whose scores are held at a time, and groups of a chunk that a task takes in turn.
ANCHOR_STEP = 128
RUN_GROUPS = 64
POINTS = "uid long, vec_id long, label long, vector array<long>"
GROUPS = "blocks long, sizes binary, labels binary, low binary, high binary, far binary, ids binary, uids binary, vectors binary"
ANCHORS = "uid long, vec_id long, label long, vector binary, seed long"
CHUNKS = "chunk long, uids binary, ids binary, labels binary, vectors binary, least binary, windows binary"
NEED = "group long, chunk long, need binary"
PAIRS = "anchor long, place int, uid long, vec_id long, score long"
NONE = np.iinfo(np.int64).min


# --- the curve -----------------------------------------------------------------------


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of rows of cell numbers, each of ``bits`` bits
    (Skilling's transposed form: undo the turns from the highest bit down, Gray
    code, then deal the bits out by dimension)."""
    x, n = cells.astype(np.uint64).T.copy(), cells.shape[1]
    one = np.uint64(1)
    for shift in range(bits - 1, 0, -1):
        bit, below = one << np.uint64(shift), (one << np.uint64(shift)) - one
        for d in range(n):
            turned = (x[d] & bit) > 0
            swap = np.where(turned, np.uint64(0), (x[0] ^ x[d]) & below)
            x[0] = np.where(turned, x[0] ^ below, x[0] ^ swap)
            x[d] ^= swap
    for d in range(1, n):
        x[d] ^= x[d - 1]
    flips = np.zeros_like(x[0])
    for shift in range(bits - 1, 0, -1):
        flips ^= np.where((x[n - 1] >> np.uint64(shift)) & one > 0, (one << np.uint64(shift)) - one, np.uint64(0))
    x ^= flips
    key = np.zeros_like(x[0])
    for shift in range(bits - 1, -1, -1):
        for d in range(n):
            key = (key << one) | ((x[d] >> np.uint64(shift)) & one)
    return key


class Curve:
    """Leading directions of a sample and the cuts of its coordinates into cells."""

    def __init__(self, sample: np.ndarray):
        self.dim = sample.shape[1]
        self.centre = sample.mean(axis=0)
        x = sample - self.centre
        _, directions = np.linalg.eigh(x.T @ x)
        self.directions = directions[:, ::-1][:, :CURVE_DIMS]
        cuts = np.linspace(0, 1, (1 << CURVE_BITS) + 1)[1:-1]
        self.cuts = np.quantile(x @ self.directions, cuts, axis=0)

    def key(self, vectors: np.ndarray) -> np.ndarray:
        x = (fitted(vectors, self.dim) - self.centre) @ self.directions
        cells = np.stack([np.searchsorted(self.cuts[:, d], x[:, d]) for d in range(x.shape[1])], axis=1)
        return hilbert_key(cells, CURVE_BITS).view(np.int64) ^ np.int64(NONE)  # unsigned order


def fitted(x: np.ndarray, dim: int) -> np.ndarray:
    """Rows with exactly ``dim`` columns."""
    return x[:, :dim] if x.shape[1] >= dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of a list column, zeros in the dimensions that a row lacks."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten())
    width = int(sizes.max(initial=0)) if dim is None else dim
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row[at < width], at[at < width]] = flat[at < width]
    return out


# --- products and their bounds --------------------------------------------------------


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows: by floating point where that is exact."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Zones:
    """Zone maps of a group's blocks."""

    def __init__(self, row: dict, dim: int):
        self.sizes, self.labels = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.low, self.high = (np.frombuffer(row[c], np.int64).reshape(-1, dim) for c in ("low", "high"))
        self.far = np.frombuffer(row["far"], np.float64)

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest product that each anchor can have with a row of each
        block: the sums over the dimensions, and no more than the lengths allow.
        In floating point, with a margin for its rounding."""
        a, low, high = (x.astype(np.float64) for x in (anchors, self.low, self.high))
        up, down = np.maximum(a, 0), np.minimum(a, 0)
        size = np.sqrt((a * a).sum(axis=1))[:, None] * self.far[None, :]
        slack = 1 + 1e-9 * size
        return np.maximum(up @ low.T + down @ high.T, -size) - slack, np.minimum(up @ high.T + down @ low.T, size) + slack


def needed(zones: Zones, chunk: Chunk) -> np.ndarray:
    """Anchors x blocks: which blocks an anchor has to read."""
    low, high = zones.bounds(chunk.vectors)
    same = chunk.labels[:, None] == zones.labels[None, :]
    if chunk.windows is None:  # positives
        return same & (high >= chunk.least[:, :1])
    out = np.zeros(same.shape, bool)
    for j in range(chunk.windows.shape[1]):
        score = chunk.windows[:, j]
        open_ = score >= 0
        floor = np.maximum(-(-80 * np.where(open_, score, 0) // 100), chunk.least[:, j])
        out |= open_[:, None] & (low <= score[:, None]) & (high >= floor[:, None])
    return out & ~same


class Chunk:
    """Anchors, the least score that each still has use for (for each of its
    windows), and the positives' scores (-1: none) that end the windows."""

    def __init__(self, row: dict, dim: int):
        self.uids, self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("uids", "ids", "labels"))
        self.vectors = np.frombuffer(row["vectors"], np.int64).reshape(-1, dim)
        n = len(self.uids)
        self.least = np.frombuffer(row["least"], np.int64).reshape(n, -1).copy()
        self.windows = np.frombuffer(row["windows"], np.int64).reshape(n, -1) if row["windows"] else None


class Best:
    """The k best rows so far of each anchor and window."""

    def __init__(self, chunk: Chunk, k: int):
        self.chunk, self.k = chunk, k
        self.rows = tuple(np.empty(0, np.int64) for _ in range(4))  # place of the anchor and window, score, id, uid

    def read(self, group: dict, zones: Zones, need: np.ndarray) -> None:
        """Score the rows of the chosen blocks; ``need``: anchors x blocks."""
        ids, uids = np.frombuffer(group["ids"], np.int64), np.frombuffer(group["uids"], np.int64)
        vectors = np.frombuffer(group["vectors"], np.int64).reshape(len(ids), -1)
        ends = np.cumsum(zones.sizes)
        for lo in range(0, len(need), ANCHOR_STEP):
            step = np.arange(lo, min(lo + ANCHOR_STEP, len(need)))
            blocks = np.flatnonzero(need[step].any(axis=0))
            if not len(blocks):
                continue
            rows = np.concatenate([np.arange(ends[b] - zones.sizes[b], ends[b]) for b in blocks])
            block = np.repeat(blocks, zones.sizes[blocks])
            score = products(self.chunk.vectors[step], vectors[rows])
            self._keep(step, score, need[step][:, block], ids[rows], uids[rows])

    def _keep(self, step: np.ndarray, score: np.ndarray, open_: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        chunk, windows = self.chunk, 1 if self.chunk.windows is None else self.chunk.windows.shape[1]
        found = [self.rows]
        for j in range(windows):
            use = open_ & (score >= chunk.least[step, j][:, None])
            if chunk.windows is not None:
                top = chunk.windows[step, j][:, None]
                use &= (score <= top) & (80 * top <= 100 * score) & (top >= 0)
            at, row = np.nonzero(use)
            own = uids[row] != chunk.uids[step[at]]
            at, row = at[own], row[own]
            found.append((step[at] * windows + j, score[at, row], ids[row], uids[row]))
        place, score, vec_id, uid = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((uid, vec_id, -score, place))
        place, score, vec_id, uid = place[order], score[order], vec_id[order], uid[order]
        nth = np.arange(len(place)) - np.searchsorted(place, place)
        kept = nth < self.k
        last = nth == self.k - 1  # the k-th best: a lesser score is of no more use
        chunk.least[place[last] // windows, place[last] % windows] = np.maximum(chunk.least[place[last] // windows, place[last] % windows], score[last])
        self.rows = place[kept], score[kept], vec_id[kept], uid[kept]

    def batch(self) -> pa.RecordBatch:
        place, score, vec_id, uid = self.rows
        windows = 1 if self.chunk.windows is None else self.chunk.windows.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(self.chunk.uids[place // windows]), pa.array((place % windows).astype(np.int32)), pa.array(uid), pa.array(vec_id), pa.array(score)],
                                          names=["anchor", "place", "uid", "vec_id", "score"])


# --- the index ------------------------------------------------------------------------


def _points(df: DataFrame, id_col: str, vector_col: str, label_col: str, relabel) -> DataFrame:
    """The rows that take part, numbered and as integers; written once."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"), F.col(label_col).cast("long").alias("label"))
    rows = rows.where("vec_id is not null and label is not null and x is not null")
    rows = rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    most = float(1 << 62)
    whole = F.transform("x", lambda v: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), v * float(SCALE)))).cast("long"))
    return write_table(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", relabel(F.col("vec_id"), F.col("label")).cast("long").alias("label"), whole.alias("vector")), "zone-points")


def _index(points: DataFrame, dim: int) -> DataFrame:
    """Groups of blocks, in the order of label and curve, in small row groups."""
    sample = points.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("vector").toArrow()
    curve = points.sparkSession.sparkContext.broadcast(Curve(matrix(sample.column("vector").combine_chunks(), dim).astype(np.float64)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = curve.value.key(matrix(batch.column("vector"), dim).astype(np.float64)) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], names=[*batch.schema.names, "key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[tuple] = []
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            uid, vec_id, label = (np.asarray(batch.column(c)) for c in ("uid", "vec_id", "label"))
            held.append((uid, vec_id, label, matrix(batch.column("vector"), dim)))
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            parts, rest = _split(columns)
            held = [rest]
            blocks += parts
            while len(blocks) >= GROUP:
                yield _group(blocks[:GROUP])
                blocks = blocks[GROUP:]
        if held and len(held[0][0]):
            blocks.append(tuple(held[0]))
        if blocks:
            yield _group(blocks)

    ordered = points.mapInArrow(place, POINTS + ", key long").repartitionByRange(shuffle_parts(points.sparkSession), "label", "key", "vec_id", "uid").sortWithinPartitions("label", "key", "vec_id", "uid")
    grouped = ordered.mapInArrow(cut, GROUPS)
    grouped = grouped.select(F.monotonically_increasing_id().alias("group"), "*")
    path = scratch_path(points.sparkSession, "zone-groups")
    grouped.write.option("compression", "zstd").option("parquet.block.size", 4 << 20).parquet(path)
    return points.sparkSession.read.schema(grouped.schema).parquet(path)


def _split(columns: list[np.ndarray]) -> tuple[list[tuple], tuple]:
    """Whole blocks of one label, and the rows after them."""
    label, parts, lo = columns[2], [], 0
    while lo < len(label):
        run = lo + int(np.searchsorted(label[lo:], label[lo], "right"))
        hi = min(lo + BLOCK, run)
        if hi == len(label) and hi - lo < BLOCK:
            break  # the next batch may go on with it
        parts.append(tuple(c[lo:hi] for c in columns))
        lo = hi
    return parts, tuple(c[lo:] for c in columns)


def _group(blocks: list[tuple]) -> pa.RecordBatch:
    vectors = [b[3] for b in blocks]
    far = [np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)).max() for v in vectors]
    values = [
        np.array([len(v) for v in vectors], np.int64), np.array([b[2][0] for b in blocks], np.int64),
        np.stack([v.min(axis=0) for v in vectors]), np.stack([v.max(axis=0) for v in vectors]), np.array(far),
        np.concatenate([b[1] for b in blocks]), np.concatenate([b[0] for b in blocks]), np.concatenate(vectors),
    ]
    return pa.RecordBatch.from_arrays([pa.array([len(blocks)], pa.int64())] + [pa.array([v.tobytes()], pa.binary()) for v in values],
                                      names=[c.split()[0] for c in GROUPS.split(", ")])


def _anchors(groups: DataFrame, dim: int, every: int, k: int) -> DataFrame:
    """Anchors with the k-th best score of the block that they lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], np.int64)
                ids, uids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["uids"], np.int64), np.frombuffer(row["labels"], np.int64)
                vectors = np.frombuffer(row["vectors"], np.int64).reshape(len(ids), dim)
                out = []
                for b, end in enumerate(np.cumsum(sizes).tolist()):
                    own = np.arange(end - sizes[b], end)
                    for i in own[ids[own] % every == 0].tolist():
                        score = np.sort(products(vectors[i : i + 1], vectors[own[own != i]])[0])
                        out.append((uids[i], ids[i], labels[b], vectors[i].tobytes(), score[-k] if len(score) >= k else NONE))
                if out:
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in columns[:3]] + [pa.array(columns[3], pa.binary()), pa.array(np.array(columns[4], np.int64))],
                                                     names=[c.split()[0] for c in ANCHORS.split(", ")])

    return write_table(groups.select("sizes", "labels", "ids", "uids", "vectors").mapInArrow(run, ANCHORS), "zone-anchors")


def _chunks(anchors: DataFrame, n_chunks: int, k: int) -> DataFrame:
    """Anchors in chunks; ``windows`` (array of scores) only in the second round."""
    second = "windows" in anchors.columns

    def pack(table: pa.Table) -> pa.Table:
        number = table.column("chunk")[0].as_py()
        uids, ids, labels = (np.asarray(table.column(c)).astype(np.int64) for c in ("uid", "vec_id", "label"))
        vectors = b"".join(table.column("vector").to_pylist())
        windows = matrix(table.column("windows").combine_chunks()).astype(np.int64) if second else None
        least = np.full(windows.shape, NONE) if second else np.asarray(table.column("seed")).reshape(-1, 1)
        row = [number, uids.tobytes(), ids.tobytes(), labels.tobytes(), vectors, least.tobytes(), windows.tobytes() if second else None]
        kinds = [pa.int64(), *[pa.binary()] * 6]
        return pa.table([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in CHUNKS.split(", ")])

    chunk = F.pmod(F.xxhash64("uid"), F.lit(n_chunks)).alias("chunk")
    return write_table(anchors.select("*", chunk).groupBy("chunk").applyInArrow(pack, CHUNKS), "zone-chunks")


def _search(groups: DataFrame, chunks: DataFrame, n_chunks: int, dim: int, k: int) -> DataFrame:
    """Rows of the chosen blocks that are among their task's k best of an anchor's window."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                need = needed(Zones(row, dim), Chunk(row["chunk_row"], dim))
                if need.any():
                    yield pa.RecordBatch.from_arrays([pa.array([row["group"]], pa.int64()), pa.array([row["chunk_row"]["chunk"]], pa.int64()), pa.array([np.packbits(need).tobytes()], pa.binary())],
                                                     names=["group", "chunk", "need"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for k_row in range(batch.num_rows):
                row = {c: batch.column(c)[k_row].as_py() for c in batch.schema.names}
                if best is None or best[0] != row["chunk"]:
                    if best:
                        yield best[1].batch()
                    best = row["chunk"], Best(Chunk(row["chunk_row"], dim), k)
                zones, chunk = Zones(row, dim), best[1].chunk
                shape = (len(chunk.uids), len(zones.sizes))
                need = np.unpackbits(np.frombuffer(row["need"], np.uint8), count=shape[0] * shape[1]).reshape(shape).astype(bool)
                need &= needed(zones, chunk)  # by what the blocks before have shown
                best[1].read(row, zones, need)
        if best:
            yield best[1].batch()

    maps = groups.select("group", "sizes", "labels", "low", "high", "far")
    parcel = chunks.select("chunk", F.struct(*chunks.columns).alias("chunk_row"))
    spread = maps.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)).cast("array<long>")))
    chosen = write_table(spread.join(parcel, "chunk").mapInArrow(choose, NEED), "zone-need")
    payload = groups.select("group", "sizes", "labels", "low", "high", "far", "ids", "uids", "vectors")
    run = F.floor(F.col("group") / RUN_GROUPS)
    met = chosen.join(payload, "group").join(parcel, "chunk")
    met = met.repartition(shuffle_parts(groups.sparkSession), "chunk", run).sortWithinPartitions("chunk", "group")
    return write_table(met.mapInArrow(read, PAIRS), "zone-pairs")


def _first(pairs: DataFrame, k: int) -> DataFrame:
    """The k first rows of each anchor and window."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id", "uid")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(df: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 5, relabel=None,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Hard negatives of every anchor (ids divisible by ``every``) and positive."""
    spark = df.sparkSession
    points = _points(df, id_col, vector_col, label_col, relabel or (lambda i, label: label))
    dim = points.agg(F.max(F.size("vector")).alias("dim")).first()["dim"]
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not dim:
        return empty
    groups = _index(points, dim)
    anchors = _anchors(groups, dim, every, n_positives)
    n_anchors = anchors.count()
    if not n_anchors:
        return empty
    n_chunks = -(-n_anchors // CHUNK)
    positives = write_table(_first(_search(groups, _chunks(anchors, n_chunks, n_positives), n_chunks, dim, n_positives), n_positives), "zone-positives")
    # the positives' scores in the order of their ranks; one that an anchor lacks counts as -1, an empty window
    scores = positives.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("rank", "score"))).alias("m"))
    ranks = [F.coalesce(F.try_element_at("m", F.lit(r)), F.lit(-1)) for r in range(1, n_positives + 1)]
    second = anchors.join(scores.select(F.col("anchor").alias("uid"), F.array(*ranks).alias("windows")), "uid")
    negatives = _first(_search(groups, _chunks(second, n_chunks, n_negatives), n_chunks, dim, n_negatives), n_negatives)
    of = positives.select("anchor", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = negatives.join(of, ["anchor", "place"]).join(ids, "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_zone_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of all vectors whose id is divisible by 100; every seventh label is moved by one first."""
    moved = lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), relabel=moved)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (
  SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, other AS positive_row FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other) <= 5)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.r, positive_row ORDER BY score DESC, vec_id, other) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.r = p.r AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.r, positive_row ORDER BY score DESC, vec_id, other) <= 5
"""
