"""Near-duplicate documents by ProbMinHash.

A document is its word shingles (five words; a shorter text is one shingle),
each weighted by how often it occurs. ProbMinHash: every shingle is a Poisson
process whose rate is its weight; each arrival goes to a random register, which
keeps the earliest one, and a process stops as soon as its next arrival is later
than all of the document's registers. Two documents agree in a register with
their probability Jaccard similarity. Bands of four registers make buckets of
candidates, and candidates are verified exactly on their shingles: a link is a
probability Jaccard, or a plain Jaccard of the shingle sets, of at least 0.8. A
text in which a shingle repeats has a second signature and bands, of the set
without weights (other texts' only signature is just that), so that pairs of
either similarity meet.

Work is done once for each distinct word sequence (its class of copies). In a
bucket, up to ``SMALL`` texts are compared with one another; in a larger one all
texts are compared with the text that stands in the most and largest buckets,
then those that are not yet connected with it with the next such one, and what
is left after ``ROUNDS`` of these is compared with every text of the bucket that
two sketches do not rule out: the 96 registers (below 0.59, five standard
deviations under the threshold) and the least hashes of 512 bins of the set
(below 0.71, five; together they lose no more than the bands); if a shingle repeats in one of the two, the registers
speak for one similarity and the bins for the other, and only both together rule it out. So no group is
paired out, and only texts about as alike as the threshold are compared.

Defined cases: null and empty texts are never duplicates; other texts without
words are copies if their bytes are equal; repeated rows are copies; ties go to
the smallest id, then to the first row; an empty table gives an empty result;
extra columns are not read (``keep_one`` returns them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import U64, documents, last_table_only, mix, prefix_hash, runs, sliced, span_hash, text_buffer, word_segments, write_table, whole_rows
from orderlens.llm.components import connected
from orderlens.llm.decontaminate import IN_WORD, bitmap, gram_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
SMALL = 8
ROUNDS = 1
LEAST_SKETCH = 0.59
BINS = 512
LEAST_BINS = 0.71
CHUNK = 256


# --- shingles and signatures -----------------------------------------------------------


def shingles(data: np.ndarray, offsets: np.ndarray):
    """Distinct shingles of every row: (row, hash, weight) sorted by row and
    hash; and each row's number of words and word-sequence hash."""
    n = len(offsets) - 1
    words, rows = [], []
    for part, starts, ends, row, _ in word_segments(data, offsets, IN_WORD):
        words.append(span_hash(prefix_hash(part), starts, ends))
        rows.append(row)
    words = np.concatenate(words) if words else np.empty(0, np.uint64)
    rows = np.concatenate(rows) if rows else np.empty(0, np.int64)
    bounds = np.searchsorted(rows, np.arange(n + 1))
    sequence = span_hash(prefix_hash(words), bounds[:-1], bounds[1:])
    grams = gram_hashes(words, SHINGLE)
    inside = np.flatnonzero(rows[: len(grams)] == rows[SHINGLE - 1 : SHINGLE - 1 + len(grams)]) if len(grams) else np.empty(0, np.int64)
    n_words = np.diff(bounds)
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    row = np.concatenate([rows[inside], short])
    gram = np.concatenate([grams[inside], mix(sequence[short], 99)])
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    begin = np.flatnonzero(runs(row) | runs(gram))
    return row[begin], gram[begin], np.diff(begin, append=len(row)), n_words, sequence


def prob_min_hash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, registers: int = REGISTERS) -> np.ndarray:
    """``(n_rows, registers)``: the element whose arrival came first in each
    register. All processes take their next arrival together; those past their
    row's latest register stop."""
    first = np.full(n_rows * registers, np.inf)
    winner = np.zeros(n_rows * registers, np.uint64)
    time = np.zeros(len(row))
    active, turn = np.arange(len(row)), 0
    while len(active):
        turn += 1
        h = mix(element[active], 2 * turn)
        time[active] -= np.log(((h >> U64(11)).astype(np.float64) + 0.5) / 2**53) / weight[active]
        slot = row[active] * registers + (mix(h, 1) % U64(registers)).astype(np.int64)
        early = np.flatnonzero(time[active] < first[slot])
        early = early[np.argsort(-time[active[early]], kind="stable")]  # the earliest is written last
        first[slot[early]] = time[active[early]]
        winner[slot[early]] = element[active[early]]
        alive = np.unique(row[active])
        latest = np.full(n_rows, -1.0)
        latest[alive] = first.reshape(n_rows, registers)[alive].max(axis=1)
        active = active[time[active] < latest[row[active]]]
    return winner.reshape(n_rows, registers)


SIGNED = "_row long, doc_id long, text_hash long, h1 long, h2 long, bands array<long>, sketch array<long>, bins array<long>, heavy boolean"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 2):
        data, offsets = text_buffer(batch.column(2))
        row, gram, weight, n_words, sequence = shingles(data, offsets)
        n = batch.num_rows
        own = _signatures(row, gram, weight, n)
        mixed = mix(own, 3)
        heavy = np.bincount(row, weight > 1, n) > 0
        plain, again = mixed.copy(), heavy[row]
        renumbered = (np.cumsum(heavy) - 1)[row[again]]
        plain[heavy] = mix(_signatures(renumbered, gram[again], np.ones(len(renumbered), np.int64), int(heavy.sum())), 3)
        keys = np.concatenate([_band_keys(mixed), _band_keys(plain)], axis=1)
        sketch = np.ascontiguousarray(mixed.astype(np.uint8)).view(np.int64)
        h1, h2 = sequence.astype(np.int64), mix(sequence ^ n_words.astype(np.uint64), 4).astype(np.int64)
        raw = batch.column(3).to_numpy(zero_copy_only=False)
        size, rows = np.diff(offsets), batch.column(0).to_numpy(zero_copy_only=False)
        wordless = n_words == 0
        h1 = np.where(wordless, np.where(size > 0, raw, rows), h1)
        h2 = np.where(wordless, np.where(size > 0, -size, 0), h2)
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), batch.column(3), pa.array(h1), pa.array(h2),
            _lists(keys.view(np.int64), wordless), _lists(sketch.reshape(n, REGISTERS // 8), wordless),
            _lists(least_of_bins(row, gram, n), wordless), pa.array(heavy),
        ], names=[c.split()[0] for c in SIGNED.split(", ")])


def _band_keys(signature: np.ndarray) -> np.ndarray:
    n = len(signature)
    starts = np.arange(n * BANDS) * ROWS
    keys = span_hash(prefix_hash(signature.reshape(-1)), starts, starts + ROWS) ^ mix(np.tile(np.arange(BANDS, dtype=np.uint64), n), 8)
    return keys.reshape(n, BANDS)


def least_of_bins(row: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
    """A byte of the least hash in each of ``BINS`` bins of a row's shingles, 0
    for an empty bin; eight bins to a number."""
    h = mix(gram, 12)
    slot = row * BINS + (h % U64(BINS)).astype(np.int64)
    order = np.argsort(h)[::-1]  # the least is written last
    out = np.zeros(n * BINS, np.uint8)
    out[slot[order]] = (mix(h[order], 13) % U64(255)).astype(np.uint8) + 1
    return out.view(np.int64).reshape(n, BINS // 8)


def _lists(values: np.ndarray, empty: np.ndarray) -> pa.Array:
    sizes = np.where(empty, 0, values.shape[1])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values[~empty].reshape(-1)))


def _signatures(row, gram, weight, n: int) -> np.ndarray:
    """In parts of bounded size."""
    out = np.zeros((n, REGISTERS), np.uint64)
    bounds, lo = np.searchsorted(row, np.arange(n + 1)), 0
    while lo < n:
        hi = max(lo + 1, min(n, int(np.searchsorted(bounds, bounds[lo] + 250_000, "right")) - 1, lo + 4000))
        a, b = bounds[lo], bounds[hi]
        out[lo:hi] = prob_min_hash(row[a:b] - lo, gram[a:b], weight[a:b], hi - lo)
        lo = hi
    return out


# --- exact similarity ------------------------------------------------------------------


def probability_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two weight vectors over the same elements: the sum over common d of
    1 / sum over d' of max(a[d'] / a[d], b[d'] / b[d]).

    With elements sorted by a/b the inner sum is a suffix sum of a and a prefix
    sum of b."""
    with np.errstate(divide="ignore"):
        ratio = np.where(b > 0, a / np.where(b > 0, b, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    a, b = a[order], b[order]
    below = np.cumsum(b) - b  # of elements with a smaller ratio
    above = np.cumsum(a[::-1])[::-1]
    common = (a > 0) & (b > 0)
    return float((1.0 / (above[common] / a[common] + below[common] / b[common])).sum())


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of plain and probability Jaccard of two weighted shingle sets."""
    (ex, wx), (ey, wy) = x, y
    at = np.minimum(np.searchsorted(ex, ey), len(ex) - 1)
    shared = ex[at] == ey
    union = len(ex) + len(ey) - int(shared.sum())
    plain = int(shared.sum()) / union
    if wx.max() == 1 and wy.max() == 1 or not shared.any():
        return plain
    a = np.concatenate([wx, np.zeros(int((~shared).sum()))]).astype(float)
    b = np.zeros(union)
    b[at[shared]] = wy[shared]
    b[len(ex) :] = wy[~shared]
    return max(plain, probability_jaccard(a, b))


def _packed(gram: np.ndarray, weight: np.ndarray) -> bytes:
    """Six bytes of each hash, then the weights if any is over one."""
    six = np.ascontiguousarray(gram).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
    return np.uint32(len(gram)).tobytes() + six + (b"" if weight.max() == 1 else weight.astype(np.uint32).tobytes())


def _unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(body, np.uint32, 1)[0])
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = np.frombuffer(body, np.uint8, 6 * n, 4).reshape(n, 6)
    rest = np.frombuffer(body, np.uint32, -1, 4 + 6 * n) if len(body) > 4 + 6 * n else np.ones(n, np.uint32)
    return wide.view(np.uint64).reshape(-1), rest


# --- the jobs ----------------------------------------------------------------------------


def _hashed(df: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    return documents(df, id_col, text_col, row_col).withColumn("_hash", F.xxhash64(F.coalesce("_text", F.lit(""))))


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text for each wanted ``_hash``, with wanted's other columns. A bitmap
    of fixed size keeps most other texts out of the join."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.col("_hash").alias("fp"))))

    def only_wanted(batches):
        words = bits.value
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & U64(len(words) * 64 - 1)
            yield batch.filter(pa.array((words[(h >> U64(6)).astype(np.int64)] >> (h & U64(63))) & U64(1) == 1))

    return docs.select("_hash", "_text").mapInArrow(only_wanted, "_hash long, _text string").dropDuplicates(["_hash"]).join(wanted, "_hash")


def verified(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` of text hashes whose similarity reaches the threshold.

    Only texts that stand in a pair are read again; b's rows are few and
    large groups meet at them, so that side is the one repeated on a split."""
    wanted = pairs.groupBy(F.col("a").alias("_hash")).agg(F.collect_set("b").alias("others"))
    centres = pairs.select(F.col("b").alias("_hash")).distinct()
    both = write_table(wanted.join(centres.withColumn("centre", F.lit(True)), "_hash", "full"), "wanted")
    texts = _texts_of(docs, both)

    def sets(batches):
        for batch in sliced(batches, 1):
            data, offsets = text_buffer(batch.column(1))
            row, gram, weight, _, _ = shingles(data, offsets)
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
            out = []
            for k, (h, others, centre) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                body = _packed(gram[bounds[k] : bounds[k + 1]], weight[bounds[k] : bounds[k + 1]])
                out += [(b, h, body) for b in others or ()] + ([(h, None, body)] if centre else [])
                if len(out) >= 256:
                    yield _set_rows(out)
                    out = []
            yield _set_rows(out)

    all_sets = write_table(texts.select("_hash", "_text", "others", "centre").mapInArrow(sets, "b long, a long, body binary"), "shingle-sets")
    left = all_sets.where("a is not null")
    right = all_sets.where("a is null").select("b", F.col("body").alias("centre_body"))

    def check(batches):
        for batch in batches:
            a, b, x, y = (batch.column(k) for k in range(4))
            opened: dict[int, tuple] = {}
            keep = np.zeros(batch.num_rows, bool)
            for k, centre in enumerate(b.to_pylist()):
                if centre not in opened:
                    opened = {centre: _unpacked(y[k].as_py())}
                keep[k] = similarity(_unpacked(x[k].as_py()), opened[centre]) >= threshold
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep))

    met = left.join(right, "b").select("a", "b", "body", "centre_body")
    return write_table(met.mapInArrow(check, "a long, b long"), "near-links")


def _set_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["b", "a", "body"])


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, row_col: str | None = None) -> DataFrame:
    """Per document: ``_row`` (from ``row_col`` if given), doc_id, ``class_id`` (the smallest id of its
    class), ``class_row`` (that document's row)."""
    rows = last_table_only(df.sparkSession, lambda: _class_rows(df, id_col, text_col, threshold, row_col))
    key = ["component", "wordless", "alone"]
    heads = rows.groupBy(*key).agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row")).alias("head"))
    same = [rows[k].eqNullSafe(heads[k]) for k in key]
    return rows.join(heads, same[0] & same[1] & same[2]).select("_row", rows["doc_id"], F.col("head.doc_id").alias("class_id"), F.col("head._row").alias("class_row"))


def _class_rows(df: DataFrame, id_col: str, text_col: str, threshold: float, row_col: str | None) -> DataFrame:
    """Every document with its class."""
    docs = _hashed(df, id_col, text_col, row_col)
    signed = write_table(docs.mapInArrow(_sign, SIGNED), "signatures")
    first = F.min(F.struct("text_hash", "bands", "sketch", "bins", "heavy")).alias("m")  # equal for all copies but for text_hash
    texts = write_table(signed.groupBy("h1", "h2").agg(first).select("h1", "h2", F.col("m.text_hash").alias("node"), F.col("m.bands").alias("bands"), F.col("m.sketch").alias("sketch"), F.col("m.bins").alias("bins"), F.col("m.heavy").alias("heavy")), "texts")

    banded = texts.select("node", F.explode(F.array_distinct("bands")).alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = write_table(banded.join(sizes, "bucket"), "buckets")
    support = members.groupBy("node").agg(F.sum("size").alias("support"))
    members = write_table(members.join(support, "node"), "bucket-members")

    few = members.where(F.col("size") <= SMALL).select("bucket", "node")
    pairs = few.select("bucket", F.col("node").alias("a")).join(few.select("bucket", F.col("node").alias("b")), "bucket").where("a < b").select("a", "b")
    open_members = members.where(F.col("size") > SMALL).select("bucket", "node", "support")
    stars = _stars(open_members)
    tested = write_table(pairs.union(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = verified(docs, _to_centres(tested, support), threshold)
    labels = connected(links)
    for _ in range(ROUNDS):
        more = write_table(_stars(_apart(open_members, labels)).join(tested.select("b", "a"), ["a", "b"], "left_anti"), "pairs")
        links = links.union(verified(docs, _to_centres(more, support), threshold))
        labels = connected(links)
    rest = write_table(_apart(open_members, labels), "apart")
    if rest.limit(1).count():
        links = links.union(_compare_apart(docs, _labelled(open_members, labels), rest, texts, threshold))
        labels = connected(links)

    class_of = texts.join(labels, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component"))
    rows = signed.join(class_of, ["h1", "h2"]).select("_row", "doc_id", "component", F.when(F.size("bands") == 0, F.col("h2")).alias("wordless"), F.when(F.size("bands") == 0, F.col("h1")).alias("alone"))
    return write_table(rows, "classes")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").select("bucket", "node", "support", F.coalesce("component", "node").alias("component"))


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Of each bucket, the texts that aren't connected with its best one."""
    own = _labelled(members, labels)
    best = own.groupBy("bucket").agg(F.max(F.struct("support", "node", "component")).alias("top"))
    return own.join(best, "bucket").where("component <> top.component").select("bucket", "node", "support", "component")


def _stars(members: DataFrame) -> DataFrame:
    """Pairs of each bucket's texts with the one of most support."""
    hubs = members.groupBy("bucket").agg(F.max(F.struct("support", "node")).alias("hub"))
    return members.join(hubs, "bucket").where("node <> hub.node").select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()


def _compare_apart(docs: DataFrame, members: DataFrame, apart: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links of the texts that are apart with any text of their bucket that is
    of another component. Buckets are dealt out in pairs of chunks; a chunk of
    texts meets a chunk of others inside a task, and only links leave it."""
    size_x, size_y = (t.groupBy("bucket").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(f"n_{n}")) for t, n in ((apart, "x"), (members, "y")))
    open_buckets = write_table(size_x.join(size_y, "bucket"), "open-buckets")
    members = members.join(open_buckets.select("bucket"), "bucket", "left_semi")
    body = _texts_of(docs, write_table(members.select(F.col("node").alias("_hash")).distinct(), "wanted"))

    def sets(batches):
        for batch in sliced(batches, 1):
            data, offsets = text_buffer(batch.column(1))
            row, gram, weight, _, _ = shingles(data, offsets)
            at = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_packed(gram[a:b], weight[a:b]) for a, b in zip(at, at[1:])], pa.binary())], names=["node", "body"])

    known = texts.select("node", "sketch", "bins", "heavy", "bands")
    full = write_table(body.select("_hash", "_text").mapInArrow(sets, "node long, body binary").join(known, "node"), "sets")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        placed = rows.select("bucket", "node", "component").join(open_buckets, "bucket")
        here = F.pmod(F.hash("node"), F.col(f"n_{own}")).alias(own)
        return placed.select("bucket", "node", "component", here, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)).alias(other)).join(full, "node")

    x, y = dealt(apart, "x", "y"), dealt(members, "y", "x")
    y = y.toDF(*y.columns)  # names of its own, for the cogroup
    links = x.groupBy("bucket", "x", "y").cogroup(y.groupBy("bucket", "x", "y")).applyInArrow(lambda a, b: _compare(a, b, threshold), "a long, b long")
    return write_table(links, "apart-links")


def _compare(left: pa.Table, right: pa.Table, threshold: float) -> pa.Table:
    """Links between two chunks of a bucket: not ruled out by the sketches, of
    different components, and in the first bucket that the two share."""
    links: list[tuple[int, int]] = []
    if len(left) and len(right):
        def lists(t, c, kind):
            return t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).view(kind).reshape(len(t), -1)

        bucket = left.column("bucket")[0].as_py()
        (nx, cx, hx), (ny, cy, hy) = ([t.column(c).to_numpy() for c in ("node", "component", "heavy")] for t in (left, right))
        (sx, bx, kx), (sy, by, ky) = ([lists(t, c, k) for c, k in (("sketch", np.uint8), ("bins", np.uint8), ("bands", np.int64))] for t in (left, right))
        xs, ys = left.column("body").to_pylist(), right.column("body").to_pylist()
        opened: dict[int, tuple] = {}
        for i in range(len(left)):
            at = np.flatnonzero(cy != cx[i])
            alike = (sy[at] == sx[i]).sum(axis=1) >= LEAST_SKETCH * REGISTERS
            heavy = hx[i] | hy[at]  # plain and probability Jaccard differ
            at, alike, heavy = (v[alike | heavy] for v in (at, alike, heavy))
            same, either = ((by[at] == bx[i]) & (bx[i] > 0)).sum(axis=1), ((by[at] > 0) | (bx[i] > 0)).sum(axis=1)
            in_bins = same >= LEAST_BINS * either
            at = at[np.where(heavy, alike | in_bins, alike & in_bins)]
            at = at[_first_shared(kx[i], ky[at]) == bucket]
            own = _unpacked(xs[i]) if len(at) else None
            for j in at.tolist():
                if j not in opened:
                    opened[j] = _unpacked(ys[j])
                if similarity(own, opened[j]) >= threshold:
                    links.append((int(nx[i]), int(ny[j])))
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _first_shared(x: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """The least bucket that one text shares with each of some others; either
    of its two keys of a band may be either of theirs."""
    x, ys = x.reshape(2, 1, BANDS), ys.reshape(-1, 1, 2, BANDS)
    return np.where(ys == x, ys, np.iinfo(np.int64).max).min(axis=(1, 2, 3))


def _to_centres(pairs: DataFrame, support: DataFrame) -> DataFrame:
    """Turn pairs so that b is the text of more support, where many meet."""
    s = support.withColumnRenamed("support", "s")
    both = pairs.join(s.withColumnRenamed("node", "a").withColumnRenamed("s", "sa"), "a").join(s.withColumnRenamed("node", "b").withColumnRenamed("s", "sb"), "b")
    turn = F.struct("sa", "a") > F.struct("sb", "b")
    return both.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with one document of each class, all columns. The rows
    are written with their numbers, which so are the same in every step."""
    rows = write_table(df.select(F.monotonically_increasing_id().alias("row"), whole_rows(df).alias("whole")), "near-rows")
    texts = rows.select("row", F.col("whole").getField(id_col).alias("doc_id"), F.col("whole").getField(text_col).alias("text"))
    kept = near_classes(texts, row_col="row").where("_row = class_row").select(F.col("_row").alias("row"))
    return rows.join(kept, "row", "left_semi").select("whole.*")


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    classes = near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return classes.select("doc_id", "class_id", (F.col("_row") == F.col("class_row")).alias("kept"))
