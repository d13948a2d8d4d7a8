"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 512 bytes. Every passage is encoded: counts
of its byte classes and of neighbouring pairs of them, standardised, through a
learned tanh layer. Gated attention (a tanh gate times a sigmoid gate) weighs
the passages, and the weighted sum of their codes is scored. Only documents
carry labels; the weights of the passages are learned from these.

The model is trained in numpy on a bounded sample: at most ``MAX_DOCS`` labelled
documents, half of each label, and ``MAX_PASSAGES`` passages of each, spread over
its text. It is applied to all passages of all texts.

Defined cases: null and empty texts have one empty passage and so a score too;
without labels of both kinds every score is 0.5; a null id counts as the empty
string for the split and has no label; an id that is labelled twice counts once
(label 1 first); of rows that share a sampled id one trains (least text hash),
and all are scored as documents of their own; empty tables give
empty results; extra columns are not read (``keep_good`` returns them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import expand, row_slices, ship, text_buffer
from orderlens.llm.language_id import split

PASSAGE = 512
MAX_DOCS = 4000
MAX_PASSAGES = 16
CODE, GATE = 24, 12
EPOCHS = 12


def _classes() -> np.ndarray:
    """Class of each byte: kinds of letters, digits and spaces, and the symbols by themselves."""
    table = np.zeros(256, np.int64)
    table[65:91], table[48:58], table[128:] = 1, 2, 3
    for k, group in enumerate((b"aeiou", b"bcdfghjklmnpqrstvwxyz", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!?", b"'\"`", b"*", b"$", b"%", b"#", b"&", b"|", b"@", b"-_", b"/\\", b":;", b"()[]{}<>", b"=+~^")):
        table[list(group)] = 4 + k
    return table


CLASS = _classes()
N_CLASS = int(CLASS.max()) + 1
FEATURES = N_CLASS * (N_CLASS + 1)


def passage_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Log counts of byte classes and class pairs, a row for each passage."""
    size = ends - starts
    at = expand(starts, size)
    passage = np.repeat(np.arange(len(starts)), size)
    kind = CLASS[data[at]] if len(at) else np.empty(0, np.int64)
    single = np.bincount(passage * N_CLASS + kind, minlength=len(starts) * N_CLASS).reshape(-1, N_CLASS)
    same = passage[1:] == passage[:-1]
    code = (passage[1:] * N_CLASS + kind[:-1]) * N_CLASS + kind[1:]
    pairs = np.bincount(code[same], minlength=len(starts) * N_CLASS**2).reshape(-1, N_CLASS**2)
    return np.log1p(np.concatenate([single, pairs], axis=1).astype(np.float32))


def passages(offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the passages of some rows; an empty row has one."""
    size = np.diff(offsets[lo : hi + 1])
    n = np.maximum(1, -(-size // PASSAGE))
    row = np.repeat(np.arange(lo, hi), n)
    starts = np.repeat(offsets[lo:hi], n) + expand(np.zeros(hi - lo, np.int64), n) * PASSAGE
    return row, starts, np.minimum(starts + PASSAGE, offsets[row + 1])


def _softmax(e: np.ndarray, begin: np.ndarray, bag: np.ndarray) -> np.ndarray:
    a = np.exp(e - np.maximum.reduceat(e, begin)[bag])
    return a / np.add.reduceat(a, begin)[bag]


class GatedAttention:
    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 5):
        r = np.random.default_rng(seed)
        self.mean, self.spread = mean.astype(np.float32), spread.astype(np.float32)
        self.p = {
            "W": r.normal(0, len(mean) ** -0.5, (len(mean), CODE)), "b": np.zeros(CODE), "V": r.normal(0, 0.3, (CODE, GATE)),
            "U": r.normal(0, 0.3, (CODE, GATE)), "w": r.normal(0, 0.3, GATE), "c": r.normal(0, 0.3, CODE), "d": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of passages, and their attention before the softmax."""
        h = np.tanh((x - self.mean) / self.spread @ self.p["W"] + self.p["b"])
        return h, (np.tanh(h @ self.p["V"]) / (1 + np.exp(-(h @ self.p["U"])))) @ self.p["w"]

    def score(self, h: np.ndarray, e: np.ndarray, begin: np.ndarray, bag: np.ndarray) -> np.ndarray:
        z = np.add.reduceat(h * _softmax(e, begin, bag)[:, None], begin)
        return 1 / (1 + np.exp(-(z @ self.p["c"] + self.p["d"][0]).astype(np.float64)))

    def fit(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.003, decay: float = 1e-4) -> None:
        x = (x - self.mean) / self.spread
        bounds = np.searchsorted(bag, np.arange(len(y) + 1))
        r, step = np.random.default_rng(3), 0
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for _ in range(epochs):
            order = r.permutation(len(y))
            for lo in range(0, len(y), batch):
                own = order[lo : lo + batch]
                sizes = bounds[own + 1] - bounds[own]
                step += 1
                for k, g in self._gradients(x[expand(bounds[own], sizes)], sizes, y[own]).items():
                    m, v = moments[k]
                    g = g + decay * self.p[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, x, sizes, y) -> dict[str, np.ndarray]:
        p, begin = self.p, np.cumsum(sizes) - sizes
        bag = np.repeat(np.arange(len(y)), sizes)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        gate = t * s
        a = _softmax(gate @ p["w"], begin, bag)
        z = np.add.reduceat(h * a[:, None], begin)
        dy = (1 / (1 + np.exp(-(z @ p["c"] + p["d"]))) - y) / len(y)
        dz = dy[:, None] * p["c"]
        da = (h * dz[bag]).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, begin)[bag])
        dgate = de[:, None] * p["w"]
        dt, ds = dgate * s * (1 - t * t), dgate * t * s * (1 - s)
        dh = (a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": gate.T @ de, "c": z.T @ dy, "d": dy.sum(keepdims=True)}


def sample_bags(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage features, bag numbers and labels of a bounded sample."""
    one = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    one = split(one).where("not held_out").withColumn("order", F.xxhash64("doc_id"))
    drawn = one.where("y = 0").orderBy("order", "doc_id").limit(max_docs // 2).union(one.where("y = 1").orderBy("order", "doc_id").limit(max_docs // 2))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = texts.join(F.broadcast(drawn.select("doc_id", "y")), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("m")).select("doc_id", "y", F.col("m.text").alias("text"))  # at most max_docs rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            out = []
            for k in range(batch.num_rows):
                _, starts, ends = passages(offsets, k, k + 1)
                own = np.unique(np.linspace(0, len(starts) - 1, MAX_PASSAGES).astype(np.int64))
                out.append(passage_features(data, starts[own], ends[own]).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "y", "x"])

    got = both.mapInArrow(cut, "doc_id long, y double, x binary").toArrow().sort_by("doc_id")
    bags = [np.frombuffer(b, np.float16).reshape(-1, FEATURES) for b in got.column("x").to_pylist()]
    x = np.concatenate(bags).astype(np.float32) if bags else np.empty((0, FEATURES), np.float32)
    return x, np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.asarray(got.column("y")).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> GatedAttention | None:
    x, bag, y = sample_bags(docs, labels, max_docs)
    if len(np.unique(y)) < 2:
        return None
    model = GatedAttention(x.mean(axis=0), x.std(axis=0) + 0.1)
    model.fit(x, bag, y)
    return model


def batch_scores(model: GatedAttention | None, column) -> np.ndarray:
    """Scores of a column of texts, all passages of each."""
    data, offsets = text_buffer(column)
    n = len(offsets) - 1
    out = np.full(n, 0.5)
    if model is None or not n:
        return out
    for lo, hi in row_slices(offsets, 1 << 20):
        row, starts, ends = passages(offsets, lo, hi)
        parts = [model.encode(passage_features(data, starts[k : k + 2048], ends[k : k + 2048])) for k in range(0, len(row), 2048)]
        h, e = (np.concatenate(p) for p in zip(*parts, strict=True))
        begin = np.searchsorted(row, np.arange(lo, hi))
        out[lo:hi] = model.score(h, e, begin, row - lo)
    return out


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(train(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch_scores(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    rows = split(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with all columns, that the classifier doesn't reject."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(batch_scores(shared.value, batch.column(at)) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_documents(docs, labels)
