"""Language identification with a byte convolutional network.

Bytes are embedded, filters of widths 2, 3 and 4 slide over windows of 128
bytes, each filter's maximum over the window goes to a softmax. The network is
trained in numpy on windows of a bounded sample of labelled documents
(``MAX_DOCS`` documents, the same share of each language up to it, and
``WINDOWS_EACH`` windows of each, spread over its text). It is applied to all
windows of the whole text; a document's prediction is the mean of its windows'
log probabilities, weighted by their letters. For that, a filter's products
with byte pairs are laid out as tables once for each task.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
without any labelled document all predictions are ``und`` with score 0; a null
id counts as the empty string for the split; repeated rows are documents of
their own; empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import ascii_lower, expand, row_slices, ship, text_buffer

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
MAX_DOCS = 4000
WINDOWS_EACH = 4
EPOCHS = 6
_LETTER = np.zeros(256, np.float32)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1


def split(df: DataFrame, remainder: int = 1) -> DataFrame:
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return df.withColumn("held_out", F.crc32(name) % 3 == remainder)


def windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes of the windows, zero after a text's end (and in the filters' overhang)."""
    at = starts[:, None] + np.arange(WINDOW + max(WIDTHS) - 1)
    inside = at < np.minimum(ends, starts + WINDOW)[:, None]
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8) if len(data) else np.zeros(at.shape, np.uint8)


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """A-Z and the two-byte capitals of Latin-1 in lower case."""
    low = ascii_lower(data)
    if len(low):
        low[1:] += np.uint8(32) * ((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E))
    return low


class ByteNetwork:
    def __init__(self, n_classes: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"E": r.normal(0, 0.5, (256, EMBEDDING))}
        for w in WIDTHS:
            self.p[f"K{w}"] = r.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["W"] = r.normal(0, 0.1, (FILTERS * len(WIDTHS), n_classes))
        self.p["c"] = np.zeros(n_classes)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.004) -> None:
        r, step = np.random.default_rng(11), 0
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for _ in range(epochs):
            order = r.permutation(len(x))
            for lo in range(0, len(x), batch):
                own = order[lo : lo + batch]
                step += 1
                for k, g in self._gradients(x[own], y[own]).items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        e = p["E"][x]
        pooled, cache = [], []
        for w in WIDTHS:
            cols = np.concatenate([e[:, j : j + WINDOW] for j in range(w)], axis=2)
            conv = cols @ p[f"K{w}"]
            best = conv.argmax(axis=1)
            top = np.take_along_axis(conv, best[:, None], 1)[:, 0] + p[f"b{w}"]
            pooled.append(np.maximum(top, 0))
            cache.append((cols, best, top > 0))
        h = np.concatenate(pooled, axis=1)
        z = h @ p["W"] + p["c"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = z / z.sum(axis=1, keepdims=True)
        d[np.arange(n), y] -= 1
        d /= n
        g = {"W": h.T @ d, "c": d.sum(axis=0), "E": np.zeros_like(p["E"])}
        dh = d @ p["W"].T
        for i, (w, (cols, best, on)) in enumerate(zip(WIDTHS, cache, strict=True)):
            dt = dh[:, i * FILTERS : (i + 1) * FILTERS] * on
            own = np.take_along_axis(cols, best[:, :, None], 1)  # the window's bytes under each maximum
            g[f"b{w}"], g[f"K{w}"] = dt.sum(axis=0), np.einsum("nfk,nf->kf", own, dt)
            back = np.einsum("nf,kf->nfk", dt, p[f"K{w}"]).reshape(n, FILTERS, w, EMBEDDING)
            for j in range(w):
                np.add.at(g["E"], x[np.arange(n)[:, None], best + j], back[:, :, j])
        return g

    def tables(self) -> list[tuple[int, np.ndarray, int, np.ndarray]]:
        """For each width: products of the filters with pairs of bytes, and with
        the pair or the byte after them."""
        e, out = self.p["E"], []
        for w in WIDTHS:
            single = [e @ self.p[f"K{w}"][j * EMBEDDING : (j + 1) * EMBEDDING] for j in range(w)]
            pair = (single[0][:, None] + single[1][None]).reshape(65536, FILTERS) + self.p[f"b{w}"]
            rest = None if w == 2 else single[2] if w == 3 else (single[2][:, None] + single[3][None]).reshape(65536, FILTERS)
            out.append((w, pair, rest))
        return out

    def log_probabilities(self, x: np.ndarray, tables) -> np.ndarray:
        pairs = x[:, :-1].astype(np.uint16) << 8 | x[:, 1:]
        pooled = []
        for w, pair, rest in tables:
            conv = pair[pairs[:, :WINDOW]]
            if rest is not None:
                conv += rest[x[:, 2 : WINDOW + 2] if w == 3 else pairs[:, 2 : WINDOW + 2]]
            pooled.append(np.maximum(conv.max(axis=1), 0))
        z = np.concatenate(pooled, axis=1) @ self.p["W"] + self.p["c"]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def sample_windows(df: DataFrame, max_docs: int = MAX_DOCS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Windows and languages of a bounded sample of the training documents."""
    usable = split(df.select("doc_id", "text", "lang")).where("not held_out and lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return [], np.empty((0, 0), np.uint8), np.empty(0, np.int64)
    each = max(1, max_docs // len(counts))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, each / n))])
    drawn = usable.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).select("text", "lang")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            data = lower_bytes(data)
            n = np.diff(offsets)
            spread = np.linspace(0, 1, WINDOWS_EACH)
            starts = (offsets[:-1, None] + np.maximum(n - WINDOW, 0)[:, None] * spread).astype(np.int64)
            keep = np.ones(starts.shape, bool)
            keep[:, 1:] = starts[:, 1:] > starts[:, :-1]
            row = np.repeat(np.arange(len(n)), WINDOWS_EACH)[keep.reshape(-1)]
            x = windows(data, starts.reshape(-1)[keep.reshape(-1)], offsets[1:][row])
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(row)), pa.array([w.tobytes() for w in x], pa.binary())], names=["lang", "window"])

    got = drawn.mapInArrow(cut, "lang string, window binary").toArrow().sort_by([("lang", "ascending"), ("window", "ascending")])
    langs = sorted(counts)
    x = np.frombuffer(b"".join(got.column("window").to_pylist()), np.uint8).reshape(len(got), -1)
    return langs, x, np.array([langs.index(v) for v in got.column("lang").to_pylist()])


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(df: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Train on ``df`` (doc_id, text, lang) and predict every row's language."""
    spark = df.sparkSession
    ship(spark)
    langs, x, y = sample_windows(df, max_docs)
    network = ByteNetwork(max(1, len(langs)))
    if len(langs) > 1:
        network.fit(x, y)
    shared = spark.sparkContext.broadcast(network)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.tables()
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            data = lower_bytes(data)
            total, weight = np.zeros((batch.num_rows, max(1, len(langs)))), np.zeros(batch.num_rows)
            for lo, hi in row_slices(offsets, 2 << 20):
                size = np.diff(offsets[lo : hi + 1])
                n = -(-size // WINDOW)
                row = np.repeat(np.arange(lo, hi), n)
                starts = np.repeat(offsets[lo:hi], n) + expand(np.zeros(hi - lo, np.int64), n) * WINDOW
                for k in range(0, len(row), 512):
                    own = row[k : k + 512]
                    x = windows(data, starts[k : k + 512], offsets[own + 1])
                    letters = _LETTER[x].sum(axis=1) + 1e-3
                    logs = model.log_probabilities(x, tables) * letters[:, None]
                    begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    total[own[begin]] += np.add.reduceat(logs, begin)
                    weight[own[begin]] += np.add.reduceat(letters, begin)
            mean = total / np.maximum(weight, 1e-9)[:, None]
            mean = np.exp(mean - mean.max(axis=1, keepdims=True))
            mean /= mean.sum(axis=1, keepdims=True)
            best, known = mean.argmax(axis=1), np.asarray(batch.column(3).fill_null(False)) & bool(langs)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)], pa.string()),
                pa.array(np.where(known, mean.max(axis=1), 0.0)),
            ], names=[c.split()[0] for c in PREDICTED.split(", ")])

    rows = split(df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return rows.select("doc_id", "text", "held_out", F.col("text").rlike(r"\p{L}").alias("letters")).mapInArrow(predict, PREDICTED)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """Predict the language of all documents."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
