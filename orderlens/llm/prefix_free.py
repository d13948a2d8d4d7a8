"""Exact removal of repeated byte strings by prefix-free parsing.

Each byte that lies in a string of ``LENGTH`` = 100 bytes which also starts
earlier (smaller document id, or the same document and an earlier start) goes.

Parse. Rolling hashes of 32 bytes trigger phrase bounds: the trigger of a
100-byte window is the least hash in it (the last of equal ones), and all
neighbouring windows with the same trigger make one phrase, so phrases overlap
by 99 bytes, each window lies in exactly one phrase, no phrase is a prefix of
another one at the same trigger, and equal text is parsed into equal phrases
wherever it stands.
Dictionary. Phrases are counted over the corpus under the hash of their
trigger and of their whole content. Every occurrence but the first of a phrase
is repeated text as a whole; a phrase whose trigger stands in no other phrase
has no repeated window.
Suffix order. Only phrases that share a trigger with a different phrase remain,
once each. Their suffixes of at least 100 bytes are sorted (a suffix array of
the dictionary, by the first 100 bytes), block by block; equal neighbours
combine, by the parse's order of occurrences, to the first of them, and the
groups of all blocks are merged under the fingerprint of their 100 bytes.

A corpus is held in blocks of bounded size. Blocks exchange packed arrays with
buckets of hashes; a block first settles what it can alone and then sends at
most ``PER_TRIGGER`` phrases of one trigger, so a passage that a third of all
documents share gives each bucket a few entries for each block.

Defined cases: null texts are empty; null ids come first; rows that repeat an
id follow one another in input order (block, then row); rows shorter than 100
bytes never change; empty tables give empty results; other columns are kept by
``remove_repeats`` and never looked at. What is left may end inside a UTF-8
character; ``remove_repeats`` leaves such a fragment out of the text column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import U64, expand, mix, prefix_hash, release_shuffles, routed, row_slices, runs, ship, span_hash, text_buffer, write_table

LENGTH = 100
TRIGGER = 32
BLOCK_BYTES = 2 << 20
#: Text hashed at a time; the arrays over it take a hundred times its size.
WORK_BYTES = 1 << 20
PER_TRIGGER = 8
PER_BUCKET = 600_000
_LOW = U64((1 << 24) - 1)
MESSAGE = "bucket int, block long, body binary"


# --- blocks --------------------------------------------------------------------------


def to_blocks(df: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``df`` in blocks of about ``block_bytes`` of text, as Arrow streams."""
    ship(df.sparkSession)
    position = df.columns.index(text_col)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = text_buffer(batch.column(position))
            for lo, hi in row_slices(offsets, block_bytes):
                own = batch.slice(lo, hi - lo)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(own)
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + n], pa.int64()), pa.array([int(offsets[hi] - offsets[lo])], pa.int64()),
                                                  pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "n_bytes", "rows"])
                n += 1

    return write_table(df.mapInArrow(make, "block long, n_bytes long, rows binary"), "blocks")


def open_block(body: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(body).read_next_batch()


def row_order(ids: pa.Array) -> np.ndarray:
    """Rank of each row by id (nulls first), then by place."""
    valid = ~np.asarray(ids.is_null())
    values = np.asarray(ids.fill_null(0)).astype(np.int64)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((np.arange(len(values)), values, valid))] = np.arange(len(values))
    return rank


# --- parse ---------------------------------------------------------------------------


class Parse:
    """Phrases of a block: trigger hash, content hash, first window and number
    of windows, row; in text order. ``when`` ranks them by (id, row, place)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rank: np.ndarray):
        found = [self._segment(data, offsets, a, b) for a, b in self._ranges(offsets)]
        self.trigger, self.content, self.start, self.windows = (
            np.concatenate([f[k] for f in found]) if found else np.empty(0, kind)
            for k, kind in enumerate((np.uint64, np.uint64, np.int64, np.int64)))
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.when = np.empty(len(self.row), np.int64)
        self.when[np.argsort(rank[self.row], kind="stable")] = np.arange(len(self.row))

    @staticmethod
    def _ranges(offsets: np.ndarray):
        """Ranges of window starts, of bounded size."""
        for lo, hi in row_slices(offsets, WORK_BYTES):
            a, b = int(offsets[lo]), int(offsets[hi])
            for x in range(a, b, WORK_BYTES):
                yield x, min(b, x + WORK_BYTES)

    @staticmethod
    def _segment(data, offsets, a, b):
        stop = min(len(data), b + LENGTH - 1)
        part = data[a:stop]
        lo, hi = np.searchsorted(offsets, [a, b - 1], "right") - 1
        first = np.maximum(offsets[lo : hi + 1], a)
        last = np.minimum(offsets[lo + 1 : hi + 2] - LENGTH + 1, b)
        windows = expand(first - a, np.maximum(last - first, 0))
        if not len(windows):
            return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        prefix = prefix_hash(part)
        at = np.arange(len(part) - TRIGGER + 1)
        grams = span_hash(prefix, at, at + TRIGGER)
        least = (grams & ~_LOW) | (_LOW - at.astype(np.uint64))
        width, have = LENGTH - TRIGGER + 1, 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: -(width - have)], least[width - have :])
        trigger = (_LOW - (least[windows] & _LOW)).astype(np.int64)
        new = runs(trigger)
        new[1:] |= np.diff(windows) != 1
        begin = np.flatnonzero(new)
        start, n = windows[begin], np.diff(begin, append=len(windows))
        trigger = trigger[begin]
        content = span_hash(prefix, start, start + n + LENGTH - 1)
        return grams[trigger], mix(content ^ mix((trigger - start).astype(np.uint64), 5), 6), start + a, n


def class_order(trigger: np.ndarray, content: np.ndarray, when: np.ndarray):
    """Order by (trigger, content, when); where a class and a trigger begin; and
    whether the trigger stands in several classes."""
    order = np.lexsort((when, content, trigger))
    new_trigger = runs(trigger[order])
    new_class = new_trigger | runs(content[order])
    group = np.cumsum(new_trigger) - 1
    return order, new_class, group, np.bincount(group, new_class)[group] > 1 if len(group) else new_class


class Block:
    """A block's parse, and what it settles alone: ``removed`` phrases (not the
    first of their class), ``sent`` ones, and ``mixed`` ones of a trigger that
    stands in more than ``PER_TRIGGER`` of its own classes."""

    def __init__(self, rows: pa.RecordBatch, id_col: str, text_col: str):
        self.ids = rows.column(rows.schema.names.index(id_col))
        self.data, self.offsets = text_buffer(rows.column(rows.schema.names.index(text_col)))
        self.rank = row_order(self.ids)
        self.parse = p = Parse(self.data, self.offsets, self.rank)
        order, new_class, group, _ = class_order(p.trigger, p.content, p.when)
        first = np.flatnonzero(new_class)
        self.removed = np.zeros(len(order), bool)
        self.removed[order[~new_class]] = True
        own_group = group[first]
        nth = np.arange(len(first)) - np.searchsorted(own_group, own_group)
        many = np.bincount(own_group, minlength=1)[own_group] > PER_TRIGGER if len(first) else np.empty(0, bool)
        self.mixed = np.zeros(len(order), bool)
        self.mixed[order[first[many]]] = True
        sent = order[first[~many | (nth < 2)]]
        self.sent = np.sort(sent)

    def messages(self, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """Of each bucket: which phrases go there, in text order."""
        order, bounds = routed(self.parse.trigger[self.sent], n_buckets)
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            yield k, self.sent[order[bounds[k] : bounds[k + 1]]]


def _keys_of(ids: pa.Array) -> np.ndarray:
    """Ids as numbers for sorting, null as the least."""
    return np.where(np.asarray(ids.is_null()), np.iinfo(np.int64).min, np.asarray(ids.fill_null(0)).astype(np.int64))


def _message(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(a) for a in arrays], np.int64)
    return sizes.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


_CODEC = pa.Codec("zstd", compression_level=3)


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _unsqueezed(body: bytes) -> bytes:
    return pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd", asbytes=True)


def _opened(body: bytes, *kinds) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(body, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(body, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _batch(rows: list[tuple], names=("bucket", "block", "body")) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=list(names))


def _gathered(table: pa.Table):
    """Messages of one bucket in the order of their blocks."""
    rows = sorted(zip(table.column("block").to_pylist(), table.column("body").to_pylist(), strict=True), key=lambda x: x[0])
    return [b for b, _ in rows], [m for _, m in rows]


# --- the jobs ------------------------------------------------------------------------


def _by_row(id_keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run lengths of rows, with their ids."""
    begin = np.flatnonzero(runs(row))
    return id_keys[row[begin]], np.diff(begin, append=len(row)).astype(np.uint32)


def _settle_phrases(table: pa.Table) -> pa.Table:
    """For one bucket: which phrases are not the first of their class, and which
    are first but share their trigger with another class."""
    blocks, bodies = _gathered(table)
    parts = [_opened(_unsqueezed(b), np.uint64, np.uint64, np.int64, np.uint32) for b in bodies]
    trigger, content = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    when = np.concatenate([np.repeat(p[2], p[3]) for p in parts])
    order, new_class, _, shared = class_order(trigger, content, when)
    state = np.zeros(len(order), np.uint8)
    state[order] = np.where(~new_class, 1, np.where(shared, 2, 0))
    return pa.Table.from_batches([_batch(_answers(table, blocks, parts, state))])


def _answers(table, blocks, parts, state):
    bucket, out, at = table.column("bucket")[0].as_py(), [], 0
    for block, p in zip(blocks, parts, strict=True):
        own = state[at : at + len(p[0])]
        at += len(p[0])
        if own.any():
            out.append((bucket, block, _message(np.flatnonzero(own == 1).astype(np.uint32), np.flatnonzero(own == 2).astype(np.uint32))))
    return out


def _settle_windows(table: pa.Table) -> pa.Table:
    """For one bucket: which windows are not the first with their content."""
    blocks, bodies = _gathered(table)
    parts = [_opened(_unsqueezed(b), np.uint64, np.uint32, np.int64, np.uint32) for b in bodies]
    content, more = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    when = np.concatenate([np.repeat(p[2], p[3]) for p in parts])
    order = np.lexsort((when, more, content))
    state = np.zeros(len(order), np.uint8)
    state[order[~(runs(content[order]) | runs(more[order]))]] = 1
    return pa.Table.from_batches([_batch(_answers(table, blocks, parts, state))])


def suffix_groups(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Sort the suffixes at ``starts`` by their first ``length`` bytes, eight at
    a time and only where they still tie; equal ones get equal group numbers."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data),), ">u8", padded, strides=(1,))
    group = np.zeros(len(starts), np.int64)
    active, used = np.arange(len(starts)), 1
    for offset in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        if not len(active):
            break
        key = words[starts[active] + offset].astype(np.uint64)
        order = np.lexsort((key, group[active]))
        active = active[order]
        new = runs(group[active]) | runs(key[order])
        group[active] = used + np.cumsum(new)
        used += int(new.sum()) + 1
        last = np.append(new[1:], True)
        active = active[~(new & last)]
    return group


class Windows:
    """Windows of the phrases that are to be compared, each content once: those
    that come later in the block are removed here."""

    def __init__(self, block: Block, phrases: np.ndarray):
        p = block.parse
        self.start = expand(p.start[phrases], p.windows[phrases])
        phrase = np.repeat(phrases, p.windows[phrases])
        row, place = p.row[phrase], self.start
        when = np.lexsort((place, block.rank[row]))
        rank = np.empty(len(when), np.int64)
        rank[when] = np.arange(len(when))
        group = suffix_groups(block.data, self.start, LENGTH)
        order = np.lexsort((rank, group))
        later = order[~runs(group[order])]
        self.removed = np.zeros(len(order), bool)
        self.removed[later] = True
        self.sent = np.flatnonzero(~self.removed)
        self.row, self.trigger = row, p.trigger[phrase]
        self.content = np.empty(len(order), np.uint64)
        for lo in range(0, len(self.sent), 1 << 20):  # hashed in bounded parts
            own = self.sent[lo : lo + (1 << 20)]
            a, b = int(self.start[own[0]]), int(self.start[own[-1]]) + LENGTH
            for x, y in [(a, b)] if b - a <= 2 * WORK_BYTES else self._pieces(own):
                inside = own[(self.start[own] >= x) & (self.start[own] + LENGTH <= y)]
                prefix = prefix_hash(block.data[x:y])
                self.content[inside] = span_hash(prefix, self.start[inside] - x, self.start[inside] - x + LENGTH)

    def _pieces(self, own):
        a, b = int(self.start[own[0]]), int(self.start[own[-1]]) + LENGTH
        step = WORK_BYTES
        return [(x, min(b, x + step + LENGTH)) for x in range(a, b, step)]

    def messages(self, n_buckets: int):
        order, bounds = routed(self.content[self.sent], n_buckets)
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            yield k, self.sent[order[bounds[k] : bounds[k + 1]]]


def _told(block: Block, answers, n_buckets: int):
    """Apply the buckets' answers on phrases: removed ones, and those to compare."""
    removed, compare = block.removed.copy(), block.mixed.copy()
    sent = dict(block.messages(n_buckets))
    for a in answers or ():
        later, shared = _opened(a["body"], np.uint32, np.uint32)
        own = sent[a["bucket"]]
        removed[own[later]] = True
        compare[own[shared]] = True
    return removed, np.flatnonzero(compare & ~removed)


def _collected(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "body")).alias(name))


def find_repeats(blocks: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """Blocks with the answers on their phrases and windows, and the two bucket counts."""
    total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()["n"]
    n_phrase = n_window = max(1, -(-total // (PER_BUCKET * 35)))

    def send_phrases(batches):
        for batch in batches:
            for number, body in zip(batch.column("block").to_pylist(), batch.column("rows"), strict=True):
                block = Block(open_block(body.as_py()), id_col, text_col)
                keys, p = _keys_of(block.ids), block.parse
                yield _batch([(k, number, _squeezed(_message(p.trigger[own], p.content[own], *_by_row(keys, p.row[own])))) for k, own in block.messages(n_phrase)])

    def send_windows(batches):
        for batch in batches:
            for number, body, answers in zip(batch.column("block").to_pylist(), batch.column("rows"), batch.column("phrases").to_pylist(), strict=True):
                block = Block(open_block(body.as_py()), id_col, text_col)
                keys, w = _keys_of(block.ids), Windows(block, _told(block, answers, n_phrase)[1])
                yield _batch([(k, number, _squeezed(_message(w.content[own], w.trigger[own].astype(np.uint32), *_by_row(keys, w.row[own])))) for k, own in w.messages(n_window)])

    sent = blocks.select("block", "rows").mapInArrow(send_phrases, MESSAGE)
    phrases = write_table(sent.groupBy("bucket").applyInArrow(_settle_phrases, MESSAGE), "phrase-answers")
    release_shuffles(blocks.sparkSession)
    known = blocks.join(_collected(phrases, "phrases"), "block", "left")
    sent = known.select("block", "rows", "phrases").mapInArrow(send_windows, MESSAGE)
    windows = write_table(sent.groupBy("bucket").applyInArrow(_settle_windows, MESSAGE), "window-answers")
    release_shuffles(blocks.sparkSession)
    both = _collected(phrases, "phrases").join(_collected(windows, "windows"), "block", "full")
    return blocks.join(both, "block", "left").select("block", "rows", "phrases", "windows"), n_phrase, n_window


def _removed_bytes(block: Block, phrase_answers, window_answers, n_phrase: int, n_window: int) -> np.ndarray:
    """A mask of the block's bytes that go."""
    removed, compare = _told(block, phrase_answers, n_phrase)
    p = block.parse
    change = np.zeros(len(block.data) + 1, np.int32)
    np.add.at(change, p.start[removed], 1)
    np.add.at(change, p.start[removed] + p.windows[removed] + LENGTH - 1, -1)
    w = Windows(block, compare)
    gone = w.removed.copy()
    sent = dict(w.messages(n_window))
    for a in window_answers or ():
        gone[sent[a["bucket"]][_opened(a["body"], np.uint32, np.uint32)[0]]] = True
    np.add.at(change, w.start[gone], 1)
    np.add.at(change, w.start[gone] + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


def _each_block(batches, id_col, text_col, n_phrase, n_window):
    for batch in batches:
        for body, phrases, windows in zip(batch.column("rows"), batch.column("phrases").to_pylist(), batch.column("windows").to_pylist(), strict=True):
            rows = open_block(body.as_py())
            block = Block(rows, id_col, text_col)
            yield rows, block, _removed_bytes(block, phrases, windows, n_phrase, n_window)


def _kept(block: Block, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kept = block.data[~gone]
    before = np.zeros(len(gone) + 1, np.int64)
    np.cumsum(~gone, out=before[1:])
    return kept, before[block.offsets]


def repeat_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    blocks = to_blocks(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "text")
    told, n_phrase, n_window = find_repeats(blocks, "doc_id", "text")

    def digest(batches):
        for rows, block, gone in _each_block(batches, "doc_id", "text", n_phrase, n_window):
            kept, bounds = _kept(block, gone)
            size = np.diff(block.offsets)
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            first = block.offsets[:-1][size > 0]
            opens[first] = gone[first]
            spans = np.zeros(len(opens) + 1, np.int64)
            np.cumsum(opens, out=spans[1:])
            text = kept.tobytes()
            yield pa.RecordBatch.from_arrays([
                rows.column(0), pa.array(size), pa.array(size - np.diff(bounds)), pa.array(np.diff(spans[block.offsets])),
                pa.array([hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string()),
            ], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return told.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, the text without its repeated bytes; a text that
    was null stays null."""
    told, n_phrase, n_window = find_repeats(to_blocks(df, text_col), id_col, text_col)

    def rewrite(batches):
        for rows, block, gone in _each_block(batches, id_col, text_col, n_phrase, n_window):
            kept, bounds = _kept(block, gone)
            text, at = kept.tobytes(), rows.schema.names.index(text_col)
            null = np.asarray(rows.column(at).is_null()).tolist()
            texts = [None if n else text[a:b].decode(errors="ignore") for n, a, b in zip(null, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(rows.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=rows.schema.names)

    return told.mapInArrow(rewrite, df.schema)


def op7_prefix_free_dedup(spark, sf_dir: str) -> DataFrame:
    """Remove repeated strings of 100 bytes from all documents."""
    return repeat_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
