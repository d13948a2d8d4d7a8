"""Best-fit packing into fixed-length sequences by bin completion.

Only the histogram of piece lengths (at most ``capacity`` counts, whatever the
corpus size) reaches the driver. There, bins are completed around the largest
remaining length: fillings are enumerated by branch and bound, dominated ones
are left out, the waste bound prunes, and the best-fit filling is the first
incumbent. A filling is repeated as often as the counts allow. This packing and
best-fit decreasing are the first whole solutions; while the best one is over
the lower bound (volume, and pieces over half a sequence), a branch and bound
over fillings and their multiplicities looks for a better one, at every size of
the table and until its nodes are used up. Pieces then find their place by their rank among the pieces of equal length.

Defined cases: a null text is empty, and every document has at least its end
id; repeated rows and ids are documents of their own; an empty table gives no
row; only documents longer than ``capacity`` are cut; extra columns are not
read. Sequence numbers are arbitrary.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import documents, expand, text_buffer, write_table
from orderlens.llm.tokens import encoder, tokenizer_path

CAPACITY = 2048
END_ID = 0
PIECES = "_part int, _rank long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


# --- the packing of a histogram ------------------------------------------------------


def best_fit(counts: np.ndarray, room: int) -> list[int]:
    """Fill ``room`` with the largest length that fits, again and again."""
    left, got = counts.copy(), []
    while room > 0:
        fits = np.flatnonzero(left[: room + 1])
        if not len(fits):
            break
        k = int(fits[-1])
        got.append(k)
        left[k] -= 1
        room -= k
    return got


def complete(counts: np.ndarray, room: int, max_nodes: int) -> list[int]:
    """The undominated filling of ``room`` with least waste.

    Depth first, larger lengths first, in non-increasing order; a branch goes
    no further once its least possible waste reaches the incumbent's, and a
    filling whose last piece could be a larger one is dominated by that one."""
    best = best_fit(counts, room)
    waste = room - sum(best)
    if waste == 0 or not best:
        return best
    sizes = np.flatnonzero(counts[: room + 1])
    reachable = np.cumsum(sizes * counts[sizes])  # of all lengths up to this one
    nodes = 0
    stack: list[tuple[int, int, tuple[int, ...]]] = [(room, len(sizes) - 1, ())]
    while stack and waste and nodes < max_nodes:
        left, top, chosen = stack.pop()
        top = min(top, int(np.searchsorted(sizes, left, "right")) - 1)
        if left < waste:
            best, waste = list(chosen), left
            continue
        if top < 0 or left - reachable[top] >= waste:
            continue
        nodes += 1
        size = int(sizes[top])
        stack.append((left, top - 1, chosen))
        if chosen.count(size) < counts[size]:
            stack.append((left - size, top, (*chosen, size)))
    return best


def best_fit_decreasing(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Each piece, the largest first, into the fullest sequence that it fits."""
    capacity = len(counts) - 1
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by what is left
    for size in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[size])
        while n:
            room = min((r for r in bins if r >= size), default=capacity)
            filling, times = bins[room].pop() if room in bins else ((), n)
            if room in bins and not bins[room]:
                del bins[room]
            each = min(room // size, n)
            used = min(times, n // each)
            if filling and used < times:
                bins.setdefault(room, []).append((filling, times - used))
            bins.setdefault(room - each * size, []).append((filling + (size,) * each, used))
            n -= each * used
    return [x for own in bins.values() for x in own]


def lower_bound(counts: np.ndarray) -> int:
    """No packing has fewer sequences: the volume, and the pieces over half a sequence."""
    capacity = len(counts) - 1
    volume = int((np.arange(capacity + 1) * counts).sum())
    return max(-(-volume // capacity), int(counts[capacity // 2 + 1 :].sum()))


def completed(counts: np.ndarray, max_nodes: int) -> list[tuple[tuple[int, ...], int]]:
    """The filling of least waste around the largest piece that is left, again and again."""
    capacity = len(counts) - 1
    left, out = counts.astype(np.int64).copy(), []
    for size in range(capacity, 0, -1):
        while left[size]:
            left[size] -= 1
            filling = Counter([size, *complete(left, capacity - size, max_nodes)])
            left[size] += 1
            times = min(int(left[k]) // n for k, n in filling.items())
            for k, n in filling.items():
                left[k] -= n * times
            out.append((tuple(sorted(filling.elements(), reverse=True)), times))
    return out


def pack_histogram(counts: np.ndarray, max_nodes: int = 4000) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how often each is used, for ``counts[length]`` pieces: the
    best whole solution, of best-fit decreasing, of bin completion, or of the
    branch and bound, which bisects between the lower bound and the best, first
    with each filling as often as it can be, then with all numbers of times."""
    def size(packing):
        return sum(n for _, n in packing)

    best, nodes = min(best_fit_decreasing(counts), completed(counts, max_nodes), key=size), max_nodes
    for partly in (False, True):
        low, high = lower_bound(counts), size(best)
        target = low
        while low < high and nodes > 0:
            found, used = _search(counts, target, min(nodes, -(-max_nodes // 8)), partly)
            nodes -= max(used, 1)
            if found:
                best, high = found, size(found)
            else:
                low = target + 1
            target = (low + high) // 2
    return best


def _search(counts: np.ndarray, target: int, max_nodes: int, partly: bool) -> tuple[list[tuple[tuple[int, ...], int]] | None, int]:
    """A packing into at most ``target`` sequences or None, and the nodes used.

    Depth first on the histogram: around the largest length left, each filling
    and, if ``partly``, fewer times (halved again and again; the next node may
    take the same filling). The volume bound is kept as the waste still allowed."""
    capacity = len(counts) - 1
    left, chosen, nodes = counts.astype(np.int64).copy(), [], 0
    rest = int((np.arange(capacity + 1) * left).sum())
    waste = target * capacity - rest
    frames = [_choices(left, capacity, waste, partly)]
    while frames and nodes < max_nodes:
        choice = next(frames[-1], None)
        if choice is None:
            frames.pop()
            if not chosen:
                break
            (filling, times), sign = chosen.pop(), 1
        else:
            nodes += 1
            chosen.append(choice)
            (filling, times), sign = choice, -1
        np.add.at(left, list(filling), sign * times)
        rest += sign * times * sum(filling)
        waste += sign * times * (capacity - sum(filling))
        if not rest:
            return chosen, nodes
        if sign < 0:
            frames.append(_choices(left, capacity, waste, partly))
    return None, nodes


def _choices(counts: np.ndarray, capacity: int, waste: int, partly: bool) -> Iterator[tuple[tuple[int, ...], int]]:
    """Fillings around the largest length, with how often each is used."""
    own = counts.copy()
    top = int(np.flatnonzero(own)[-1])
    own[top] -= 1
    seen = set()
    for rest in chain([tuple(complete(own, capacity - top, 200))], _fillings(own, capacity - top, waste)):
        filling = (top, *rest)
        lost = capacity - sum(filling)
        if filling in seen or lost > waste:
            continue
        seen.add(filling)
        times = min(int(counts[k]) // n for k, n in Counter(filling).items())
        times = min(times, waste // lost) if lost else times
        while times:
            yield filling, times
            times = times // 2 if partly else 0


def _fillings(counts: np.ndarray, room: int, waste: int, max_steps: int = 20_000) -> Iterator[tuple[int, ...]]:
    """Fillings that waste no more than that and to which nothing can be added,
    larger lengths first."""
    sizes = np.flatnonzero(counts[: room + 1])
    reachable = np.cumsum(sizes * counts[sizes])
    stack: list[tuple[int, int, tuple[int, ...]]] = [(room, len(sizes) - 1, ())]
    for _ in range(max_steps):
        if not stack:
            return
        left, top, chosen = stack.pop()
        top = min(top, int(np.searchsorted(sizes, left, "right")) - 1)
        if top < 0:
            if left <= waste and not any(k <= left and chosen.count(k) < counts[k] for k in sizes[: np.searchsorted(sizes, left, "right")].tolist()):
                yield chosen
            continue
        if left - reachable[top] > waste:
            continue
        size = int(sizes[top])
        stack.append((left, top - 1, chosen))
        if chosen.count(size) < counts[size]:
            stack.append((left - size, top, (*chosen, size)))


class _Places:
    """For each length: the rank from which a filling's slots hold, how many
    pieces of it the filling takes, its first sequence and the offset in it."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        used: Counter = Counter()
        sequence = 0
        for filling, times in patterns:
            at = 0
            for size, n in Counter(filling).items():
                rows.setdefault(size, []).append((used[size], n, sequence, at))
                used[size] += n * times
                at += size * n
            sequence += times
        self.by_length = {k: np.array(v, np.int64).T for k, v in rows.items()}
        self.n_sequences = sequence

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty_like(rank), np.empty_like(rank)
        for k in np.unique(length):
            own = np.flatnonzero(length == k)
            first, n, base, at = self.by_length[int(k)]
            slot = np.searchsorted(first, rank[own], "right") - 1
            inside = rank[own] - first[slot]
            sequence[own] = base[slot] + inside // n[slot]
            offset[own] = at[slot] + inside % n[slot] * k
        return sequence, offset


# --- the Spark job -------------------------------------------------------------------


def cut_pieces(df: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None,
               keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenised documents cut into pieces; ``_rank`` counts the pieces of equal
    length within one task ``_part``."""
    path = tokenizer or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = encoder(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            doc_ids = batch.column(0)
            for first, ids, counts in encode.batches(*text_buffer(batch.column(1))):
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, np.uint32(end_id))
                counts = counts + 1
                doc_starts = np.cumsum(counts) - counts
                n_pieces = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), n_pieces)
                piece = expand(np.zeros(len(counts), np.int64), n_pieces)
                start = piece * capacity
                length = np.minimum(capacity, counts[doc] - start)
                a = doc_starts[doc] + start
                parts = [ids[x:y] for x, y in zip(a.tolist(), (a + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                rank = np.empty_like(length)
                rank[order] = np.arange(len(order)) - np.searchsorted(ordered, ordered) + seen[ordered]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(doc), part, np.int32)), pa.array(rank), doc_ids.slice(first, len(counts)).take(pa.array(doc)),
                    pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                    pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                    pa.array([x.tobytes() for x in parts] if keep_ids else [None] * len(parts), pa.binary()),
                ], names=[c.split()[0] for c in PIECES.split(", ")])

    return documents(df, id_col, text_col).select("_id", "_text").mapInArrow(cut, PIECES)


def pack(df: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None,
         keep_ids: bool = False, max_nodes: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset and, with ``keep_ids``, its ids (little-endian 32 bits)."""
    pieces = write_table(cut_pieces(df, capacity, end_id, tokenizer, keep_ids, id_col, text_col), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[row["length"]] = row["count"]
    places = _Places(pack_histogram(counts, max_nodes))

    by_part = pieces.groupBy("_part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("_part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    ranked = pieces.join(bases, ["_part", "length"]).select(*columns, (F.col("_base") + F.col("_rank")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(zero_copy_only=False), batch.column("_rank").to_numpy(zero_copy_only=False)
            sequence, offset = places.find(length, rank)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    kinds = dict(c.split() for c in PIECES.split(", "))
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """Packed sequences of a ``keep_ids`` packing: sequence_id, ids, doc_ids."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    rows = packed.groupBy("sequence_id").agg(own.alias("own"))
    joined = F.aggregate("own", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.col("own.doc_id").alias("doc_ids"))


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
