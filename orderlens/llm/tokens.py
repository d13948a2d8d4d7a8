"""Tokenisation with a public tokenizer file, bounded memory.

The tokenizer drops white space and its pieces never span it, so a text's ids
are the ids of its white-space-separated chunks, one after the other. Each
distinct chunk is encoded once by the library and remembered under its 64-bit
hash (a bounded memo of one worker), which is what makes whole-corpus
tokenisation cheap.
"""

from __future__ import annotations

import os
import re

import numpy as np

from orderlens.llm.common import expand, prefix_hash, row_slices, span_hash, word_spans

TOKENIZER_FILE = "word_bpe_49k.json"
_ENCODERS: dict = {}
_CHUNK_BYTE = np.ones(256, bool)
_CHUNK_BYTE[[9, 10, 11, 12, 13, 32]] = False
#: Chunks of Latin letters, with a run of ASCII symbols after them or not: one
#: piece, or two. All others are encoded one by one.
_SIMPLE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+([!#$%&()*+,\-./:;=?@_`{}~\"\[\]\\^]+)?")


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Ids of texts by the remembered ids of their chunks.

    ``max_chunks`` bounds the memo; when it is full it starts anew."""

    def __init__(self, path: str, max_chunks: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.max_chunks = max_chunks
        vocabulary = self.tokenizer.get_vocab()
        self.ends_piece = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_piece[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self):
        self.keys = np.empty(0, np.uint64)  # sorted
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _encode_all(self, texts: list[str]) -> list[list[int]]:
        out = []
        for at in range(0, len(texts), 1024):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + 1024], add_special_tokens=False)]
        return out

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of the chunks, how many each has, and the order they stand
        in. Simple chunks go through the library many in a line, and the line
        is cut after the tokens that end a piece; a line that doesn't come
        apart so is encoded chunk by chunk."""
        pieces = np.zeros(len(chunks), np.int64)
        for i, m in enumerate(map(_SIMPLE.fullmatch, chunks)):
            if m:
                pieces[i] = 1 + (m[1] is not None)
        simple, alone = np.flatnonzero(pieces), np.flatnonzero(pieces == 0)
        flat, lengths = np.empty(0, np.uint32), np.empty(0, np.int64)
        if len(simple):
            own = [chunks[i] for i in simple.tolist()]
            ids = [np.array(x, np.uint32) for x in self._encode_all([" ".join(own[i : i + 64]) for i in range(0, len(own), 64)])]
            line = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
            flat = np.concatenate(ids)
            end = self.ends_piece[flat]
            chunk_line = np.arange(len(simple)) // 64
            good = np.bincount(line, end, len(ids)) == np.bincount(chunk_line, pieces[simple], len(ids))
            good &= [len(x) > 0 and bool(self.ends_piece[x[-1]]) for x in ids]
            flat, end = flat[good[line]], end[good[line]]
            alone = np.concatenate([alone, simple[~good[chunk_line]]])
            simple = simple[good[chunk_line]]
            lengths = np.diff((np.flatnonzero(end) + 1)[np.cumsum(pieces[simple]) - 1], prepend=0)
        if len(alone):
            more = self._encode_all([chunks[i] for i in alone.tolist()])
            flat = np.concatenate([flat, *(np.array(x, np.uint32) for x in more)])
            lengths = np.concatenate([lengths, [len(x) for x in more]]).astype(np.int64)
        return flat, lengths, np.concatenate([simple, alone])

    def _learn(self, keys: np.ndarray, chunks: list[str]):
        flat, lengths, order = self._encode_chunks(chunks)
        starts = np.empty(len(keys), np.int64)
        own = np.empty(len(keys), np.int64)
        starts[order] = len(self.ids) + np.cumsum(lengths) - lengths
        own[order] = lengths
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.starts = np.insert(self.starts, at, starts)
        self.lengths = np.insert(self.lengths, at, own)
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows of a text buffer, and the number of each row's."""
        starts, ends, row = word_spans(data, offsets, _CHUNK_BYTE)
        counts = np.zeros(len(offsets) - 1, np.int64)
        if not len(starts):
            return np.empty(0, np.uint32), counts
        keys, first, which = np.unique(span_hash(prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
        known = self._known(keys)
        if len(self.keys) + int((~known).sum()) > self.max_chunks and len(self.keys):
            self._clear()
            known = np.zeros(len(keys), bool)
        if not known.all():
            text, new = data.tobytes(), first[~known]
            spans = zip(starts[new].tolist(), ends[new].tolist(), strict=True)
            self._learn(keys[~known], [text[a:b].decode() for a, b in spans])
        at = np.searchsorted(self.keys, keys)[which]
        lengths = self.lengths[at]
        np.add.at(counts, row, lengths)
        return self.ids[expand(self.starts[at], lengths)], counts

    def _known(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys

    def batches(self, data: np.ndarray, offsets: np.ndarray):
        """``(first row, flat ids, ids of each row)`` for slices of bounded size."""
        for lo, hi in row_slices(offsets):
            a, b = int(offsets[lo]), int(offsets[hi])
            yield lo, *self.encode(data[a:b], offsets[lo : hi + 1] - a)


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
