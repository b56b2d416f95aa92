"""Sum-of-squares online packing of tokenised documents into windows of a fixed number of tokens.

Each input partition is packed on its own, in its scan order, without a shuffle: a document's full windows are closed at
once; its rest goes to the fill level (or a new window) for which the sum of squared counts of partially filled windows
grows least, found in an array of counts by level. As documents may be cut freely, at most `open_windows` windows stay
open: beyond that, and at the end, the emptiest window's tokens are cut to top up the fullest ones, so a partition ends
with one padded window at most. Memory is bounded by the open windows (8 kB each), the known words and one Arrow batch; a
text longer than a run is tokenised as a run of its own, so memory grows with the longest text.

Nulls and ties: a null text is empty (a document of one end token); a null doc_id stays null; repeated rows are packed as
separate documents; of equal changes the highest level is taken. Other columns are left out, whatever their names. An empty table gives no pieces. A task that is run again
reads the same split and so makes the same pieces; sequence ids are the partition's number and a count.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from mediaframe.llm import _text as T

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words whose ids are kept in a worker, which bounds the memory this takes.
CACHE_WORDS = 1_000_000
RUN_BYTES = 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_tokenizers: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Ids of texts by a tokenizer that drops white space and the case of A-Z, and never joins words across white space or letters with signs.

    Words (runs of bytes other than ASCII white space) are known by 64-bit hashes, all of a run at once; each new word is
    encoded once. A stop or comma after ASCII letters is a word of its own. Words with a bar keep their case in the hash,
    as special tokens have it. A white space character beyond ASCII stays within its word and is left to the tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.n = np.zeros(1 << 16, np.uint32), 0

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        """The one of this worker process, with the words it knows already."""
        if path not in _tokenizers:
            _tokenizers[path] = cls(path)
        return _tokenizers[path]

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        got = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False)]
        size = np.array([len(x) for x in got])
        flat = np.array([i for x in got for i in x], np.uint32)
        first = self.n + np.cumsum(size) - size
        if self.n + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.n], np.zeros(self.n + 2 * len(flat), np.uint32)))
        self.ids[self.n : self.n + len(flat)] = flat
        self.n += len(flat)
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.first, self.size = (np.insert(x, at, y[order]) for x, y in ((self.keys, keys), (self.first, first), (self.size, size)))

    def encode_run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a run, as of text_buffer(), and the number of ids before each row (n + 1)."""
        starts, ends, _ = T.word_bounds(data, offsets)
        letters, bars = (np.concatenate(([0], np.cumsum(x))) for x in (_LETTER[data], data == ord("|")))
        last = data[ends - 1]
        stop = ends[((last == ord(".")) | (last == ord(","))) & (letters[ends] - letters[starts] == ends - starts - 1) & (ends - starts > 1)] - 1
        starts, ends = np.sort(np.concatenate((starts, stop))), np.sort(np.concatenate((ends, stop)))
        lower = T.LOWER[data]
        for k in np.flatnonzero(bars[ends] > bars[starts]).tolist():
            lower[starts[k] : ends[k]] = data[starts[k] : ends[k]]
        h = T.prefix_hash(lower)
        _, inv = T.powers(len(data) + 1)
        h = T.mix((h[ends] - h[starts]) * inv[starts] + (ends - starts).astype(np.uint64))
        code, keys = pd.factorize(h)
        if len(self.keys) > CACHE_WORDS:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            where = np.empty(len(keys), np.int64)
            where[code[::-1]] = np.arange(len(code))[::-1]  # where each stands first
            self._learn(keys[new], [data[starts[k] : ends[k]].tobytes() for k in where[new].tolist()])
            at = np.searchsorted(self.keys, keys)
        at = at[code]
        size, first = self.size[at], self.first[at]
        before = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(first - before[:-1], size) + np.arange(before[-1])]
        return ids, before[np.searchsorted(starts, offsets)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        data, offsets = T.text_buffer(pa.array(texts, pa.large_string()))
        for i, j in T.runs(offsets, RUN_BYTES):
            ids, at = self.encode_run(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                yield ids[x:y].astype("<u4").tobytes()


class SumOfSquares:
    """Open windows by fill level; closed() pieces come out as (doc, start, ids as bytes, doc_tokens, window, offset)."""

    def __init__(self, size: int, open_windows: int) -> None:
        self.size, self.most = size, open_windows
        self.counts = np.zeros(size + 1, np.int64)  # the level array
        self.levels: dict[int, list[list]] = {}
        self.n_open = 0

    def place(self, piece: tuple, n: int) -> list[list]:
        """Puts a piece of n < size tokens; returns the windows that are full now."""
        c, room = self.counts, self.size - n
        change = np.empty(room + 1, np.int64)  # by the level it is put on; 0 opens a window
        after = 2 * c[n : self.size + 1] + 1
        after[room] = 0  # a full window is no longer counted
        change[:] = after - (2 * c[: room + 1] - 1)
        change[0] = after[0]
        change[1:][c[1 : room + 1] == 0] = np.iinfo(np.int64).max
        h = room - int(np.argmin(change[::-1]))
        if h:
            w = self._take(h)
        else:
            w = []
            self.n_open += 1
        w.append(piece)
        full = []
        self._put(w, h + n, full)
        while self.n_open > self.most:
            full += self._top_up()
        return full

    def _take(self, h: int) -> list:
        self.counts[h] -= 1
        return self.levels[h].pop()

    def _put(self, w: list, h: int, full: list) -> None:
        if h == self.size:
            self.n_open -= 1
            full.append(w)
        else:
            self.counts[h] += 1
            self.levels.setdefault(h, []).append(w)

    def _top_up(self) -> list[list]:
        """Cuts the emptiest window's pieces to fill the fullest windows."""
        used = np.flatnonzero(self.counts)
        pieces, full = self._take(int(used[0])), []
        self.n_open -= 1
        for doc, start, ids, total in pieces:
            while ids:
                h = int(np.flatnonzero(self.counts)[-1]) if self.counts.any() else 0
                if h:
                    w = self._take(h)
                else:
                    w = []
                    self.n_open += 1
                cut = 4 * (self.size - h)
                w.append((doc, start, ids[:cut], total))
                self._put(w, h + len(ids[:cut]) // 4, full)
                start, ids = start + len(ids[:cut]) // 4, ids[cut:]
        return full

    def rest(self) -> list[list]:
        full = []
        while self.n_open > 1:
            full += self._top_up()
        return full + [w for ws in self.levels.values() for w in ws]


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, open_windows: int = 4096) -> DataFrame:
    """Pieces of all documents: doc_id, start (tokens of the document before it), length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, bins, n = WordTokenizer.of(tokenizer_path), SumOfSquares(size, open_windows), 0
        base = TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4").tobytes()

        def rows(windows: list[list]) -> Iterator[tuple]:
            nonlocal n
            for w in windows:
                at = 0
                for doc, start, ids, total in w:
                    yield doc, start, len(ids) // 4, zlib.crc32(ids), total, base + n, at
                    at += len(ids) // 4
                n += 1

        def out(found: list[tuple]) -> pa.RecordBatch:
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names)

        for b in batches:
            data, offsets = T.text_buffer(b.column(1))
            docs_of = b.column(0).to_pylist()
            for i, j in T.runs(offsets, RUN_BYTES):
                found: list[tuple] = []
                flat, at = tokens.encode_run(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                flat, at = flat.astype("<u4", copy=False), at.tolist()
                for doc, x, y in zip(docs_of[i:j], at[:-1], at[1:], strict=True):
                    ids = flat[x:y].tobytes() + end
                    total, start = len(ids) // 4, 0
                    while total - start >= size:
                        found += rows([[(doc, start, ids[4 * start : 4 * (start + size)], total)]])
                        start += size
                    if start < total:
                        found += rows(bins.place((doc, start, ids[4 * start :], total), total - start))
                if found:
                    yield out(found)
        if found := list(rows(bins.rest())):
            yield out(found)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
