"""Token ids of documents as Simple-8b files: written in the order of doc_id, read back whole or by position.

A 64-bit word has a selector in its upper 4 bits and packs c ids of b bits in the others, c * b <= 60. An id that doesn't
fit the b bits of its word is written there as all ones, an escape, and follows in full (32 bits) in a list beside the
words; each word takes the selector with the fewest bits an id, escapes counted. Blocks of BLOCK ids begin with a word of
their own, and a page's table has each block's first word and first escape, so a block is decoded alone and all words of
one selector at once.

Documents are range-partitioned and sorted by doc_id before they are encoded, so a file holds a range of ids and positions
need no more than the totals of the files. A file is a Parquet part with a row a page (part, page, ids before it in
its part, the documents' ids and sizes, the coded ids): Spark's writer commits whole parts, so tasks that are lost or run
twice leave nothing half written. A page ends with a document, so it and a task's memory grow with the longest text only.

Nulls and ties: a null text is empty (its end id alone); null doc_ids come first; rows of one doc_id follow each other in
the order of a hash of their texts, and a doc_id that very many rows share is spread over tasks. Equal rows are written
each. Other columns are left out, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaframe.llm import _text as T
from mediaframe.llm.packing import _LETTER, RUN_BYTES, WordTokenizer

COUNTS = np.array([60 // b for b in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)])  # ids a word by selector
BITS = 60 // COUNTS
BLOCK, PAGE = 4096, 1 << 18
#: Words whose ids are kept in a worker (some 40 bytes each).
WORDS = 2_000_000

#: Bytes that can follow a blank at which a text is cut: no white space of any script begins with them.
_BEGINS = np.zeros(256, bool)
_BEGINS[33:127] = _BEGINS[0xC3:] = True
_BEGINS[0xE1:0xE4] = False
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True


class ByteTokenizer(WordTokenizer):
    """Ids of texts by a byte-level tokenizer whose pieces never cross from before a blank to the word after it.

    A text is cut before a blank that a word follows, after a single line feed between visible ASCII characters, and
    between an ASCII letter and a stop: the tokenizer's own pattern cuts there too, whatever stands around. What lies
    between two cuts is known by a 64-bit hash and encoded once.
    """

    def __init__(self, path: str) -> None:
        super().__init__(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # a word is encoded once, so the model need not keep it
        n = self.tokenizer.get_vocab_size()
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(n)])  # the sign for a blank

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """New words with one blank, at their start, are encoded in rows: an id that begins with a blank is the next word's first."""
        plain = np.array([w[:1] == b" " and w.count(b" ") == 1 and w[-1:] != b" " for w in words])
        rows = [w for w, p in zip(words, plain.tolist(), strict=True) if p]
        text = [b"".join(rows[k : k + 64]).decode("utf-8") for k in range(0, len(rows), 64)]
        flat = np.array([i for e in self.tokenizer.encode_batch_fast(text, add_special_tokens=False) for i in e.ids], np.uint32)
        first = np.flatnonzero(self.opens[flat])
        if len(first) != len(rows):
            return super()._learn(keys, words)
        self._add(keys[plain], flat, np.diff(np.append(first, len(flat))))
        super()._learn(keys[~plain], [w for w, p in zip(words, plain.tolist(), strict=True) if not p])

    def _add(self, keys: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        if self.n + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.n], np.zeros(self.n + 2 * len(flat), np.uint32)))
        self.ids[self.n : self.n + len(flat)] = flat
        first = self.n + np.cumsum(size) - size
        self.n += len(flat)
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.first, self.size = (np.insert(x, at, y[order]) for x, y in ((self.keys, keys), (self.first, first), (self.size, size)))

    def encode_run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = np.zeros(len(data) + 1, bool)
        begins, line = _BEGINS[data], data == 10
        cut[:-2] = (data[:-1] == 32) & begins[1:]
        cut[2:-1] |= line[1:-1] & begins[2:] & (data[:-2] > 32) & (data[:-2] < 127)
        cut[1:-1] |= _LETTER[data[:-1]] & _STOP[data[1:]]
        cut[offsets] = True
        cut[-1] = False
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        h = T.prefix_hash(data)
        _, inv = T.powers(len(data) + 1)
        code, keys = pd.factorize(T.mix((h[ends] - h[starts]) * inv[starts] + (ends - starts).astype(np.uint64)))
        if len(self.keys) > WORDS:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            where = np.empty(len(keys), np.int64)
            where[code[::-1]] = np.arange(len(code))[::-1]
            self._learn(keys[~known], [data[starts[k] : ends[k]].tobytes() for k in where[~known].tolist()])
            at = np.searchsorted(self.keys, keys)
        size, first = self.size[at][code], self.first[at][code]
        before = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(first - before[:-1], size) + np.arange(before[-1])]
        return ids, before[np.searchsorted(starts, offsets)]


#: A whole number of 64-bit words' and escapes' shares in an id, for any selector.
_SHARE = int(np.lcm.reduce(COUNTS))


def _selectors(ids: np.ndarray) -> np.ndarray:
    """For each id the selector of the word that would begin with it; ids: a row a block, no word goes beyond its row."""
    rows, n = ids.shape
    best = np.full((rows, n), 64 * _SHARE << 4 | len(COUNTS) - 1, np.int32)  # bits an id, times _SHARE, and the selector in the lowest bits
    wide, here = np.zeros((rows, n + 1), np.int32), np.empty((rows, n), np.int32)
    for k, (c, b) in enumerate(zip(COUNTS.tolist(), BITS.tolist(), strict=True)):
        if n < c or b >= 32:
            continue
        np.cumsum(ids >= (1 << b) - 1, axis=1, out=wide[:, 1:], dtype=np.int32)
        x = np.subtract(wide[:, c:], wide[:, :-c], out=here[:, : n - c + 1])
        x *= 32 * (_SHARE // c) << 4
        x += 64 * (_SHARE // c) << 4 | k
        np.minimum(best[:, : n - c + 1], x, out=best[:, : n - c + 1])
    return best & 15


def encode(ids: np.ndarray) -> bytes:
    """Ids (below 2**32) as a page: the numbers of ids, blocks, words and escapes, the blocks' first words and first escapes, the words, the escapes."""
    n = len(ids)
    v, whole = ids.astype(np.uint64), n // BLOCK * BLOCK
    best = np.concatenate((_selectors(ids[:whole].reshape(-1, BLOCK)).reshape(-1), _selectors(ids[whole:].reshape(1, -1))[0]))
    jump, starts, i = COUNTS[best].tolist(), [], 0
    while i < n:
        starts.append(i)
        i += jump[i]
    starts = np.array(starts, np.int64)
    chosen = best[starts]
    words, escaped = np.zeros(len(starts), np.uint64), []
    for k in np.unique(chosen).tolist():
        c, b, at = int(COUNTS[k]), int(BITS[k]), np.flatnonzero(chosen == k)
        place = starts[at][:, None] + np.arange(c)
        x, top = v[place], np.uint64((1 << b) - 1)
        if b < 32:
            escaped.append(place[x >= top])
            x = np.minimum(x, top)
        words[at] = (np.uint64(k) << np.uint64(60)) | np.bitwise_or.reduce(x << (np.arange(c) * b).astype(np.uint64), 1)
    escaped = np.sort(np.concatenate([*escaped, np.zeros(0, np.int64)]))
    edges = np.arange(0, n, BLOCK)
    table = np.stack((np.searchsorted(starts, edges), np.searchsorted(escaped, edges)), 1)
    head = np.array([n, len(edges), len(words), len(escaped)], "<u8")
    return b"".join((head.tobytes(), table.astype("<u8").tobytes(), words.astype("<u8").tobytes(), v[escaped].astype("<u4").tobytes()))


def decode(page: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids (uint32) of a page from position first on and before last; only the blocks that hold them are decoded."""
    n, blocks, n_words, n_escapes = np.frombuffer(page, "<u8", 4).astype(np.int64).tolist()
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    table = np.concatenate((np.frombuffer(page, "<u8", 2 * blocks, 32).reshape(-1, 2).astype(np.int64), [[n_words, n_escapes]]))
    (w0, e0), (w1, e1) = table[first // BLOCK], table[(last - 1) // BLOCK + 1]
    base = 32 + 16 * blocks
    words = np.frombuffer(page, "<u8", w1 - w0, base + 8 * w0)
    escapes = np.frombuffer(page, "<u4", e1 - e0, base + 8 * n_words + 4 * e0)
    selector = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[selector])
    out, escaped = np.zeros(ends[-1], np.uint32), []
    for k in np.unique(selector).tolist():
        c, b, at = int(COUNTS[k]), int(BITS[k]), np.flatnonzero(selector == k)
        top = np.uint64((1 << b) - 1)
        x = (words[at][:, None] >> (np.arange(c) * b).astype(np.uint64)) & top
        place = (ends[at] - c)[:, None] + np.arange(c)
        out[place] = x
        if b < 32:
            escaped.append(place[x == top])
    out[np.sort(np.concatenate([*escaped, np.zeros(0, np.int64)]))] = escapes
    skip = first // BLOCK * BLOCK
    return out[first - skip : last - skip]


def write_token_ids(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2) -> None:
    """Encodes all texts of docs (doc_id, text), each with end_id after it, into files below folder."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = ByteTokenizer.of(tokenizer_path), TaskContext.get().partitionId()
        names, sizes, flat, waiting, before, page = [], [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            size = np.concatenate(sizes)
            cols = ([part], [page], [before], [waiting], [pa.concat_arrays(names)], [pa.array(size, pa.int64())], [encode(np.concatenate(flat))])
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(names[0].type), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x[0].to_pylist() if isinstance(x[0], pa.Array) else x[0]], t) for x, t in zip(cols, types, strict=True)], ["part", "page", "before", "n_ids", "doc_id", "size", "ids"])

        for b in batches:
            data, offsets = T.text_buffer(b.column(1))
            for i, j in T.runs(offsets, RUN_BYTES):
                ids, at = tokens.encode_run(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                out = np.full(len(ids) + j - i, end_id, np.uint32)
                out[np.arange(len(ids)) + np.repeat(np.arange(j - i), np.diff(at))] = ids
                names.append(b.column(0).slice(i, j - i))
                sizes.append(np.diff(at) + 1)
                flat.append(out)
                waiting += len(out)
                if waiting >= PAGE:
                    yield row()
                    before, page = before + waiting, page + 1
                    names, sizes, flat, waiting = [], [], [], 0
        if waiting:
            yield row()

    order = ["doc_id", "_h", "_row"]  # rows that are equal in the first two are interchangeable, so any order of them will do
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_row"))
    d = d.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    d.mapInArrow(run, f"part int, page long, before long, n_ids long, doc_id array<{kind}>, size array<bigint>, ids binary").write.parquet(folder)


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """All pages with start, the number of ids before them. A row a part is summed in one place; parts are as many as write tasks."""
    pages = spark.read.parquet(folder)
    totals = sorted((r.part, r.n) for r in pages.groupBy("part").agg(F.max(F.col("before") + F.col("n_ids")).alias("n")).collect())
    starts = np.cumsum([0, *(n for _, n in totals)]).tolist()
    t = spark.createDataFrame([(p, s) for (p, _), s in zip(totals, starts[:-1], strict=True)], "part int, _first long")
    return pages.join(F.broadcast(t), "part").withColumn("start", F.col("_first") + F.col("before"))


def read_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of the files: start counts the ids of all documents before, ids are little-endian unsigned 32-bit integers."""
    kind = spark.read.parquet(folder).schema["doc_id"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                page = b.slice(k, 1)
                names, size = page.column(1).flatten(), page.column(2).flatten().to_numpy()
                ids, at = decode(page.column(3)[0].as_buffer()), np.concatenate(([0], np.cumsum(size)))
                raw = pa.array([ids[x:y].astype("<u4").tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([names, pa.array(page.column(0)[0].as_py() + at[:-1]), pa.array(size), raw], ["doc_id", "start", "n_tokens", "ids"])

    return _pages(spark, folder).select("start", "doc_id", "size", "ids").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids binary")


def read_positions(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """Rows (start, ids), a row a page, of the ids at positions first to last - 1 over all documents; only their pages are read and their blocks decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                at = max(first, start)
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([decode(page.as_buffer(), at - start, last - start).astype("<u4").tobytes()], pa.binary())], ["start", "ids"])

    pages = _pages(spark, folder).where((F.col("start") < last) & (F.col("start") + F.col("n_ids") > first))
    return pages.select("start", "ids").mapInArrow(run, "start long, ids binary")
