"""Language-model scoring with a log-frequency Bloom filter.

The model is a bigram model with Witten-Bell smoothing: P(w|h) = (c(hw) + T(h) P(w)) / (c(h) + T(h)), T the number of
different words after h, P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). Its counts stand, quantised, in a Bloom filter: for a
key with count c the filter holds (key, level) for every level whose threshold is at most c, and a count is found again by
probing one level after another until one misses. Thresholds are the numbers with three significant bits (at most a
quarter apart); counts above the line are rounded down and below the line up, so the probabilities of a history add up
to 1 at most, but for false positives.

Counting gathers packed arrays of keys and counts by segment of the key's hash; a segment is merged by one task, and there
are as many as the text needs. A task adds up its runs before the shuffle (a hot word is one entry of some million), and
sends only segments that hold something. All bigrams of a history are in one segment, which so grows with the vocabulary.

The filter has `bits` bits an entry at every size. It and the exact counts of words, which only the base score needs, are
broadcast in waves of segments within `max_filter_bytes` and `max_table_bytes` (a wave has 1 of at most 4096 parts at
least). Waves are jobs of their own with a written result between, which keeps the levels found so far, three bytes a
token: of the word, of the types after the word before it, and of the bigram. The last wave turns them into scores.
release() drops the last wave's broadcasts once the scores are written.

Nulls and ties: a null text counts as empty (one end token), a null doc_id is hashed as ''; repeated rows are scored
each and count each. Extra columns pass through (names that begin with `_lm_` are reserved). A text longer than a run is
a run of its own, so memory grows with the longest text. Without training tokens N = V = 0. An empty table gives an empty
result. Histories are told apart by 32 bits, bigrams of a history by 32 more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from mediaframe.llm import _text as T
from mediaframe.llm._spark import checkpointed

START, END, TYPES = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD1B54A32D192ED03))
LEVELS = np.array(sorted({m << k for m in (4, 5, 6, 7) for k in range(60)} | {1, 2, 3}), np.float64)
SEGMENT_BYTES = 4 << 20
RUN_BYTES = 1 << 19
#: Keys that a task adds up before it sends them; parts by which waves are cut.
ENTRIES, PARTS = 1 << 19, 4096
_HIGH = np.uint64(0xFFFFFFFF00000000)
_K = np.uint64(0x9E6C63D0876A9A35)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens (words, then the end) of each row, the keys of the bigrams that end in them, and the number of tokens before each row."""
    h, before = T.word_hashes(data, offsets)
    n = len(before) - 1
    at = before + np.arange(n + 1)
    w = np.full(at[-1], END)
    words = np.ones(len(w), bool)
    words[at[1:] - 1] = False
    w[words] = h
    prev = np.empty_like(w)
    prev[1:] = w[:-1]
    prev[at[:-1]] = START
    return w, (prev & _HIGH) | (T.mix(prev * _K + w) >> np.uint64(32)), at


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable") if counts is not None else None
    keys = keys[order] if counts is not None else np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts[order], first) if len(keys) else np.zeros(0, np.int64)
    return keys[first], n.astype(np.int64)


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Keys, those of count 1 first, then the other counts."""
    one = counts == 1
    return int(one.sum()).to_bytes(8, "little") + np.concatenate((keys[one], keys[~one])).tobytes() + counts[~one].astype(np.uint32).tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    ones = int.from_bytes(blob[:8], "little")
    more = (len(blob) - 8 - 8 * ones) // 12
    counts = np.ones(ones + more, np.int64)
    counts[ones:] = np.frombuffer(blob, np.uint32, more, 8 + 8 * (ones + more))
    return np.frombuffer(blob, np.uint64, ones + more, 8), counts


class Filter:
    """The log-frequency filter: words of 64 bits by segment, one word and four of its bits an entry."""

    def __init__(self, words: np.ndarray, first: np.ndarray, shift: int, low: int = 0, size: np.ndarray | None = None) -> None:
        """The segments from low on; first: where each begins (and ends, where no sizes are given)."""
        self.words, self.first, self.shift, self.low = words, first, np.uint64(shift), low
        self.size = (np.diff(first) if size is None else size).astype(np.uint64)

    @staticmethod
    def entry(keys: np.ndarray, level: np.ndarray | int, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        x = T.mix(keys + np.asarray(level, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
        at = (x >> np.uint64(32)) * np.asarray(size, np.uint64) >> np.uint64(32)
        bits = np.zeros(len(x), np.uint64)
        for k in (0, 6, 12, 18):
            bits |= np.uint64(1) << (x >> np.uint64(k) & np.uint64(63))
        return at.astype(np.int64), bits

    @classmethod
    def segment(cls, keys: np.ndarray, counts: np.ndarray, bits: float) -> np.ndarray:
        levels = np.searchsorted(LEVELS, counts, "right")
        n = int(levels.sum())
        words = np.zeros(max(1, int(np.ceil(n * bits / 64))), np.uint64)
        for level in range(int(levels.max()) if len(levels) else 0):
            at, mask = cls.entry(keys[levels > level], level, len(words))
            np.bitwise_or.at(words, at, mask)
        return words

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """How many levels of each key are there, by probing until one misses."""
        out = np.zeros(len(keys), np.int64)
        seg = (keys >> self.shift).astype(np.int64) - self.low if self.shift < 64 else np.zeros(len(keys), np.int64)
        first, size = self.first[seg], self.size[seg]
        open_ = np.arange(len(keys))
        for level in range(len(LEVELS)):
            at, mask = self.entry(keys[open_], level, size[open_])
            open_ = open_[self.words[first[open_] + at] & mask == mask]
            if not len(open_):
                break
            out[open_] += 1
        return out


_LOW = np.concatenate(([0.0], LEVELS))
_UP = np.concatenate(([0.0], LEVELS[1:] - 1, [LEVELS[-1]]))


def fit(docs: DataFrame, bits: float = 12.0, max_filter_bytes: int = 160 << 20, max_table_bytes: int = 160 << 20) -> dict:
    """Counts of the texts of docs: filter and exact word counts by segment, the waves of segments, N and V."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("d")).first()
    power = max(5, int(np.ceil(np.log2(max(1, size.n / SEGMENT_BYTES)))))
    shift = np.uint64(64 - power)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[tuple]] = [[], []]  # words and bigrams, with their counts

        def merged() -> list[tuple]:
            return [_counted(*(np.concatenate(x) for x in zip(*w, strict=True))) for w in waiting]

        def sent(both: list[tuple]) -> Iterator[pa.RecordBatch]:
            cuts = [np.unique(keys >> shift, return_index=True) for keys, _ in both]
            segments = np.unique(np.concatenate([seg for seg, _ in cuts]))
            packed = []
            for (keys, n), (seg, first) in zip(both, cuts, strict=True):
                at = dict(zip(seg.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True), strict=True))
                packed.append([_pack(keys[slice(*at.get(x, (0, 0)))], n[slice(*at.get(x, (0, 0)))]) for x in segments.tolist()])
            for k in range(0, len(segments), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(segments[k : k + 1024].astype(np.int32)), *(pa.array(x[k : k + 1024], pa.binary()) for x in packed)], ["segment", "words", "pairs"])

        n = 0
        for b in batches:
            data, offsets = T.text_buffer(b.column(0))
            for i, j in T.runs(offsets, RUN_BYTES):
                w, pair, _ = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for one, keys in zip(waiting, (w, pair), strict=True):
                    one.append(_counted(keys))
                    n += len(one[-1][0])
                if n >= ENTRIES:
                    both = merged()
                    waiting, n = [[x] for x in both], sum(len(x[0]) for x in both)
                    if n >= ENTRIES // 2:
                        yield from sent(both)
                        waiting, n = [[], []], 0
        if waiting[0]:
            yield from sent(merged())

    def merge(parts: pd.DataFrame) -> tuple:
        words, pairs = ([_unpack(x) for x in parts[c]] for c in ("words", "pairs"))
        w, c = _counted(*(np.concatenate(x) for x in zip(*words, strict=True)))
        p, n = _counted(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
        h = p & _HIGH
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        return w, c, p, n, h[first], np.diff(np.append(first, len(h)))

    def _type_keys(h: np.ndarray) -> np.ndarray:
        return (h & _HIGH) | (T.mix((h & _HIGH) + TYPES) >> np.uint64(32))

    def build(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        w, c, p, n, h, t = merge(parts)
        keys = np.concatenate((p, T.mix(w) & ~_HIGH | w & _HIGH, _type_keys(h)))
        return pd.DataFrame({"segment": [key[0]], "words": [w.tobytes()], "counts": [c.tobytes()], "filter": [Filter.segment(keys, np.concatenate((n, c, t)), bits).tobytes()], "n": [int(c.sum())]})

    packed = docs.select("text").mapInArrow(count, "segment int, words binary, pairs binary")
    built = checkpointed(packed.groupBy("segment").applyInPandas(build, "segment int, words binary, counts binary, filter binary, n long"))
    each = max(1, (1 << power) // PARTS)
    rows = built.groupBy(F.expr(f"segment div {each}").alias("part")).agg(F.sum(F.length("filter")).alias("f"), F.sum(F.length("words") / 8).cast("long").alias("v"), F.sum("n").alias("n")).collect()
    by = {r.part: r for r in rows}
    waves, f, v = [[0, 0, 0]], 0, 0  # first segment, bytes of the filter, words
    for s in sorted(by):
        f, v = waves[-1][1] + by[s].f, waves[-1][2] + by[s].v
        if s * each > waves[-1][0] and (f > max_filter_bytes or 16 * v > max_table_bytes):
            waves.append([s * each, by[s].f, by[s].v])
        else:
            waves[-1][1:] = f, v
    ends = [w[0] for w in waves[1:]] + [1 << power]
    waves = [(low, high, f, v) for (low, f, v), high in zip(waves, ends, strict=True)]
    return {"shift": int(shift), "N": sum(r.n for r in rows), "V": sum(r.v for r in rows), "built": built, "waves": waves, "docs": size.d, "held": []}


def release(model: dict) -> None:
    """Drops the broadcasts that scores not yet written still need."""
    while model["held"]:
        model["held"].pop().destroy()


def _wave(model: dict, low: int, high: int, n_bytes: int, n_words: int) -> tuple:
    """The filter of the segments from low to high (its words, and where each segment begins and how many it has) and their words in order with their counts."""
    filt, keys, counts = np.zeros(1 + n_bytes // 8, np.uint64), np.zeros(n_words, np.uint64), np.zeros(n_words, np.int64)
    first, size = np.zeros(high - low, np.int64), np.ones(high - low, np.int64)  # a segment that holds nothing is one empty word
    f, v = 1, 0
    for r in model["built"].where(f"segment >= {low} and segment < {high}").select("segment", "filter", "words", "counts").toLocalIterator():
        x, w = np.frombuffer(r.filter, np.uint64), np.frombuffer(r.words, np.uint64)
        first[r.segment - low], size[r.segment - low] = f, len(x)
        filt[f : f + len(x)] = x
        keys[v : v + len(w)], counts[v : v + len(w)] = w, np.frombuffer(r.counts, np.int64)
        f, v = f + len(x), v + len(w)
    order = np.argsort(keys)
    return filt, first, size, keys[order], counts[order]


def _segment(keys: np.ndarray, shift: np.uint64, low: int, high: int) -> np.ndarray:
    seg = (keys >> shift).astype(np.int64)
    return (seg >= low) & (seg < high)


def scored(docs: DataFrame, model: dict, keep_text: bool = True) -> DataFrame:
    """Adds _lm_tokens, _lm_known, _lm_base (base score), _lm_score and _lm_train_tokens to docs (which have a column text, left out of the result if not to be kept)."""
    sc = docs.sparkSession.sparkContext
    names = docs.columns
    at_text = names.index("text")
    waves, shift, n_all, n_docs = model["waves"], np.uint64(model["shift"]), model["N"], model["docs"]
    floor = n_all + 0.5 * (model["V"] + 1)
    added = {"_lm_tokens": LongType(), "_lm_known": LongType(), "_lm_base": DoubleType(), "_lm_score": DoubleType(), "_lm_levels": BinaryType()}
    out = docs
    for low, high, *sizes in waves:
        wave = sc.broadcast(_wave(model, low, high, *sizes))
        last = low == waves[-1][0]
        kept = [k for k, x in enumerate(names) if keep_text or not last or k != at_text]
        names_now = [*(names[k] for k in kept), *(a for a in added if not (last and a == "_lm_levels"))]

        def run(batches: Iterator[pa.RecordBatch], low: int = low, high: int = high, wave=wave, last: bool = last, kept: list = kept, names_now: list = names_now) -> Iterator[pa.RecordBatch]:
            words, first, sizes, keys, counts = wave.value
            f = Filter(words, first, int(shift), low, sizes)
            for b in batches:
                data, offsets = T.text_buffer(b.column(at_text))
                for i, j in T.runs(offsets, RUN_BYTES):
                    rows = b.slice(i, j - i)
                    w, pair, at = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    u, back = np.unique(w, return_inverse=True)
                    mine = _segment(u, shift, low, high)
                    k = np.minimum(np.searchsorted(keys, u), max(0, len(keys) - 1))
                    hit = mine & (keys[k] == u) if len(keys) else np.zeros(len(u), bool)
                    c = np.where(hit, counts[k] if len(keys) else 0, 0).astype(np.float64)
                    part = np.where(mine, np.log10((c + 0.5) / floor), 0.0)
                    known, base = np.add.reduceat(hit[back].astype(np.int64), at[:-1]), np.add.reduceat(part[back], at[:-1])
                    levels = np.zeros((len(w), 3), np.uint8)
                    if low:
                        known, base = known + rows.column("_lm_known").to_numpy(), base + rows.column("_lm_base").to_numpy()
                        levels = np.frombuffer(b"".join(rows.column("_lm_levels").to_pylist()), np.uint8).reshape(-1, 3).copy()

                    def look(x: np.ndarray) -> np.ndarray:  # levels of the keys of this wave's segments
                        got, here = np.zeros(len(x), np.uint8), _segment(x, shift, low, high)
                        got[here] = f.levels(x[here])
                        return got

                    prev = np.empty(len(w), np.int64)
                    prev[1:] = back[:-1]
                    prev[at[:-1]] = len(u)
                    kinds = np.append(u, START) & _HIGH
                    p, again = np.unique(pair, return_inverse=True)
                    # a key is in one wave's segments, in the others its level is 0
                    levels[:, 0] += look(T.mix(u) & ~_HIGH | u & _HIGH)[back]
                    levels[:, 1] += look(kinds | (T.mix(kinds + TYPES) >> np.uint64(32)))[prev]
                    levels[:, 2] += look(p)[again]
                    score = np.zeros(len(known))
                    if last:
                        history = np.empty(len(w))
                        history[1:] = _UP[levels[:-1, 0]]
                        history[at[:-1]] = float(n_docs)
                        single, th = (_LOW[levels[:, 0]] + 0.5) / floor, _UP[levels[:, 1]]
                        both = _LOW[levels[:, 2]]
                        ch = np.maximum(history, both)
                        both = np.where(th > 0, both, 0.0)
                        prob = np.where(th > 0, (both + th * single) / np.maximum(ch + th, 1e-300), single)
                        score = np.add.reduceat(np.log10(np.minimum(prob, 1.0)), at[:-1])
                    new = [pa.array(x) for x in (np.diff(at), known, base, score)]
                    if not last:
                        new.append(pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((3 * at).astype(np.int32)), pa.py_buffer(levels)]))
                    yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in kept), *new], names_now)

        out = out.mapInArrow(run, StructType([*(docs.schema.fields[k] for k in kept), *(StructField(a, added[a]) for a in names_now[len(kept) :])]))
        if not last:
            out = checkpointed(out)
            wave.destroy()
        else:
            model["held"].append(wave)
    return out.withColumn("_lm_train_tokens", F.lit(n_all).cast("long"))
