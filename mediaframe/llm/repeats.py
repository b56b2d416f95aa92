"""Removing long repeats with a run-length index.

Candidates: every 200-byte string chooses the first of its 32-byte grams with the least hash; equal strings choose equal
grams at equal places, so both occurrences lie in regions of the same gram (the strings that chose it are adjacent; a
region is the text that they span). Regions of grams that occur once can't repeat. Equal regions are one, counted; all
their strings repeat if there are two or more.

Different regions of a gram are indexed: the regions of a bucket of grams form one text, of which a run-compressed
Burrows-Wheeler transform is built with suffix positions sampled at both ends of every run. All regions are streamed
through it from their ends by steps back on its runs. Within a run the longest matches with the neighbours in suffix order
grow by one a step; at a run's ends they are those with the nearest runs of the same symbol, found once from the samples.
That gives the matching statistics of all positions, and those of 200 or more are marked.
Where a gram has more than `most` different regions (the edges of a passage that very many documents share), their strings
choose again, taking the grams that several of these regions hold last: strings at the passage's edges then choose grams
of their own, and those inside have equal regions. A gram that still has more than `most` different regions is dealt over
chunks, each indexed on its own; strings that repeat within no chunk are then compared across chunks by hash, one row a
chunk and string, added up before the shuffle. So no gram's regions meet in one task, however many they are, and the work
stays in proportion to their text.

Documents are told apart by 128 bits of hashes of doc_id and text, so rows alike in both share their marks. Texts are
shuffled once: they are kept by that key for cutting out regions and for removing what is found.

Nulls: a null text is empty (no bytes); a null doc_id is a value like any other. Repeated rows are documents of their own,
so their long strings repeat; extra columns are ignored, whatever their names; a text longer than a run is a run of its
own, so memory grows with the longest text; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.llm import _text as T
from mediaframe.llm._spark import by_merging, checkpointed

GRAM = 32
BUCKET_BYTES = 1 << 19


def regions(data: np.ndarray, offsets: np.ndarray, length: int, common: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Document, start in it, number of strings, gram hash and content hash of each region of the texts. Grams in common (sorted) are chosen only by strings without others."""
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    pre = T.prefix_hash(data)
    _, inv = T.powers(len(data) + 1)
    gram = T.mix((pre[GRAM:] - pre[:-GRAM]) * inv[: len(data) - GRAM + 1])
    bits = np.uint64(len(data).bit_length())
    rank = gram >> np.uint64(1)
    if common is not None and len(common):
        at = np.minimum(np.searchsorted(common, gram), len(common) - 1)
        rank[common[at] == gram] |= np.uint64(1 << 63)
    key = rank >> bits << bits | np.arange(len(gram), dtype=np.uint64)
    span, low = length - GRAM + 1, key
    have = 1
    while have * 2 <= span:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    low = np.minimum(low[:n], low[span - have :][:n])
    at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ok = np.zeros(n, bool)
    edge = np.zeros(n + 1, np.int64)
    last = offsets[1:] - length + 1
    full = last > offsets[:-1]
    np.add.at(edge, offsets[:-1][full], 1)
    np.add.at(edge, last[full], -1)
    ok = np.cumsum(edge[:-1]) > 0
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    begin = ok.copy()
    begin[1:] &= ~(ok[:-1] & (at[1:] == at[:-1]) & (doc[1:] == doc[:-1]))
    start = np.flatnonzero(begin)
    stop = np.flatnonzero(ok & ~np.concatenate((ok[1:] & ~begin[1:], [False])))
    count = stop - start + 1
    end = stop + length
    text = T.mix((pre[end] - pre[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (at[start] - start).astype(np.uint64))
    return doc[start], start - offsets[doc[start]], count, gram[at[start]].view(np.int64), text.view(np.int64)


class RunLengthIndex:
    """A run-compressed transform of strings that end each with a mark of its own, with suffixes sampled at run ends."""

    def __init__(self, strings: list[bytes], depth: int) -> None:
        self.size = np.array([len(s) for s in strings])
        self.start = np.concatenate(([0], np.cumsum(self.size + 1)))[:-1]
        text = np.zeros(int(self.size.sum()) + len(strings), np.int64)
        owner = np.repeat(np.arange(len(strings)), self.size + 1)
        body = np.ones(len(text), bool)
        body[self.start + self.size] = False
        text[body] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + len(strings)
        text[~body] = np.arange(len(strings))  # the marks, each smaller than any byte and unlike the others
        self.text, self.end = text, (self.start + self.size)[owner]
        n = len(text)
        left = self.end - np.arange(n)  # symbols before the mark
        low = np.where(body, text - len(strings) + 1, 0)
        first = np.zeros(n, np.int64)
        for k in range(7):  # the next seven symbols, nothing after a mark
            first = first << 9
            first[: n - k] |= np.where(left[: n - k] >= k, low[k:], 0)
        order = np.argsort(first, kind="stable")
        a = first[order]
        new = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (left[order[1:]] < 7))))  # those with a mark stand alone, in the marks' order
        rank, have = np.empty(n, np.int64), 7
        rank[order] = new
        parts = 3 if n < 1 << 20 else 2  # ranks by the first `have` symbols, of which as many as fit make the next key
        while new[-1] < n - 1 and have <= depth:
            key = rank
            for k in range(1, parts):
                key = key * (n + 1)
                key[: max(0, n - k * have)] += rank[k * have :] + 1
            order = np.argsort(key)
            a = key[order]
            new = np.concatenate(([0], np.cumsum(a[1:] != a[:-1])))
            rank[order] = new
            have *= parts
        last = text[order - 1]  # the transform
        self.head = np.flatnonzero(np.concatenate(([True], last[1:] != last[:-1])))  # the row at which each run begins
        self.symbols, self.lengths = last[self.head], np.diff(np.append(self.head, n))
        self.at_head, self.at_tail = order[self.head], order[self.head + self.lengths - 1]  # the samples: suffixes at both ends of runs
        by_symbol = np.argsort(self.symbols, kind="stable")
        length = self.lengths[by_symbol]
        self.step = np.empty(len(by_symbol), np.int64)  # the row that a step back from each run's head leads to
        self.step[by_symbol] = np.cumsum(length) - length
        # a step back from a run's head lands below that from the tail of the symbol's run before it: how far these agree
        self.above, self.below = np.zeros(len(by_symbol), np.int64), np.zeros(len(by_symbol), np.int64)
        x, y = by_symbol[:-1], by_symbol[1:]
        alike = self.symbols[x] == self.symbols[y]
        x, y = x[alike], y[alike]
        self.above[y] = self.below[x] = 1 + self._match(self.at_tail[x], self.at_head[y])

    def _match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes a and b, which end at their strings' marks."""
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        most = np.minimum(self.end[a] - a, self.end[b] - b)
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            live = live[(out[live] < most[live]) & (self.text[x] == self.text[y])]
            out[live] += 1
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each position of the text the longest match of what starts there with what starts anywhere else.

        All strings are streamed from their marks to their starts, a symbol a step, by steps back on the runs alone. Within
        a run the rows above and below make the same step, so the matches with them grow by one; at a run's ends the
        matches with the symbol's runs before and after it are known.
        """
        out = np.zeros(len(self.text), np.int64)
        order = np.argsort(-self.size, kind="stable")
        size, at = self.size[order], (self.start + self.size)[order]
        row = order.astype(np.int64)  # the suffix of a mark alone stands in the marks' order
        up, down = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        going = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")  # strings longer than the steps made
        for k, n in enumerate(going.tolist()):
            run = np.searchsorted(self.head, row[:n], "right") - 1
            off = row[:n] - self.head[run]
            up = np.where(off == 0, self.above[run], up[:n] + 1)
            down = np.where(off == self.lengths[run] - 1, self.below[run], down[:n] + 1)
            row = self.step[run] + off
            out[at[:n] - 1 - k] = np.maximum(up, down)
        return out

    def marked(self, length: int) -> list[np.ndarray]:
        """For each string the starts of its substrings of that length that occur again."""
        hit = self.matching_statistics() >= length
        return [np.flatnonzero(hit[s : s + k]) for s, k in zip(self.start.tolist(), self.size.tolist(), strict=True)]


def _spans(starts: np.ndarray) -> bytes:
    """Runs of consecutive starts as pairs (first, number)."""
    first = np.flatnonzero(np.concatenate(([True], np.diff(starts) != 1))) if len(starts) else np.zeros(0, np.int64)
    return np.stack((starts[first], np.diff(np.append(first, len(starts)))), 1).astype(np.int32).tobytes()


def _occurrences(length: int):
    """Rows of the regions of each text: the key k, k2, start and number of strings in one number, gram and content hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = T.text_buffer(b.column(2))
            for i, j in T.runs(offsets, 2 << 20):
                doc, start, count, gram, text = regions(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)
                at = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(start << 32 | count), pa.array(gram), pa.array(text)], ["k", "k2", "at", "gram", "text"])

    return run


def _cut(length: int):
    """Rows (gram, text, chunk, many, region bytes) of the asked regions of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = T.text_buffer(b.column(0))
            asked = b.column(1).to_pylist()
            out = [(r["gram"], r["text"], r["chunk"], r["many"], data[o + r["start"] : o + r["start"] + r["n"] + length - 1].tobytes()) for o, rs in zip(offsets[:-1].tolist(), asked, strict=True) for r in rs]
            for i in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[i : i + 20_000], strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], ["gram", "text", "chunk", "many", "body"])

    return run


def _common_grams(bodies: DataFrame) -> np.ndarray:
    """The grams that several of about eight regions hold, for each gram of bodies, the 2**14 with most regions at most. Any list gives the same result, as it only sets which grams strings choose."""
    top = bodies.groupBy("gram").agg(F.first("r").alias("r")).orderBy(F.desc("r"), "gram").limit(1 << 14).select("gram")
    some = bodies.where(F.pmod(F.xxhash64("text", F.lit(2)), F.ceil(F.col("r") / 8)) == 0).join(F.broadcast(top), "gram", "left_semi").select("gram", "body")

    def grams(_: tuple, g: pd.DataFrame) -> pd.DataFrame:
        found = []
        for body in g.body:
            pre = T.prefix_hash(np.frombuffer(body, np.uint8))
            _, inv = T.powers(len(body) + 1)
            found.append(np.unique(T.mix((pre[GRAM:] - pre[:-GRAM]) * inv[: len(body) - GRAM + 1])))
        h, n = np.unique(np.concatenate(found), return_counts=True)
        return pd.DataFrame({"g": [h[n >= min(2, len(found))].tobytes()]})

    rows = some.groupBy("gram").applyInPandas(grams, "g binary").toLocalIterator()  # at most 2**14 rows of a few kB
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r.g, np.uint64) for r in rows)]))


def _chosen_again(length: int, common):
    """Regions (gram2, text2, their start and number of strings) within each region's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = b.column(5).to_pylist()
            for k in range(0, len(bodies), 4096):
                part = bodies[k : k + 4096]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in part])))
                row, start, count, gram, text = regions(np.frombuffer(b"".join(part), np.uint8), offsets, length, common.value)
                kept = b.select(range(5)).take(pa.array(row + k))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(gram), pa.array(text), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], [*kept.schema.names, "gram2", "text2", "start2", "n2"])

    return run


def _indexed(length: int):
    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        """spans: strings that repeat within the bucket; rest: for grams in several chunks, the hash and place of each different string."""
        bodies = list(g.body)
        marks = RunLengthIndex(bodies, max(map(len, bodies))).marked(length)
        rest = []
        for many, body in zip(g.many, bodies, strict=True):
            if many:
                pre = T.prefix_hash(np.frombuffer(body, np.uint8))
                _, inv = T.powers(len(body) + 1)
                rest.append(T.mix((pre[length:] - pre[:-length]) * inv[: len(body) - length + 1]).tobytes())
            else:
                rest.append(None)
        return pd.DataFrame({"gram": g.gram, "text": g.text, "chunk": g.chunk, "spans": [_spans(m) for m in marks], "rest": rest})

    return run


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for gram, text, chunk, rest in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            h = np.frombuffer(rest, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), gram)), pa.array(np.full(len(h), text)), pa.array(np.full(len(h), chunk, np.int32)), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h)], ["gram", "text", "chunk", "at", "h"])


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = T.text_buffer(b.column(1))
            rows = []
            for lo, hi, spans in zip(offsets[:-1].tolist(), offsets[1:].tolist(), b.column(2).to_pylist(), strict=True):
                body = data[lo:hi]
                edge = np.zeros(len(body) + 1, np.int64)
                for s in spans or ():
                    edge[s["s"]] += 1
                    edge[s["s"] + s["n"] + length - 1] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                rows.append((len(body), int(gone.sum()), int((gone & ~np.concatenate(([False], gone[:-1]))).sum()), body[~gone].tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array([hashlib.sha256(x).hexdigest() for x in cols[3]], pa.string()), pa.array(cols[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 200, most: int = 512, held: list | None = None) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): kept is the text's bytes without those in a string of length bytes that starts anywhere else too. What is kept in memory or on disk until the result is written is added to held, to be unpersisted then."""
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k"), F.xxhash64("text", "doc_id", F.lit(1)).alias("k2"))
    keyed = docs.repartition("k", "k2").persist()
    if held is not None:
        held.append(keyed)
    occ = docs.select("k", "k2", "text").mapInArrow(_occurrences(length), "k long, k2 long, at long, gram long, text long")
    each = occ.groupBy("gram", "text").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("k", "k2", "at")).alias("one"))
    place = lambda x: [F.shiftrightunsigned(x, 32).cast("int").alias("start"), F.col(x).bitwiseAND(0xFFFFFFFF).cast("int").alias("n")]
    each = each.select("gram", "text", "c", "one.k", "one.k2", *place("one.at"))
    many = each.groupBy("gram").agg(F.sum("c").alias("g"), F.count(F.lit(1)).alias("r"), F.sum(F.col("n") + length).alias("b")).where("g > 1").drop("g")
    first = checkpointed(each.join(many, "gram"))

    def cut_out(ask: DataFrame) -> DataFrame:
        """ask: gram, text, chunk, many, k, k2, start, n. Rows alike in doc_id and text are cut once."""
        asked = ask.groupBy("k", "k2").agg(F.collect_list(F.struct("gram", "text", "chunk", "many", "start", "n")).alias("asked"))
        return keyed.dropDuplicates(["k", "k2"]).join(asked, ["k", "k2"]).select("text", "asked").mapInArrow(_cut(length), "gram long, text long, chunk int, many boolean, body binary")

    names = ["gram", "text", "c", "k", "k2", "start", "n", "r", "b"]
    region, again = first.select(names), None
    if not first.where(F.col("r") > most).isEmpty():
        crowd = first.where(F.col("r") > most)
        bodies = cut_out(crowd.withColumns({"chunk": F.lit(0), "many": F.lit(False)})).select("gram", "text", "body")
        bodies = checkpointed(bodies.join(by_merging(crowd.select("gram", "text", "c", "k", "k2", "start", "r")), ["gram", "text"]))
        common = docs.sparkSession.sparkContext.broadcast(_common_grams(bodies))
        cells = bodies.select("gram", "text", "c", F.struct("k", "k2").alias("key"), "start", "body")
        again = checkpointed(cells.mapInArrow(_chosen_again(length, common), "gram long, text long, c long, key struct<k:long,k2:long>, start int, gram2 long, text2 long, start2 int, n2 int").withColumn("gram2", F.xxhash64("gram", "gram2")))
        each = again.groupBy("gram2", "text2").agg(F.sum("c").alias("c"), F.min(F.struct("key", (F.col("start") + F.col("start2")).alias("start"), "n2")).alias("one"))
        each = each.select(F.col("gram2").alias("gram"), F.col("text2").alias("text"), "c", "one.key.*", "one.start", F.col("one.n2").alias("n"))
        many = each.groupBy("gram").agg(F.sum("c").alias("g"), F.count(F.lit(1)).alias("r"), F.sum(F.col("n") + length).alias("b")).where("g > 1").drop("g")
        region = checkpointed(region.where(F.col("r") <= most).union(each.join(many, "gram").select(names)))
    size = region.where("r > 1").agg(F.coalesce(F.sum(F.col("n") + length), F.lit(0)).alias("b")).first().b
    buckets = max(1, int(size // BUCKET_BYTES))
    chunk = F.when(F.col("r") > most, F.pmod(F.xxhash64("text", F.lit(1)), F.ceil(F.col("r") / most))).otherwise(0).cast("int")
    cut = cut_out(region.where("r > 1").select("gram", "text", chunk.alias("chunk"), (F.col("r") > most).alias("many"), "k", "k2", "start", "n"))
    # grams in one chunk share buckets of about the same size; each chunk of the others has a bucket of its own
    bucket = F.when(F.col("many"), F.xxhash64("gram", "chunk")).otherwise(F.pmod(F.xxhash64("gram"), F.lit(buckets)))
    marks = checkpointed(cut.groupBy(bucket.alias("bucket")).applyInPandas(_indexed(length), "gram long, text long, chunk int, spans binary, rest binary"))
    strings = marks.where("rest is not null").select("gram", "text", "chunk", "rest").mapInArrow(_strings, "gram long, text long, chunk int, at int, h long")
    shared = strings.select("gram", "h", "chunk").distinct().groupBy("gram", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram", "h")
    across = strings.join(shared, ["gram", "h"]).select("gram", "text", F.array(F.struct(F.col("at").alias("s"), F.lit(1).alias("n"))).alias("spans"))
    inside = marks.select("gram", "text", "spans").mapInArrow(lambda it: (_unpacked(b) for b in it), "gram long, text long, spans array<struct<s:int,n:int>>").where(F.size("spans") > 0)
    copies = region.where("c > 1").select("gram", "text", F.array(F.struct(F.lit(0).alias("s"), F.col("n"))).alias("spans"))
    # written, so that the join below deals both sides anew and a region that very many documents share is split
    found = copies.union(inside).union(across)
    if again is not None:  # what was found in regions chosen again goes back to the regions that they lie in
        back = again.select(F.col("gram2").alias("gram"), F.col("text2").alias("text"), F.struct("gram", "text").alias("of"), "start2").join(by_merging(found), ["gram", "text"])
        back = back.select("of.gram", "of.text", F.expr("transform(spans, x -> struct(start2 + x.s as s, x.n as n))").alias("spans"))
        found = found.union(back)
    found = checkpointed(found.groupBy("gram", "text").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    mine = occ.join(by_merging(found), ["gram", "text"]).select("k", "k2", *place("at")[:1], "spans")
    mine = mine.select("k", "k2", F.expr("transform(spans, x -> struct(start + x.s as s, x.n as n))").alias("spans"))
    mine = mine.groupBy("k", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = keyed.join(by_merging(mine), ["k", "k2"], "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_removed(length), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _unpacked(b: pa.RecordBatch) -> pa.RecordBatch:
    spans = [[{"s": int(s), "n": int(n)} for s, n in np.frombuffer(x, np.int32).reshape(-1, 2)] for x in b.column(2).to_pylist()]
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("n", pa.int32())])))], ["gram", "text", "spans"])
