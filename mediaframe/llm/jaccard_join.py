"""Near-duplicate documents by an exact Jaccard join of word-shingle sets.

Equal sets are one class. Whole documents are all about equally far (1) from each other, so the outer pivots are single
shingles: in one global order (those found in many documents last, else by hash) two sets of similarity t or more have
their first common shingle among the first n - ceil(t n) + 1 of each. A class is therefore replicated to the regions of
that many pivots, and each linked pair meets in one. Regions, joined on their own, come packed in arrays by segment of
the hash, those of hot shingles by class. A region of at most `direct` classes is compared as it is (a few pairs a row).
A larger one gets a class as pivot: all others are compared with it, links merge components, and where a region still
holds several, its classes are joined in pairs of blocks, those of different components only. A block pair first names
the classes that its bounds leave, then decides them on the whole sets and returns a spanning forest of its links.

Two classes are compared only if their distances from the region's pivot, where known, differ by at most 1 - t (triangle
inequality), and if the region's shingle can be their first common one: each must have enough shingles from there on, as
nothing before is common. A pair is first tested by parities of the counts of shingles in hashed buckets, a bit each (those
that differ are at most the symmetric difference); what passes is decided on the whole sets.

Nulls and ties: a null or empty text, or one without words, has the empty set and links with nothing. Rows that repeat are
documents of their own; a null doc_id takes part but never is a component's number unless alone (then null). Extra columns
are ignored, whatever their names. A text longer than a run is a run of its own, so memory grows with the longest text.
An empty table gives an empty result. Shingles and sets are identified by 64-bit hashes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.llm import _text as T
from mediaframe.llm._spark import by_merging, checkpointed, components, sized

NUM, DEN = 3, 4  # the similarity, 0.75
HOT_SHARE, HOT_LEAST, HOT_MOST = 1 << 14, 8, 1 << 19
SEGMENT_BYTES = 4 << 20
#: Entries of regions that a task packs together; rows of ids (24 bytes each) that are broadcast at most, beyond which they are joined by shuffling.
ENTRIES, BROADCAST_ROWS = 1 << 18, 1 << 20
PIVOT_PAIRS, GROUP_ROWS = 512, 1 << 15
#: Shingles of a task that are counted together for the order.
COUNTED = 3 << 18
_END = np.uint64(0xB5297A4D2C1B3E6F)


def class_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each set; 0 for the empty set alone."""
    size = np.array([len(s) for s in sets])
    flat = T.mix(np.concatenate([*sets, np.zeros(1, np.uint64)]) + _END)
    at = np.concatenate(([0], np.cumsum(size)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(flat)))  # a sum of mixed members, so independent of order
    out = T.mix(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return np.where(size > 0, out, np.uint64(0)).view(np.int64)


def signature(s: np.ndarray) -> bytes:
    """Parities of the counts of shingles in 4 to 8 buckets a shingle, a bit each, their number a power of two."""
    m = 8 << (len(s).bit_length() - 1)
    return np.packbits((np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(bool)).tobytes()


def _halved(x: np.ndarray, size: int) -> np.ndarray:
    """The signature of the same set in so many bytes: where buckets fall together, parities add up."""
    return np.bitwise_xor.reduce(x.reshape(-1, size), 0)


def may_link(a: bytes, b: bytes, n: int, k: int) -> bool:
    """False only if sets of n and k shingles with these signatures are surely less similar than 3/4: parities that differ are at most as many as shingles in one set alone."""
    if NUM * max(n, k) > DEN * min(n, k):
        return False
    size = min(len(a), len(b))
    x, y = (_halved(np.frombuffer(v, np.uint8), size) for v in (a, b))
    return (DEN + NUM) * int(np.bitwise_count(x ^ y).sum()) <= (DEN - NUM) * (n + k)


def _runs(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in batches:
        data, offsets = T.text_buffer(b.column(at))
        for i, j in T.runs(offsets, 1 << 20):
            yield b.slice(i, j - i), T.shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and one for about COUNTED shingles with those among them that are there more than once and their counts."""
    names, types = ["doc_id", "h", "n", "c", "sig", "hot", "hot_n"], (*(pa.int64(),) * 4, *(pa.binary(),) * 3)
    kept, waiting = [], 0

    def often() -> pa.RecordBatch:
        s = np.sort(np.concatenate(kept))
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(s)))
        row = (None, None, -1, None, None, s[first][count > 1].tobytes(), count[count > 1].astype(np.uint32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

    for b, sets in _runs(batches, 2):
        none = [None] * len(sets)
        cols = (b.column(0).to_pylist(), b.column(1).to_pylist(), [len(s) for s in sets], class_ids(sets).tolist(), [signature(x) if len(x) else None for x in sets], none, none)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names)
        kept += sets
        waiting += sum(map(len, sets))
        if waiting >= COUNTED:
            yield often()
            kept, waiting = [], 0
    if kept:
        yield often()


def _hot(described: DataFrame, n_docs: int) -> np.ndarray:
    """Shingles found in about one of 2**14 documents or more, the most frequent HOT_MOST at most. They only set the order (and where a region is spread), so any list gives the same links."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(s, np.int64)), pa.array(np.frombuffer(c, np.uint32).astype(np.int64))], ["s", "k"])

    rows = described.where("n = -1").select("hot", "hot_n").mapInArrow(unpack, "s long, k long")
    rows = rows.groupBy("s").agg(F.sum("k").alias("k")).where(F.col("k") >= max(HOT_LEAST, n_docs // HOT_SHARE)).orderBy(F.desc("k"), "s").limit(HOT_MOST)
    return np.sort(rows.select("s").toArrow()["s"].to_numpy().view(np.uint64))


def _regions(docs: DataFrame, hot: np.ndarray, power: int, direct: int) -> DataFrame:
    """Rows (kind, s, a, b, n, rest): a pair of classes to compare in a small region (kind 0), or a class a of a large region s (kind 1) or of one whose shingle is hot (kind 2), its size and how many of its shingles are not before the region's."""
    known = docs.sparkSession.sparkContext.broadcast(hot)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed rows, those of a segment together; of hot shingles by the class, so that no region meets in one task."""
        h, seen, kept, waiting = known.value, set(), [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            s, c, n, place, warm = (np.concatenate(x) for x in zip(*kept, strict=True))
            to = np.where(warm, -1 - (c.view(np.uint64) & np.uint64((1 << power) - 1)).astype(np.int64), (s >> np.uint64(64 - power)).astype(np.int64))
            order = np.argsort(to, kind="stable")
            s, c, n, place, to = s[order], c[order], n[order], place[order], to[order]
            low = (s >> np.uint64(32 - power) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            ends = np.append(first[1:], len(to))
            for k in range(0, len(first), 4096):
                cut = list(zip(first[k : k + 4096].tolist(), ends[k : k + 4096].tolist(), strict=True))
                shingle = [(s if to[i] < 0 else low)[i:j].tobytes() for i, j in cut]
                yield pa.RecordBatch.from_arrays([pa.array(to[first[k : k + 4096]].astype(np.int32)), pa.array(shingle, pa.binary()), *(pa.array([x[i:j].tobytes() for i, j in cut], pa.binary()) for x in (c, n, place))], ["segment", "s", "c", "n", "place"])

        for _, sets in _runs(batches, 0):
            for s, c in zip(sets, class_ids(sets).tolist(), strict=True):
                n = len(s)
                if not n or c in seen:
                    continue
                if len(seen) >= 1 << 19:
                    seen.clear()  # copies that come again are merged where they meet
                seen.add(c)
                p = n - -(-NUM * n // DEN) + 1
                warm = np.zeros(n, bool)
                if len(h):
                    warm = h[np.minimum(np.searchsorted(h, s), len(h) - 1)] == s
                    s, warm = np.concatenate((s[~warm], s[warm])), np.sort(warm)
                kept.append((s[:p], np.full(p, c, np.int64), np.full(p, n, np.uint32), np.minimum(np.arange(p), 65535).astype(np.uint16), warm[:p]))
                waiting += p
                if waiting >= ENTRIES:
                    yield from packed()
                    kept, waiting = [], 0
        if kept:
            yield from packed()

    def meet(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        warm = key[0] < 0
        s, c, n, place = (np.frombuffer(b"".join(parts[k]), t) for k, t in (("s", np.uint64 if warm else np.uint32), ("c", np.int64), ("n", np.uint32), ("place", np.uint16)))
        order = np.lexsort((place, c, s))
        s, c, n = s[order], c[order], n[order].astype(np.int64)
        rest = n - place[order]
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (c[1:] != c[:-1]))) if len(s) else np.zeros(0, bool)
        s, c, n, rest = s[new], c[new], n[new], rest[new]
        if warm:
            return pd.DataFrame({"kind": np.full(len(s), 2, np.int32), "s": (s ^ np.uint64(1 << 63)).view(np.int64), "a": c, "b": np.zeros(len(s), np.int64), "n": n, "rest": rest})
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(s)))
        pairs = []
        for k in range(2, direct + 1):
            at = first[size == k]
            for i, j in itertools.combinations(range(k), 2):
                x = at[(DEN + NUM) * np.minimum(rest[at + i], rest[at + j]) >= NUM * (n[at + i] + n[at + j])]
                pairs.append(np.stack((c[x + i], c[x + j]), 1))
        pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        large = np.repeat(size > direct, size)
        region = (np.int64(key[0]) << 32) | s[large].astype(np.int64)
        zero = np.zeros(len(pairs), np.int64)
        return pd.DataFrame({"kind": np.repeat(np.array([0, 1], np.int32), (len(pairs), int(large.sum()))), "s": np.concatenate((zero, region)), "a": np.concatenate((pairs[:, 0], c[large])),
                             "b": np.concatenate((pairs[:, 1], np.zeros(large.sum(), np.int64))), "n": np.concatenate((zero, n[large])), "rest": np.concatenate((zero, rest[large]))})

    packed = docs.select("text").mapInArrow(replicate, "segment int, s binary, c binary, n binary, place binary")
    return packed.groupBy("segment").applyInPandas(meet, "kind int, s long, a long, b long, n long, rest long")


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column(k).to_pylist() for k in range(2, 6)]
        yield b.select([0, 1, 6]).filter(pa.array([may_link(*x) for x in zip(*cols, strict=True)], pa.bool_()))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        common, union = [], []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            k = len(np.intersect1d(x, y, assume_unique=True))
            common.append(k)
            union.append(len(x) + len(y) - k)
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(common, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "common", "all"])


def _near_pairs(g: pd.DataFrame, signatures: dict[int, bytes]) -> Iterator[tuple[int, int]]:
    """Rows of a group of region blocks (their places in g) that can be links: labels differ, neither is the region's pivot, sizes, places and distances from the pivot are within their bounds, and so are the signatures."""
    n, rest, label, own, star = (g[k].to_numpy() for k in ("n", "rest", "label", "own", "star"))
    d0 = g.d0.to_numpy(np.float64)
    sig = [np.frombuffer(signatures[c], np.uint8) for c in g.c.tolist()]
    length = np.array([len(x) for x in sig])
    for (_, i, j), at in g.groupby(["s", "i", "j"]).indices.items():
        left = at[(own[at] == i) & ~star[at]]
        right = left if i == j else at[(own[at] == j) & ~star[at]]
        for k in range(0, len(left), 256):
            x = left[k : k + 256, None]
            ok = (label[x] != label[right]) & (NUM * np.maximum(n[x], n[right]) <= DEN * np.minimum(n[x], n[right])) & ((DEN + NUM) * np.minimum(rest[x], rest[right]) >= NUM * (n[x] + n[right]))
            ok &= ~(np.abs(d0[x] - d0[right]) > 1 - NUM / DEN + 1e-9)  # the triangle inequality; an unknown distance excludes nothing
            if i == j:
                ok &= x < right
            a, b = np.nonzero(ok)
            a, b = left[k + a], right[b]
            short = np.minimum(length[a], length[b])
            for m in np.unique(short).tolist():
                u, v = a[short == m], b[short == m]
                ids, back = np.unique(np.concatenate((u, v)), return_inverse=True)
                folded = np.stack([_halved(sig[r], m) for r in ids])
                for q in range(0, len(u), 4096):
                    x, y = u[q : q + 4096], v[q : q + 4096]
                    apart = np.bitwise_count(folded[back[q : q + len(x)]] ^ folded[back[len(u) + q : len(u) + q + len(x)]]).sum(1, dtype=np.int64)
                    near = (DEN + NUM) * apart <= (DEN - NUM) * (n[x] + n[y])
                    yield from zip(x[near].tolist(), y[near].tolist(), strict=True)


def _asked(_: tuple, g: pd.DataFrame, described: pd.DataFrame) -> pd.DataFrame:
    """The rows of a group whose sets are needed to decide its pairs."""
    at = sorted({r for pair in _near_pairs(g, dict(zip(described.c, described.sig, strict=True))) for r in pair})
    return g.iloc[at]


def _joined(_: tuple, g: pd.DataFrame, fetched: pd.DataFrame) -> pd.DataFrame:
    """Links between labels of a group, as many as join what its links join."""
    sets = {c: np.frombuffer(x, np.uint64) for c, x in zip(fetched.c, fetched.members, strict=True)}
    root = {x: x for x in g.label.unique().tolist()}
    label, c = g.label.tolist(), g.c.tolist()

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out, apart = [], set()
    for a, b in _near_pairs(g, {k: signature(x) for k, x in sets.items()}):
        x, y = top(label[a]), top(label[b])
        pair = (min(c[a], c[b]), max(c[a], c[b]))
        if x != y and pair not in apart:
            p, q = sets[c[a]], sets[c[b]]
            k = len(np.intersect1d(p, q, assume_unique=True))
            if k * DEN >= (len(p) + len(q) - k) * NUM:
                root[max(x, y)] = min(x, y)
                out.append((label[a], label[b]))
            else:
                apart.add(pair)
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def near_documents(docs: DataFrame, direct: int = 8, block: int = 1024) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of docs (columns doc_id, text). direct: regions of at most so many classes are compared as they are; block: classes of a block of a larger one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    described = checkpointed(texts.mapInArrow(_described, "doc_id long, h long, n long, c long, sig binary, hot binary, hot_n binary"))
    rows = described.where("n >= 0")
    size = rows.agg(F.count(F.lit(1)).alias("d"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    classes = rows.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "h")).alias("text_of"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = classes.repartition("c").persist()  # kept by key, so only what is joined to it is shuffled
    power = min(30, max(5, int(np.ceil(np.log2(max(1, 3 * size.n / SEGMENT_BYTES))))))
    met = checkpointed(_regions(docs, _hot(described, size.d), power, direct))

    # regions with the same classes are one: their links' first common shingle is that of the first of them
    member = met.where("kind > 0").select("kind", "s", F.col("a").alias("c"), "n", "rest")
    pivot = F.min_by(F.struct("c", "n", "rest"), F.xxhash64("c")).alias("pivot")
    regions = member.groupBy("kind", "s").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y"), pivot).where("k > 1")
    regions = regions.groupBy("kind", "k", "x", "y").agg(F.min_by(F.struct("s", "pivot"), "s").alias("r")).select("kind", "k", "r.s", "r.pivot")
    of_pivot = regions.groupBy("pivot.c").agg(F.ceil(F.sum("k") / GROUP_ROWS).alias("m")).select(F.col("c").alias("p"), "m")  # groups for a pivot's regions
    regions, n_regions = sized(regions.join(by_merging(of_pivot), F.col("pivot.c") == F.col("p")).drop("p"))

    def of_regions(member: DataFrame, table: DataFrame) -> DataFrame:
        """Members with their region's row; a hot region can be large, so its row, one of HOT_MOST at most, goes to the members."""
        return member.where("kind = 1").join(by_merging(table.where("kind = 1")), ["kind", "s"]).unionByName(member.where("kind = 2").join(F.broadcast(table.where("kind = 2")), ["kind", "s"]))

    def fetched(wanted: DataFrame) -> DataFrame:
        """Sets (c, members) of the classes in wanted (c), from one text of each: that of its least doc_id and hash, so that rows of one doc_id, or of none, don't meet each other. Rows that are equal in both can be several, so one is chosen again."""
        chosen, n = sized(classes.join(wanted.distinct(), "c", "left_semi").select(F.col("text_of.doc_id").alias("id"), F.col("text_of.h").alias("hash"), F.col("c").alias("want")))
        chosen = F.broadcast(chosen) if n <= BROADCAST_ROWS else by_merging(chosen)

        def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, sets in _runs(batches, 0):
                keep = class_ids(sets) == b.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([b.column(1).filter(pa.array(keep)), pa.array([s.tobytes() for s, k in zip(sets, keep, strict=True) if k], pa.binary())], ["c", "members"])

        found = texts.join(chosen, (F.col("h") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("text", "want")
        return found.mapInArrow(sets_of, "c long, members binary").repartition("c").dropDuplicates(["c"]).persist()  # shuffled once; lost parts are made again from the texts

    # first round: the pairs of small regions, and each larger region's classes with its pivot. A pair begins with the class
    # of the lesser hash, as each pivot is in its region; a pivot's pairs are dealt over copies of it, one for PIVOT_PAIRS
    spread = lambda k: F.ceil(F.col(k) / PIVOT_PAIRS).cast("int").alias("m")
    first = F.xxhash64("a") < F.xxhash64("b")
    small = met.where("kind = 0").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"), F.lit(1).alias("m"))
    at_pivot = of_regions(member, regions).where("c <> pivot.c").where(f"{DEN + NUM} * least(rest, pivot.rest) >= {NUM} * (n + pivot.n)")
    pairs = small.union(at_pivot.select("pivot.c", "c", spread("k"))).groupBy("a", "b").agg(F.max("m").alias("m")).withColumn("part", F.pmod(F.xxhash64("b"), "m").cast("int"))
    copies = regions.where(F.col("k") > PIVOT_PAIRS).select("pivot.c", spread("k")).groupBy("c").agg(F.max("m").alias("m"))

    def copied(table: DataFrame) -> DataFrame:
        return table.join(by_merging(copies), "c", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("m", F.lit(1)) - 1))).drop("m")

    side = lambda t, x: t.select(F.col("c").alias(x), F.col("n").alias("n" + x), F.col("sig").alias("s" + x), *(["part"] if x == "a" else []))
    close = pairs.join(by_merging(side(copied(classes), "a")), ["a", "part"]).join(by_merging(side(classes, "b")), "b").where(f"{NUM} * greatest(na, nb) <= {DEN} * least(na, nb)")
    close, _ = sized(close.select("a", "b", "sa", "sb", "na", "nb", "part").mapInArrow(_passing, "a long, b long, part int"))
    sets = fetched(close.select(F.col("a").alias("c")).union(close.select("b")))
    of = lambda t, x: t.select(F.col("c").alias(x), F.col("members").alias("m" + x), *(["part"] if x == "a" else []))
    known = close.join(by_merging(of(copied(sets), "a")), ["a", "part"]).join(by_merging(of(sets, "b")), "b").select("a", "b", "ma", "mb").mapInArrow(_measured, "a long, b long, common long, all long")
    known, _ = sized(known)
    sets.unpersist()
    labels = components(known.where(F.col("common") * DEN >= F.col("all") * NUM).select("a", "b"))

    # second round: larger regions with several components, in pairs of blocks, classes of different components only
    if n_regions:
        far = known.select("a", "b", (1 - F.col("common") / F.col("all")).alias("d0"))
        far = far.union(far.select("b", "a", "d0")).toDF("c", "p", "d0")
        r = of_regions(member, regions).join(by_merging(labels.toDF("c", "component")), "c", "left").withColumn("label", F.coalesce("component", "c"))
        several = r.groupBy("kind", "s").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("kind", "s")
        r = of_regions(r, several).where("k > 2").select("s", "k", "m", "c", "n", "rest", "label", F.col("pivot.c").alias("p"), (F.col("c") == F.col("pivot.c")).alias("star"))
        r, left = sized(r)
    if n_regions and left:
        # small regions with the same pivot share most classes, so they meet in one group, which fetches each class once;
        # groups are of GROUP_ROWS or so at most, and each pair of blocks of a larger region is a group of its own
        r = r.join(by_merging(far), ["c", "p"], "left")
        blocks = F.ceil(F.col("k") / block).cast("int")
        r = r.withColumn("own", F.pmod(F.xxhash64("c", F.lit(2)), blocks).cast("int"))
        r = r.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
        shared = F.pmod(F.xxhash64("p", F.pmod(F.xxhash64("s"), "m")), F.lit(-(-left // block)))
        r = r.select(F.when(blocks == 1, shared).otherwise(F.xxhash64("s", "i", "j")).alias("g"), "s", "i", "j", "own", "c", "n", "rest", "label", "star", "d0")
        r, _ = sized(r)
        described_in = r.select("g", "c").distinct().join(by_merging(classes.select("c", "sig")), "c").select(F.col("g").alias("h"), F.col("c").alias("c"), F.col("sig").alias("sig"))
        asked, n_asked = sized(r.groupBy("g").cogroup(described_in.groupBy("h")).applyInPandas(_asked, r.schema))
        if n_asked:
            sets = fetched(asked.select("c"))
            fetched_in = asked.select("g", "c").distinct().join(by_merging(sets), "c").select(F.col("g").alias("h"), F.col("c").alias("c"), F.col("members").alias("members"))
            found = asked.groupBy("g").cogroup(fetched_in.groupBy("h")).applyInPandas(_joined, "a long, b long")
            moved = components(found).toDF("component", "to")
            sets.unpersist()
            nodes = moved.select(F.col("component").alias("node")).join(by_merging(labels), "node", "left_anti").select("node", F.col("node").alias("component"))
            labels = labels.union(nodes).join(by_merging(moved), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    root = classes.join(by_merging(labels.withColumnRenamed("node", "c")), "c", "left").select("c", "least", F.coalesce("component", "c").alias("root"))
    least = root.groupBy("root").agg(F.min("least").alias("component_id"))
    found = checkpointed(root.join(by_merging(least), "root").select(F.col("c").alias("cc"), "component_id"))
    classes.unpersist()
    out = rows.select("doc_id", "n", "c").join(found, (F.col("c") == F.col("cc")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
