"""Grouping of spelling variants: words that differ by one inserted, deleted or replaced code point.

Two words are one edit apart exactly if the lengths of their common prefix and common suffix add up to the longer
length minus one or more. One of the two then is at least half of that, so a word is listed under its first and its
last half, once for each length M (its own and one more) that the longer word can have; near words meet under one of
these. The lists are dealt, sorted and cut into blocks; words of a block are rows of a padded matrix of code points, and
pairs of blocks that share a list are compared as a whole, prefix and suffix lengths of all pairs at once, column by
column until no pair is left. A list of more than `block` words is cut into pairs of blocks by a hash, each a group of its
own, so no list meets in one task. A pair is counted under its prefix if that is long enough, else under its suffix, so
once; a group returns a row a word (number of near words, the best of them), not its pairs.

Words: `extract` counts runs of letters in texts, a bounded number of distinct words a task before they are merged.

Nulls and ties: a null text has no words; a null doc_id is written as an empty one. Of near words with the same n the
smallest in code-point order is the form. Repeated rows count again. Only doc_id and text are read, whatever other
columns there are. A word of any length is compared whole. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.llm._spark import by_merging, checkpointed

LETTERS = "A-Za-zÀ-ÿ"
#: Distinct words that a task counts before it passes them on; words of a group that is compared in one call, about.
COUNTED, GROUP_ROWS = 400_000, 1 << 13
#: Pairs of words that are compared together; cells of a block's matrix at most.
PAIRS, CELLS = 1 << 18, 1 << 20
_LOWER = {c: c + 32 for c in range(65, 91)}


def extract(docs: DataFrame, least_length: int = 5, typo: int = 97) -> DataFrame:
    """Rows (word, n): runs of letters of all texts, A-Z lower-cased, of at least least_length code points. One of `typo` runs of a document, by a hash, loses a code point."""
    find = re.compile(f"[{LETTERS}]{{{least_length},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                base = zlib.crc32(f"{'' if name is None else name}:".encode())
                for w, n in Counter(find(text)).items():
                    if not w.islower():
                        w = w.translate(_LOWER)
                    h = zlib.crc32(w.encode(), base)
                    if h % typo == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                        if len(w) < least_length:
                            continue
                    total[w] += n
                if len(total) >= COUNTED:
                    yield out()
                    total.clear()
        if total:
            yield out()

    d = docs.select(F.col("doc_id").cast("string").alias("name"), "text").where("text is not null")
    return d.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _half(m: np.ndarray | Column) -> np.ndarray | Column:
    """The least length of the longer of common prefix and suffix of two near words, the longer one of m code points."""
    return (m - m % 2) / 2 if isinstance(m, Column) else m // 2


def _matrix(flat: np.ndarray, first: np.ndarray, length: np.ndarray, width: int, right: bool) -> np.ndarray:
    """Code points of words, a row each, padded with zeros on the right, or on the left and reversed."""
    at = np.arange(width)
    place = (first + length - 1)[:, None] - at if right else first[:, None] + at
    inside = at < length[:, None]
    return np.where(inside, flat[np.where(inside, place, 0)], 0).astype(flat.dtype)


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For blocks x and y (block pair, word, code point) the number of equal leading columns of all pairs of their words."""
    alive = np.ones((x.shape[0], x.shape[1], y.shape[1]), bool)
    out = np.zeros(alive.shape, np.int32)
    for c in range(x.shape[2]):
        alive &= x[:, :, None, c] == y[:, None, :, c]
        if not alive.any():
            break
        out += alive
    return out


def near_in_group(words: list[str], key: np.ndarray, m: np.ndarray, by_prefix: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of a group that are near, each once: rows of one list (key, m, by_prefix) are compared if their sides differ or are negative."""
    order = np.lexsort((key, by_prefix, m))
    m, key, by_prefix, side = m[order], key[order], by_prefix[order], side[order]
    length = np.array([len(words[i]) for i in order.tolist()])
    flat = np.frombuffer("".join([words[i] for i in order.tolist()]).encode("utf-32-le"), np.uint32)
    if len(flat) and flat.max() < 256:
        flat = flat.astype(np.uint8)
    first = np.cumsum(length) - length
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (by_prefix[1:] != by_prefix[:-1]) | (m[1:] != m[:-1]))) if len(m) else np.zeros(0, bool)
    listed = np.cumsum(new)
    found = [np.zeros((2, 0), np.int64)]
    for size in np.unique(m).tolist():  # words of about one length, so that little is padded
        lo, hi = np.searchsorted(m, (size, size + 1)).tolist()
        rows = max(1, min(64, CELLS // size))
        blocks = -(-(hi - lo) // rows)
        at = np.minimum(lo + np.arange(blocks * rows), hi - 1)
        real = lo + np.arange(blocks * rows) < hi
        per = max(1, min(PAIRS // (rows * rows), CELLS // (rows * size)))
        ids, head, tail = np.where(real, listed[at], 0).reshape(blocks, rows), listed[at[::rows]], listed[np.minimum(at[::rows] + rows - 1, hi - 1)]
        for step in range(blocks):
            mine = np.flatnonzero(tail[: blocks - step] == head[step:]) if step else np.arange(blocks)
            if not len(mine):
                break
            for k in range(0, len(mine), per):
                a, b = mine[k : k + per], mine[k : k + per] + step
                ra, rb = at.reshape(blocks, rows)[a], at.reshape(blocks, rows)[b]
                ok = (ids[a][:, :, None] == ids[b][:, None, :]) & (ids[a] > 0)[:, :, None]
                ok &= (length[ra][:, :, None] == size) | (length[rb][:, None, :] == size)
                if step == 0:
                    ok &= np.tri(rows, k=-1, dtype=bool).T
                ok &= (side[ra][:, :, None] != side[rb][:, None, :]) | (side[ra] < 0)[:, :, None]
                if not ok.any():
                    continue
                shorter = np.minimum(length[ra][:, :, None], length[rb][:, None, :])
                both = []
                for right in (False, True):
                    x = [_matrix(flat, first[r.ravel()], length[r.ravel()], size, right).reshape(*r.shape, size) for r in (ra, rb)]
                    both.append(np.minimum(_common(*x), shorter))
                prefix, suffix = both
                half = _half(size)
                ok &= (prefix + suffix >= size - 1) & np.where(by_prefix[ra][:, :, None], prefix >= half, prefix < half)
                p, i, j = np.nonzero(ok)
                found.append(np.stack((order[ra[p, i]], order[rb[p, j]])))
    i, j = np.concatenate(found, 1)
    return i, j


def _summed(g: pd.DataFrame) -> pd.DataFrame:
    """Rows (word, n_near, best, best_n) of the words of a group that have near ones in it."""
    words, n = g.word.tolist(), g.n.to_numpy()
    i, j = near_in_group(words, *(g[c].to_numpy() for c in ("key", "m", "by_prefix", "side")))
    a, b = np.concatenate((i, j)), np.concatenate((j, i))
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    at = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
    text = lambda rows: pd.Series([words[k] for k in rows.tolist()], dtype=object)
    return pd.DataFrame({"word": text(a[at]), "n_near": np.diff(np.append(at, len(a))), "best": text(b[at]), "best_n": n[b[at]]})


def near_words(words: DataFrame, block: int = 2048) -> DataFrame:
    """Rows (word, n_near, best, best_n) of the words (word, n; different words) that have near ones; best has the largest n, then is the smallest. block: words of a list that are compared in one group."""
    size = F.length("word")
    d = words.withColumn("m", F.explode(F.array(size, size + 1))).withColumn("by_prefix", F.explode(F.array(F.lit(True), F.lit(False))))
    half = _half(F.col("m")).cast("int")
    part = F.when(F.col("by_prefix"), F.substring("word", F.lit(1), half)).otherwise(F.substring("word", size - half + 1, half))
    d = d.withColumn("key", F.xxhash64(part))
    lists = ["m", "by_prefix", "key"]
    sizes = d.groupBy(*lists).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    d = d.join(by_merging(sizes), lists)
    blocks = F.ceil(F.col("k") / block).cast("int")
    d = d.withColumn("own", F.pmod(F.xxhash64("word", F.lit(3)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    groups = max(1, words.count() * 4 // GROUP_ROWS)
    group = F.when(blocks == 1, F.xxhash64(F.pmod(F.xxhash64("key", "m"), F.lit(groups)))).otherwise(F.xxhash64("key", "m", "by_prefix", i, j))
    side = F.when((blocks == 1) | (i == j), -1).otherwise(F.when(F.col("own") == i, 0).otherwise(1))
    d = d.select(group.alias("group"), "word", "n", "m", "by_prefix", "key", side.alias("side"))
    found = d.repartition(max(8, groups // 8), "group").groupBy("group").applyInPandas(lambda g: _summed(g), "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("w"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.k")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) of the words that have a form (word, form): the last of the forms that follow each other. Each round goes twice as far, and n at least doubles at each form, so a few rounds do."""
    d = checkpointed(forms.select("word", F.col("form").alias("to")))
    while True:
        step = d.join(by_merging(d.select(F.col("word").alias("to"), F.col("to").alias("next"))), "to", "left")
        step = checkpointed(step.select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("on")))
        d = step.select("word", "to")
        if step.where("on").isEmpty():
            return d.withColumnRenamed("to", "root")


def variants(docs: DataFrame, least_length: int = 5, least_n: int = 3, typo: int = 97, factor: int = 2, block: int = 2048) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of the words of docs (doc_id, text) that occur least_n times or more; a word's form is its near word of largest n if that is at least factor * n."""
    words = checkpointed(extract(docs, least_length, typo).where(F.col("n") >= least_n))
    near = near_words(words, block)
    d = words.join(by_merging(near), "word", "left")
    has = F.col("best_n") >= factor * F.col("n")
    d = checkpointed(d.select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")))
    root = roots(d.where("form is not null").select("word", "form"))
    return d.join(by_merging(root), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
