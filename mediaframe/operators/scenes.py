"""Scene cuts, segments and intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaframe.functions.text import cosine_distance, numbered_name
from mediaframe.functions.timecode import format_duration
from mediaframe.operators.ordered import kept, plain_column


def score_threshold(df: DataFrame, key: str, t: str, score: str, threshold: float) -> DataFrame:
    """Different cut times (6 places) whose score is over the threshold."""
    return df.where((F.col(score) > threshold) & (F.col(t) >= 0)).select(key, F.round(t, 6).alias("t")).distinct()


def union_cuts(*cuts: DataFrame) -> DataFrame:
    out = cuts[0]
    for c in cuts[1:]:
        out = out.unionByName(c)
    return out.distinct()


#: A key's time is cut into spans of so many gaps for coalesce_min_gap; rows that are handled in one call, about.
SPAN_GAPS, CALL_ROWS = 1024, 1 << 16


def _groups_of(parts: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Rows sorted by the columns `by`, in runs of whole groups."""
    held: list[pd.DataFrame] = []
    rows = 0
    for g in parts:
        if not len(g):
            continue
        held.append(g)
        rows += len(g)
        if rows < CALL_ROWS:
            continue
        d = pd.concat(held, ignore_index=True)
        last = d[by].iloc[-1]
        same = np.logical_and.reduce([(d[c] == last[c]).to_numpy() | (d[c].isna().to_numpy() & pd.isna(last[c])) for c in by])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield d.iloc[:cut]
        held, rows = [d.iloc[cut:]], len(d) - cut
    if rows:
        yield pd.concat(held, ignore_index=True)


def _bounds(d: pd.DataFrame, by: list[str]) -> np.ndarray:
    """Where the groups of sorted rows begin, and their number of rows at the end."""
    codes = [pd.factorize(d[c], use_na_sentinel=False)[0] for c in by]
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in codes])
    return np.append(np.flatnonzero(np.concatenate(([True], new))), len(d))


def _successors(t: np.ndarray, starts: np.ndarray, gap: float) -> np.ndarray:
    """For each row of the groups (of ascending t) the first row of its group that is gap or more after it, itself where none is."""
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((np.repeat([1, 0], len(t)), np.concatenate((t, t + gap)), np.tile(group, 2)))
    place = np.cumsum(order < len(t))  # rows up to each place of the merged order
    nxt = np.empty(len(t), np.int64)
    nxt[order[order >= len(t)] - len(t)] = place[order >= len(t)]
    end = starts[group + 1]
    while True:  # t + gap is rounded, the difference decides
        back = np.flatnonzero((nxt - 1 > np.arange(len(t))) & (t[np.maximum(nxt - 1, 0)] - t >= gap))
        on = np.flatnonzero((nxt < end) & (t[np.minimum(nxt, len(t) - 1)] - t < gap))
        if not len(back) and not len(on):
            return np.where(nxt < end, nxt, np.arange(len(t)))
        nxt[back] -= 1
        nxt[on] += 1


def _squared(nxt: np.ndarray) -> Iterator[np.ndarray]:
    """The maps that go 1, 2, 4, ... steps along nxt, until none goes further."""
    while True:
        yield nxt
        further = nxt[nxt]
        if (further == nxt).all():
            return
        nxt = further


def coalesce_min_gap(df: DataFrame, key: str, t: str = "t", gap: float = 0.33, span_gaps: int = SPAN_GAPS) -> DataFrame:
    """Each key's first cut, and on from there always the next cut that is at least gap after the last one kept; null and NaN times go, of equal ones a positive gap keeps one.

    A key's time is cut into spans, each a group of its own. Which cut a span begins with depends on where the span before
    ends, so each span first tells for every cut that it can begin with (those within a gap of its start) which cut the next
    one then begins with: successors of all cuts, composed by doubling. Most spans end alike however they begin; where
    not, these small tables are composed by doubling too, until the beginnings of all spans are known. Then the cuts that the
    successors reach from them are kept.
    """
    real = F.col(t).isNotNull() & ~F.isnan(F.col(t).cast("double"))
    if gap <= 0:
        return df.select(key, t).where(real)
    kind, span = df.schema[key].dataType.simpleString(), gap * span_gaps
    d = kept(df.select(F.col(key).alias("k"), F.col(t).cast("double").alias("t")).where("t is not null and not isnan(t)").distinct().withColumn("s", F.floor(F.col("t") / span)))
    ahead = d.where(F.col("t") <= (F.col("s") + 1e-6) * span + gap).select("k", "t", (F.col("s") - 1).alias("s"), F.lit(True).alias("next"))
    rows = d.withColumn("next", F.lit(False)).unionByName(ahead)

    def gates(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(k, s, at, to): a span that begins with the cut at is followed by one that begins with to; -inf is a span's first cut whatever it is, inf its first one beyond those within a gap of its start."""
        for g in _groups_of(parts, ["k", "s"]):
            g = g[np.repeat(np.add.reduceat(~g.next.to_numpy(), _bounds(g, ["k", "s"])[:-1]) > 0, np.diff(_bounds(g, ["k", "s"])))].reset_index(drop=True)
            if not len(g):
                continue
            own, x, starts = ~g.next.to_numpy(), g.t.to_numpy(), _bounds(g, ["k", "s"])
            size = np.add.reduceat(own, starts[:-1])
            mine = np.flatnonzero(own)
            first = np.concatenate(([0], np.cumsum(size)))
            *_, last = _squared(_successors(x[mine], first, gap))
            limit = (g.s.to_numpy()[starts[:-1]] + 1e-6) * span + gap
            early = x[mine] <= np.repeat(limit, size)
            n_early = np.add.reduceat(early, first[:-1])
            whole = np.arange(len(size))
            at_row = np.concatenate((first[:-1], np.flatnonzero(early), np.minimum(first[:-1] + n_early, first[1:] - 1)))
            at = np.concatenate((np.full(len(size), -np.inf), x[mine][early], np.full(len(size), np.inf)))
            of = np.concatenate((whole, np.repeat(whole, size)[early], whole))
            none = np.concatenate((np.zeros(len(size) + int(early.sum()), bool), n_early == size))  # nothing is kept
            end = x[mine][last[at_row]]
            later = np.flatnonzero(~own)
            group = np.repeat(whole, np.diff(starts))[later]
            order = np.lexsort((np.repeat([1, 0], (len(later), len(end))), np.concatenate((x[later], end + gap * (1 - 1e-12))), np.concatenate((group, of))))
            place = np.cumsum(order < len(later))
            p = np.empty(len(end), np.int64)
            p[order[order >= len(later)] - len(later)] = place[order >= len(later)]
            stop = np.searchsorted(group, of, "right")
            while True:
                on = np.flatnonzero((p < stop) & (x[later][np.minimum(p, len(later) - 1)] - end < gap)) if len(later) else []
                if not len(on):
                    break
                p[on] += 1
            to = np.where(p < stop, x[later][np.minimum(p, len(later) - 1)] if len(later) else 0.0, np.inf)
            yield pd.DataFrame({"k": plain_column(g.k.iloc[starts[:-1]].iloc[of]), "s": g.s.to_numpy()[starts[:-1]][of], "at": at, "to": np.where(none, -np.inf, to)})

    def reached(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups_of(parts, ["k", "s"]):
            x, starts = g.t.to_numpy(), _bounds(g, ["k", "s"])
            at = g["at"].to_numpy()[starts[:-1]]
            limit = np.repeat((g.s.to_numpy()[starts[:-1]] + 1e-6) * span + gap, np.diff(starts))
            begin = np.where(np.repeat(at == np.inf, np.diff(starts)), x > limit, x >= np.repeat(at, np.diff(starts)))
            first = np.add.reduceat(~begin, starts[:-1]) + starts[:-1]
            hit = np.zeros(len(x), bool)
            hit[first[first < starts[1:]]] = True
            for step in _squared(_successors(x, starts, gap)):
                hit[step[hit]] = True
            yield pd.DataFrame({"k": plain_column(g.k[hit]), "t": x[hit]})

    ordered = lambda x: x.repartition("k", "s").sortWithinPartitions("k", "s", "t")
    jump = kept(ordered(rows).mapInPandas(gates, f"k {kind}, s long, at double, to double"))
    spans = jump.select("k", "s").distinct()
    before = jump.groupBy("k", (F.col("s") + 1).alias("s")).agg(F.min("to").alias("lo"), F.max("to").alias("hi"))
    on = lambda x, y: F.expr(f"{x}.k <=> {y}.k and {x}.s = {y}.s")
    known = spans.alias("x").join(before.alias("y"), on("x", "y"), "left").select("x.k", "x.s", F.when(F.col("lo").isNull(), float("-inf")).when(F.col("lo") == F.col("hi"), F.col("lo")).alias("at"))
    known, steps, here = kept(known), 1, jump
    while not known.where("at is null").isEmpty():
        follow = here.alias("x").join(known.where("at is not null").alias("y"), F.expr("x.k <=> y.k and x.s = y.s and x.at = y.at")).select("x.k", (F.col("x.s") + steps).alias("s"), "x.to")
        known = known.alias("x").join(follow.alias("y"), on("x", "y"), "left").select("x.k", "x.s", F.coalesce("x.at", "y.to").alias("at"))
        known = kept(known.groupBy("k", "s").agg(F.min("at").alias("at")))
        twice = here.alias("x").join(here.alias("y"), F.expr(f"x.k <=> y.k and x.s + {steps} = y.s and x.to = y.at")).select("x.k", "x.s", "x.at", "y.to")
        here, steps = kept(twice), 2 * steps
    begun = d.alias("x").join(known.alias("y"), on("x", "y")).select("x.k", "x.s", "x.t", "y.at")
    return ordered(begun).mapInPandas(reached, f"k {kind}, t double").select(F.col("k").alias(key), F.col("t").alias(t))


def build_segments(cuts: DataFrame, durations: DataFrame, key: str, t: str = "t", least: float = 1e-6) -> DataFrame:
    """Segments between 0, the cuts strictly inside and the duration, numbered from 1, with times as text and file names."""
    inside = cuts.join(durations, key).where((F.col(t) > 0) & (F.col(t) < F.col("duration_sec"))).select(key, F.col(t).alias("start_sec"))
    edges = inside.union(durations.select(key, F.lit(0.0))).distinct().join(durations, key)
    w = Window.partitionBy(key).orderBy("start_sec")
    s = edges.withColumn("end_sec", F.coalesce(F.lead("start_sec").over(w), F.col("duration_sec"))).where(F.col("end_sec") - F.col("start_sec") >= least)
    s = s.withColumn("index", F.row_number().over(w)).withColumn("duration_sec", F.col("end_sec") - F.col("start_sec"))
    width = F.greatest(F.lit(2), F.length(F.count(F.lit(1)).over(Window.partitionBy(key)).cast("string")))
    s = s.withColumns({"start_tc": format_duration("start_sec"), "end_tc": format_duration("end_sec"), "video_name": numbered_name("vid_", "index", "mov", width), "audio_name": numbered_name("aud_", "index", "wav", width)})
    return s.select(key, "index", "start_sec", "end_sec", "duration_sec", "start_tc", "end_tc", "video_name", "audio_name")


def scene_segments(detectors: list[DataFrame], durations: DataFrame, key: str, gap: float = 0.33) -> DataFrame:
    """Cuts of all detectors, thinned to the least gap, as segments."""
    return build_segments(coalesce_min_gap(union_cuts(*detectors), key, gap=gap), durations, key)


def assign_to_intervals(points: DataFrame, intervals: DataFrame, key: str, t: str = "t", how: str = "inner", width: float | None = None) -> DataFrame:
    """Points t in [start_sec, end_sec) of intervals of their key; how: inner, left, left_semi or left_anti.

    An interval is listed under the buckets that it touches at the level where they are as wide as itself or up to twice,
    so under two at most however long it is; a point looks into its bucket at each level that an interval has. Level 0 is
    width wide: where none is given, as wide as one in twenty intervals at most.
    """
    i = intervals.withColumnRenamed(key, "_ik").where("end_sec > start_sec").withColumn("_len", F.col("end_sec") - F.col("start_sec"))
    if not width:
        width = i.agg(F.percentile_approx("_len", 0.05, 1000)).first()[0] or 1.0
    i = i.withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2(F.col("_len") / width))).cast("int"))
    bucket = lambda c: F.floor(c / (F.pow(F.lit(2.0), F.col("_level")) * width))
    i = i.withColumn("_ib", F.explode(F.sequence(bucket(F.col("start_sec")), bucket(F.col("end_sec"))))).drop("_len").withColumnRenamed("_level", "_il")
    levels = sorted(r._il for r in i.select("_il").distinct().collect())  # at most some 1100, as doubles go
    p = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_b", bucket(F.col(t)))
    on = (F.col(key) == F.col("_ik")) & (F.col("_level") == F.col("_il")) & (F.col("_b") == F.col("_ib")) & (F.col(t) >= F.col("start_sec")) & (F.col(t) < F.col("end_sec"))
    if how == "inner":
        return p.join(i, on).drop("_ik", "_ib", "_b", "_il", "_level")
    hit = p.join(i, on, "left_semi").select(F.col(key).alias("_hk"), F.col(t).alias("_ht")).distinct()  # only key and t decide
    is_hit = (F.col(key) == F.col("_hk")) & (F.col(t) == F.col("_ht"))
    if how in ("left_semi", "left_anti"):
        return points.join(hit, is_hit, how)
    if how != "left":
        raise ValueError("how must be inner, left, left_semi or left_anti")
    return p.join(i, on).drop("_ik", "_ib", "_b", "_il", "_level").unionByName(points.join(hit, is_hit, "left_anti"), allowMissingColumns=True)


def content_change(df: DataFrame, key: str, order: str, vec: str) -> DataFrame:
    """The cosine distance of each vector from the one before it."""
    d = df.withColumn("_before", F.lag(vec).over(Window.partitionBy(key).orderBy(order)))
    return d.withColumn("score", F.when(F.col("_before").isNotNull(), cosine_distance(vec, "_before"))).drop("_before")
