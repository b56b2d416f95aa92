"""Grouping by similarity of vectors: density clusters over cosine distance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.operators.ordered import kept, mean_vector, new_folder, plain_column, remove_folder, with_ordinal

MAX_BROADCAST_GROUPS = 4096
#: Pivots of a metric index, the vectors that they are chosen from, vectors of a block, and of a block of a large table at most.
PIVOTS, PIVOT_SAMPLE, BLOCK_VECTORS, BLOCK_MOST = 32, 1024, 2048, 1 << 15
GROUP_POINTS = 1 << 14


def _unit(vec: str):
    e = F.transform(vec, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(e, lambda x: x / norm)).otherwise(e)


def _numbers(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(np.float64)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of x and of y."""
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T))


def _spread(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows of a sample, each the one farthest from those before it."""
    chosen, far = [0], _distances(sample, sample[:1])[:, 0]
    while len(chosen) < n and far.max() > 1e-6:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def metric_index(df: DataFrame, key: str, vec: str, pivots: int = PIVOTS, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The vectors as rows (id, v, block), v of length 1 (or 0), and the blocks' table (block, cell, lo, hi), a row a block.

    A vector's cell is that of its nearest pivot; a cell's vectors are cut into blocks in the order of their distance from
    it. Where block is not given, blocks grow with the table from BLOCK_VECTORS to BLOCK_MOST, so that their number, and
    with it the blocks that a vector is sent to, stays about the same up to half of PIVOTS * BLOCK_MOST vectors. lo and hi are the least and largest distances of a block's vectors from every pivot. Pivots come from a sample of
    PIVOT_SAMPLE vectors and only steer the work: any choice gives the same pairs.
    """
    d = kept(df.select(F.col(key).alias("id"), _unit(vec).alias("v")))
    block = block or min(BLOCK_MOST, max(BLOCK_VECTORS, -(-2 * d.count() // pivots)))
    sample = d.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("v").toPandas()
    table = _spread(_numbers(sample.v), pivots) if len(sample) else np.zeros((1, 1))

    def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in parts:
            if len(g):
                far = _distances(_numbers(g.v), table)
                yield g.assign(cell=far.argmin(1).astype(np.int32), near=far.min(1), far=list(far))

    kind = df.schema[key].dataType.simpleString()
    d = with_ordinal(d.mapInPandas(placed, f"id {kind}, v array<double>, cell int, near double, far array<double>"), "_at", ["cell", "near"])
    first = d.groupBy("cell").agg(F.min("_at").alias("_first"))  # a row a pivot
    d = d.join(F.broadcast(first), "cell").withColumn("block", F.shiftleft(F.col("cell").cast("long"), 40) + F.floor((F.col("_at") - F.col("_first")) / block))
    edge = lambda f: F.array(*[f(F.col("far")[k]) for k in range(len(table))])
    return d.select("id", "v", "block"), kept(d.groupBy("block", "cell").agg(edge(F.min).alias("lo"), edge(F.max).alias("hi")))


def block_pairs(boxes: DataFrame, radius: float) -> DataFrame:
    """Rows (p, q), p <= q: the pairs of blocks that can hold vectors within radius of each other. By the triangle inequality two such have distances from any pivot that differ by the radius at most; a block looks only into cells that it can reach so."""
    far = radius + 1e-6  # distances come from rounded sums
    reach = boxes.groupBy("cell").agg(F.max(F.expr("hi[cell]")).alias("r"))  # a row a pivot
    x = boxes.select(F.col("block").alias("p"), "lo", "hi", F.posexplode("lo").alias("to", "least"))
    x = x.join(F.broadcast(reach.withColumnRenamed("cell", "to")), "to").where(F.col("least") <= F.col("r") + far).select("p", "to", "lo", "hi")
    y = boxes.select(F.col("block").alias("q"), F.col("cell").alias("of"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    apart = F.exists(F.arrays_zip("lo", "hi", "lo2", "hi2"), lambda z: (z["lo"] - z["hi2"] > far) | (z["lo2"] - z["hi"] > far))
    return x.join(y, F.expr("to = of and p <= q")).where(~apart).select("p", "q")


def _spanning(label: np.ndarray, i: np.ndarray, j: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Of the edges i, j between nodes those that join different labels, as many as join what they all do; and the nodes' labels then."""
    chosen = [np.zeros(0, np.int64)]
    at = np.arange(len(i))
    while len(at := at[label[i[at]] != label[j[at]]]):
        rank = rng.permutation(len(label))  # each label goes to one of lesser rank, if it has an edge to any
        x, y = label[i[at]], label[j[at]]
        swap = rank[x] < rank[y]
        high, first = np.unique(np.where(swap, y, x), return_index=True)
        to = np.arange(len(label))
        to[high] = np.where(swap, x, y)[first]
        while (to[to] != to).any():
            to = to[to]
        label = to[label]
        chosen.append(at[first])
    return np.concatenate(chosen), label


def similar_pairs(df: DataFrame, key: str, vec: str, eps: float, pivots: int = PIVOTS, block: int | None = None, spanning: bool = False) -> DataFrame:
    """Rows (a, b, dist), a < b, for all pairs of rows of different key at cosine distance of at most eps (a zero vector is 1 away from all); or (a, b) of a spanning forest of each two blocks' pairs, which has the same ends and components but no more rows than there are vectors in the two.

    Exact. Vectors are unit vectors in blocks of a metric index; only pairs of blocks that the triangle inequality leaves are
    compared, each in a group of its own that gets the vectors of its two blocks. Null vectors have no pairs.
    """
    vectors, boxes = metric_index(df.where(F.col(vec).isNotNull()), key, vec, pivots, block)
    pairs = kept(block_pairs(boxes, math.sqrt(2 * max(0.0, eps))))

    def side(wanted: DataFrame, k: str, *names: str) -> DataFrame:
        d = vectors.join(wanted, F.col("block") == F.col(k))
        return d.select(*[F.col(c).alias(n) for c, n in zip(("p", "q", "id", "v"), names, strict=True)])

    def within(u: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distances of pairs that may be within eps, summed again term after term, and whether they are."""
        dist = np.zeros(len(i))
        for n in range(0, len(i), 1 << 14):
            dist[n : n + (1 << 14)] = np.clip(1 - np.add.accumulate(u[i[n : n + (1 << 14)]] * v[j[n : n + (1 << 14)]], axis=1)[:, -1], 0.0, 2.0)
        return dist, dist <= eps

    def near(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        own = not len(y)
        y = x if own else y.set_axis(x.columns, axis=1)
        if not len(x):
            return pd.DataFrame({"a": plain_column(x.id), "b": plain_column(x.id)} | ({} if spanning else {"dist": np.zeros(0)}))
        u, v, found = _numbers(x.v), _numbers(y.v), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        node = 0 if own else len(u)  # of y's first vector
        label, rng = np.arange(node + len(v)), np.random.default_rng(0)
        single, slack = (u.astype(np.float32), v.astype(np.float32)), 1e-9 + (u.shape[1] + 4) * 2.0**-23  # more than single precision rounds
        step = max(16, (1 << 22) // len(v))
        for k in range(0, len(u), step):
            far = 1 - single[0][k : k + step] @ single[1].T
            i, j = np.nonzero(far <= np.float32(eps + slack))
            far = far[i, j]
            i += k
            if own:
                i, j, far = i[i < j], j[i < j], far[i < j]
            if spanning:
                new = label[i] != label[node + j]
                i, j, far = i[new], j[new], far[new]
                sure = far <= np.float32(eps - 2 * slack)
                sure[~sure] = within(u, v, i[~sure], j[~sure])[1]
                i, j = i[sure], j[sure]
                at, label = _spanning(label, i, node + j, rng)
                found.append((i[at], j[at], np.zeros(0)))
            else:
                dist, ok = within(u, v, i, j)
                found.append((i[ok], j[ok], dist[ok]))
        i, j, dist = (np.concatenate(z) for z in zip(*found, strict=True))
        return pd.DataFrame({"a": plain_column(x.id.iloc[i]), "b": plain_column(y.id.iloc[j])} | ({} if spanning else {"dist": dist}))

    kind = df.schema[key].dataType.simpleString()
    left, right = side(pairs, "p", "p", "q", "id", "v"), side(pairs.where("p <> q"), "q", "p2", "q2", "id2", "v2")
    found = left.groupBy("p", "q").cogroup(right.groupBy("p2", "q2")).applyInPandas(near, f"a {kind}, b {kind}" + ("" if spanning else ", dist double"))
    return found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *([] if spanning else ["dist"]))


def clusters(edges: DataFrame, cores: DataFrame) -> DataFrame:
    """(id, root): the smallest core reachable over edges (a, b) between cores.

    Each round sends every node to the first of itself and its neighbours in a hashed order and draws the edges between
    where they went, so that at least a constant share of the nodes goes each time, chains included; the rounds' maps are
    then followed from the last to the first.
    """
    spark = edges.sparkSession
    folder = new_folder(spark, "clusters")

    def written(df: DataFrame, name: str) -> DataFrame:
        """df as files: they have a known size, while a checkpoint keeps the estimate of its plan, which joins multiply from round to round."""
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    core = cores.toDF("_c")
    e = edges.select("a", "b").join(core, F.col("a") == F.col("_c"), "left_semi").join(core, F.col("b") == F.col("_c"), "left_semi").where("a <> b")
    e, steps = written(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"), []
    rank = lambda c, k: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("v"))
    while not e.isEmpty():
        k = len(steps)
        both = e.union(e.select("b", "a"))
        step = both.groupBy("a").agg(F.min(rank("b", k)).alias("m")).select(F.col("a").alias("from"), F.least(rank("a", k), F.col("m"))["v"].alias("to"))
        steps.append(step := written(step, f"step-{k}"))
        moved = e.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b").where("x <> y")
        e = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"edges-{k}")
    out = None
    for k, step in reversed(list(enumerate(steps))):
        if out is not None:
            step = written(step.join(out.toDF("to", "last"), "to", "left").select("from", F.coalesce("last", "to").alias("to")), f"to-{k}")
        out = step
    if out is None:
        found = core.select(F.col("_c").alias("id"), F.col("_c").alias("root"))
    else:
        least = out.groupBy("to").agg(F.min("from").alias("root"))
        out = out.join(least, "to").select(F.col("from").alias("id"), "root")
        found = core.join(out, core["_c"] == out.id, "left").select(F.col("_c").alias("id"), F.coalesce("root", "_c").alias("root"))
    found = kept(found)
    remove_folder(spark, folder)
    return found


def nearest_centroid(points: DataFrame, centroids: DataFrame, key: str, vec: str, max_dist: float) -> DataFrame:
    """(key, group, dist) for points (key is unique) with a centroid strictly nearer than max_dist; ties go to the smallest group. Centroids are broadcast up to a checked number, beyond that they are kept under parents."""
    c = centroids.select(F.col("group").alias("g"), _unit(vec).alias("gv"))
    p = points.select(key, _unit(vec).alias("pv"))
    if c.limit(MAX_BROADCAST_GROUPS + 1).count() > MAX_BROADCAST_GROUPS:
        return _nearest_by_parents(p, c, key, max_dist)
    dot = F.aggregate(F.zip_with("pv", "gv", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    j = p.crossJoin(F.broadcast(c)).withColumn("dist", 1 - dot).where(F.col("dist") < max_dist)
    return j.groupBy(key).agg(F.min(F.struct("dist", "g")).alias("m")).select(key, F.col("m.g").alias("group"), F.col("m.dist").alias("dist"))


def _nearest_by_parents(p: DataFrame, c: DataFrame, key: str, max_dist: float) -> DataFrame:
    """nearest_centroid by descent: centroids (g, gv) are listed under the nearest of PIVOTS parents, each with the radius that covers its list. A point first meets the list of its nearest parent; with the distance found there it goes on to those parents alone that can have a nearer one (its distance from the parent less the radius). Points of a list are dealt over groups of GROUP_POINTS."""
    c, p = kept(c), kept(p)
    sample = c.orderBy(F.xxhash64("g"), "g").limit(PIVOT_SAMPLE).select("gv").toPandas()
    parents = _spread(_numbers(sample.gv), PIVOTS)

    def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in parts:
            if len(g):
                far = _distances(_numbers(g.gv), parents)
                yield g.assign(cell=far.argmin(1).astype(np.int32), near=far.min(1))

    kinds = {"g": c.schema["g"].dataType.simpleString(), key: p.schema[key].dataType.simpleString()}
    c = kept(c.mapInPandas(placed, f"g {kinds['g']}, gv array<double>, cell int, near double"))
    found = c.groupBy("cell").agg(F.max("near").alias("r")).orderBy("cell").collect()  # a row a parent
    cells, radius = np.array([r.cell for r in found], np.int32), np.array([r.r for r in found])
    parents = parents[cells]

    def first(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in parts:
            if len(g):
                yield g.assign(cell=cells[_distances(_numbers(g.pv), parents).argmin(1)])

    def others(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in parts:
            if len(g):
                far = _distances(_numbers(g.pv), parents)
                bound = np.sqrt(2 * np.maximum(0.0, g.dist.to_numpy()))
                i, j = np.nonzero((far - radius <= bound[:, None] + 1e-6) & (np.arange(len(cells)) != far.argmin(1)[:, None]))
                yield g[[key, "pv"]].iloc[i].reset_index(drop=True).assign(cell=cells[j])

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        i, j, dist = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(x) and len(y):
            u, v = _numbers(x.pv), _numbers(y.gv)
            y = y.reset_index(drop=True)
            order = np.empty(len(y), np.int64)
            order[y.g.sort_values().index.to_numpy()] = np.arange(len(y))
            for k in range(0, len(u), 256):
                d = 1 - u[k : k + 256] @ v.T
                p, q = np.nonzero(d <= d.min(1)[:, None] + 1e-9)  # what can be the least is summed again, term after term
                exact = 1 - np.add.accumulate(u[k + p] * v[q], axis=1)[:, -1]
                best = np.lexsort((order[q], exact, p))
                best = best[np.concatenate(([True], p[best][1:] != p[best][:-1]))]
                best = best[exact[best] < max_dist]
                i.append(k + p[best])
                j.append(q[best])
                dist.append(exact[best])
        i, j, dist = np.concatenate(i), np.concatenate(j), np.concatenate(dist)
        return pd.DataFrame({key: plain_column(x[key].iloc[i]), "g": plain_column(y.g.iloc[j]), "dist": dist})

    def met(routed: DataFrame) -> DataFrame:
        routed = kept(routed)
        groups = routed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / GROUP_POINTS).cast("int").alias("m"))  # a row a parent
        x = routed.join(F.broadcast(groups), "cell").withColumn("part", F.pmod(F.xxhash64(key), F.col("m")).cast("int"))
        y = c.join(F.broadcast(groups), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        y = y.select(F.col("cell").alias("cell2"), F.col("part").alias("part2"), "g", "gv")
        return x.select("cell", "part", key, "pv").groupBy("cell", "part").cogroup(y.groupBy("cell2", "part2")).applyInPandas(meet, f"{key} {kinds[key]}, g {kinds['g']}, dist double")

    at_first = kept(met(p.mapInPandas(first, f"{key} {kinds[key]}, pv array<double>, cell int")))
    known = at_first.select(F.col(key).alias("_k"), "dist")
    rest = p.join(known, F.col(key) == F.col("_k"), "left").select(key, "pv", F.coalesce("dist", F.lit(float(max_dist))).alias("dist"))
    found = at_first.union(met(rest.mapInPandas(others, f"{key} {kinds[key]}, pv array<double>, cell int")))
    return found.groupBy(key).agg(F.min(F.struct("dist", "g")).alias("m")).select(key, F.col("m.g").alias("group"), F.col("m.dist").alias("dist"))


def group_by_similarity(vectors: DataFrame, key: str, vec: str, eps: float = 0.35, min_samples: int = 2, every: DataFrame | None = None) -> DataFrame:
    """(key, group_id): face_001, ... numbered by each cluster's first core, then noise (to the nearest cluster's mean within 1.5 eps, else groups of its own); keys of every without vectors: no_face."""
    m = kept(mean_vector(vectors.where(F.size(vec) > 0), key, vec))
    pairs = kept(similar_pairs(m, key, vec, eps, spanning=min_samples <= 2))  # with two samples whatever is in a pair is a core, so a forest of them does
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    cores = kept(ends.groupBy("id").agg((F.count(F.lit(1)) + 1).alias("n")).where(F.col("n") >= min_samples).select("id"))
    root = clusters(pairs, cores)
    border = pairs.select(F.col("a").alias("x"), F.col("b").alias("id")).union(pairs.select("b", "a")).join(root, "id").join(cores.toDF("x"), "x", "left_anti")
    member = root.union(border.groupBy("x").agg(F.min("root")))
    centre = mean_vector(m.join(member.toDF(key, "group"), key).select("group", vec), "group", vec)
    noise = m.join(member.select(F.col("id").alias(key)), key, "left_anti")
    near = nearest_centroid(noise, centre, key, vec, 1.5 * eps)
    alone = noise.join(near, key, "left_anti").select(key, F.lit(1).alias("kind"), F.col(key).alias("root"))
    every_group = member.select(F.col("id").alias(key), F.lit(0).alias("kind"), "root").union(near.select(key, F.lit(0), "group")).union(alone)
    names = with_ordinal(every_group.select("kind", "root").distinct(), "_n", ["kind", "root"]).select("kind", "root", F.format_string("face_%03d", F.col("_n") + 1).alias("group_id"))
    out = every_group.join(names, ["kind", "root"]).select(key, "group_id")
    if every is not None:
        out = out.union(every.select(key).distinct().join(m.select(key), key, "left_anti").withColumn("group_id", F.lit("no_face")))
    return out
