"""Near-duplicate vectors by an exact metric range join.

Equal vectors are one class. Classes are unit vectors; cosine >= c means a distance of at most r = sqrt(2 - 2c). Pivots
(classes first in a hashed order) give every class its home cell, that of the nearest pivot. By the triangle inequality a
pair within r whose homes are i and j has each member at most 2r farther from the other's pivot than from its own, and,
the space being Euclidean, within r of the plane midway between the pivots; so a class is also sent to each cell of lower
number for which both hold, and each pair meets in the lower of its two cells. Cells are joined on their own, in pairs of
blocks of bounded size, so a cell that holds most vectors spreads over many tasks. A block pair returns link counts and a
spanning forest of its links, not the links.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Vectors of different lengths
don't link. Rows that repeat are separate vectors; a null id takes part as a vector but gets no component of its own
number (component_id null if it is alone). Other columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.llm._spark import checkpointed, components

SLACK = 1e-6


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 with links (a, b), the smallest node of each one's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def linked(x: np.ndarray, y: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and y (double) with at least that cosine: single precision finds candidates, double precision decides."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    fx, fy = (x / nx[:, None]).astype(np.float32), (y / ny[:, None]).astype(np.float32)
    found = []
    for i in range(0, len(x), 1024):
        a, b = np.nonzero(fx[i : i + 1024] @ fy[i if same else 0 :].T >= np.float32(cosine - 1e-4))
        a, b = a + i, b + (i if same else 0)
        keep = a < b if same else slice(None)
        found.append((a[keep], b[keep]))
    a, b = (np.concatenate(c) for c in zip(*found, strict=True))
    ok = [np.einsum("ij,ij->i", x[a[k : k + 65536]], y[b[k : k + 65536]]) / (nx[a[k : k + 65536]] * ny[b[k : k + 65536]]) >= cosine for k in range(0, len(a), 65536)]
    keep = np.concatenate(ok) if ok else np.zeros(0, bool)
    return a[keep], b[keep]


def near_vectors(df: DataFrame, cosine: float = 0.95, cell: int = 8192, block: int = 4096, max_pivots: int = 1024) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) for columns vec_id and embedding. cell: classes aimed at for a cell; at most max_pivots pivots are broadcast."""
    v = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).withColumn("_row", F.monotonically_increasing_id())
    ok = F.coalesce((F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0), F.lit(False))
    v = v.withColumn("e", F.when(ok, F.col("e"))).drop("_row")
    v = v.withColumns({"h1": F.when(ok, F.xxhash64("e")), "h2": F.when(ok, F.xxhash64(F.lit(2), "e"))})  # 128 bits that stand for the vector where only its class is looked up
    classes = checkpointed(v.where("e is not null").groupBy("h1", "h2", "e").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("rep", F.xxhash64("e", "id")))
    total = classes.count()
    k = int(min(max_pivots, max(1, total // cell)))
    pivots = classes.orderBy("rep", "e").limit(k).select("e").collect()
    dims = sorted({len(p.e) for p in pivots})
    by_dim = {d: np.array([p.e for p in pivots if len(p.e) == d]) for d in dims}
    by_dim = {d: p / np.linalg.norm(p, axis=1)[:, None] for d, p in by_dim.items()}
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A cell's number has the vectors' length in it; vectors of a length without pivots share one cell."""
        for b in batches:
            raw = b.column(0)
            size = np.diff(raw.offsets.to_numpy())
            flat, ends = raw.flatten().to_numpy(zero_copy_only=False), np.cumsum(size)
            cells: list = [None] * len(size)
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                x = np.stack([flat[ends[i] - d : ends[i]] for i in at])
                x = x / np.linalg.norm(x, axis=1)[:, None]
                p = by_dim.get(d)
                if p is None:
                    for i in at:
                        cells[i] = [d << 20]
                    continue
                dot = x @ p.T
                dist = np.sqrt(np.maximum(0, 2 - 2 * dot))
                home = np.argmin(dist, 1)
                own = dist[np.arange(len(x)), home]
                between = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))[home]
                near = (dist - own[:, None] <= 2 * radius + SLACK) & (dot[np.arange(len(x)), home][:, None] - dot <= radius * between + SLACK)
                near &= np.arange(len(p)) < home[:, None]
                for j, i in enumerate(at):
                    cells[i] = [d << 20 | int(home[j]), *((d << 20 | np.flatnonzero(near[j])).tolist())]
            vec = [flat[e - s : e].tobytes() for s, e in zip(size, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(vec, pa.binary()), pa.array(cells, pa.list_(pa.int64()))], ["id", "n", "rep", "vec", "cells"])

    placed = checkpointed(classes.select("e", "id", "n", "rep").mapInArrow(assign, "id long, n long, rep long, vec binary, cells array<long>"))
    members = placed.select("id", "n", "rep", "vec", F.posexplode("cells").alias("k", "cell"))
    sizes = members.groupBy("cell").agg(F.count_if(F.col("k") == 0).alias("h"), F.count_if(F.col("k") > 0).alias("r"))
    sizes = sizes.select("cell", F.ceil(F.col("h") / block).cast("int").alias("a"), F.ceil(F.col("r") / (2 * block)).cast("int").alias("b"))
    members = members.join(F.broadcast(sizes), "cell")  # a row for each pivot and length at most
    home = F.pmod("rep", F.greatest("a", F.lit(1))).cast("int")
    tasks = F.when(F.col("k") == 0, F.expr("concat(transform(sequence(0, a - 1), j -> struct(least(h, j) as i, greatest(h, j) as j, h as own)), transform(filter(sequence(0, b), j -> j < b), j -> struct(h as i, a + j as j, h as own)))"))
    tasks = tasks.otherwise(F.expr("transform(filter(sequence(0, a), i -> i < a), i -> struct(i as i, cast(a + pmod(rep, b) as int) as j, cast(a + pmod(rep, b) as int) as own))"))
    rows = members.withColumn("h", home).select("cell", "id", "n", "rep", "vec", F.explode(tasks).alias("t")).select("cell", "t.i", "t.j", "t.own", "id", "n", "rep", "vec")

    def join(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        g = g.sort_values(["rep", "id"], kind="stable")
        first = (g.own == i).to_numpy()
        mat = lambda s: np.frombuffer(b"".join(s), np.float64).reshape(len(s), -1) if len(s) else np.zeros((0, 1))
        x, y = mat(g.vec[first]), mat(g.vec[~first]) if i != j else None
        n, ids = g.n.to_numpy(), g.id.to_numpy()
        at = np.flatnonzero(first)
        if i == j and len(x):
            a, b = linked(x, x, cosine, True)
            a, b = at[a], at[b]
        elif i != j and len(x) and len(y):
            a, b = linked(x, y, cosine, False)
            a, b = at[a], np.flatnonzero(~first)[b]
        else:
            a = b = np.zeros(0, np.int64)
        links = np.bincount(a, n[b], minlength=len(g)) + np.bincount(b, n[a], minlength=len(g))
        root = forest(len(g), a, b)
        has = links > 0
        return pd.DataFrame({"rep": g.rep.to_numpy()[has], "links": links[has].astype(np.int64), "root": g.rep.to_numpy()[root[has]]})

    found = checkpointed(rows.groupBy("cell", "i", "j").applyInPandas(join, "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), "component")
    c = classes.drop("e").join(links, "rep", "left").join(comp, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = c.groupBy("component").agg(F.min("id").alias("component_id"))
    c = c.join(least, "component").select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id")
    out = v.drop("e").join(c, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")  # one row of c for each key, so Spark can split a frequent vector's rows
    comp_id = F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.lit(False)).alias("kept"))
