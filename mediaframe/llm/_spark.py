"""Sessions, checkpoints and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder that spark.checkpoint.dir names and cuts its lineage; a folder of our own only where none is named and all runs in this process (local tests)."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
    return df.checkpoint()


#: Rows of a partition of a table of ids. Small tables dealt over many partitions make more files and tasks than data.
ROWS, LEAST_PARTS = 1 << 16, 8


def parts(rows: int) -> int:
    return max(LEAST_PARTS, -(-rows // ROWS))


def sized(df: DataFrame, most: int | None = None) -> tuple[DataFrame, int]:
    """df, a table of narrow rows, checkpointed in partitions of about ROWS rows, and its number of rows; most: a bound on that number, where one is known before."""
    out = checkpointed(df if most is None else df.coalesce(parts(most)))
    n = out.count()
    return out.coalesce(parts(n)), n


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all columns, nulls told apart by column: what tells rows apart where ids repeat or are null; only equal rows share it."""
    return F.xxhash64(*df.columns, *(F.col(c).isNull() for c in df.columns))


def by_merging(df: DataFrame) -> DataFrame:
    """df as a side of a join by sorting and merging: rounds of small broadcasts would fill the driver, which keeps a page for each."""
    return df.hint("merge")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component the smallest node reachable; nodes without edges are absent.

    Each round maps every node to the neighbour (or itself) that comes first in a hashed order and contracts the edges;
    the number of nodes falls geometrically whatever their numbering, and no node's edges are gathered in one place.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    e, n = sized(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct())
    maps, nodes = [], 2 * n
    while n:
        both = e.union(e.select(F.col("b"), F.col("a"))).toDF("a", "b")
        near = both.groupBy("a").agg(F.least(F.first(order("a")), F.min(order("b")))["v"].alias("to"))
        near = checkpointed(near.withColumnRenamed("a", "node").coalesce(parts(2 * n)))
        maps.append(near)
        left = e.join(by_merging(near.toDF("a", "x")), "a").join(by_merging(near.toDF("b", "y")), "b")
        e, n = sized(left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), n)
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[-1]
    for m in reversed(maps[:-1]):
        out = m.join(by_merging(out.toDF("to", "root")), "to", "left").select("node", F.coalesce("root", "to").alias("to"))
    least = out.groupBy("to").agg(F.min("node").alias("component"))
    return checkpointed(out.join(by_merging(least), "to").select("node", "component").coalesce(parts(nodes)))


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder below the shared folder of spark.checkpoint.dir; below one of our own only where none is named and all runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark's file systems have it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
