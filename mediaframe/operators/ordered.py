"""Operators in which the order of rows counts: numbering, first rows, sections, segments, samples, names, summaries."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediaframe.functions import text as X
from mediaframe.functions.timecode import timecode_to_frames


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where none is named and all runs in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark's file systems have it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def kept(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder of the cluster (only a local session may go without one)."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def plain_column(values: pd.Series) -> pd.Series:
    """A column to return to Spark: text of pandas' own type, which can be of no or several Arrow chunks, as objects."""
    return (values if pd.api.types.is_numeric_dtype(values) else values.astype(object)).reset_index(drop=True)


#: Rows of a partition of a large table that tasks sort as a whole.
TASK_ROWS = 1 << 17


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of so many rows, by its keys in partitions of about TASK_ROWS rows: rows that are much alike are so small when shuffled that Spark would leave many more to a task."""
    return df.repartition(-(-rows // TASK_ROWS), *keys) if rows > TASK_ROWS else df


def with_ordinal(df: DataFrame, name: str = "_ord", order_by: list | None = None) -> DataFrame:
    """Row positions from 0, by order_by or as the rows come; no step gathers all rows in one task. The rows are written to the checkpoint folder, so that their partitions stay as they are counted."""
    d = kept(df.orderBy(*order_by) if order_by else df).withColumn("_place", F.monotonically_increasing_id())
    part = F.shiftright("_place", 33)
    sizes = d.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))  # a row a partition
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))
    at = F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return d.join(F.broadcast(starts), part == F.col("_part")).select(*df.columns, at.alias(name))


def number_within(df: DataFrame, by: str | list[str], order: list, name: str = "n") -> DataFrame:
    """Positions from 1 within groups of any size, by one sort over all rows; where every group fits a task, number_rows does with less."""
    by = [by] if isinstance(by, str) else by
    d = with_ordinal(df, "_at", [*by, *order])
    first = d.groupBy(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)]).agg(F.min("_at").alias("_first"))
    on = [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)]
    return d.join(first, on).select(*df.columns, (F.col("_at") - F.col("_first") + 1).alias(name))


def number_rows(df: DataFrame, partition: list, order: list, name: str = "n", start: int = 1) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) + (start - 1))


def first_by_key(df: DataFrame, keys: list, order: list, status: str = "duplicate") -> DataFrame:
    """A column status: null for the first row of a key, else the given word."""
    return df.withColumn("status", F.when(F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1, status))


def ordered_distinct(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each value."""
    return df.groupBy(key).agg(F.min(order).alias(order))


def fill_section(df: DataFrame, partition: list, order: str, kind: Column, name: str = "kind", rows: int = 1 << 16) -> DataFrame:
    """The last kind that is not null at or before each row, in the order of row numbers (order). Each stretch of `rows` numbers is filled on its own; its last kind goes on to those after it by a table with a row a stretch."""
    d = df.withColumns({"_kind": kind, "_stretch": F.floor(F.col(order) / rows)})
    within = Window.partitionBy(*partition, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = d.groupBy(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(partition)], F.col("_stretch").alias("_s")).agg(F.max_by("_kind", F.when(F.col("_kind").isNotNull(), F.col(order))).alias("_end"))
    before = Window.partitionBy(*[f"_p{i}" for i in range(len(partition))]).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    on = [F.col(p).eqNullSafe(F.col(f"_p{i}")) for i, p in enumerate(partition)] + [F.col("_stretch") == F.col("_s")]
    filled = d.withColumn("_own", F.last("_kind", ignorenulls=True).over(within)).join(ends, on)
    return filled.select(*[c for c in df.columns if c != name], F.coalesce("_own", "_before").alias(name))


def first_identical_row_no(df: DataFrame, cols: list, order: str, name: str = "csv_row") -> DataFrame:
    """The number (order + 1) of the first of the rows that are equal in cols."""
    return dealt(df, df.count(), *cols).withColumn(name, F.min(order).over(Window.partitionBy(*cols)) + 1)


def sample_evenly(df: DataFrame, key: list, order: list, n: int) -> DataFrame:
    """n rows of each key at even distances, first and last included; short groups repeat rows."""
    w = Window.partitionBy(*key)
    d = df.withColumn("_p", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_c", F.count(F.lit(1)).over(w))
    at = F.expr(f"transform(sequence(0, {n - 1}), i -> case when {n} = 1 then 0 when i = {n - 1} then _c - 1 else cast(floor(i * ((_c - 1) / {max(1, n - 1)}D)) as bigint) end)")
    return d.withColumn("_at", at).withColumn("pick", F.explode(F.filter(F.transform("_at", lambda x, i: F.when(x == F.col("_p"), i)), lambda x: x.isNotNull()))).drop("_p", "_c", "_at")


def bounce(df: DataFrame, key: list, order: list, name: str = "pos") -> DataFrame:
    """Each key's sequence forwards, backwards and forwards again: positions from 1."""
    w = Window.partitionBy(*key)
    d = df.withColumn("_p", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(w))
    at = F.array(F.col("_p"), 2 * F.col("_n") + 1 - F.col("_p"), 2 * F.col("_n") + F.col("_p"))
    return d.withColumn(name, F.explode(at)).drop("_p", "_n")


def disambiguate_names(df: DataFrame, group: list, name: str, order: list, out: str = "unique_name") -> DataFrame:
    """stem.ext, stem_1.ext, ... in each group; a made-up name that is taken as it is is numbered on beyond the group's size."""
    w = Window.partitionBy(*group, name)
    d = df.withColumn("_k", F.row_number().over(w.orderBy(*order)) - 1)
    ext = F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1)
    made = lambda k: F.when(k == 0, F.col(name)).otherwise(F.concat(X.stem(name), F.lit("_"), k.cast("string"), ext))
    d = d.withColumn(out, made(F.col("_k")))
    taken = df.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(name).alias("_t")).distinct()
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [(F.col(out) == F.col("_t")) & (F.col("_k") > 0)]
    size = F.count(F.lit(1)).over(Window.partitionBy(*group))
    return d.withColumn("_n", size).join(taken, on, "left").withColumn(out, F.when(F.col("_t").isNull(), F.col(out)).otherwise(made(F.col("_k") + F.col("_n")))).select(*df.columns, out)


def running_total(df: DataFrame, partition: list, order: list, value: str, name: str = "total") -> DataFrame:
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def natural_sort(df: DataFrame, col: str) -> DataFrame:
    return df.orderBy(X.natural_sort_key(X.basename(col)), col)


def timecode_order(start: str, fps: float = 24.0, ordinal: str = "_ord") -> list:
    """What sorts by start; timecodes that don't parse count as 0, ties keep their ordinal."""
    return [F.coalesce(timecode_to_frames(start, fps), F.lit(0)), F.col(ordinal)]


def sort_by_timecode(df: DataFrame, start: str, fps: float = 24.0, ordinal: str = "_ord") -> DataFrame:
    return df.orderBy(*timecode_order(start, fps, ordinal))


def limit_by_ordinal(df: DataFrame, n: int | None, ordinal: str = "_ord") -> DataFrame:
    return df.where(F.col(ordinal) < n) if n else df


def preview_top(df: DataFrame, group: list, order: list, n: int) -> DataFrame:
    """The first n rows of each group and how many more there are."""
    w = Window.partitionBy(*group)
    return df.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("more", F.greatest(F.count(F.lit(1)).over(w) - n, F.lit(0))).where(F.col("rank") <= n)


def select_rows(df: DataFrame, ordinal: str, rows: list[int] | None = None, limit: int | None = None, test: bool = False) -> DataFrame:
    """Rows by number (from 1, in the given order, repeats kept, numbers out of range dropped), else the first limit, else the first in a test; ordinal counts from 1."""
    if rows:
        want = df.sparkSession.createDataFrame([(r, i) for i, r in enumerate(rows)], "_row long, want_pos int")
        return df.join(F.broadcast(want), F.col(ordinal) == F.col("_row")).drop("_row")
    return df.where(F.col(ordinal) <= limit) if limit and limit > 0 else df.where(F.col(ordinal) == 1) if test else df


def index_range(df: DataFrame, idx: str, n_pairs: str, start: int = 1, end: int = 28) -> DataFrame:
    if start < 1 or end < start:
        raise ValueError("start must be at least 1 and end at least start")
    return df.where(F.col(idx).between(F.lit(start), F.least(F.lit(end), F.col(n_pairs))))


def outcome_summary(df: DataFrame, status: Column, by: list | None = None, rollup: bool = False) -> DataFrame:
    d = df.withColumn("_s", status)
    g = d.rollup(*by) if rollup else d.groupBy(*(by or []))
    return g.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("_s") == s).alias(s) for s in ("successful", "failed", "skipped")])


def progress(current: Column, total: Column) -> Column:
    return F.when(total > 0, current / total * 100).otherwise(F.lit(0.0))


def mean_vector(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Element-wise means of each key's vectors, not normalised."""
    e = df.select(key, F.posexplode(vec).alias("_p", "_v")).groupBy(key, "_p").agg(F.avg(F.col("_v").cast("double")).alias("_v"))
    return e.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_v"))), lambda x: x["_v"]).alias(vec))


def group_sizes(df: DataFrame, group: str, none: str = "no_face") -> DataFrame:
    """Rows (group, n, grouped), largest group first, ties in group order; rows without a group are counted apart, as `none`, after all groups."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    grouped = F.col(group).isNotNull() & (F.col(group).cast("string") != none)
    out = sizes.select(F.coalesce(F.col(group).cast("string"), F.lit(none)).alias("group"), "n", grouped.alias("grouped"))
    out = out.groupBy("group", "grouped").agg(F.sum("n").alias("n"))
    return out.orderBy(F.desc("grouped"), F.desc("n"), "group").select("group", "n", "grouped")


def counts_by(df: DataFrame, *keys: str | Column, also: list[Column] | None = None) -> DataFrame:
    """Rows of each value of the keys, and other aggregates of them."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(also or []))


def sorted_distinct(df: DataFrame, *keys: str) -> DataFrame:
    """Each value of the keys once, in order."""
    return df.select(*keys).distinct().orderBy(*keys)
