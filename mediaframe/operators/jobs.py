"""Joins over jobs, inputs and outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.functions.text import backoff_seconds, missing_inputs
from mediaframe.operators.ordered import number_rows


def positional_pair(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """The i-th row of a key on the left with the i-th on the right; what is over is dropped."""
    r = number_rows(right, [key], [order], "idx")
    r = r.select(key, "idx", *[F.col(c).alias("right_" + c) for c in right.columns if c != key])
    return number_rows(left, [key], [order], "idx").join(r, [key, "idx"])


def inputs_exist(jobs: DataFrame, objects: DataFrame, video: str, audio: str, key: str = "key") -> DataFrame:
    """Adds missing: which of a job's inputs are not among the objects ('' if none)."""
    o = objects.select(key).where(F.col(key).isNotNull()).distinct()
    d = jobs.join(o.select(F.col(key).alias("_v")), F.col(video) == F.col("_v"), "left").join(o.select(F.col(key).alias("_a")), F.col(audio) == F.col("_a"), "left")
    return d.withColumn("missing", missing_inputs(F.col("_v").isNotNull(), F.col("_a").isNotNull())).drop("_v", "_a")


def skip_existing(plan: DataFrame, existing: DataFrame, key: str, force: bool = False, on_exists: str = "skipped") -> DataFrame:
    """Adds status: 'pending', or on_exists for what is there already."""
    e = existing.select(F.col(key).alias("_e")).distinct()
    d = plan.join(e, F.col(key) == F.col("_e"), "left")
    return d.withColumn("status", F.when(F.col("_e").isNotNull() & F.lit(not force), on_exists).otherwise("pending")).drop("_e")


def pending_jobs(jobs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return jobs.join(done, key, "left_anti")


def expected_vs_actual(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """expected: key and expected; actual: rows to count by key."""
    a = actual.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("actual"))
    d = expected.join(a, F.col(key) == F.col("_k"), "left").drop("_k").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return d.withColumn("complete", F.col("actual") >= F.col("expected"))


def name_conflicts(plan: DataFrame, inventory: DataFrame, target: str, name: str, folder: list) -> DataFrame:
    """Adds holder: the file of the inventory that has a row's target name already in its folder, null where none has or the row itself does; other columns of the inventory follow as held_<column>."""
    rest = [c for c in inventory.columns if c not in (name, *folder)]
    h = inventory.select(*[F.col(f).alias(f"_at_{f}") for f in folder], F.col(name).alias("holder"), *[F.col(c).alias(f"held_{c}") for c in rest])
    on = [F.col(f).eqNullSafe(F.col(f"_at_{f}")) for f in folder] + [F.col(target) == F.col("holder"), F.col(name) != F.col("holder")]
    return plan.join(h, on, "left").drop(*[f"_at_{f}" for f in folder])


def merge_outcomes(success: DataFrame, failure: DataFrame) -> DataFrame:
    """Records of both kinds under one schema, fields that one of them lacks null; success says which."""
    return success.withColumn("success", F.lit(True)).unionByName(failure.withColumn("success", F.lit(False)), allowMissingColumns=True)


def retry_rounds(ledger: DataFrame, idx: str, failed, done, max_rounds: int) -> DataFrame:
    """Jobs without a success that failed fewer than max_rounds times, with the wait before their next round."""
    g = ledger.groupBy(idx).agg(F.count_if(failed).alias("attempts"), F.max(done).alias("_done"))
    return g.where(~F.coalesce("_done", F.lit(False)) & (F.col("attempts") > 0) & (F.col("attempts") < max_rounds)).select(idx, "attempts", backoff_seconds("attempts", kind="rounds").alias("wait_sec"))


def max_attempts(ledger: DataFrame, idx: str, failed: Column, by: list | None = None) -> DataFrame:
    """The most failed attempts of a job, over all jobs or for each value of by; 0 where none failed."""
    each = ledger.groupBy(*(by or []), idx).agg(F.count_if(failed).alias("attempts"))
    return each.groupBy(*(by or [])).agg(F.max("attempts").alias("max_attempts"))
