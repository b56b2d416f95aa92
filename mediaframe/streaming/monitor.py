"""Arrivals and job states as streams, and their batch twins."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from mediaframe.functions.text import job_outcome
from mediaframe.operators.ordered import plain_column


def arrivals(objects: DataFrame, pattern: str, directory, key: str = "key", ts: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Different matching keys by directory; the same for a stream (update or complete mode) and a table. With ts, the column of the objects' times, a stream remembers a key only until the watermark (delay behind the latest time) has passed it: a key that comes again within the delay counts once, and the state doesn't grow with all keys that ever came."""
    found = objects.where(F.col(key).rlike(pattern))
    if ts and objects.isStreaming:
        found = found.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay).dropDuplicatesWithinWatermark([key])
    else:
        found = found.dropDuplicates([key])
    return found.groupBy(directory.alias("dir")).agg(F.count(F.lit(1)).alias("n"))


def progress_series(events: DataFrame, ts: str, interval: str, by: list | None = None, watermark: str | None = None) -> DataFrame:
    """Counts by tumbling window; a stream gets the watermark."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    e = e.withWatermark("_ts", watermark) if watermark else e
    return e.groupBy(F.window("_ts", interval).alias("w"), *(by or [])).agg(F.count(F.lit(1)).alias("n"))


def monitor_arrivals(arrived: DataFrame, local: DataFrame | None, expected: int) -> DataFrame:
    """A report of counts by directory (dir, n) that arrived, against those of the local directories: dir, expected, actual, total and complete (total of all that arrived, at least expected). Without local directories, one row with null ones."""
    total = arrived.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    if local is None:
        return total.select(F.lit(None).cast("string").alias("dir"), F.lit(None).cast("long").alias("expected"), F.lit(None).cast("long").alias("actual"), "total", (F.col("total") >= expected).alias("complete"))
    a = arrived.select(F.col("dir").alias("_d"), F.col("n").alias("actual"))
    d = local.select("dir", F.col("n").alias("expected")).join(a, F.col("dir") == F.col("_d"), "left").drop("_d").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return d.withColumn("total", total.scalar()).withColumn("complete", F.col("total") >= expected)


def report_exists(spark: SparkSession, path: str) -> bool:
    """Whether a report has been written whole."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def report_when_complete(counts: DataFrame, expected: int, path: str, checkpoint: str, local: DataFrame | None = None, interval: str | None = None) -> StreamingQuery:
    """Starts a query that writes one report, once expected keys have arrived: monitor_arrivals against local directories (dir, n), or without them the counts.

    The written report itself is what says that it has been written: a query that was stopped or lost finds it again, and one
    that was lost while writing writes over the unfinished one. interval ('180 seconds'): looks for arrivals so often, on
    and on; without it once over all that is there.
    """

    def check(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        total = batch.agg(F.sum("n")).first()[0] or 0  # of each batch, as its state is committed only if it is computed
        if total >= expected and not report_exists(batch.sparkSession, path):
            report = batch if local is None else monitor_arrivals(batch, local, expected)
            report.withColumn("batch", F.lit(number)).write.mode("overwrite").json(path)
        batch.unpersist()

    how = {"processingTime": interval} if interval else {"availableNow": True}
    return counts.writeStream.outputMode("complete").foreachBatch(check).option("checkpointLocation", checkpoint).trigger(**how).start()


def await_report(query: StreamingQuery, path: str, spark: SparkSession, seconds: float = 5.0, timeout: float | None = None) -> bool:
    """Waits for the report of a running query and then stops the query; False if the query ended, or the time was up, without one."""
    began = time.monotonic()
    while not (done := report_exists(spark, path)):
        if query.awaitTermination(seconds):
            return report_exists(spark, path)
        if timeout is not None and time.monotonic() - began > timeout:
            return False
    query.stop()
    return done


def latest_job_state(events: DataFrame, key: str, ts: str, status: str, url: str) -> DataFrame:
    """Each job's last state; once a state is final, later events don't change it."""
    o = job_outcome(status, url, F.lit(None).cast("string"))
    e = events.withColumn("_o", o).withColumn("_final", F.col("_o.state") != "pending")
    first_final = F.min_by("_o", F.when(F.col("_final"), F.col(ts)))
    return e.groupBy(key).agg(F.coalesce(first_final, F.max_by("_o", ts)).alias("outcome")).select(key, "outcome.state", "outcome.url")


class MinGap(StatefulProcessor):
    """Holds a key's times until the watermark has passed them, then takes them in their order; besides them only the last kept one stays."""

    def __init__(self, gap: float) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t double")
        self.waiting = handle.getListState("waiting", "t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = [t for part in rows for t in part["t"].tolist()]
        self.waiting.appendList([(t,) for t in times])
        self.handle.registerTimer(self._due(min(times)))
        yield self._rows(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        times = sorted(t for (t,) in self.waiting.get()) if self.waiting.exists() else []
        later = [t for t in times if self._due(t) > now]
        last, out = self.last.get()[0] if self.last.exists() else None, []
        for t in times[: len(times) - len(later)]:
            if last is None or t - last >= self.gap:
                out.append(t)
                last = t
        if out:
            self.last.update((last,))
        if len(later) < len(times):
            self.waiting.clear()
            if later:
                self.waiting.appendList([(t,) for t in later])
                self.handle.registerTimer(self._due(later[0]))
        yield self._rows(key, out)

    @staticmethod
    def _due(t: float) -> int:
        """The first whole millisecond after a time."""
        return math.floor(t * 1000) + 1

    @staticmethod
    def _rows(key, times: list[float]) -> pd.DataFrame:
        return pd.DataFrame({"key": plain_column(pd.Series([key[0]] * len(times), dtype=None if times else object)), "t": pd.Series(times, dtype=float)})

    def close(self) -> None:
        pass


def coalesce_min_gap_stream(stream: DataFrame, key: str, t: str, gap: float, delay: str = "10 seconds") -> DataFrame:
    """coalesce_min_gap of a stream whose times (seconds) come in any order, late by the delay at most: a time is decided once the watermark has passed it, so batches, and the order within them, make no difference. Later ones are dropped."""
    kind = stream.schema[key].dataType.simpleString()
    s = stream.select(F.col(key).alias("key"), F.col(t).cast("double").alias("t")).where("t is not null and not isnan(t)")
    s = s.withColumn("_ts", F.timestamp_micros(F.floor(F.col("t") * 1e6))).withWatermark("_ts", delay)
    return s.groupBy("key").transformWithStateInPandas(MinGap(gap), f"key {kind}, t double", "Append", "EventTime")
