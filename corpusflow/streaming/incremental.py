"""Running totals of a stream as a table of partial aggregates, without engine state.

Each batch adds one partial aggregate per key it has, in a folder named by the batch, so a batch that is repeated overwrites
itself. Totals are the merged partials. Every few batches the partials become a new base and what it replaces is emptied.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MARKS = "batch long, newest_ms long, base long"


@dataclass
class RunningTable:
    """``partial`` aggregates rows to ``keys`` and ``merges``' columns; ``merges`` says how partials of a key become one."""

    path: str
    keys: list[str]
    partial: Callable[[DataFrame], DataFrame]
    merges: dict[str, Callable[[str], Column]]
    compact_every: int = 16

    def _folder(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}/{kind}={number}"

    def _read(self, spark: SparkSession, kind: str, schema: str) -> DataFrame:
        # an empty folder to begin with, so that there is something to read
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(self._folder(kind, -1))
        return spark.read.schema(f"{schema}, {kind} long").parquet(f"{self.path}/{kind}")

    def _marks(self, spark: SparkSession) -> DataFrame:
        spark.createDataFrame([], _MARKS).write.mode("overwrite").parquet(self._folder("mark", -1))
        return spark.read.schema(_MARKS).parquet(f"{self.path}/mark")

    def _base(self, spark: SparkSession) -> int:
        newest = self._marks(spark).agg(F.max("base")).first()[0]
        return -1 if newest is None else newest

    def _merged(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy(*self.keys).agg(*[merge(c).alias(c) for c, merge in self.merges.items()])

    def read(self, spark: SparkSession, schema: str) -> DataFrame:
        """The totals of all batches so far; ``schema`` is that of a partial."""
        base = self._base(spark)
        parts = self._read(spark, "part", schema).filter(F.col("part") > base).drop("part")
        bases = self._read(spark, "base", schema).filter((F.col("base") == base) & (F.col("base") >= 0)).drop("base")
        return self._merged(bases.unionByName(parts))

    def late_rows(self, spark: SparkSession, schema: str) -> DataFrame:
        """Rows that came too late for their window; ``schema`` is the stream's."""
        return self._read(spark, "late", schema).drop("late")

    def add(self, rows: DataFrame, batch: int, newest: Column | None = None, too_late: Callable[[int | None], Column] | None = None) -> None:
        """Takes a batch in. ``newest`` is the time of its newest row in ms, and ``too_late`` tells, from the newest time of the batches
        before (none: null), which rows go to the table of late rows and not into the totals."""
        spark = rows.sparkSession
        base = self._base(spark)
        if base >= batch:  # a batch that is repeated after it became a base is in that base already
            return
        marks = self._marks(spark).filter(F.col("batch") < batch)
        before = marks.agg(F.max("newest_ms")).first()[0]
        if too_late is not None:
            late = F.coalesce(too_late(before), F.lit(False))
            rows.filter(late).write.mode("overwrite").parquet(self._folder("late", batch))
            rows = rows.filter(~late)
        part = self.partial(rows)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema)
        part.write.mode("overwrite").parquet(self._folder("part", batch))
        newest_ms = F.lit(None).cast("long") if newest is None else newest
        mark = rows.agg(F.lit(batch).cast("long").alias("batch"), newest_ms.alias("newest_ms"), F.lit(None).cast("long").alias("base"))
        if batch - base >= self.compact_every:
            parts = self._read(spark, "part", schema).filter(F.col("part") > base).drop("part")
            bases = self._read(spark, "base", schema).filter((F.col("base") == base) & (F.col("base") >= 0)).drop("base")
            self._merged(bases.unionByName(parts)).write.mode("overwrite").parquet(self._folder("base", batch))
            mark = mark.withColumn("base", F.lit(batch).cast("long"))
        mark.write.mode("overwrite").parquet(self._folder("mark", batch))
        if batch - base >= self.compact_every:
            self._empty(spark, schema, base, batch)

    def _empty(self, spark: SparkSession, schema: str, old: int, new: int) -> None:
        """Empties what a base replaced; readers skip it anyway, so dying here costs space only."""
        nothing = spark.createDataFrame([], schema)
        if old >= 0:
            nothing.write.mode("overwrite").parquet(self._folder("base", old))
        for batch in range(old + 1, new + 1):
            nothing.write.mode("overwrite").parquet(self._folder("part", batch))

    def run(self, stream: DataFrame, checkpoint: str, **lateness) -> None:
        """Takes in everything that is available, and stops."""
        query = (
            stream.writeStream.foreachBatch(lambda rows, batch: self.add(rows.persist(), batch, **lateness))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def _sum(c: str) -> Column:
    return F.sum(c)


# --- job state ----------------------------------------------------------------------------------

JOB_COUNTERS = ["total", "completed", "failed", "cancelled_count", "skipped_count"]


def job_table(path: str, key: str = "job_id", compact_every: int = 16) -> RunningTable:
    """Counters of jobs from item rows ``(job_id, status, skipped)``, as ``jobs.job_state`` has them."""
    from corpusflow.operators.jobs import state_aggregates

    merges: dict[str, Callable[[str], Column]] = {c: _sum for c in JOB_COUNTERS}
    merges["cancelled"] = F.bool_or
    return RunningTable(path, [key], lambda items: items.groupBy(key).agg(*state_aggregates()), merges, compact_every)


def job_states(table: RunningTable, spark: SparkSession, key_type: str = "long") -> DataFrame:
    """One row per job, equal to the batch roll-up over all items."""
    schema = ", ".join([f"{table.keys[0]} {key_type}", *[f"{c} long" for c in JOB_COUNTERS], "cancelled boolean"])
    return table.read(spark, schema).withColumn("mode", F.when(F.col("total") > 1, "batch").otherwise("single"))


# --- metric windows -----------------------------------------------------------------------------


def window_table(path: str, width: str = "5 seconds", compact_every: int = 16) -> RunningTable:
    """Sums per name and tumbling window of ``metrics(ts, name, value)``."""

    def partial(metrics: DataFrame) -> DataFrame:
        windowed = metrics.groupBy(F.window("ts", width).alias("window"), "name").agg(F.sum("value").alias("value_sum"), F.count("value").alias("values"), F.count("*").alias("samples"))
        return windowed.select(F.col("window.start").alias("window_start"), "name", "value_sum", "values", "samples")

    return RunningTable(path, ["window_start", "name"], partial, {c: _sum for c in ("value_sum", "values", "samples")}, compact_every)


def window_lateness(width_ms: int, late_ms: int) -> dict:
    """For ``RunningTable.run``: rows whose window ended ``late_ms`` or more before the newest row of the batches before are late, and so
    are rows without a time, which have no window."""
    end = (F.floor(F.unix_millis("ts") / width_ms) + 1) * width_ms
    timeless = F.col("ts").isNull()
    return {"newest": F.max(F.unix_millis("ts")), "too_late": lambda newest: timeless if newest is None else timeless | (end <= newest - late_ms)}


def window_averages(table: RunningTable, spark: SparkSession) -> DataFrame:
    """window_start, name, average, samples of all windows, also of those that are still open."""
    found = table.read(spark, "window_start timestamp, name string, value_sum double, values long, samples long")
    return found.select("window_start", "name", (F.col("value_sum") / F.nullif("values", F.lit(0))).alias("average"), "samples")
