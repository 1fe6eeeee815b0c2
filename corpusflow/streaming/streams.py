"""Streaming forms: logs, job state, metric windows, event streams, request rate, cache, folder ingestion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusflow import fixed_values as fv
from corpusflow.functions import replies
from corpusflow.functions.keys import base_name, file_kind
from corpusflow.operators import cache as cache_ops
from corpusflow.operators import jobs, observability
from corpusflow.session import scratch_path
from corpusflow.sources import listing


def _timeout(ttl_ms: int | None) -> str:
    """State timeout of a stateful step.

    A processing-time timeout keeps a query asking for one more batch, so runs
    over available data must leave it off; endless queries should set it.
    """
    return GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout


# --- sinks ---------------------------------------------------------------------------------


def append_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append everything that is available to parquet files and stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def appended(stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream over the available data and read its files."""
    spark = stream.sparkSession
    path, schema = scratch_path(spark, name), stream.schema
    append_available(stream, path, scratch_path(spark, f"{name}-checkpoint"))
    return spark.read.schema(schema).parquet(path)


def snapshots(stream: DataFrame, name: str) -> DataFrame:
    """Run a complete-mode stream and read its newest snapshot.

    Each batch overwrites its own folder, so a repeated batch is harmless.
    """
    spark = stream.sparkSession
    path, schema = scratch_path(spark, name), stream.schema
    newest: list[int] = []

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch-{batch_id}")
        newest.append(batch_id)

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", scratch_path(spark, f"{name}-checkpoint"))
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not newest:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch-{max(newest)}")


# --- logs, jobs, metrics ----------------------------------------------------------------------


def log_stream(logs: DataFrame, minimum: str) -> DataFrame:
    return observability.logs_from_level(logs, minimum)


def job_state_stream(items: DataFrame) -> DataFrame:
    """The batch roll-up as running state; write it in complete mode for full snapshots."""
    return jobs.job_state(items)


def metric_windows(metrics: DataFrame, width: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """Averages per name and tumbling window of ``metrics(ts, name, value)``.

    The watermark is this engine's own choice: rows later than it are dropped,
    and a window is final once the watermark has passed its end.
    """
    windowed = metrics.withWatermark("ts", late).groupBy(F.window("ts", width), "name")
    return windowed.agg(F.avg("value").alias("average"), F.count("*").alias("samples")).select(
        F.col("window.start").alias("window_start"), "name", "average", "samples"
    )


# --- event streams --------------------------------------------------------------------------------

_CALL_SCHEMA = "call_id long, content string, prompt_tokens long, completion_tokens long, total_tokens long"


def _assembler(ttl_ms: int | None):
    """Add new pieces to the call's text; hand the call out at its end mark or when it times out."""
    counters = ["prompt_tokens", "completion_tokens", "total_tokens"]

    def assemble(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        content, usage, done = "", None, state.hasTimedOut
        if state.exists:
            content, *counts, known = state.get
            usage = counts if known else None
        if not done:
            lines = pd.concat(list(parts)).sort_values("line_no")
            content += "".join(p for p in lines["piece"] if isinstance(p, str))
            used = lines[lines["has_usage"]]
            if usage is None and len(used):
                first = used.iloc[0]
                usage = [None if pd.isna(v) else int(v) for v in first[["prompt", "completion", "total"]]]
            done = bool(lines["done"].any())
        if done:
            state.remove()
            row = (key[0], content, *(usage or (None, None, None)))
            frame = pd.DataFrame([row], columns=["call_id", "content", *counters])
            yield frame.astype({c: "Int64" for c in counters})
            return
        state.update((content, *(usage or (None, None, None)), usage is not None))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)

    return assemble


def sse_stream(lines: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Assemble chat-format lines per call; a row appears when its call is done.

    JSON is parsed by column functions; the state holds one call's text so far,
    without a cut, since cutting could damage a line.
    """
    v = replies.parse_json(replies.sse_data(F.col("line")))
    parsed = lines.select("call_id", "line_no", "line", v.alias("v")).select(
        "call_id",
        "line_no",
        F.nullif(replies.answer_text(F.col("v")), F.lit("")).alias("piece"),
        replies.usage(F.col("v")).alias("u"),
        F.col("line").rlike(r"^\s*data:\s*\[DONE\]\s*$").alias("done"),
    )
    flat = parsed.select(
        "call_id", "line_no", "piece", "done", F.col("u").isNotNull().alias("has_usage"), "u.prompt", "u.completion", "u.total"
    )
    return flat.groupBy("call_id").applyInPandasWithState(
        _assembler(ttl_ms),
        _CALL_SCHEMA,
        "content string, prompt long, completion long, total long, has_usage boolean",
        "append",
        _timeout(ttl_ms),
    )


# --- request rate -------------------------------------------------------------------------------------

_RATE_SCHEMA = "event_id long, ts_ms long, in_window long, wait_ms long"


def rate_stream(
    requests: DataFrame,
    key: str,
    window_ms: int = fv.RATE_WINDOW_MS,
    limit: int = fv.RATE_MAX_REQUESTS,
    bucket_ms: int = 3600 * 1000,
    ttl_ms: int | None = None,
) -> DataFrame:
    """Requests in the window before each request of ``requests(event_id, ts_ms, key)``.

    As in the batch form a key is cut into time buckets with an overlap, so a hot
    key is many small states; a state keeps the timestamps of one window.
    """

    def check(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values("ts_ms")
        now = rows["ts_ms"].to_numpy()
        earlier = np.array(state.get[0] if state.exists else [], dtype=np.int64)
        seen = np.sort(np.concatenate([earlier, now]))
        first = np.searchsorted(seen, now - window_ms + 1, side="left")
        count = np.searchsorted(seen, now, side="right") - first - 1
        wait = np.where(count >= limit, window_ms - (now - seen[first]) + fv.RATE_WAIT_MARGIN_MS, 0)
        state.update((seen[seen > seen[-1] - window_ms].tolist(),))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        out = pd.DataFrame({"event_id": rows["event_id"], "ts_ms": now, "in_window": count, "wait_ms": wait})
        yield out[rows["own"].to_numpy()]

    bucket = F.floor(F.col("ts_ms") / bucket_ms)
    next_bucket = F.floor((F.col("ts_ms") + window_ms - 1) / bucket_ms)
    spread = requests.select(
        "event_id", "ts_ms", key, F.explode(F.sequence(bucket, next_bucket)).alias("bucket")
    ).withColumn("own", F.col("bucket") == bucket)
    return spread.groupBy(key, "bucket").applyInPandasWithState(
        check, _RATE_SCHEMA, "seen array<long>", "append", _timeout(ttl_ms)
    )


# --- cache and ingestion ------------------------------------------------------------------------------------


def cache_stream(calls: DataFrame, cache: DataFrame, now_ms: int, ttl_ms: int = fv.CACHE_TTL_MS) -> DataFrame:
    """Stream-static lookup of ``calls(model, text_hash, ...)`` in the cache table."""
    return cache_ops.lookup(calls, cache, ["model", "text_hash"], now_ms, ttl_ms)


#: Settings under which very many small files are read: tasks of some hundred files, found by one listing task per core or so.
_SMALL_FILES = {"spark.sql.files.openCostInBytes": str(256 * 1024)}


def ingest_stream(spark: SparkSession, folder: str, files_per_batch: int = 50_000, checkpoint: str | None = None) -> DataFrame:
    """New text and Markdown files of a folder as documents; the checkpoint remembers finished files.

    A batch holds ``files_per_batch`` files at most; run it with ``ingest_available``, or the defaults for large files give
    each 32 files a task and an output file. With the ``checkpoint`` of the run, tasks list the folder now, the paths of
    files that are new are added to a table in it, and the stream reads that table's files and the files they name, so the
    driver holds neither. Without it, or on a file system that Arrow doesn't know, Spark's own source lists the folder at
    each trigger, with all its files in the driver's memory; that is the form for runs without an end.
    """
    if checkpoint is not None and listing.tasks_can_list(spark, folder):
        raw = _found_files(spark, folder, files_per_batch, checkpoint)
    else:
        raw = (
            spark.readStream.format("text")
            .option("wholetext", True)
            .option("maxFilesPerTrigger", files_per_batch)
            .option("pathGlobFilter", "*.{[tT][xX][tT],[mM][dD]}")
            .load(folder)
            .select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
        )
    name = base_name(F.col("path"))
    return raw.select(F.sha2("path", 256).alias("id"), "path", name.alias("name"), file_kind(name).alias("kind"), "text")


def _found_files(spark: SparkSession, folder: str, files_per_batch: int, checkpoint: str) -> DataFrame:
    """A stream of ``path`` and ``text`` over the files of a folder that are named in a table in the checkpoint, new ones added first.

    A run that dies while it adds has added some or none of the table's files: the next one finds the paths that are missing.
    """
    table = f"{checkpoint.rstrip('/')}/found-files"
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(checkpoint).getFileSystem(spark._jsc.hadoopConfiguration())
    begun = system.exists(hadoop.Path(table))
    if not begun and system.exists(hadoop.Path(f"{checkpoint}/sources")):
        raise ValueError(f"the checkpoint {checkpoint} belongs to a stream of another form; its finished files would come again")
    new = listing.listed_files(spark, folder, recursive=False).where(listing.is_text_file()).select("path", "size")
    if begun:
        new = new.join(spark.read.schema("path string").parquet(table), "path", "left_anti")
    per_file = max(1, min(listing.LISTED_FILES, files_per_batch))
    if not begun or not new.isEmpty():
        new.write.mode("append").option("maxRecordsPerFile", per_file).parquet(table)
    named = spark.readStream.schema("path string, size long").option("maxFilesPerTrigger", max(1, files_per_batch // per_file)).parquet(table)
    return listing.with_contents(named.where("size > 0")).select(F.col("content").cast("string").alias("text"), "path")


def ingest_available(found: DataFrame, path: str, checkpoint: str) -> None:
    """``append_available`` for rows of ``ingest_stream``: its query plans for small files."""
    spark = found.sparkSession
    listing = str(4 * spark.sparkContext.defaultParallelism)  # instead of up to 10,000 tasks, of a few files each
    wanted = _SMALL_FILES | {"spark.sql.sources.parallelPartitionDiscovery.parallelism": listing}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        append_available(found, path, checkpoint)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
