"""Catalogue: the streaming forms, run over everything available and compared with batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions.keys import content_key
from corpusflow.operators import chunking
from corpusflow.plans import samples, views
from corpusflow.plans.queries_records import _chunk_cache, _chunk_calls
from corpusflow.plans.registry import query
from corpusflow.session import scratch_path
from corpusflow.sources.reports import write_reports
from corpusflow.streaming import incremental, stateful, streams


def _live(sf_dir: str) -> views.LiveDir:
    return views.LiveDir(sf_dir)


@query("stream_logs", same_as="log_min_level")
def stream_logs(spark, sf_dir):
    logs = streams.log_stream(views.logs(spark, _live(sf_dir)), "warn").select("log_id", "level", "message")
    return streams.appended(logs, "logs")


@query("stream_job_state", same_as="job_state")
def stream_job_state(spark, sf_dir):
    return streams.snapshots(streams.job_state_stream(views.job_items(spark, _live(sf_dir))), "job-state")


@query("stream_sse", same_as="sse_chat")
def stream_sse(spark, sf_dir):
    return streams.appended(streams.sse_stream(views.sse_lines(spark, _live(sf_dir))), "sse")


@query(
    "stream_metrics",
    """SELECT epoch_us(time_bucket(INTERVAL '5 seconds', ts)) // 1000 AS window_ms, name, round(avg(value), 6) AS average, count(*) AS samples
    FROM (SELECT ts, CASE WHEN event_id % 5 = 0 THEN 'memory_used' ELSE event_type END AS name, value FROM events)
    GROUP BY 1, 2 HAVING epoch_us(time_bucket(INTERVAL '5 seconds', any_value(ts))) // 1000 + 5000 <= (SELECT max(epoch_us(ts)) // 1000 FROM events) - 600000""",
)
def stream_metrics(spark, sf_dir):
    """Windows that the watermark has closed: their end lies ten minutes before the newest row."""
    metrics = views.metrics(spark, _live(sf_dir)).withColumn("ts", F.timestamp_millis("ts_ms"))
    found = streams.appended(streams.metric_windows(metrics), "metrics")
    return found.select(F.unix_millis("window_start").alias("window_ms"), "name", F.round("average", 6).alias("average"), "samples")


@query(
    "stream_metrics_all",
    """SELECT epoch_us(time_bucket(INTERVAL '5 seconds', ts)) // 1000 AS window_ms, name, round(avg(value), 6) AS average, count(*) AS samples
    FROM (SELECT ts, CASE WHEN event_id % 5 = 0 THEN 'memory_used' ELSE event_type END AS name, value FROM events) GROUP BY 1, 2""",
)
def stream_metrics_all(spark, sf_dir):
    """Every window with its last state, also those that are open where the available data ends."""
    metrics = views.metrics(spark, _live(sf_dir)).withColumn("ts", F.timestamp_millis("ts_ms"))
    found = streams.snapshots(streams.metric_windows(metrics), "metrics-all")
    return found.select(F.unix_millis("window_start").alias("window_ms"), "name", F.round("average", 6).alias("average"), "samples")


@query(
    "stream_rate",
    """SELECT event_id, ts_ms, n AS in_window, CASE WHEN n >= 5 THEN 3600000 - (ts_ms - oldest) + 100 ELSE 0 END AS wait_ms FROM (
      SELECT event_id, ts_ms, count(*) OVER w - 1 AS n, min(ts_ms) OVER w AS oldest FROM v_events
      WINDOW w AS (PARTITION BY user_id % 2 ORDER BY ts_ms RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW))""",
)
def stream_rate(spark, sf_dir):
    requests = views.events(spark, _live(sf_dir)).select("event_id", "ts_ms", (F.col("user_id") % 2).alias("caller"))
    return streams.appended(
        streams.rate_stream(requests, "caller", window_ms=3600 * 1000, bucket_ms=24 * 3600 * 1000), "rate"
    )


@query("stream_cache", same_as="cache_lookup")
def stream_cache(spark, sf_dir):
    cache = _chunk_cache(spark, sf_dir, _chunk_calls(spark, sf_dir))
    docs = views.ff_docs(spark, _live(sf_dir))
    rows = chunking.chunk_rows(docs, chunking.text_chunks(F.col("text"), 1000), "doc_id")
    calls = rows.select(
        "doc_id", "index", F.lit("gpt-4o").alias("model"), content_key(F.col("chunk.content")).alias("text_hash")
    )
    found = streams.cache_stream(calls, cache, samples.NOW_MS)
    return streams.appended(found.select("doc_id", "index", "hit", "cached_result"), "cache")


@query(
    "stream_ingest",
    """SELECT 'Doc ' || doc_id || '.txt' AS name, text, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 ELSE 2 END AS run FROM documents""",
)
def stream_ingest(spark, sf_dir):
    """Two drops into one folder: labelled documents first; each run picks up new files only."""
    folder, sink = scratch_path(spark, "inbox"), scratch_path(spark, "ingested")
    checkpoint = scratch_path(spark, "ingest-checkpoint")
    docs = views.documents(spark, sf_dir)
    named = docs.select(
        "doc_id", F.concat(F.lit("Doc "), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), F.col("text").alias("content")
    )
    labelled = views.table(spark, sf_dir, "labels").select("doc_id")
    for run, kind in ((1, "left_semi"), (2, "left_anti")):
        write_reports(named.join(labelled, "doc_id", kind), folder)
        found = streams.ingest_stream(spark, folder, checkpoint=checkpoint).select("path", "text", F.lit(run).alias("run"))
        streams.ingest_available(found, sink, checkpoint)
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    return spark.read.parquet(sink).select(name.alias("name"), "text", "run")


# --- streams whose state ends ---------------------------------------------------------------------


def _halves(rows, name: str, part):
    """The folder of ``rows`` as a stream of one file per value of ``part``, 0 then 1."""
    folder = scratch_path(rows.sparkSession, name)
    for k in range(2):
        rows.filter(part == k).coalesce(1).write.mode("append").parquet(folder)
    return folder


def _live_files(rows, folder: str):
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _dropped(rows, name: str, part, heartbeat: dict):
    """``rows`` in two halves as a stream, and a last row a year later that ends all state."""
    folder = _halves(rows, name, part)
    last = rows.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 365 DAYS")).alias("ts"))
    last.select(*[F.lit(heartbeat.get(f.name)).cast(f.dataType).alias(f.name) if f.name != "ts" else F.col("ts") for f in rows.schema]).coalesce(1).write.mode("append").parquet(folder)
    return _live_files(rows, folder)


@query("stream_job_totals", same_as="job_state")
def stream_job_totals(spark, sf_dir):
    """The items of all jobs in two batches, as partial counters that are merged."""
    items = views.job_items(spark, sf_dir)
    live = _live_files(items, _halves(items, "job-items", F.col("item_id") % 2))
    table = incremental.job_table(scratch_path(spark, "job-totals"), compact_every=1)
    table.run(live, scratch_path(spark, "job-totals-checkpoint"))
    return incremental.job_states(table, spark)


@query("stream_window_totals", same_as="stream_metrics_all")
def stream_window_totals(spark, sf_dir):
    """Every metric window, fed in two batches of time."""
    metrics = views.metrics(spark, sf_dir).withColumn("ts", F.timestamp_millis("ts_ms")).select("ts", "name", "value")
    live = _live_files(metrics, _halves(metrics, "metrics", F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp"), 0).otherwise(1)))
    table = incremental.window_table(scratch_path(spark, "window-totals"))
    table.run(live, scratch_path(spark, "window-totals-checkpoint"), **incremental.window_lateness(5000, 600_000))
    found = incremental.window_averages(table, spark)
    return found.select(F.unix_millis("window_start").alias("window_ms"), "name", F.round("average", 6).alias("average"), "samples")


@query(
    "stream_calls",
    """SELECT conv_id * 1000 + turn AS call_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: x || ' '), '') AS content,
    length(text) AS prompt_tokens, 2 AS completion_tokens, length(text) AS total_tokens, (conv_id * 1000 + turn) % 5 <> 0 AS complete FROM conversations""",
)
def stream_calls(spark, sf_dir):
    """Calls in two halves; every fifth has no end mark and comes out without it."""
    lines = views.sse_lines(spark, sf_dir).filter("call_id % 5 <> 0 OR line <> 'data: [DONE]'")
    lines = lines.select("*", F.timestamp_millis(samples.NOW_MS + F.col("call_id") * 10 + F.col("line_no")).alias("ts"))
    live = _dropped(lines, "call-lines", F.when(F.col("line_no") < 3, 0).otherwise(1), {"line": ""})
    return stateful.stateful_appended(stateful.call_stream(live, quiet_ms=365 * 12 * 3600 * 1000, late="100 days"), "calls")


_TTL_MS = 6 * 3600 * 1000


@query(
    "stream_cache_ttl",
    f"""WITH RECURSIVE a AS (SELECT event_id AS access_id, model, key AS text_hash, ts_ms, row_number() OVER (PARTITION BY model, key ORDER BY ts_ms, event_id) AS n FROM v_cache_log),
    run AS (SELECT *, ts_ms AS written_ms, false AS hit FROM a WHERE n = 1
      UNION ALL SELECT a.access_id, a.model, a.text_hash, a.ts_ms, a.n, CASE WHEN a.ts_ms - r.written_ms <= {_TTL_MS} THEN r.written_ms ELSE a.ts_ms END, a.ts_ms - r.written_ms <= {_TTL_MS}
      FROM run r JOIN a ON a.model = r.model AND a.text_hash = r.text_hash AND a.n = r.n + 1)
    SELECT access_id, model, text_hash, hit, 'answer to ' || text_hash AS result, written_ms FROM run""",
)
def stream_cache_ttl(spark, sf_dir):
    """The access log in two halves of time; what missed in the first is a hit in the second while it is fresh."""
    log = views.cache_log(spark, sf_dir).select(
        F.col("event_id").alias("access_id"), "model", F.col("key").alias("text_hash"), F.concat(F.lit("answer to "), "key").alias("answer"), F.timestamp_millis("ts_ms").alias("ts")
    )
    middle = F.lit("2024-01-15").cast("timestamp")
    live = _dropped(log, "accesses", F.when(F.col("ts") < middle, 0).otherwise(1), {})
    return stateful.stateful_appended(stateful.living_cache_stream(live, _TTL_MS), "cache-ttl")


@query("stream_rate_state", same_as="stream_rate")
def stream_rate_state(spark, sf_dir):
    """The request log in two halves of time; buckets end with the watermark."""
    requests = views.events(spark, sf_dir).select("event_id", F.timestamp_millis("ts_ms").alias("ts"), (F.col("user_id") % 2).alias("caller"))
    live = _dropped(requests, "requests", F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp"), 0).otherwise(1), {"event_id": -1, "caller": -1})
    rates = stateful.stateful_appended(stateful.rate_stream(live, "caller", window_ms=3600 * 1000), "rate-state")
    return rates.filter("event_id >= 0")
