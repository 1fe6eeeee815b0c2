"""Error, metric, span and log tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow import fixed_values as fv
from corpusflow.functions.labels import at_least_level, detect_level
from corpusflow.operators.tables import fixed_rows

_CATALOG_COLUMNS = ["code", "message", "details", "suggestion", "severity", "category", "retryable", "delay_ms"]
_CATALOG_TYPES = [pa.string()] * 6 + [pa.bool_(), pa.int64()]


# --- errors ------------------------------------------------------------------------------


def error_catalog(spark: SparkSession, custom: DataFrame | None = None) -> DataFrame:
    """The fixed error table; custom rows replace rows with their code."""
    base = fixed_rows(spark, _CATALOG_COLUMNS, fv.ERROR_CATALOG, _CATALOG_TYPES)
    if custom is None:
        return base
    return base.join(custom.select("code"), "code", "left_anti").unionByName(custom)


def enrich_errors(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add the catalogue entry of each code; unknown codes keep their raw message as details."""
    _, message, suggestion, severity = fv.UNKNOWN_ERROR
    entry = catalog.select("code", F.struct(*[c for c in _CATALOG_COLUMNS if c != "code"]).alias("entry"))
    known = F.col("entry").isNotNull()
    return events.join(entry, "code", "left").select(
        *events.columns,
        F.when(known, F.col("entry.message")).otherwise(message).alias("title"),
        F.when(known, F.col("entry.details")).otherwise(F.col("message")).alias("details"),
        F.when(known, F.col("entry.suggestion")).otherwise(suggestion).alias("suggestion"),
        F.when(known, F.col("entry.severity")).otherwise(severity).alias("severity"),
        F.col("entry.category").alias("category"),
        F.coalesce("entry.retryable", F.lit(False)).alias("retryable"),
        F.coalesce("entry.delay_ms", F.lit(fv.DEFAULT_RETRY_DELAY_MS)).cast("bigint").alias("delay_ms"),
    )


def error_stats(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Count, first and last time, last message and category per code.

    Events are reduced to one row per code before they meet the catalogue.
    """
    stats = events.groupBy("code").agg(
        F.count("*").alias("n"),
        F.min("ts_ms").alias("first_ms"),
        F.max("ts_ms").alias("last_ms"),
        F.max_by("message", F.struct("ts_ms", "event_id")).alias("last_message"),
    )
    return stats.join(catalog.select("code", "category"), "code", "left")


def cap_stats(stats: DataFrame, size: int = fv.HISTORY_SIZE) -> DataFrame:
    """Keep the codes that occurred last; the oldest ones fall out."""
    return stats.orderBy(F.col("last_ms").desc(), "code").limit(size)


def by_category(stats: DataFrame) -> DataFrame:
    return stats.groupBy(F.coalesce("category", F.lit(fv.UNKNOWN_CATEGORY)).alias("category")).agg(
        F.sum("n").alias("n"),
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "code"))), lambda s: s["code"]
        ).alias("codes"),
    )


def error_report(stats: DataFrame, top: int = fv.REPORT_TOP) -> DataFrame:
    """Report rows ``(part, name, n, last_ms)``: total, categories, most frequent, most recent."""

    def rows(df: DataFrame, part: str, name: Column, n: Column, last: Column) -> DataFrame:
        return df.select(F.lit(part).alias("part"), name.alias("name"), n.alias("n"), last.alias("last_ms"))

    none = F.lit(None).cast("bigint")
    total = stats.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    frequent = stats.orderBy(F.col("n").desc(), "code").limit(top)
    recent = stats.orderBy(F.col("last_ms").desc(), "code").limit(top)
    return (
        rows(total, "total", F.lit(None).cast("string"), F.col("n"), none)
        .unionByName(rows(by_category(stats), "category", F.col("category"), F.col("n"), none))
        .unionByName(rows(frequent, "frequent", F.col("code"), F.col("n"), F.col("last_ms")))
        .unionByName(rows(recent, "recent", F.col("code"), F.col("n"), F.col("last_ms")))
    )


# --- metrics and spans -----------------------------------------------------------------------


def average_durations(metrics: DataFrame) -> DataFrame:
    """Mean of the millisecond values of every name; 0 for names without one."""
    mean = F.avg(F.when(F.col("unit") == "ms", F.col("value")))
    return metrics.groupBy("name").agg(F.coalesce(mean, F.lit(0.0)).alias("average_ms"))


def performance_report(metrics: DataFrame) -> DataFrame:
    """Report rows ``(part, name, value)``: metric count, averages, newest memory sample.

    One pass reduces to a row per name; the three parts are unpacked from it.
    """
    mean = F.avg(F.when(F.col("unit") == "ms", F.col("value")))
    newest = F.max_by("value", F.struct("ts_ms", "metric_id"))
    per_name = metrics.groupBy("name").agg(
        F.count("*").alias("n"), F.coalesce(mean, F.lit(0.0)).alias("average_ms"), newest.alias("newest")
    )
    parts = F.array(
        F.struct(F.lit("average").alias("part"), F.col("name"), F.col("average_ms").alias("value")),
        F.when(
            F.col("name") == "memory_used",
            F.struct(F.lit("memory").alias("part"), F.col("name"), F.col("newest").alias("value")),
        ),
    )
    detail = per_name.select(F.inline(F.array_compact(parts)))
    count = per_name.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("value")).select(
        F.lit("metrics").alias("part"), F.lit(None).cast("string").alias("name"), "value"
    )
    return detail.unionByName(count)


def pair_spans(marks: DataFrame) -> DataFrame:
    """Start and end of each span in one aggregation; ends without a start drop out.

    ``duration_ms`` is null while a span is active.
    """
    start = F.col("mark") == "start"
    paired = marks.groupBy("span_id").agg(
        F.min(F.when(start, F.col("ts_ms"))).alias("start_ms"),
        F.min(F.when(~start, F.col("ts_ms"))).alias("end_ms"),
        F.min_by("name", F.when(start, F.col("ts_ms"))).alias("name"),
    )
    return paired.filter(F.col("start_ms").isNotNull()).select(
        "span_id", "name", "start_ms", "end_ms",
        (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"),
        F.col("end_ms").isNull().alias("active"),
    )


def newest(df: DataFrame, size: int, ts: str, tie: str) -> DataFrame:
    """The newest rows; a top-k over partial top-k results, never a full sort."""
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(size)


def history_size(requested: int) -> int:
    return max(requested, fv.LOG_HISTORY_FLOOR)


# --- logs -------------------------------------------------------------------------------------


def logs_from_level(logs: DataFrame, minimum: str) -> DataFrame:
    return logs.filter(at_least_level(F.col("level"), minimum))


def search_logs(lines: DataFrame, levels: list[str], text: str, size: int | None = None) -> DataFrame:
    """Filter lines, or the newest ``size`` of them, by detected level and by text, ignoring case."""
    tail = (lines if size is None else newest(lines, size, "ts_ms", "log_id")).withColumn("detected", detect_level(F.col("line")))
    return tail.filter(F.col("detected").isin(levels) & F.lower("line").contains(text.lower()))


# --- request rate --------------------------------------------------------------------------------


def rate_waits(
    requests: DataFrame,
    key: str,
    window_ms: int = fv.RATE_WINDOW_MS,
    limit: int = fv.RATE_MAX_REQUESTS,
    bucket_ms: int = 3600 * 1000,
) -> DataFrame:
    """Requests of the same key in the window before each request, and the wait it causes.

    Windows reach back less than ``window_ms``, so a key is cut into time buckets
    and each row that later rows may look back to is copied into the next bucket.
    A hot key is thus spread over as many tasks as it has buckets. A request enters its window and leaves it
    ``window_ms`` later: what has entered less what has left is in the window, and the oldest of it leaves next. So
    each row costs the same, however many requests a window holds.
    """
    bucket = F.floor(F.col("ts_ms") / bucket_ms)
    next_bucket = F.floor((F.col("ts_ms") + window_ms - 1) / bucket_ms)
    spread = requests.withColumn("_bucket", F.explode(F.sequence(bucket, next_bucket)))
    own = F.when(F.col("_bucket") == bucket, F.struct(*requests.columns))
    leaves = F.col("ts_ms") + window_ms
    marks = F.array(
        F.struct(F.col("ts_ms").alias("at"), F.lit(1).alias("step"), F.lit(None).cast("bigint").alias("leaves"), own.alias("own")),
        F.struct(leaves.alias("at"), F.lit(-1).alias("step"), leaves.alias("leaves"), F.lit(None).alias("own")),
    )
    marked = spread.select(F.col(key).alias("_key"), "_bucket", F.inline(marks))
    upto = Window.partitionBy("_key", "_bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("_key", "_bucket").orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, -1)
    recent = marked.select(
        "own", (F.sum("step").over(upto) - 1).alias("in_window"), (F.min("leaves").over(later) - window_ms).alias("oldest_ms")
    ).filter("own IS NOT NULL")
    wait = F.lit(window_ms) - (F.col("own.ts_ms") - F.col("oldest_ms")) + fv.RATE_WAIT_MARGIN_MS
    return recent.select(
        "own.*",
        "in_window",
        F.when(F.col("in_window") >= limit, wait).otherwise(0).cast("bigint").alias("wait_ms"),
    )
