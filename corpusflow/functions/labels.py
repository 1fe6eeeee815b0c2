"""Labels for people: statuses, durations, log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow import fixed_values as fv
from corpusflow.functions.templates import render


def status_label(status: Column, skipped: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in fv.STATUS_LABELS for x in pair])
    return F.when(skipped, fv.SKIPPED_LABEL).otherwise(F.try_element_at(labels, status))


def _count_text(count: Column) -> Column:
    return F.coalesce(count.cast("string"), F.lit(fv.REPORT_UNKNOWN))


def chunking_label(enabled: Column, count: Column, degraded: Column, reason: Column) -> Column:
    """Long form; ``enabled`` is null when nothing is known."""
    words = fv.CHUNKING_LABELS
    lines = F.array_compact(
        F.array(
            render(words["on"], count=_count_text(count)),
            F.when(degraded, words["degraded"]).otherwise(words["kept"]),
            F.when(degraded & (F.length(reason) > 0), F.concat(F.lit(words["reason"]), reason)),
        )
    )
    return (
        F.when(enabled.isNull(), words["none"])
        .when(~enabled, words["off"])
        .otherwise(F.array_join(lines, "\n"))
    )


def item_chunking_label(enabled: Column, count: Column, degraded: Column, reason: Column) -> Column:
    words = fv.ITEM_CHUNKING_LABELS
    tail = (
        F.when(~F.coalesce(degraded, F.lit(False)), F.lit(words["kept"]))
        .when(F.length(reason) > 0, F.concat(F.lit(words["reason"]), reason))
        .otherwise(F.lit(words["degraded"]))
    )
    return F.when(~enabled, F.lit(words["off"])).otherwise(
        F.concat(render(words["on"], count=_count_text(count)), tail)
    )


def duration_label(start_ms: Column, end_ms: Column, now_ms: Column) -> Column:
    """Milliseconds, seconds with one decimal, or minutes and seconds."""
    diff = F.greatest(F.coalesce(end_ms, now_ms) - start_ms, F.lit(0))
    tenths = F.floor(diff / 100 + 0.5).cast("bigint")
    seconds = F.format_string("%d.%ds", F.floor(tenths / 10), F.pmod(tenths, F.lit(10)))
    minutes = F.format_string(
        "%dm %ds", F.floor(diff / 60000), F.floor(F.pmod(diff, F.lit(60000)) / 1000)
    )
    return (
        F.when(start_ms.isNull(), F.lit(None).cast("string"))
        .when(diff < 1000, F.concat(diff.cast("string"), F.lit("ms")))
        .when(diff < 60000, seconds)
        .otherwise(minutes)
    )


def log_line(timestamp: Column, level: Column, category: Column, message: Column, metadata: Column) -> Column:
    """``[ts] LEVEL: [category] message {metadata json}``; empty parts are left out."""
    tag = F.when(F.length(category) > 0, F.concat(F.lit("["), category, F.lit("] "))).otherwise("")
    extra = F.when(metadata.isNotNull(), F.concat(F.lit(" "), metadata)).otherwise("")
    return F.concat(
        F.lit("["), timestamp, F.lit("] "), F.upper(level), F.lit(": "), tag, message, extra
    )


def detect_level(line: Column) -> Column:
    upper = F.upper(line)
    return (
        F.when(upper.contains("ERROR") | upper.contains("FAIL"), "ERROR")
        .when(upper.contains("WARN"), "WARN")
        .otherwise("INFO")
    )


def at_least_level(level: Column, minimum: str) -> Column:
    levels = F.array(*[F.lit(x) for x in fv.LOG_LEVELS])
    return F.array_position(levels, level) >= fv.LOG_LEVELS.index(minimum) + 1
