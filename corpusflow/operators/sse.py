"""Event-stream lines to answers, one row per call."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions import replies


def _joined_pieces():
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "piece")))
    return F.array_join(F.transform(ordered, lambda s: s["piece"]), "")


def _usage_fields(df: DataFrame) -> DataFrame:
    return df.select(
        "call_id",
        "content",
        F.col("usage.prompt").alias("prompt_tokens"),
        F.col("usage.completion").alias("completion_tokens"),
        F.col("usage.total").alias("total_tokens"),
    )


def chat_streams(lines: DataFrame) -> DataFrame:
    """``data:`` lines of the chat format: joined pieces, the first usage wins, bad lines are skipped."""
    parsed = lines.select(
        "call_id", "line_no", replies.parse_json(replies.sse_data(F.col("line"))).alias("v")
    )
    pieces = parsed.select(
        "call_id",
        "line_no",
        F.nullif(replies.answer_text(F.col("v")), F.lit("")).alias("piece"),
        replies.usage(F.col("v")).alias("usage"),
    )
    first = F.min_by("usage", F.when(F.col("usage").isNotNull(), F.col("line_no")))
    return _usage_fields(pieces.groupBy("call_id").agg(_joined_pieces().alias("content"), first.alias("usage")))


def event_streams(lines: DataFrame) -> DataFrame:
    """``event:`` and ``data:`` lines of the event format.

    An event line names the data lines after it; usage comes from the start
    message and is replaced by a later delta. The window and the aggregation
    share one partitioning by call.
    """
    order = Window.partitionBy("call_id").orderBy("line_no")
    named = lines.select(
        "call_id",
        "line_no",
        F.last(replies.sse_event(F.col("line")), ignorenulls=True).over(order).alias("event"),
        replies.sse_data(F.col("line")).alias("data"),
    )
    parsed = named.withColumn("v", replies.parse_json(F.col("data")))
    event = F.col("event")
    text = F.try_variant_get(F.col("v"), "$.delta.text", "string")
    usage = F.when(event == "message_start", replies.usage(F.col("v"), "$.message.usage")).when(
        event == "message_delta", replies.usage(F.col("v"))
    )
    pieces = parsed.select(
        "call_id",
        "line_no",
        F.when(event == "content_block_delta", text).alias("piece"),
        usage.alias("usage"),
    )
    last = F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col("line_no")))
    return _usage_fields(pieces.groupBy("call_id").agg(_joined_pieces().alias("content"), last.alias("usage")))
