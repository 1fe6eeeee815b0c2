"""Batch jobs: skip existing outputs, roll item states up, resolve retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import fixed_values as fv
from corpusflow.functions.errors import run_error
from corpusflow.functions.templates import render


def without_existing(files: DataFrame, existing: DataFrame, path: str) -> DataFrame:
    """Files whose output is still missing; run before any text is read."""
    return files.join(existing.select(path), path, "left_anti")


def with_existing(files: DataFrame, existing: DataFrame, path: str) -> DataFrame:
    return files.join(existing.select(path), path, "left_semi")


def state_aggregates() -> list[Column]:
    """Counters of a job; a skipped item is also a completed one."""
    status = F.col("status")
    return [
        F.count("*").alias("total"),
        F.count_if(status == "success").alias("completed"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status == "cancelled").alias("cancelled_count"),
        F.count_if(F.col("skipped")).alias("skipped_count"),
        F.coalesce(F.bool_or(status == "cancelled"), F.lit(False)).alias("cancelled"),
    ]


def job_state(items: DataFrame) -> DataFrame:
    state = items.groupBy("job_id").agg(*state_aggregates())
    return state.withColumn("mode", F.when(F.col("total") > 1, "batch").otherwise("single"))


def progress(state: DataFrame) -> DataFrame:
    """Processed items, percent rounded half up, and what remains."""
    done = F.col("completed") + F.col("failed") + F.col("cancelled_count")
    percent = F.when(F.col("total") > 0, F.floor(done * 100.0 / F.col("total") + 0.5)).otherwise(0)
    return state.select(
        "job_id",
        done.alias("processed"),
        percent.cast("bigint").alias("percent"),
        F.greatest(F.col("total") - done, F.lit(0)).alias("remaining"),
    )


def is_completed() -> Column:
    return (F.col("status") == "success") & ~F.col("skipped")


def chunking_summary(items: DataFrame) -> DataFrame:
    chunked = is_completed() & F.col("chunking_enabled")
    return items.groupBy("job_id").agg(
        F.count_if(is_completed()).alias("total"),
        F.count_if(chunked).alias("chunked"),
        F.count_if(chunked & F.col("degraded")).alias("degraded"),
    )


def latest_outcomes(items: DataFrame) -> DataFrame:
    """Output of the last success and message of the last failure, in item order."""
    order = F.col("item_id")
    success = (F.col("status") == "success") & F.col("output_path").isNotNull()
    failure = (F.col("status") == "failed") & F.col("error_message").isNotNull()
    return items.groupBy("job_id").agg(
        F.max_by("output_path", F.when(success, order)).alias("latest_output"),
        F.max_by("error_message", F.when(failure, order)).alias("latest_error"),
    )


def current_names(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """Names of a job's running items in list order; unknown ids drop out.

    The id list of a job is bounded by its concurrency.
    """
    wanted = jobs.select("job_id", F.posexplode("current_ids").alias("pos", "item_id"))
    named = wanted.join(items.select("job_id", "item_id", "name"), ["job_id", "item_id"])
    ordered = F.array_sort(F.collect_list(F.struct("pos", "name")))
    found = named.groupBy("job_id").agg(F.transform(ordered, lambda s: s["name"]).alias("names"))
    return jobs.select("job_id").join(found, "job_id", "left").select(
        "job_id", F.coalesce("names", F.array().cast("array<string>")).alias("names")
    )


def retry_outcome(attempts: DataFrame, retries: int) -> DataFrame:
    """Final state per item from an attempts log with 0 to 5 retries.

    The first success or cancellation ends an item; later attempts and attempts
    past the limit do not count. A success clears code and message.
    """
    limit = min(max(retries, 0), 5) + 1
    stops = F.min(F.when(F.col("status") != "failed", F.col("attempt")))
    counted = attempts.filter(F.col("attempt") <= limit)
    ended = counted.groupBy("item_id").agg(
        stops.alias("stop"),
        F.max("attempt").alias("last"),
        # one struct per distinct outcome: the stopping attempt, else the last failure
        F.min_by(F.struct("status", "message"), F.when(F.col("status") != "failed", F.col("attempt"))).alias("ended"),
        F.max_by(F.struct("status", "message"), F.when(F.col("status") == "failed", F.col("attempt"))).alias("failed"),
    )
    outcome = F.coalesce("ended", "failed")
    resolved = ended.select(
        "item_id", F.coalesce("stop", "last").alias("attempts"), outcome.alias("o")
    ).withColumn("e", run_error(F.coalesce("o.message", F.lit(""))))
    good = F.col("o.status") == "success"
    return resolved.select(
        "item_id",
        "attempts",
        F.col("o.status").alias("status"),
        F.when(~good, F.col("e.code")).alias("error_code"),
        F.when(~good, F.col("e.message")).alias("error_message"),
    )


def retry_messages(attempts: DataFrame, retries: int) -> DataFrame:
    """Messages of failed attempts that are tried again."""
    again = (F.col("status") == "failed") & (F.col("attempt") <= min(max(retries, 0), 5))
    message = render(fv.RETRY_MESSAGE, attempt=F.col("attempt"), message=run_error(F.col("message"))["message"])
    return attempts.filter(again).select("item_id", "attempt", message.alias("retry_message"))
