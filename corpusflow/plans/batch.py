"""A batch run: skip finished documents, interpret the rest with retries, return item rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow import fixed_values as fv
from corpusflow.functions.errors import run_error
from corpusflow.operators import jobs
from corpusflow.operators.hooks import Hooks
from corpusflow.plans.interpret import interpret
from corpusflow.session import materialise, scratch_path
from corpusflow.sources.reports import own_paths


def run_batch(
    docs: DataFrame,
    existing: DataFrame,
    client,
    instructions: str,
    model: str,
    folder: str,
    *,
    job_id: str = "job",
    retries: int = 0,
    ledger: str | None = None,
    cancelled: DataFrame | None = None,
    hooks: Hooks | None = None,
    **options,
) -> DataFrame:
    """Item rows of one job over ``docs(doc_id, name, path, kind, text)``.

    Documents whose report is in ``existing(output_path)`` are skipped before
    their text is used; documents listed in ``cancelled(doc_id)`` are cancelled
    and never fail. Every attempt is one job over the documents still open and is
    written before it is split, so finished documents are never called again. A
    Python client's calls go through a ledger, so the finished chunks of a failed document are not called again either;
    give a ``ledger`` folder to resume a job that died. Documents whose names give one report path get paths of their own.
    The rows feed ``jobs.job_state`` and ``reports.batch_report``. ``hooks`` go around every call; their observers are called
    with tables that are written already: ``batch_before`` once with the job's documents and output paths,
    ``before_parse`` once per attempt with its documents, ``batch_after`` once with the item rows.
    """
    hooks = hooks or Hooks()
    names = materialise(own_paths(docs.select("doc_id", "name", "path"), folder), "outputs")
    hooks.notify("batch_before", names)
    paths = names.select("doc_id", "output_path")
    if ledger is None and not client.inline and options.get("cache") is None:
        ledger = scratch_path(docs.sparkSession, "ledger")
    no_text = F.lit(None).cast("string")

    def items(df: DataFrame, status: str, skipped: bool, attempts, path, code, message, report) -> DataFrame:
        chunking = F.col("chunking") if "chunking" in df.columns else None
        return df.select(
            F.lit(job_id).alias("job_id"),
            F.col("doc_id").alias("item_id"),
            "name",
            F.lit(status).alias("status"),
            F.lit(skipped).alias("skipped"),
            F.lit(attempts).cast("bigint").alias("attempts"),
            path.alias("output_path"),
            code.alias("error_code"),
            message.alias("error_message"),
            (F.lit(None).cast("boolean") if chunking is None else chunking["enabled"]).alias("chunking_enabled"),
            (F.lit(None).cast("boolean") if chunking is None else chunking["degraded"]).alias("degraded"),
            report.alias("report"),
        )

    # texts are only read for documents that are open
    open_ids = jobs.without_existing(names, existing, "output_path").select("doc_id")
    skipped = jobs.with_existing(names, existing, "output_path")
    parts = [items(skipped, "success", True, 0, F.col("output_path"), no_text, no_text, no_text)]
    if cancelled is not None:
        stopped = names.join(open_ids, "doc_id", "left_semi").join(cancelled.select("doc_id"), "doc_id", "left_semi")
        parts.append(items(stopped, "cancelled", False, 0, no_text, F.lit("CANCELLED"), F.lit(fv.CANCELLED_TEXT), no_text))
        open_ids = open_ids.join(cancelled.select("doc_id"), "doc_id", "left_anti")
    open_ids = materialise(open_ids, "open-documents")
    last = max(retries, 0) + 1
    for attempt in range(1, last + 1):
        todo = docs.join(open_ids, "doc_id", "left_semi")
        tried = materialise(interpret(todo, client, instructions, model, ledger=ledger, hooks=hooks, **options), "attempt")
        good = tried.filter(F.col("error").isNull()).join(paths, "doc_id")
        parts.append(items(good, "success", False, attempt, F.col("output_path"), no_text, no_text, F.col("report")))
        bad = tried.filter(F.col("error").isNotNull())
        if attempt == last:
            fault = run_error(F.col("error"))
            parts.append(items(bad, "failed", False, attempt, no_text, fault["code"], fault["message"], no_text))
        else:
            open_ids = bad.select("doc_id")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    hooks.notify("batch_after", result)
    return result
