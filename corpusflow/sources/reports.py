"""Report texts and sinks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from corpusflow import fixed_values as fv
from corpusflow.functions.keys import join_path, output_name
from corpusflow.functions.labels import status_label
from corpusflow.functions.templates import render
from corpusflow.session import materialise
from corpusflow.sources.report_sink import filesystem_uri


def _yes_no(flag: Column) -> Column:
    return F.when(flag, fv.REPORT_YES).otherwise(fv.REPORT_NO)


def _or_unknown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(fv.REPORT_UNKNOWN))


def _field(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value)


def _chunking_lines(c: Column, with_max_tokens: bool) -> Column:
    count, original, final, max_tokens, degraded, reason = fv.REPORT_CHUNKING_FIELDS
    lines = [
        F.lit(fv.REPORT_CHUNKING_ON),
        _field(count, _or_unknown(c["chunk_count"])),
        _field(original, c["original_length"].cast("string")),
        _field(final, c["final_length"].cast("string")),
        *([_field(max_tokens, _or_unknown(c["max_tokens"]))] if with_max_tokens else []),
        _field(degraded, _yes_no(c["degraded"])),
        F.when(c["degraded"] & (F.length(c["degrade_reason"]) > 0), _field(reason, c["degrade_reason"])),
    ]
    return F.when(c["enabled"], F.array(*lines)).otherwise(F.array(F.lit(fv.REPORT_CHUNKING_OFF)))


def _direction_lines(d: Column) -> Column:
    main, subs, keywords, confidence = fv.REPORT_DIRECTION_FIELDS

    def joined(values: Column) -> Column:
        return F.coalesce(F.array_join(values, ", "), F.lit(fv.REPORT_NONE))

    lines = F.array(
        F.lit(fv.REPORT_DIRECTION),
        _field(main, d["main"]),
        _field(subs, joined(d["subs"])),
        _field(keywords, joined(d["keywords"])),
        # whole numbers are written without a fraction
        _field(confidence, F.regexp_replace(_or_unknown(d["confidence"]), r"\.0$", "")),
    )
    return F.when(d.isNotNull(), lines).otherwise(F.array().cast("array<string>"))


def _usage_lines(u: Column) -> Column:
    lines = [_field(label, _or_unknown(u[n])) for label, n in zip(fv.REPORT_USAGE_FIELDS, ("prompt", "completion", "total"))]
    return F.when(u.isNull(), F.array(F.lit(fv.REPORT_USAGE_OFF))).otherwise(
        F.array(F.lit(fv.REPORT_USAGE_ON), *lines)
    )


def _appendix(chunking: Column, summaries: Column) -> Column:
    blocks = F.transform(
        summaries, lambda s, i: F.concat(render(fv.CHUNK_HEADER, index=i + 1), s, F.lit("\n"))
    )
    lines = F.concat(F.array(F.lit(fv.REPORT_APPENDIX)), blocks)
    return F.when(chunking["enabled"] & (F.size(summaries) > 0), lines).otherwise(
        F.array().cast("array<string>")
    )


def _report_body(name: Column, with_max_tokens: bool) -> Column:
    t = F.col("truncation")
    detail = F.when(
        t["applied"], render(fv.REPORT_CUT_DETAIL, original=t["original_length"], final=t["final_length"])
    ).otherwise("")
    values = [
        name,
        F.col("path"),
        F.col("kind"),
        F.col("model"),
        F.col("endpoint_summary"),
        F.coalesce(F.col("prompt_name"), F.lit(fv.REPORT_NO_TEMPLATE)),
        F.col("generated_at"),
        F.concat(_yes_no(t["applied"]), detail),
    ]
    head = F.array(*[_field(label, v) for label, v in zip(fv.REPORT_FIELDS, values)])
    lines = F.concat(
        head,
        _chunking_lines(F.col("chunking"), with_max_tokens),
        _direction_lines(F.col("direction")),
        _usage_lines(F.col("usage")),
        F.array(F.lit(""), F.lit(fv.REPORT_BODY), F.col("content"), F.lit("")),
        _appendix(F.col("chunking"), F.col("chunk_summaries")),
    )
    return F.concat(F.lit(fv.REPORT_TITLE), F.array_join(F.array_compact(lines), "\n"))


def markdown_report() -> Column:
    """Plain Markdown report of a result row."""
    return _report_body(F.col("name"), with_max_tokens=False)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def front_matter_report() -> Column:
    """Markdown report with YAML front matter and a linked file name."""
    d, c = F.col("direction"), F.col("chunking")

    def listed(key: str, values: Column) -> Column:
        items = F.array_join(F.transform(values, _quoted), ", ")
        return F.when(F.size(values) > 0, F.concat(F.lit(f"{key}: ["), items, F.lit("]")))

    def text(key: str, value: Column) -> Column:
        return F.concat(F.lit(f"{key}: "), _quoted(value))

    tags = F.concat(F.array(d["main"]), d["subs"], d["keywords"])
    known = d.isNotNull()
    chunking = F.concat(
        F.lit("chunking:\n  enabled: true\n  chunk_count: "),
        F.coalesce(c["chunk_count"].cast("string"), F.lit("undefined")),
        F.lit("\n  max_tokens: "),
        F.coalesce(c["max_tokens"].cast("string"), F.lit("undefined")),
    )
    title = F.regexp_replace(F.col("name"), r"\.[^/.]+$", "")
    lines = F.array(
        F.lit("---"),
        text("title", title),
        F.when(known, listed("tags", tags)),
        text("created", F.col("generated_at")),
        text("source", F.col("path")),
        text("model", F.col("model")),
        F.when(known, text("paper_direction", d["main"])),
        F.when(known, listed("sub_directions", d["subs"])),
        F.when(known, listed("keywords", d["keywords"])),
        F.when(c["enabled"], chunking),
        F.lit("---"),
    )
    linked = F.concat(F.lit("[["), F.col("name"), F.lit("]]"))
    return F.concat(
        F.array_join(F.array_compact(lines), "\n"), F.lit("\n"), _report_body(linked, with_max_tokens=True)
    )


def report_path(folder: str) -> Column:
    return join_path(F.lit(folder), output_name(F.col("name")))


def own_paths(names: DataFrame, folder: str) -> DataFrame:
    """``names(doc_id, name, path)`` with an ``output_path`` each.

    Where names of several sources give one path, each gets the start of its source path's
    SHA-256 behind the name, so none overwrites another and a later run finds the same paths.
    """
    wanted = names.withColumn("output_path", report_path(folder))
    shared = wanted.groupBy("output_path").agg(F.min(F.coalesce("path", F.lit(""))).alias("low"), F.max(F.coalesce("path", F.lit(""))).alias("high")).filter("low <> high")
    shared = materialise(shared.select("output_path", F.lit(True).alias("shared")), "shared-paths")
    own = F.regexp_replace("output_path", r"(\.[^.]*)$", "")
    ending = F.regexp_extract("output_path", r"(\.[^.]*)$", 1)
    apart = F.concat(own, F.lit("-"), F.substring(F.sha2(F.coalesce("path", F.lit("")), 256), 1, 12), ending)
    met = wanted.join(shared, "output_path", "left")
    return met.select(*names.columns, F.when(F.col("shared"), apart).otherwise(F.col("output_path")).alias("output_path"))


def batch_report(items: DataFrame, state: DataFrame, generated_at: str) -> DataFrame:
    """Sections ``(job_id, section_no, content)`` of the reports of jobs with more than one item.

    Section -1 is the head with the totals, then one section per item in item
    order. A job of any size stays spread over tasks: ``write_sections`` sorts
    by range instead of gathering a job.
    """
    made, *labels = fv.BATCH_FIELDS
    totals = ["total", "completed", "failed", "cancelled_count", "skipped_count"]
    batch = state.filter(F.col("mode") == "batch")
    head = F.concat_ws(
        "\n",
        F.lit(fv.BATCH_TITLE),
        F.lit(made + generated_at),
        *[_field(label, F.col(n).cast("string")) for label, n in zip(labels, totals)],
        F.lit(fv.BATCH_ITEMS_TITLE),
    )
    name, status, tries, path, code, message = fv.BATCH_ITEM_FIELDS

    def or_none(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(fv.REPORT_NONE))

    section = F.concat_ws(
        "\n",
        _field(name, F.col("name")),
        _field(status, status_label(F.col("status"), F.col("skipped"))),
        _field(tries, F.coalesce("attempts", F.lit(0)).cast("string")),
        _field(path, or_none("output_path")),
        _field(code, or_none("error_code")),
        _field(message, or_none("error_message")),
        F.lit(""),
    )
    sections = items.join(batch.select("job_id"), "job_id", "left_semi").select(
        "job_id", F.col("item_id").alias("section_no"), section.alias("content")
    )
    heads = batch.select("job_id", F.lit(-1).cast("bigint").alias("section_no"), head.alias("content"))
    return heads.unionByName(sections)


def write_sections(sections: DataFrame, folder: str) -> None:
    """Text files whose parts, read in order, are the reports in job and item order."""
    ordered = sections.repartitionByRange("job_id", "section_no").sortWithinPartitions("job_id", "section_no")
    ordered.select("content").write.text(folder)


def write_reports(reports: DataFrame, folder: str) -> None:
    """One file per report from ``(file_name, content)`` rows, written by the tasks.

    ``folder`` is a path that all executors reach. A file is written under a
    temporary name and then moved, so a repeated task leaves whole files only.
    For files that appear whole or not at all see ``report_sink``; for very many documents write the rows as a table.
    """
    uri = filesystem_uri(reports.sparkSession, folder)

    def write(rows: Iterator[Row]) -> None:
        from pyarrow import fs

        target, root = fs.FileSystem.from_uri(uri)
        target.create_dir(root, recursive=True)
        for row in rows:
            path = f"{root}/{row.file_name}"
            with target.open_output_stream(f"{path}.part") as out:
                out.write(row.content.encode("utf-8"))
            target.move(f"{path}.part", path)

    reports.select("file_name", "content").foreachPartition(write)
