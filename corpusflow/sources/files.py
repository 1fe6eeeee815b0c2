"""Document files: scan, whole-text reading, routing by kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow import fixed_values as fv
from corpusflow.functions.keys import base_name, file_kind, normalize_slashes
from corpusflow.functions.text import is_blank
from corpusflow.sources import listing


def scan_documents(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Files of the known kinds in path order: ``(id, path, name, ext, size, modified)``.

    Only file metadata is selected, so no content is read. Tasks list the folder; only on a file system that Arrow doesn't
    know the driver does, with all its files in memory.
    """
    if listing.tasks_can_list(spark, folder):
        listed = listing.listed_files(spark, folder, recursive).where("size > 0").withColumnsRenamed({"size": "length", "modified": "modificationTime"})
    else:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    path = normalize_slashes(F.col("path"))
    files = listed.select(
        F.sha2(path, 256).alias("id"),
        path.alias("path"),
        base_name(path).alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    ).withColumn("ext", file_kind(F.col("name")))
    return files.filter(F.col("ext").isNotNull()).orderBy(F.collate("path", "zh"))


def text_rows(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Whole text and Markdown files ``(id, path, name, kind, text, error)``, read once.

    A blank file has a null text and the error ``EMPTY_CONTENT``. Files of no bytes give no row, as in Spark's file sources,
    here and in ``scan_documents``; who lists the folder is said there.
    """
    if listing.tasks_can_list(spark, folder):
        named = listing.listed_files(spark, folder, recursive).where(listing.is_text_file() & (F.col("size") > 0))
        raw = listing.with_contents(named).select(F.col("content").cast("string").alias("text"), "path")
    else:
        raw = (
            spark.read.option("recursiveFileLookup", recursive)
            .option("pathGlobFilter", "*.{[tT][xX][tT],[mM][dD]}")
            .text(folder, wholetext=True)
            .select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
        )
    name, blank = base_name(F.col("path")), is_blank(F.col("text"))
    return raw.select(
        F.sha2("path", 256).alias("id"),
        "path",
        name.alias("name"),
        file_kind(name).alias("kind"),
        F.when(~blank, F.col("text")).alias("text"),
        F.when(blank, F.lit("EMPTY_CONTENT")).alias("error"),
    )


def read_text_documents(spark: SparkSession, folder: str, recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """Whole text and Markdown files as documents, and blank ones as quarantine rows.

    Each of the two reads the files; ``text_rows`` has both in one pass.
    """
    rows = text_rows(spark, folder, recursive)
    return rows.filter("error IS NULL").drop("error"), rows.filter("error IS NOT NULL").select("id", "path", "error")


def route_by_kind(files: DataFrame, custom: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Name the parser of each file; unknown kinds get ``UNSUPPORTED_TYPE``.

    ``custom`` adds parsers by extension, tried before the built-in kinds.
    """
    kind = file_kind(F.col("name"))
    for ext in custom or {}:
        kind = F.when(F.lower("name").endswith(f".{ext.lower()}"), F.lit(ext)).otherwise(kind)
    return files.withColumn("kind", kind).withColumn(
        "error", F.when(F.col("kind").isNull(), F.lit("UNSUPPORTED_TYPE"))
    )


def files_by_kind(files: DataFrame) -> DataFrame:
    return files.groupBy("kind").agg(F.count("*").alias("files"))


def parse_by_kind(files: DataFrame, parsers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Run each kind's parser on its files and put the documents together."""
    parts = [parse(files.filter(F.col("kind") == kind)) for kind, parse in parsers.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def parse_in_row(files: DataFrame, parsers: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``files(name, content, ...)`` with ``kind``, ``text`` and ``error``, each row parsed by its kind's column function.

    One pass, whatever the number of kinds; extensions beyond the built-in kinds are custom ones. A kind without a
    parser is ``UNSUPPORTED_TYPE``, a parsed text that is null or blank is ``EMPTY_CONTENT``; both have a null text.
    """
    routed = route_by_kind(files, {k: p for k, p in parsers.items() if k not in fv.FILE_KINDS}).drop("error")
    text = F.lit(None).cast("string")
    for kind, parse in parsers.items():
        text = F.when(F.col("kind") == kind, parse(F.col("content"))).otherwise(text)
    known = F.coalesce(F.col("kind").isin(list(parsers)), F.lit(False))
    blank = F.coalesce(is_blank(F.col("text")), F.lit(True))
    error = F.when(~known, F.lit("UNSUPPORTED_TYPE")).when(blank, F.lit("EMPTY_CONTENT"))
    parsed = routed.withColumn("text", text).withColumn("error", error)
    return parsed.withColumn("text", F.when(F.col("error").isNull(), F.col("text")))
