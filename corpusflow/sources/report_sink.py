"""Report files with a commit: ``reports.write.format("corpusflow_reports").mode("append").save(folder)``.

Tasks write below ``folder/_staging/<run>/<attempt>``. When all tasks have ended, the driver
writes one manifest that names the attempts that count; from then on the run is done, and
``publish`` moves their files in tasks. A run that dies before its manifest leaves no report,
one that dies after it is finished by the next ``publish``. The driver sees attempts, never files.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from corpusflow.session import materialise

FORMAT = "corpusflow_reports"
#: An aborted run looks so often, with such pauses, for files that its tasks still write.
ABORT_LOOKS, ABORT_PAUSE_S = 50, 0.2
_STAGING, _MANIFESTS = "_staging", "_manifests"
#: Attempt folders are listed by one task each; a file of a report takes this name's place at once.
_ATTEMPT = T.StructType().add("run", T.StringType()).add("attempt", T.StringType())
#: Files that a task moves or reads, about, and bytes of their contents and files that it hands on at a time.
TASK_FILES, BATCH_BYTES, BATCH_FILES = 20_000, 4_000_000, 10_000


def filesystem_uri(spark: SparkSession, folder: str) -> str:
    """The folder as a URI of the cluster's own file system, in the spelling Arrow knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = str(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri())
    return re.sub("^file:/+", "file:///", re.sub("^s3[an]://", "s3://", uri))


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _listed(target, folder: str, kind: str) -> list[str]:
    """Names directly below a folder that may not be there; ``kind`` is File or Directory."""
    from pyarrow import fs

    found = target.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(i.base_name for i in found if i.type.name == kind)


@dataclass
class _Written(WriterCommitMessage):
    attempt: str
    files: int


class _ReportWriter(DataSourceWriter):
    """Stages the files of each attempt, and names the ones that count."""

    def __init__(self, uri: str, columns: list[str]):
        self.uri, self.run = uri, uuid.uuid4().hex
        self.name_at, self.content_at = columns.index("file_name"), columns.index("content")

    def write(self, iterator: Iterator[T.Row]) -> WriterCommitMessage:
        target, root = _open(self.uri)
        attempt = uuid.uuid4().hex
        folder = f"{root}/{_STAGING}/{self.run}/{attempt}"
        target.create_dir(folder, recursive=True)
        files = 0
        for row in iterator:
            name, content = row[self.name_at], row[self.content_at]
            if not name or "/" in name or name.startswith("_"):
                raise ValueError(f"not a report's file name: {name!r}")
            with target.open_output_stream(f"{folder}/{name}") as out:
                out.write((content or "").encode("utf-8"))
            files += 1
        return _Written(attempt, files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        target, root = _open(self.uri)
        target.create_dir(f"{root}/{_MANIFESTS}", recursive=True)
        kept = [{"attempt": m.attempt, "files": m.files} for m in messages if m is not None]
        manifest = f"{root}/{_MANIFESTS}/{self.run}.json"
        with target.open_output_stream(f"{manifest}.part") as out:
            out.write(json.dumps(kept).encode("utf-8"))
        target.move(f"{manifest}.part", manifest)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        target, root = _open(self.uri)
        staged = f"{root}/{_STAGING}/{self.run}"
        # tasks that are being ended may still add files: the folder must be found gone twice
        gone = 0
        for _ in range(ABORT_LOOKS):
            if self.run not in _listed(target, f"{root}/{_STAGING}", "Directory"):
                gone += 1
                if gone == 2:
                    return
            else:
                gone = 0
                try:
                    target.delete_dir(staged)
                except OSError:  # a file came in between
                    pass
            time.sleep(ABORT_PAUSE_S)


class ReportSink(DataSource):
    """Sink of ``(file_name, content)`` rows; ``save`` takes a URI, see ``filesystem_uri``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("reports are added or replaced one by one: use mode('append')")
        return _ReportWriter(self.options["path"].rstrip("/"), schema.names)


def apart(reports: DataFrame) -> DataFrame:
    """``reports(file_name, path, content)`` with file names that no two different reports share.

    Reports that share a name, case aside, get the start of a SHA-256 of source path and content behind it;
    other names stay. Rows that are equal in all three are one report. A null path or content counts as empty.
    """
    blank = [F.coalesce(c, F.lit("")) for c in ("path", "content")]
    rows = reports.select("file_name", *[b.alias(n) for b, n in zip(blank, ("path", "content"))])
    rows = rows.withColumn("digest", F.sha2(F.concat_ws("\0", "path", "content"), 256)).withColumn("name_key", F.lower("file_name"))
    own = F.concat_ws("\0", "file_name", "digest")
    per_name = rows.groupBy("name_key").agg(F.min(own).alias("low"), F.max(own).alias("high"), F.count("*").alias("n"))
    # a written table, so that a hot name can be split by adaptive execution
    shared = materialise(per_name.filter("n > 1").select("name_key", (F.col("low") < F.col("high")).alias("differ")), "shared-names")
    met = rows.join(shared, "name_key", "left")
    stem, ending = F.regexp_replace("file_name", r"(\.[^.]*)$", ""), F.regexp_extract("file_name", r"(\.[^.]*)$", 1)
    other = F.concat(stem, F.lit("-"), F.substring("digest", 1, 16), ending)
    single = met.filter("differ IS NULL").select("file_name", "path", "content")
    several = met.filter("differ IS NOT NULL").select(F.when(F.col("differ"), other).otherwise(F.col("file_name")).alias("file_name"), "path", "content", "digest")
    return single.unionByName(several.dropDuplicates(["file_name", "digest"]).drop("digest"))


def _dealt(files: DataFrame, *keys: str) -> DataFrame:
    """Rows of one file each, as many to a task as it should take."""
    least = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(max(least, -(-files.count() // TASK_FILES)), *keys)


def _published(spark: SparkSession, folder: str) -> tuple[list[DataFrame], int]:
    """Does what ``publish`` says; for each run that had files a written table of their ``file_name``, and the number of runs."""
    import pyarrow as pa

    uri = filesystem_uri(spark, folder)
    target, root = _open(uri)
    runs = [n.removesuffix(".json") for n in _listed(target, f"{root}/{_MANIFESTS}", "File") if n.endswith(".json")]
    # runs of one folder are published in the order of their manifests' times, the newest last
    times = {r: target.get_file_info(f"{root}/{_MANIFESTS}/{r}.json").mtime_ns or 0 for r in runs}

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, base = _open(uri)
        for batch in batches:
            for row in batch.to_pylist():
                found = _listed(there, f"{base}/{_STAGING}/{row['run']}/{row['attempt']}", "File")
                yield pa.RecordBatch.from_pydict({**{k: [v] * len(found) for k, v in row.items()}, "file_name": pa.array(found, pa.string())})

    def move(rows: Iterator[T.Row]) -> None:
        there, base = _open(uri)
        for row in rows:
            try:
                there.move(f"{base}/{_STAGING}/{row.run}/{row.attempt}/{row.file_name}", f"{base}/{row.file_name}")
            except FileNotFoundError:  # a second copy of this task was faster
                if there.get_file_info(f"{base}/{row.file_name}").type.name != "File":
                    raise

    done = []
    for run in sorted(runs, key=lambda r: (times[r], r)):
        with target.open_input_stream(f"{root}/{_MANIFESTS}/{run}.json") as body:
            attempts = [(run, m["attempt"]) for m in json.loads(body.read()) if m["files"]]
        if attempts:
            dealt = spark.createDataFrame(attempts, _ATTEMPT).repartition(len(attempts), "attempt")
            # written before the first file moves, so that a repeated task finds the same names
            staged = materialise(dealt.mapInArrow(names, "run string, attempt string, file_name string"), "report-names")
            _dealt(staged, "file_name").foreachPartition(move)
            done.append(staged.select("file_name"))
        if run in _listed(target, f"{root}/{_STAGING}", "Directory"):
            target.delete_dir(f"{root}/{_STAGING}/{run}")
        target.delete_file(f"{root}/{_MANIFESTS}/{run}.json")
    return done, len(runs)


def publish(spark: SparkSession, folder: str) -> int:
    """Move the staged files of all committed runs of a folder to their places; the number of runs.

    Safe to repeat, and to run again after it died: a file that is gone from its attempt was moved before.
    Afterwards nothing of those runs is left beside the reports, failed attempts included.
    """
    return _published(spark, folder)[1]


def save_reports(reports: DataFrame, folder: str) -> DataFrame:
    """Write ``(file_name, path, content)`` rows whole or not at all, one file per different report; the ``file_name`` of all files published.

    Names that reports share are told apart first (``apart``). A null name, one with a slash or one that begins
    with ``_`` fails the job, which leaves no file. No rows write nothing. For very many documents write a table instead.
    """
    spark = reports.sparkSession
    spark.dataSource.register(ReportSink)
    rows = apart(reports).select("file_name", "content")
    rows.write.format(FORMAT).mode("append").save(filesystem_uri(spark, folder))
    names = spark.createDataFrame([], "file_name string")
    for more in _published(spark, folder)[0]:
        names = names.unionByName(more)
    return names.distinct()


def file_batches(files: Iterator[tuple[str, bytes]], key: str) -> Iterator[pa.RecordBatch]:
    """Names and contents of files in batches of some megabytes, with the columns ``key`` and ``content``."""
    import pyarrow as pa

    def batch(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
        found, contents = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(contents, pa.binary())], [key, "content"])

    rows, held = [], 0
    for row in files:
        rows.append(row)
        held += len(row[1])
        if held > BATCH_BYTES or len(rows) == BATCH_FILES:
            yield batch(rows)
            rows, held = [], 0
    if rows:
        yield batch(rows)


def read_reports(names: DataFrame, folder: str) -> DataFrame:
    """``file_name`` and ``content`` (bytes) of the named files, opened by tasks. Neither the driver nor a task lists the folder."""
    uri = filesystem_uri(names.sparkSession, folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, base = _open(uri)

        def content(name: str) -> bytes:
            with there.open_input_stream(f"{base}/{name}", compression=None) as body:
                return body.read()

        yield from file_batches(((n, content(n)) for b in batches for n in b.column(0).to_pylist()), "file_name")

    return _dealt(names.select("file_name"), "file_name").mapInArrow(read, "file_name string, content binary")
