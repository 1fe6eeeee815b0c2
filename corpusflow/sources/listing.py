"""Folders with very many files, listed and read by tasks: the driver sees folders, and the files of a written table of names.

Names, order of levels and spelling of paths are those of Spark's file sources, which hold every file's status on the driver.
"""

from __future__ import annotations

import errno
import os
import re
import stat
import unicodedata
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.session import scratch_path
from corpusflow.sources.report_sink import file_batches, filesystem_uri

#: Names in a file of the written listing; a task reads the contents of one such file's names at least.
LISTED_FILES = 2_000
LISTED = "path string, name string, size long, modified timestamp, is_folder boolean"
_ARROW = pa.schema([("path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("is_folder", pa.bool_())])


def spelled(path: str) -> str:
    """A path as Java writes URIs, and so Spark its ``_metadata.file_path``."""
    start, rest = re.fullmatch(r"((?:[A-Za-z][\w+.-]*:)?(?://[^/]*)?)(.*)", path, re.DOTALL).groups()

    def kept(c: str) -> bool:
        return c in "/-_.!~*'();:@&=+$," or c.isalnum() if c < "\x80" else unicodedata.category(c) not in ("Zs", "Zl", "Zp", "Cc")

    return start + "".join(c if kept(c) else quote(c, safe="") for c in rest)


def _arrow_uri(path: str) -> str:
    return re.sub("^file:/+", "file:///", re.sub("^s3[an]://", "s3://", spelled(path)))


def _hidden(name: str, folder: bool) -> bool:
    """What Spark's file sources leave out."""
    if folder and name.startswith(("_common_metadata", "_metadata")):
        return False
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def _entries(path: str) -> Iterator[tuple[str, bool, int, int]]:
    """Name, whether it is a folder, size and time in milliseconds of all that is directly below a folder, one by one where the file system can."""
    uri = _arrow_uri(path)
    if uri.startswith("file:"):
        with os.scandir(unquote(urlsplit(uri).path)) as found:
            for entry in found:
                try:
                    entry.name.encode("utf-8")
                    status = entry.stat()
                except UnicodeEncodeError:  # no path that Spark could open
                    continue
                except OSError as error:
                    if error.errno not in (errno.ENOENT, errno.ELOOP):
                        raise
                    continue  # gone meanwhile, or a link to nothing or in a circle
                yield entry.name, stat.S_ISDIR(status.st_mode), status.st_size, status.st_mtime_ns // 1_000_000
        return
    from pyarrow import fs

    target, root = fs.FileSystem.from_uri(uri)
    for info in target.get_file_info(fs.FileSelector(root)):
        yield info.base_name, info.type == fs.FileType.Directory, info.size or 0, (info.mtime_ns or 0) // 1_000_000


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    for paths in batches:
        for path in paths.column(0).to_pylist():
            rows = []
            for name, folder, size, modified in _entries(path):
                if not _hidden(name, folder):
                    rows.append((f"{path.rstrip('/')}/{name}", name, size, modified * 1000, folder))
                if len(rows) == LISTED_FILES:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)


def tasks_can_list(spark: SparkSession, folder: str) -> bool:
    """Whether Arrow knows the folder's file system; others are left to Spark's file sources."""
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(filesystem_uri(spark, folder))
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def listed_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """A written table of ``LISTED`` with all files below a folder (or a file, or a pattern of these), of those without bytes too.

    Each level of folders is listed by tasks, a folder by one task; ``recursive`` goes below the first.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    roots = list(system.globStatus(system.makeQualified(hadoop.Path(folder))) or ())
    if not roots:
        spark.read.format("binaryFile").load(folder)  # says in Spark's words what is missing
    own = [(r.getPath().toString(), r.getPath().getName(), r.getLen(), r.getModificationTime(), r.isDirectory()) for r in roots]
    tops = spark.createDataFrame(own, "path string, name string, size long, modified long, is_folder boolean").withColumn("modified", F.timestamp_millis("modified"))
    written = []
    if not all(r[-1] for r in own):
        written.append(scratch_path(spark, "listing"))
        tops.where("NOT is_folder").write.parquet(written[-1])
    folders, n = tops.where("is_folder"), sum(r[-1] for r in own)
    while n:
        written.append(scratch_path(spark, "listing"))
        spread = folders.select("path").repartition(min(n, 4 * spark.sparkContext.defaultParallelism), "path")
        spread.mapInArrow(_walk, LISTED).write.option("maxRecordsPerFile", LISTED_FILES).parquet(written[-1])
        folders = spark.read.schema(LISTED).parquet(written[-1]).where("is_folder")
        n = folders.count() if recursive else 0
    return spark.read.schema(LISTED).parquet(*written).where("NOT is_folder")


def is_text_file() -> Column:
    return F.col("name").rlike(r"(?i)\.(txt|md)\z")


def with_contents(files: DataFrame) -> DataFrame:
    """``path`` (as Spark's ``_metadata.file_path``) and ``content`` (bytes) of files by ``path``, opened by tasks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        stores: dict[tuple[str, str], fs.FileSystem] = {}

        def content(path: str) -> bytes:
            parts = urlsplit(_arrow_uri(path))
            inside = unquote(parts.path)
            if parts.scheme == "file":
                with open(inside, "rb") as body:
                    return body.read()
            store = parts[:2]
            if store not in stores:
                stores[store] = fs.FileSystem.from_uri(parts.geturl())[0]
            with stores[store].open_input_stream(inside if parts.scheme != "s3" else parts.netloc + inside, compression=None) as body:
                return body.read()

        paths = (p for b in batches for p in b.column(0).to_pylist())
        yield from file_batches(((spelled(p), content(p)) for p in paths), "path")

    return files.select("path").mapInArrow(read, "path string, content binary")
