"""Token counts through a cache of digests: only texts that no earlier run has counted are encoded."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import common
from corpusflow.llm.chunk_memo import ChunkEncoder
from corpusflow.session import materialise

CACHE_SCHEMA = "tokenizer binary, content binary, n_tokens long"


def as_it_is(text: Column) -> Column:
    """The normal form of a text whose tokens depend on every character; a null is empty."""
    return F.coalesce(text, F.lit(""))


def tokenizer_digest(path: str) -> bytes:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).digest()


def encode_counts(texts: DataFrame, path: str, keeps_space: bool) -> DataFrame:
    """``content`` and ``n_tokens`` of rows of ``content`` and ``text``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = common.per_worker((path, keeps_space), lambda: ChunkEncoder(path, keeps_space))
        for block in common.blocks(batches, "text"):
            _, lengths = encoder.encode(block.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([block.column("content"), pa.array(lengths)], ["content", "n_tokens"])

    return texts.select("content", "text").mapInArrow(encode, "content binary, n_tokens long")


def token_counts(
    documents: DataFrame,
    path: str,
    cache: str,
    keeps_space: bool = True,
    normal_form: Callable[[Column], Column] = as_it_is,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens`` per row, with the ids the library gives for the file at ``path``.

    ``cache`` is a Parquet folder that all executors reach; it is made if it isn't there, and one count per
    (tokenizer digest, content digest) is appended for every distinct text it lacks. Copies are
    encoded once: texts are reduced by digest before and after the shuffle, so a text that a third of
    all rows share moves once per task. Runs that append at the same time may store a count
    twice; readers take one. A null text counts as empty; every repeated row gets its count; no
    rows give no rows; other columns are not read.
    """
    spark = documents.sparkSession
    version = F.lit(bytearray(tokenizer_digest(path)))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)

    def known() -> DataFrame:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
        return stored.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    normal = normal_form(F.col(text))
    content = F.unhex(F.sha2(F.encode(normal, "UTF-8"), 256))
    distinct = documents.select(content.alias("content"), normal.alias("text")).groupBy("content").agg(F.first("text").alias("text"))
    misses = distinct.join(known().select("content"), "content", "left_anti")
    counted = encode_counts(misses, path, keeps_space)
    counted.select(version.alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache)
    rows = documents.select(F.col(key).alias(key), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), content.alias("content"))
    # one small row per text; written, so that a hot text is a skewed left side of two plain tables, which adaptive execution splits
    counts = materialise(known(), "token-counts")
    return rows.join(counts, "content").select(key, "n_bytes", "n_tokens")
