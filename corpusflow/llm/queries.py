"""Queries of the operators over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import (
    filter_audit,
    fingerprints,
    language,
    licences,
    oracles,
    packing,
    passages,
    piece_sampling,
    prefix_trie,
    quality,
    sharding,
    shingle_join,
    token_counts,
    url_rules,
)
from corpusflow.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


@_query("op1_piece_sampling")
def op1(spark, sf_dir):
    return piece_sampling.round_trips(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@_query("op2_license_scan", oracles.LICENCES)
def op2(spark, sf_dir):
    found = licences.scan(_documents(spark, sf_dir))
    top = F.array_max(F.transform("found", lambda b: F.struct(b["dice"].alias("dice"), (-b["block"]).alias("block"), b["license"].alias("license"))))
    return found.select(
        "doc_id",
        "n_blocks",
        F.size("found").cast("long").alias("n_found"),
        top["license"].alias("license"),
        F.round(top["dice"], 9).alias("dice"),
        (-top["block"]).cast("long").alias("block"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda b: b["license"]))), ",").alias("licenses"),
    )


@_query("op3_quality_rules", oracles.QUALITY)
def op3(spark, sf_dir):
    return quality.quality_rules(_documents(spark, sf_dir))


@_query("op4_fingerprints")
def op4(spark, sf_dir):
    return fingerprints.edited_likeness(_documents(spark, sf_dir))


@_query("op5_shingle_join", oracles.SHINGLE_JOIN)
def op5(spark, sf_dir):
    return shingle_join.link(_documents(spark, sf_dir))


@_query("op6_token_counts")
def op6(spark, sf_dir):
    counts = token_counts.token_counts(
        _documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), scratch_path(spark, "token-counts")
    )
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


@_query("op7_shards", oracles.SHARDS)
def op7(spark, sf_dir):
    sharded = sharding.shard_documents(_documents(spark, sf_dir), 24)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@_query("op8_passages", oracles.PASSAGES)
def op8(spark, sf_dir):
    cut = passages.dedup(_documents(spark, sf_dir))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@_query("op9_language")
def op9(spark, sf_dir):
    return language.identify(_documents(spark, sf_dir))


@_query("op10_packing")
def op10(spark, sf_dir):
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@_query("op11_filter_audit", oracles.FILTER_AUDIT)
def op11(spark, sf_dir):
    return filter_audit.audit(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


#: What is allowed and blocked whatever the labels say.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@_query("op12_url_filter", oracles.URL_FILTER)
def op12(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    labelled = url_rules.labelled_pages(pages, _table(spark, sf_dir, "labels"))
    return url_rules.judge(pages, labelled, URL_RULES).withColumn("confidence", F.round("confidence", 9))


@_query("op13_prefix_trie", oracles.PREFIX_TRIE)
def op13(spark, sf_dir):
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))
