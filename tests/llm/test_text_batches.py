"""Batches of text steps: their Arrow size, the order of suffix array texts, the memo of the encoder."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusflow.llm import chunk_memo, passages
from corpusflow.llm.chunk_memo import ChunkEncoder
from corpusflow.session import materialise

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def _sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})


@pytest.mark.parametrize("before", [None, "32m"])
def test_a_written_step_bounds_its_arrow_batches(spark, before):
    if before is not None:
        spark.conf.set(KEY, before)
    try:
        own = spark.conf.get(KEY, None)
        rows = spark.range(0, 500, 1, 1).select(F.expr("repeat(cast(id as string), 1000)").alias("text"))
        sizes = [r.n for r in materialise(rows.mapInArrow(_sizes, "n long"), "sizes", "100k").collect()]
        assert len(sizes) > 5 and max(sizes) < 200_000
        assert spark.conf.get(KEY, None) == own
        assert len(materialise(rows.mapInArrow(_sizes, "n long"), "sizes").collect()) == 1
    finally:
        spark.conf.unset(KEY)


def test_anchors_of_like_many_strings_come_together(spark):
    strings = [(a * 7919 % 1000, k, a % 5 + 1) for a in range(60) for k in range(a % 5 + 1)]
    table = spark.createDataFrame(strings, "anchor long, digest long, n long").repartition(7)
    rows = passages.by_anchor(table, 3).withColumn("part", F.spark_partition_id()).collect()
    assert len(rows) == len(strings)
    for part in {r.part for r in rows}:
        own = [(r.n, r.anchor) for r in rows if r.part == part]
        assert own == sorted(own)
    assert all(len({r.part for r in rows if r.anchor == a}) == 1 for a in {s[0] for s in strings})


@pytest.mark.parametrize("crowd", [128, 1])
def test_rows_that_come_twice_are_cut_like_single_ones(spark, monkeypatch, crowd):
    monkeypatch.setattr(passages, "MAX_STRINGS", crowd)
    shared = "".join(chr(97 + k * k % 23) for k in range(70))
    rows = [(k, f"{'xyz'[k % 3] * 30}{k} {shared[k % 3:]} {k}{'uvw'[k % 2] * 40}") for k in range(9)]
    once, twice = (passages.dedup(spark.createDataFrame(r, "doc_id long, text string").repartition(3)).collect() for r in (rows, rows * 2))
    assert sum(r.n_removed > 0 for r in once) > 5
    assert sorted(map(str, twice)) == sorted(map(str, once * 2))


@pytest.mark.parametrize("name, keeps", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
@pytest.mark.parametrize("limit", [5, 40, 100_000])
def test_a_memo_that_drops_chunks_gives_the_ids_of_the_library(monkeypatch, name, keeps, limit):
    monkeypatch.setattr(chunk_memo, "MEMO_CHUNKS", limit)
    encoder, library = ChunkEncoder(public_tokenizers.path(name), keeps), Tokenizer.from_file(public_tokenizers.path(name))
    common = "The naïve Straße, çá va? %%% don't"
    for k in range(40):
        texts = [common, f"word{k} Größe{k}### ключ&&& x{k}y*** it's {k * 37}!", "", f"{common} \t l'été{k % 7}... \"a\" b'c é' É&"]
        texts += ["\x85 a", "b c <|endoftext|>", "a　b", "éx", f"A{'b' * k}-- 日本{k}。"]
        ids, lengths = encoder.encode(texts)
        expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [list(x) for x in np.split(ids, np.cumsum(lengths)[:-1])] == expected


def test_the_memo_keeps_what_comes_again(monkeypatch):
    monkeypatch.setattr(chunk_memo, "MEMO_CHUNKS", 60)
    encoder = ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"), False)
    again, learned, learn = "one two three four five", [], encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda chunks: (learned.extend(chunks), learn(chunks)))
    for k in range(30):
        encoder.encode([again + " " + " ".join("x" * (20 * k + j + 1) for j in range(20))])
        assert len(encoder.memo) <= 60
    assert all(learned.count(w) == 1 for w in again.split())


def test_words_before_marks_skip_the_library(monkeypatch):
    encoder = ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"), False)
    asked, library = [], encoder._library
    monkeypatch.setattr(encoder, "_library", lambda texts: (asked.extend(texts), library(texts))[1])
    encoder.encode(["inthe&&& anores%%% émentions*** plain don't"])
    assert asked == ["don't"]
