"""Filter interaction audit over a sparse document-term matrix.

Texts are cut into blocks, and every block becomes a shard of the matrix in compressed sparse rows: first with codes of
its own, then, once all words have numbers in one global dictionary, with those. Words travel packed, one string per
shard and bucket of word hashes. Row sums are a text's words and nonzero counts its distinct words, which decides the first
two filters; the other flags ride along with the rows. What the five filters do to a document is then one of 32 sets, so all
orders of filters follow from the counts of those sets.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import common
from corpusflow.session import materialise

FILTERS = "ABCDE"
#: A: a text needs so many words.
MIN_WORDS = 200
#: B: so many of 100 words must be different ones.
MIN_DISTINCT_PERCENT = 50
#: C: so many of 100 characters may be capitals A to Z.
MAX_UPPER_PERCENT = 3
#: D: a text may hold none of these.
SYMBOLS = "#$%&*|"
#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD_BYTES = 4_000_000
#: The vocabulary is estimated from one in so many word hashes, and a bucket has so many words, about.
SKETCH_SHARE, BUCKET_WORDS = 1024, 500_000

A, B, C, D, E = (1 << k for k in range(5))
_ROW = "array<struct<key:long,part:string,digest:binary,mask:int>>"
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
#: All bytes but those that continue a character.
_FIRST = np.ones(256, bool)
_FIRST[128:192] = False


def _per_text(marked: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are marked."""
    upto = np.concatenate([[0], np.cumsum(marked)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def _bytes(values: np.ndarray, kind: type) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def _ints(column: pa.Array, k: int, kind: type) -> np.ndarray:
    return np.frombuffer(column[k].as_buffer(), kind)


def _hash(word: bytes | str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def local_shards(documents: DataFrame, key: str, part: str, text: str) -> DataFrame:
    """A written row per block of texts: ``shard``, its ``rows`` (key, part, digest of the text, failed filters C and D), its own
    ``words`` in the order of their hashes with a blank between two, ``starts``, ``codes``, ``counts`` (int32) of its sparse rows, codes
    being places in ``words``, and a ``sketch``: the hashes of its words below 1 / SKETCH_SHARE of their range."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for block in common.blocks(batches, "text", SHARD_BYTES):
            data, offsets = common.text_bytes(block.column("text"))
            begins, ends, of = common.words(data, offsets)
            coded = common.dictionary(data, begins, ends)
            hashes = np.array([_hash(w) for w in coded.dictionary.to_pylist()], np.uint64)
            order = np.argsort(hashes, kind="stable")
            code = np.empty(len(order), np.int64)
            code[order] = np.arange(len(order))
            size = max(1, len(order))
            cells, counts = np.unique(of * size + code[coded.indices.to_numpy(zero_copy_only=False)], return_counts=True)
            starts = np.searchsorted(cells, np.arange(block.num_rows + 1) * size)
            words = b" ".join(coded.dictionary.take(pa.array(order)).to_pylist()).decode()
            whole = data.tobytes()
            digests = [hashlib.sha256(whole[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            mask = np.where(100 * _per_text(_UPPER[data], offsets) > MAX_UPPER_PERCENT * _per_text(_FIRST[data], offsets), C, 0)
            mask |= np.where(_per_text(_SYMBOL[data], offsets) > 0, D, 0)
            rows = pa.StructArray.from_arrays(
                [block.column("key"), block.column("part"), pa.array(digests, pa.binary()), pa.array(mask, pa.int32())], ["key", "part", "digest", "mask"]
            )
            rows = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            own = [pa.array([_bytes(x, np.int32)], pa.binary()) for x in (starts, cells % size, counts)]
            sketch = hashes[hashes < np.uint64(2**64 // SKETCH_SHARE)].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard]), rows, pa.array([words]), *own, pa.array([sketch.tolist()], pa.list_(pa.int64()))],
                ["shard", "rows", "words", "starts", "codes", "counts", "sketch"],
            )
            shard += 1

    plain = documents.select(
        F.col(key).cast("long").alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text")
    )
    shards = plain.mapInArrow(work, f"shard long, rows {_ROW}, words string, starts binary, codes binary, counts binary, sketch array<long>")
    # the numbers of shards hold for what is written, a task that runs again may not cut the same blocks
    return materialise(shards, "local-shards")


def encoded_words(shards: DataFrame) -> DataFrame:
    """The words of all shards numbered by one dictionary, written: per ``shard`` and bucket of hashes ``place``, the code of its first word
    there, ``terms`` (int64) of its words from there on, and ``fresh``, the words that got their numbers here, ``term`` being the first.

    Words of a bucket are numbered in steps of the number of buckets, so all numbers differ and are nearly gapless. The buckets follow from
    the size of the vocabulary, so a task holds BUCKET_WORDS words or so, however many shards a word is in.
    """
    share = shards.select(F.explode("sketch").alias("h")).distinct().count()
    tasks = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(tasks, share * SKETCH_SHARE // BUCKET_WORDS + 1)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, text in zip(batch.column("shard").to_pylist(), batch.column("words").to_pylist()):
                words = text.split(" ") if text else []
                out, at = [], 0
                while at < len(words):
                    bucket = _hash(words[at]) * buckets >> 64
                    upto = bisect_right(words, bucket, at, key=lambda w: _hash(w) * buckets >> 64)
                    out.append((bucket, at, " ".join(words[at:upto])))
                    at = upto
                columns = [pa.array([o[0] for o in out], pa.int64()), pa.array([shard] * len(out), pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "shard", "place", "words"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, known = None, {}
        for batch in batches:
            terms, fresh, first = [], [], []
            for of, text in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist()):
                if of != bucket:
                    bucket, known = of, {}
                words, before = text.split(" "), len(known)
                numbers = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
                terms.append(_bytes(numbers * buckets + bucket, np.int64))
                # those of a shard are distinct, so new ones come in the order of their numbers
                fresh.append(" ".join(w for w, k in zip(words, numbers.tolist()) if k >= before))
                first.append(before * buckets + bucket)
            columns = [batch.column("shard"), batch.column("place"), pa.array(terms, pa.binary()), pa.array(fresh, pa.string()), pa.array(first, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([buckets] * batch.num_rows, pa.int64())], ["shard", "place", "terms", "fresh", "term", "step"])

    packed = shards.select("shard", "words").mapInArrow(split, "bucket long, shard long, place int, words string")
    # in this order a task that runs again gives the same numbers
    dealt = packed.repartition(tasks, "bucket").sortWithinPartitions("bucket", "shard")
    return materialise(dealt.mapInArrow(number, "shard long, place int, terms binary, fresh string, term long, step long"), "encoded-words")


def dictionary(encoded: DataFrame) -> DataFrame:
    """``word`` and ``term`` of all words, each once."""
    fresh = encoded.where("fresh <> ''").select("term", "step", F.posexplode(F.split("fresh", " ")).alias("nth", "word"))
    return fresh.select("word", (F.col("term") + F.col("nth") * F.col("step")).alias("term"))


def _with_terms(shards: DataFrame, encoded: DataFrame) -> DataFrame:
    """The shards with ``own``, the terms of their words in pieces."""
    # a shard's words are bounded by its bytes, so is what is gathered for it
    own = encoded.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("place", "terms")))["terms"].alias("own"))
    return shards.drop("words", "sketch").join(own, "shard", "left")


def _sparse(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, terms and counts of a shard's sparse rows."""
    own = [np.frombuffer(x, np.int64) for x in batch.column("own")[k].as_py() or ()]
    term = np.concatenate(own) if own else np.zeros(0, np.int64)
    starts, codes, counts = (_ints(batch.column(c), k, np.int32) for c in ("starts", "codes", "counts"))
    return starts, term[codes], counts


def matrix(shards: DataFrame, encoded: DataFrame) -> DataFrame:
    """The shards in compressed sparse rows over the global dictionary: shard, rows, starts (int32), terms (int64), counts (int32).

    Row k has the cells from ``starts[k]`` to ``starts[k + 1]``; number arrays are little-endian binaries.
    """

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [_sparse(batch, k) for k in range(batch.num_rows)]
            arrays = [pa.array([_bytes(c[i], kind) for c in cells], pa.binary()) for i, kind in enumerate((np.int32, np.int64, np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("rows"), *arrays], ["shard", "rows", "starts", "terms", "counts"])

    return _with_terms(shards, encoded).mapInArrow(renamed, f"shard long, rows {_ROW}, starts binary, terms binary, counts binary")


def failures(shards: DataFrame, encoded: DataFrame) -> DataFrame:
    """Per row of the matrix: key, part, digest and ``mask``, the filters A to D that its text fails."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                starts, terms, counts = _sparse(batch, k)
                upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                words = upto[starts[1:]] - upto[starts[:-1]]
                filled = np.concatenate([[0], np.cumsum(terms >= 0)])
                distinct = filled[starts[1:]] - filled[starts[:-1]]
                rows = batch.column("rows").slice(k, 1).flatten()
                mask = rows.field("mask").to_numpy(zero_copy_only=False)
                mask = mask | np.where(words < MIN_WORDS, A, 0) | np.where(100 * distinct < MIN_DISTINCT_PERCENT * words, B, 0)
                columns = [rows.field("key"), rows.field("part"), rows.field("digest"), pa.array(mask, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "part", "digest", "mask"])
            common.release()

    return _with_terms(shards, encoded).mapInArrow(work, "key long, part string, digest binary, mask int")


def outcomes(documents: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "lang", text: str = "text") -> DataFrame:
    """``part``, ``mask`` (the filters that fail), and of its documents ``n``, ``n_good`` and ``n_toxic``; see ``audit``."""
    shards = local_shards(documents, key, part, text)
    rows = failures(shards, encoded_words(shards))
    # texts that several keys share, once each; written, so that a text of very many rows can be split in the join
    texts = shards.select(F.explode("rows").alias("r")).select("r.key", "r.digest").where("key IS NOT NULL")
    copied = texts.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("digest", "first")
    copied = materialise(copied, "copied-texts")
    again = F.coalesce(F.col("first") < F.col("key"), F.lit(False))
    judged = rows.join(copied, "digest", "left").select("key", "part", F.col("mask").bitwiseOR(F.when(again, E).otherwise(0)).alias("mask"))
    # a key that many rows share is a row per outcome before it meets its label
    judged = judged.groupBy("key", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col(key).cast("long").alias("key")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marked = judged.join(marks, "key", "left")
    return marked.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(f"n_{c}") for c in ("good", "toxic")]
    )


def audit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "lang", text: str = "text") -> DataFrame:
    """What each of the filters A to E does at each step of each of their 120 orders, per part.

    Columns: part, filter_order, step (1 to 5), and of the part's documents kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley (what the step's filter removes, summed over all orders).

    A null text counts as empty, a null part as the empty string. Rows without a key are copies of nothing and have no label;
    rows that share key and text aren't copies of each other, each row counts. A document is good or toxic if any
    of its labels says so. A part without rows is not there, so no rows give no rows. Other columns are not read.
    """
    cells = outcomes(documents, labels, key, part, text).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("cells"))
    orders = ",".join("".join(p) for p in permutations(FILTERS))
    steps = cells.select("part", "cells", F.explode(F.split(F.lit(orders), ",")).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = f"shiftleft(1, instr('{FILTERS}', substring(filter_order, {{}}, 1)) - 1)"
    earlier = f"aggregate(sequence(1, {len(FILTERS)}), 0, (b, k) -> b + if(k < step, {bit.format('k')}, 0))"
    steps = steps.select("*", F.expr(bit.format("step")).alias("own"), F.expr(earlier).alias("before"))

    def total(condition: str, of: str = "c.n", alias: str = ""):
        return F.expr(f"aggregate(cells, 0L, (s, c) -> s + if({condition}, {of}, 0L))").alias(alias)

    fails, removed = "c.mask & own <> 0", "c.mask & own <> 0 AND c.mask & before = 0"
    return steps.select(
        "part", "filter_order", "step",
        total("c.mask & (before | own) = 0", alias="kept"),
        total(removed, alias="removed"),
        total(f"{fails} AND c.mask & before <> 0", alias="redundant"),
        total("c.mask = own", alias="unique_fails"),
        total(removed, "c.n_good", "good_lost"),
        total(removed, "c.n_toxic", "toxic_lost"),
        # a document that fails m filters is removed by each of them in 120 / m of the orders
        total(fails, "c.n * (120 div bit_count(c.mask))", "shapley"),
    )
