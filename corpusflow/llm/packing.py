"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens, its documents one behind the other. A round serves each queue in
turn; a queue's quantum is its share of the mixture times the window, and what rounding leaves is
carried as a deficit into the next round. With fixed quanta the deficits have a closed form: after r of
R rounds a queue with T tokens has given floor(r * T / R). So every task knows the deficits at any
window without walking through those before it, and windows are filled by all tasks at once.
With a target mixture a queue that has run out leaves its share to the others; the rounds then stand at
the times at which one more window is full.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm import common
from corpusflow.llm.chunk_memo import ChunkEncoder
from corpusflow.session import materialise

#: The largest sources are counted round by round inside each task; the deficits of the others come from a table of rounds and sources.
DENSE_QUEUES = 1024
#: Bytes of text that are encoded at a time: the masks, cuts and ids of a block are many times its size.
BLOCK_BYTES = 1_000_000
#: Numbers in a block of rounds and queues that a task works on at a time.
BLOCK_NUMBERS = 1 << 20
#: Up to so many (partition, source) pairs are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def _encoded(documents: DataFrame, path: str, end_id: int, key: str, text: str, source: str) -> DataFrame:
    """One row per document: its ids, and where it stands in this partition's part of its queue."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = common.per_worker((path, False), lambda: ChunkEncoder(path, False))
        part = TaskContext.get().partitionId()
        done: dict[str, int] = {}
        for block in common.blocks(batches, "text", BLOCK_BYTES):
            texts = ["" if t is None else t for t in block.column("text").to_pylist()]
            ids, lengths = encoder.encode(texts)
            ends = np.cumsum(lengths)
            packed = np.full(len(ids) + len(texts), end_id, np.uint32)
            own = np.ones(len(packed), bool)
            own[ends + np.arange(len(texts))] = False
            packed[own] = ids
            names = block.column("source").to_pylist()
            before = np.zeros(len(texts), np.int64)
            for k, name in enumerate(names):
                before[k] = done.get(name, 0)
                done[name] = int(before[k]) + int(lengths[k]) + 1
            offsets = np.concatenate([[0], (ends + np.arange(1, len(texts) + 1)) * 4])
            data = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("source"), data.cast(pa.binary()), pa.array(lengths + 1), pa.array(before), pa.array(np.full(len(texts), part))],
                ["doc_id", "source", "ids", "n", "before", "part"],
            )

    plain = documents.select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")
    )
    return plain.mapInArrow(encode, "doc_id long, source string, ids binary, n long, before long, part long")


class Schedule:
    """How many tokens a queue of ``total`` tokens has given before a round."""

    def __init__(self, window: int, everything: int, totals: Mapping[str, int] | None = None, mixture: Mapping[str, float] | None = None):
        self.everything, self.window = everything, window
        self.rounds = max(1, -(-everything // window))
        self.exact = everything * (self.rounds + 1) < 2**62
        self.weights = None
        if mixture is not None:
            self.weights = {s: float(mixture[s]) for s in totals}
            sources = sorted(totals, key=lambda s: totals[s] / self.weights[s])
            ends = np.array([totals[s] / self.weights[s] for s in sources])
            weights = np.array([self.weights[s] for s in sources])
            left = np.cumsum(weights[::-1])[::-1]  # of the queues that aren't empty before the k-th end
            self.times = np.concatenate([[0.0], ends])
            self.given = np.concatenate([[0.0], np.cumsum(np.diff(self.times) * left)])
            self.left = np.append(left, 1.0)

    def _time(self, r: np.ndarray) -> np.ndarray:
        tokens = np.asarray(r, float) * self.window
        k = np.clip(np.searchsorted(self.given, tokens, side="right") - 1, 0, len(self.left) - 2)
        return np.minimum(self.times[k] + np.maximum(tokens - self.given[k], 0.0) / self.left[k], self.times[k + 1])

    def served(self, r: np.ndarray, totals: np.ndarray, weights: np.ndarray | None) -> np.ndarray:
        """Tokens that each queue (column) has given before round r (row)."""
        r = np.asarray(r)[:, None]
        if self.weights is None:
            kind = np.int64 if self.exact else object
            return ((r.astype(kind) * np.asarray(totals, kind)[None, :]) // self.rounds).astype(np.int64)
        got = np.minimum(np.floor(self._time(r) * weights[None, :]), 2.0**62).astype(np.int64)
        return np.where(r >= self.rounds, totals[None, :], np.minimum(got, totals[None, :]))

    def of_queue(self, source: str) -> float:
        return 0.0 if self.weights is None else self.weights[source]

    def places(self, start: int, length: int, total: int, weight: float) -> tuple[int, int]:
        """The first and the last round that serve the tokens ``start`` to ``start + length``."""
        if self.weights is None:
            return ((start + 1) * self.rounds - 1) // total, ((start + length) * self.rounds - 1) // total

        def before(r: int) -> int:
            return int(self.served(np.array([r]), np.array([total]), np.array([weight]))[0, 0])

        rounds = range(self.rounds + 1)
        return bisect.bisect_right(rounds, start, key=before) - 1, bisect.bisect_left(rounds, start + length, key=before) - 1


def _cut(low: np.ndarray, high: np.ndarray, place: np.ndarray, start: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of a document that stands at ``start`` of its queue; one that crosses edges of windows is cut there."""
    some = high > low
    low, high, place = low[some], high[some], place[some]
    times = (place + (high - low) - 1) // window - place // window + 1
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    row = np.repeat(np.arange(len(low)), times)
    begin = np.maximum(place[row], (place[row] // window + nth) * window)
    stop = np.minimum(place[row] + (high - low)[row], (place[row] // window + nth + 1) * window)
    return low[row] + begin - place[row] - start, stop - begin, begin


def _pieces(schedule: Schedule, totals: list[int], weights: list[float], tail: np.ndarray):
    """A function that gives the pieces of one document of a dense queue: (start, length, place in the whole stream)."""
    sums, parts = np.array(totals, np.int64), np.array(weights)
    step = max(1, BLOCK_NUMBERS // max(1, len(totals)))

    def of(queue: int, start: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, last = schedule.places(start, length, totals[queue], weights[queue])
        found = []
        for a in range(first, last + 1, step):
            r = np.arange(a, min(a + step, last + 1) + 1)
            both = schedule.served(r, sums, parts)
            given, after = both[:-1], both[1:]
            low = np.maximum(given[:, queue], start)
            high = np.minimum(after[:, queue], start + length)
            place = given[:, queue:].sum(axis=1) + after[:, :queue].sum(axis=1) + (low - given[:, queue])
            place += tail[r[:-1]] if len(tail) else 0
            found.append(_cut(low, high, place, start, schedule.window))
        return tuple(np.concatenate(x) for x in zip(*found))

    return of


def _rows(block: pa.RecordBatch, found: list, window: int) -> pa.RecordBatch:
    """The pieces of the documents of ``block`` as rows."""
    out: dict[str, list] = {c: [] for c in ("row", "start", "length", "crc", "place")}
    for k, (ids, (start, length, place)) in enumerate(zip(block.column("ids").to_pylist(), found)):
        view = memoryview(ids)
        out["row"].append(np.full(len(start), k))
        out["start"].append(start)
        out["length"].append(length)
        out["place"].append(place)
        out["crc"].extend(zlib.crc32(view[4 * a : 4 * (a + b)]) for a, b in zip(start.tolist(), length.tolist()))
    row, place = np.concatenate(out["row"]), np.concatenate(out["place"])
    at = pa.array(row)
    columns = [
        block.column("doc_id").take(at), pa.array(np.concatenate(out["start"])), pa.array(np.concatenate(out["length"])),
        pa.array(out["crc"], pa.int64()), block.column("n").take(at), pa.array(place // window), pa.array(place % window),
        block.column("source").take(at),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])


def _turns(tail: DataFrame, schedule: Schedule) -> DataFrame:
    """One row per round and source of ``tail(source, total)`` in which the source gives tokens."""

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, total in zip(batch.column("source").to_pylist(), batch.column("total").to_pylist()):
                weight = schedule.of_queue(source)
                for a in range(0, schedule.rounds, 65_536):
                    r = np.arange(a, min(a + 65_536, schedule.rounds) + 1)
                    given = schedule.served(r, np.array([total]), np.array([weight]))[:, 0]
                    some = np.flatnonzero(np.diff(given))
                    columns = [pa.array([source] * len(some), pa.string()), pa.array(r[some]), pa.array(given[some]), pa.array(np.diff(given)[some])]
                    yield pa.RecordBatch.from_arrays(columns, ["source", "round", "given", "tokens"])

    return tail.mapInArrow(turns, "source string, round long, given long, tokens long")


def pack(
    documents: DataFrame,
    path: str,
    window: int = 4096,
    end_id: int = 2,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    mixture: Mapping[str, float] | None = None,
) -> DataFrame:
    """One row per piece: where it lies in its document, and in which sequence at which offset.

    All documents are packed; their ids are the library's, followed by ``end_id``. ``mixture`` gives each source's
    weight, above zero for every source that has documents; by default it is each source's share of all
    tokens. A window misses the mixture of the sources that aren't empty by no more tokens than there are queues, and all
    sequences but the last are full. Documents stand in their queue in scan order: by partition, then row. Ids are
    written once beside the partition they came from, so that a lost task can't change the order.

    Every source has its own queue. A task counts the ``DENSE_QUEUES`` largest in bounded blocks of rounds. The turns of
    the others, one row per round and source, get their place in the round from a window; they meet the documents of
    their source, which are below 1 / ``DENSE_QUEUES`` of all tokens and the only ids that are shuffled. Then tasks also hold
    8 bytes per sequence.

    A null text is empty and packs its ``end_id``; a null source is the source ""; a null key stays
    null; repeated rows are packed each on its own; no rows give no rows; other columns are not read.
    """
    spark = documents.sparkSession
    stored = materialise(_encoded(documents, path, end_id, key, text, source), "packing", common.BATCH_BYTES)
    by_source = stored.groupBy("source").agg(F.sum("n").alias("total"))
    by_source = materialise(by_source, "packing-sources")
    largest = [(r.source, r.total) for r in by_source.orderBy(F.desc("total"), "source").limit(DENSE_QUEUES).collect()]
    counted = by_source.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.count("*").alias("n")).first()
    every = None
    if mixture is not None:
        every = {r.source: r.total for r in by_source.collect()}
        missing = sorted(s for s in every if not mixture.get(s, 0) > 0)
        if missing:
            raise ValueError(f"the mixture has no weight above zero for {missing[:5]}")
    schedule = Schedule(window, counted.total, every, mixture)
    totals = [t for _, t in largest]
    weights = [schedule.of_queue(s) for s, _ in largest]
    queue_of = spark.createDataFrame([(s, k) for k, (s, _) in enumerate(largest)], "source string, queue int")
    sparse = counted.n > len(largest)

    # where each partition's part of a queue begins
    per_part = stored.groupBy("part", "source").agg(F.sum("n").alias("n"))
    per_part = per_part.join(F.broadcast(queue_of), "source", "left")
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = per_part.select("part", "source", "queue", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begins"))
    begins = materialise(begins, "packing-begins")  # one row per partition and source
    small = begins.count() <= BROADCAST_ROWS
    placed = stored.join(F.broadcast(begins) if small else begins, ["part", "source"])
    placed = placed.select("doc_id", "source", "ids", "n", (F.col("begins") + F.col("before")).alias("begins"), "queue")

    before = np.zeros(0, np.int64)  # tokens of the other sources before each round
    if sparse:
        turns = _turns(by_source.join(F.broadcast(queue_of), "source", "left_anti"), schedule)
        ahead = Window.partitionBy("round").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
        turns = materialise(turns.withColumn("ahead", F.coalesce(F.sum("tokens").over(ahead), F.lit(0))), "packing-turns")
        before = np.zeros(schedule.rounds + 1, np.int64)
        for r in turns.groupBy("round").agg(F.sum("tokens").alias("tokens")).toLocalIterator():
            before[r["round"] + 1] = r["tokens"]
        before = np.cumsum(before)
    dense_sums, dense_weights = np.array(totals, np.int64), np.array(weights)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(schedule, totals, weights, before) if totals else None
        for batch in batches:
            for block in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                at = zip(*(block.column(c).to_pylist() for c in ("queue", "begins", "n")))
                yield _rows(block, [pieces(*x) for x in at], window)

    def cut_sparse(docs: pa.Table, turns: pa.Table) -> pa.Table:
        turns = turns.sort_by("round")
        r, given, tokens, ahead = (turns.column(c).to_numpy() for c in ("round", "given", "tokens", "ahead"))
        place = before[r] + ahead
        step = max(1, BLOCK_NUMBERS // len(dense_sums))
        for a in range(0, len(r), step):
            place[a : a + step] += schedule.served(r[a : a + step] + 1, dense_sums, dense_weights).sum(axis=1)
        out = []
        for block in docs.to_batches(max_chunksize=512):
            found = []
            for start, n in zip(block.column("begins").to_pylist(), block.column("n").to_pylist()):
                own = slice(np.searchsorted(given, start, side="right") - 1, np.searchsorted(given, start + n))
                low, high = np.maximum(given[own], start), np.minimum(given[own] + tokens[own], start + n)
                found.append(_cut(low, high, place[own] + low - given[own], start, window))
            out.append(_rows(block, found, window))
        return pa.Table.from_batches(out)

    if not sparse:
        return placed.mapInArrow(cut, PIECES)
    others = placed.where("queue IS NULL").groupBy("source").cogroup(turns.groupBy("source")).applyInArrow(cut_sparse, PIECES)
    return placed.where("queue IS NOT NULL").mapInArrow(cut, PIECES).unionByName(others)
