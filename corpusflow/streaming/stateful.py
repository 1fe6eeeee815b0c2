"""Streams whose state ends: reply streams, a cache with a time to live, request rates.

State lives in RocksDB, so it is bounded by disk, not by memory, and every key has an event-time timer that empties it.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusflow import fixed_values as fv
from corpusflow.functions import replies
from corpusflow.streaming.streams import appended

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_db(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which stateful processors need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def stateful_appended(stream: DataFrame, name: str) -> DataFrame:
    """``streams.appended`` for a stateful processor."""
    with rocks_db(stream.sparkSession):
        return appended(stream, name)


def _millis(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[ms]").astype(np.int64)


class _Timed(StatefulProcessor):
    """One timer per key, moved by ``_end_at``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._timer = handle.getValueState("timer", "at long")

    def _end_at(self, at: int) -> None:
        if self._timer.exists():
            (old,) = self._timer.get()
            if old == at:
                return
            self._handle.deleteTimer(old)
        self._handle.registerTimer(at)
        self._timer.update((at,))

    def _ended(self) -> None:
        if self._timer.exists():
            self._handle.deleteTimer(self._timer.get()[0])
            self._timer.clear()

    def close(self) -> None:
        pass


# --- reply streams --------------------------------------------------------------------------

_CALL_SCHEMA = "call_id long, content string, prompt_tokens long, completion_tokens long, total_tokens long, complete boolean"


_CALL = Row("call_id", "content", "prompt_tokens", "completion_tokens", "total_tokens", "complete")


class _Assembler(StatefulProcessor):
    """Pieces are added to a list and put together once, when the call ends.

    A batch brings a few lines of very many calls, so what counts is the cost of a call: rows instead of frames, one
    value with the time of its last line and its usage, and no state at all for a call that ends in the batch it begins in.
    """

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._pieces = handle.getListState("pieces", "line_no long, piece string")
        self._call = handle.getValueState("call", "last long, line_no long, prompt long, completion long, total long")

    def _row(self, key: tuple, pieces: list[tuple], usage: tuple | None, complete: bool) -> Row:
        content = "".join(p[1] for p in sorted(pieces, key=lambda p: p[0]))
        return _CALL(key[0], content, *(usage[1:] if usage else (None, None, None)), complete)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0] is None:  # a heartbeat only moves the watermark
            for _ in rows:
                pass
            return
        pieces, usage, done, last = [], None, False, None
        for line in rows:
            if line.piece is not None:
                pieces.append((line.line_no, line.piece))
            if line.has_usage and (usage is None or line.line_no < usage[0]):
                usage = (line.line_no, line.prompt, line.completion, line.total)
            done |= line.done
            last = line.ts_ms if last is None else max(last, line.ts_ms)
        known = self._call.get()
        if known:
            since, before = known[0], tuple(known[1:])
            usage = before if before[0] is not None and (usage is None or before[0] <= usage[0]) else usage
            newest = max(last, since)
        else:
            newest = last
        if done:
            if known:
                pieces = [*self._pieces.get(), *pieces]
                self._pieces.clear()
                self._call.clear()
                self._handle.deleteTimer(since + self.quiet_ms)
            yield self._row(key, pieces, usage, True)
            return
        if pieces:
            self._pieces.appendList(pieces)
        self._call.update((newest, *(usage or (None, None, None, None))))
        if known and since != newest:
            self._handle.deleteTimer(since + self.quiet_ms)
        if not known or since != newest:
            self._handle.registerTimer(newest + self.quiet_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        pieces, usage = list(self._pieces.get()), tuple(self._call.get()[1:])
        self._pieces.clear()
        self._call.clear()
        yield self._row(key, pieces, usage if usage[0] is not None else None, False)

    def close(self) -> None:
        pass


def call_stream(lines: DataFrame, quiet_ms: int = 600_000, late: str = "1 minute") -> DataFrame:
    """Assembles chat-format ``lines(call_id, line_no, line, ts)`` per call: a row at its end mark, with ``complete``, or without
    it once the watermark is ``quiet_ms`` past its last line, so no call is lost and no state stays.

    Lines may come in any order within a call up to its end. A line behind the end mark's batch begins a call of its own. Rows
    without a call_id are heartbeats: they move the watermark and nothing else. JSON is parsed by column functions; a call's
    state is its pieces, appended and never rewritten.
    """
    v = replies.parse_json(replies.sse_data(F.col("line")))
    parsed = lines.select("call_id", "line_no", "line", "ts", v.alias("v")).select(
        "call_id",
        "line_no",
        "ts",
        F.nullif(replies.answer_text(F.col("v")), F.lit("")).alias("piece"),
        replies.usage(F.col("v")).alias("u"),
        F.coalesce(F.col("line").rlike(r"^\s*data:\s*\[DONE\]\s*$"), F.lit(False)).alias("done"),
    )
    at = F.unix_millis("ts").alias("ts_ms")
    flat = parsed.select("call_id", "line_no", "ts", at, "piece", "done", F.col("u").isNotNull().alias("has_usage"), "u.prompt", "u.completion", "u.total")
    keyed = flat.withWatermark("ts", late).groupBy("call_id")
    return keyed.transformWithState(_Assembler(quiet_ms), _CALL_SCHEMA, "Append", "EventTime")


# --- cache with a time to live --------------------------------------------------------------

_ACCESSES = Row("model", "text_hash", "result", "access_id", "hit", "written_ms")
_ACCESSES_SCHEMA = "model string, text_hash string, result string, access_id array<long>, hit array<boolean>, written_ms array<long>"
#: Stands for a null number in an array of numbers.
_UNKNOWN = int(np.iinfo(np.int64).min)


class _Cache(StatefulProcessor):
    """Gives a row per 10,000 accesses of a key that one answer serves, as arrays: most keys have few accesses, and a frame
    per key, or per miss, would cost more than all else."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._entry = handle.getValueState("entry", "result string, written_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # 16 bytes a row are held to bring a batch into order of time, and one answer
        ids, times, answer = array("q"), array("q"), None
        for row in rows:
            ids.append(_UNKNOWN if row.access_id is None else row.access_id)
            times.append(_UNKNOWN if row.ts_ms is None else row.ts_ms)
            answer = row.answer if answer is None else answer
        if key[1] is None:
            return
        ids, times = np.frombuffer(ids, np.int64), np.frombuffer(times, np.int64)
        order = np.lexsort((ids, times))
        ids, times = ids[order], times[order]
        known = self._entry.get()
        result, written = known or (None, None)
        hit, entry = np.ones(len(ids), bool), np.empty(len(ids), np.int64)
        old = at = 0  # so many accesses are answered by the known entry
        while at < len(times):
            first, miss = at, written is None or times[at] - written > self.ttl_ms
            if miss:
                result, written = answer, int(times[at])
                hit[at] = False
                at += 1
            at = max(at, int(np.searchsorted(times, written + self.ttl_ms, side="right")))
            entry[first:at] = written
            old = old if miss or first else at
        for low, high, text in ((0, old, known and known[0]), (old, len(ids), answer)):
            for at in range(low, high, 10_000):
                part = slice(at, min(at + 10_000, high))
                yield _ACCESSES(*key, text, ids[part].tolist(), hit[part].tolist(), entry[part].tolist())
        if known and known[1] == written:
            return  # hits only: the entry and its timer stay as they are
        if known:
            self._handle.deleteTimer(known[1] + self.ttl_ms + 1)
        self._entry.update((result, written))
        self._handle.registerTimer(written + self.ttl_ms + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._entry.clear()
        return iter(())

    def close(self) -> None:
        pass


def living_cache_stream(accesses: DataFrame, ttl_ms: int = fv.CACHE_TTL_MS, late: str = "1 minute") -> DataFrame:
    """Looks ``accesses(access_id, model, text_hash, answer, ts)`` up in a cache that is the stream's own state: a miss stores its ``answer``, so it
    is a hit in this batch and the next, until it is older than ``ttl_ms`` (a minute at least), which is the next miss.

    The rows of a key are taken in order of ts, then access_id, within a batch; batches follow each other. A row that is older than the entry it
    meets is a hit. All answers of a key count as one, the first that isn't null. A key's entry is dropped by a timer when its time is over. Rows
    without a text_hash are heartbeats.
    """
    timed = accesses.withWatermark("ts", late).withColumn("ts_ms", F.unix_millis("ts"))
    served = timed.groupBy("model", "text_hash").transformWithState(_Cache(max(ttl_ms, fv.CACHE_MIN_TTL_MS)), _ACCESSES_SCHEMA, "Append", "EventTime")
    each = served.select("model", "text_hash", "result", F.explode(F.arrays_zip("access_id", "hit", "written_ms")).alias("a"))
    return each.select("a.access_id", "model", "text_hash", "a.hit", "result", "a.written_ms")


# --- request rate -----------------------------------------------------------------------------

_RATE_SCHEMA = "event_id long, ts_ms long, in_window long, wait_ms long"


class _Rate(_Timed):
    def __init__(self, window_ms: int, limit: int):
        self.window_ms, self.limit = window_ms, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self._seen = handle.getListState("seen", "ts_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ids, times, own = [], [], []
        for part in rows:  # 17 bytes a row are held, of one window's bucket
            ids.append(part["event_id"].to_numpy(np.int64))
            times.append(_millis(part["ts"]))
            own.append(part["own"].to_numpy(bool))
        ids, times, own = np.concatenate(ids), np.concatenate(times), np.concatenate(own)
        earlier = np.fromiter((t for (t,) in self._seen.get()), np.int64) if self._seen.exists() else np.zeros(0, np.int64)
        seen = np.sort(np.concatenate([earlier, times]))
        ids, times = ids[own], times[own]
        first = np.searchsorted(seen, times - self.window_ms + 1, side="left")
        count = np.searchsorted(seen, times, side="right") - first - 1
        wait = np.where(count >= self.limit, self.window_ms - (times - seen[np.minimum(first, len(seen) - 1)]) + fv.RATE_WAIT_MARGIN_MS, 0)
        self._seen.appendList([(int(t),) for t in seen]) if not len(earlier) else self._seen.put([(int(t),) for t in seen])
        self._end_at(int((key[1] + 1) * self.window_ms))
        for at in range(0, len(ids), 10_000):
            part = slice(at, at + 10_000)
            yield pd.DataFrame({"event_id": ids[part], "ts_ms": times[part], "in_window": count[part], "wait_ms": wait[part]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._timer.clear()
        self._seen.clear()
        return iter(())


def rate_stream(requests: DataFrame, key: str, window_ms: int = fv.RATE_WINDOW_MS, limit: int = fv.RATE_MAX_REQUESTS, late: str = "1 minute") -> DataFrame:
    """Requests in the window before each of ``requests(event_id, ts, key)``, as ``observability.rate_waits`` counts them.

    A key is cut into buckets of one window, and a row also goes to the next one, so a task holds the times of two
    windows of a key, however many requests a batch brings. A bucket's state ends when the watermark has passed it: no row can
    look back to it then. Rows later than ``late`` are dropped; of rows that come out of order each counts what has come before it or with it.
    """
    at = F.unix_millis("ts")
    bucket, next_bucket = F.floor(at / window_ms), F.floor((at + window_ms - 1) / window_ms)
    spread = requests.withWatermark("ts", late).select("event_id", "ts", key, F.explode(F.sequence(bucket, next_bucket)).alias("bucket"))
    spread = spread.withColumn("own", F.col("bucket") == F.floor(F.unix_millis("ts") / window_ms))
    return spread.groupBy(key, "bucket").transformWithStateInPandas(_Rate(window_ms, limit), _RATE_SCHEMA, "Append", "EventTime")
