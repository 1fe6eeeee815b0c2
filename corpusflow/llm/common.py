"""Helpers the operators share: Arrow blocks of bounded size, byte views, mixing of integers."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

#: Bytes of text that a numpy step works on at a time; a longer single text is a block of its own.
BLOCK_BYTES = 4_000_000

#: Bytes of the Arrow batches of steps that are written: some blocks of text.
BATCH_BYTES = "4m"

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def release() -> None:
    """Gives memory that is no longer used back to the system, since workers live on and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the texts of a piece have ``limit`` bytes at most, or are one text.

    What this task hasn't asked ``per_worker`` for before is dropped: other operators have left it.
    """
    forget()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        release()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one behind the other, and the offsets of the texts; a null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Strings that lie one behind the other in ``data``."""
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))
    )


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: start, end, number of the text. A word never crosses texts."""
    inside = ~SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    begin[firsts] = inside[firsts]
    starts = np.flatnonzero(begin)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    stop[lasts] = inside[lasts]
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def dictionary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.DictionaryArray:
    """Byte ranges in dictionary form: equal ranges get equal numbers (exact, no hashing), others different ones."""
    if not len(starts):
        return pa.array([], pa.large_binary()).dictionary_encode()
    # ranges and the gaps between them tile the bytes
    offsets = np.empty(2 * len(starts) + 1, np.int64)
    offsets[:-1:2], offsets[1::2], offsets[-1] = starts, ends, ends[-1]
    own = pa.array(np.arange(len(starts)) * 2)
    return strings(data, offsets).cast(pa.large_binary()).take(own).dictionary_encode()


def codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of ``dictionary``."""
    return dictionary(data, starts, ends).indices.to_numpy(zero_copy_only=False).astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits look independent."""
    x = np.asarray(x).astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _task() -> int:
    context = TaskContext.get()
    return -1 if context is None else context.taskAttemptId()


def per_worker(key, make: Callable, small: bool = False):
    """One object per Python worker process, also across its tasks, as long as they all ask for it, or if it is ``small``."""
    kept = sys.modules.setdefault("_corpusflow_worker", types.ModuleType("_corpusflow_worker"))
    if not hasattr(kept, "objects"):
        kept.objects, kept.asked = {}, {}
    if key not in kept.objects:
        kept.objects[key] = make()
    kept.asked[key] = None if small else _task()
    return kept.objects[key]


def forget() -> None:
    """Drops the objects of this worker process that its present task has not asked for."""
    kept = sys.modules.get("_corpusflow_worker")
    left = [] if kept is None else [k for k, task in kept.asked.items() if task not in (None, _task())]
    for key in left:
        del kept.objects[key], kept.asked[key]
    if left:
        release()


def short(values: np.ndarray, buckets: int) -> np.ndarray:
    """64-bit values as bucket * 2**32 + 32 bits of the value: what ``met_twice`` tells apart and gives back."""
    return ((values % np.uint64(buckets)) << np.uint64(32) | values >> np.uint64(32)).astype(np.int64)


PACKED = "bucket int, low binary, holders binary, times binary"


def packed(values: np.ndarray, holders: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows for ``met_twice``, one per bucket: the low halves of its short values, and its holders with run lengths.

    Holders should come in runs; about 8 bytes a value travel.
    """
    values = short(values, buckets)
    bucket = (values >> 32).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, values, holders = bucket[order], values[order], holders[order]
    new = np.ones(len(bucket), bool)
    new[1:] = bucket[1:] != bucket[:-1]
    begins = np.flatnonzero(new)
    new[1:] |= holders[1:] != holders[:-1]
    runs_ = np.flatnonzero(new)
    times = np.diff(np.append(runs_, len(bucket))).astype(np.uint32)
    first_run = np.searchsorted(runs_, begins)

    def lists(of: np.ndarray, at: np.ndarray) -> pa.Array:
        offsets = np.append(at, len(of)).astype(np.int64) * of.itemsize
        return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(of))]).cast(pa.binary())

    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[begins]), lists(values.astype(np.uint32), begins), lists(holders[runs_], first_run), lists(times, first_run)],
        ["bucket", "low", "holders", "times"],
    )


def met_twice(limit: int, value: str, holder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows of ``packed``: the pairs of a short value and a holder whose value has two holders or more.

    All rows of a value must be in the partition. It is read in pieces of ``limit`` values, and only distinct values with
    their first holder are kept between them, so memory doesn't grow with the holders of one value.
    A pair may come more than once if it came in more than one piece.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        values, who, held = [], [], 0
        for batch in batches:
            for bucket, low, holders, times in zip(*(c.to_pylist() for c in batch.columns)):
                values.append(np.frombuffer(low, np.uint32).astype(np.int64) | (bucket << 32))
                who.append(np.repeat(np.frombuffer(holders, np.int64), np.frombuffer(times, np.uint32)))
                held += len(values[-1])
                if held > limit:
                    yield np.concatenate(values), np.concatenate(who)
                    values, who, held = [], [], 0
        if values:
            yield np.concatenate(values), np.concatenate(who)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen, first, known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        for values, who in pieces(batches):
            order = np.lexsort((who, values))
            values, who = values[order], who[order]
            new = np.ones(len(values), bool)
            new[1:] = (values[1:] != values[:-1]) | (who[1:] != who[:-1])
            values, who = values[new], who[new]
            begins = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            sizes = np.diff(np.append(begins, len(values)))
            old = other = np.zeros(len(begins), bool)
            late = at = np.zeros(0, np.int64)
            if len(seen):
                at = np.minimum(np.searchsorted(seen, values[begins]), len(seen) - 1)
                old = seen[at] == values[begins]
                other = old & ((sizes > 1) | (first[at] != who[begins]) | known[at])
                late = at[other & ~known[at]]  # their first holder has not been sent yet
            out = np.repeat((sizes > 1) | other, sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([values[out], seen[late]])), pa.array(np.concatenate([who[out], first[late]]))], [value, holder]
            )
            if len(seen):
                known[at[other]] = True
            add = ~old
            seen = np.concatenate([seen, values[begins][add]])
            first = np.concatenate([first, who[begins][add]])
            known = np.concatenate([known, (sizes > 1)[add]])
            order = np.argsort(seen, kind="stable")
            seen, first, known = seen[order], first[order], known[order]
            release()

    return meet
