"""Suffix-array dedup: bytes covered by a window of 50 bytes that also starts in an earlier document are removed.

Every window has an anchor, the smallest hash among its byte grams, and equal windows have equal anchors. So
windows only have to be compared within an anchor: neighbouring windows with one anchor make one short string,
equal strings are reduced to one with the smallest document id, and the strings of an anchor that several documents
share are put into one suffix array, in which equal windows lie side by side. Windows of anchors with many
different strings are put side by side by their hashes and compared, those of the few anchors with
very many are split by their whole windows instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm import anchors, common
from corpusflow.llm.suffixes import suffix_arrays
from corpusflow.session import discard, materialise

WINDOW, GRAM = 50, 20
#: Anchors with more different strings get no suffix array: their windows are put in the order of their hashes.
MAX_STRINGS = 128
#: Anchors with still more are not gathered in a task: each window of such a string is a row, and rows are grouped whole.
MAX_GATHERED = 40_000
#: Symbols of the suffix arrays made at once.
BATCH_SYMBOLS = 1_000_000
TASK_DIGESTS = 1_000_000
#: Bytes of text of a numpy step, whose arrays of 8-byte numbers are many times as large.
BLOCK_BYTES = 1_000_000


def _digests(texts: list[bytes], clashing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each text; the first is its name, unless it is ``clashing``: then the second one is."""
    whole = [xxhash.xxh3_128_intdigest(t) for t in texts]
    name, check = np.array([d & (2**64 - 1) for d in whole], np.uint64), np.array([d >> 64 for d in whole], np.uint64)
    other = np.isin(name, clashing)
    return np.where(other, check, name).view(np.int64), np.where(other, name, check).view(np.int64)


def _names(texts: list[bytes], clashing: np.ndarray) -> np.ndarray:
    return _digests(texts, clashing)[0]


def _text_list(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def named(documents: DataFrame, key: str, text: str, clashing: np.ndarray) -> DataFrame:
    """``id``, ``name`` (64-bit digest), ``check`` (the other half of the 128-bit digest) and ``n_bytes`` per row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text"):
            data, offsets = common.text_bytes(block.column("text"))
            name, check = _digests(_text_list(data, offsets), clashing)
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(name), pa.array(check), pa.array(np.diff(offsets))], ["id", "name", "check", "n_bytes"])

    return documents.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(work, "id long, name long, check long, n_bytes long")


def shared_anchors(documents: DataFrame, text: str, tasks: int, clashing: np.ndarray) -> DataFrame:
    """``anchor`` and ``name`` for all anchors that two different texts or more have.

    Digests travel packed, one row per block and bucket; a task keeps distinct ones only.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text", BLOCK_BYTES):
            data, offsets = common.text_bytes(block.column("text"))
            names = _names(_text_list(data, offsets), clashing)
            of, _, _, digest = anchors.window_groups(data, offsets, WINDOW, GRAM)
            _, once = np.unique(names, return_index=True)
            first = np.zeros(block.num_rows, bool)
            first[once] = True
            of, digest = of[first[of]], digest[first[of]]
            if not len(of):
                continue
            yield common.packed(digest, names[of], tasks)

    packed = documents.select(F.col(text).alias("text")).mapInArrow(emit, common.PACKED)
    dealt = packed.repartition(tasks, "bucket")
    return dealt.mapInArrow(common.met_twice(TASK_DIGESTS, "anchor", "name"), "anchor long, name long")


def _occurrences(texts: DataFrame, tasks: int, clashing: np.ndarray) -> DataFrame:
    """Strings of windows with one anchor, for the anchors listed with each text: anchor, digest, id, name, place, windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text", BLOCK_BYTES):
            data, offsets = common.text_bytes(block.column("text"))
            own = _names(_text_list(data, offsets), clashing) == block.column("name").to_numpy(zero_copy_only=False)
            of, first, count, digest = anchors.window_groups(data, offsets, WINDOW, GRAM)
            short = common.short(digest, tasks).view(np.uint64)
            wanted = block.column("anchors")
            flat = wanted.flatten().to_numpy(zero_copy_only=False)
            sizes = pa.compute.list_value_length(wanted).to_numpy(zero_copy_only=False)
            listed = common.mix(flat.view(np.uint64)) ^ common.mix(np.repeat(np.arange(block.num_rows), sizes))
            asked = np.isin(common.mix(short) ^ common.mix(of), listed) & own[of]
            of, first, count, digest = of[asked], first[asked], count[asked], digest[asked]
            whole = data.tobytes()
            strings = [xxhash.xxh3_64_intdigest(whole[a : a + c + WINDOW - 1]) for a, c in zip(first.tolist(), count.tolist())]
            at = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest.view(np.int64)), pa.array(np.array(strings, np.uint64).view(np.int64)), block.column("id").take(at), block.column("name").take(at),
                 pa.array((first - offsets[of]).astype(np.int32)), pa.array(count.astype(np.int32))],
                ["anchor", "digest", "id", "name", "place", "windows"],
            )

    return texts.mapInArrow(work, "anchor long, digest long, id long, name long, place int, windows int")


def _strings(texts: DataFrame, clashing: np.ndarray) -> DataFrame:
    """The bytes that are ``asked`` of each text: anchor, digest, id, n, bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text", BLOCK_BYTES):
            data, offsets = common.text_bytes(block.column("text"))
            names = _names(_text_list(data, offsets), clashing)
            whole, asked = data.tobytes(), block.column("asked")
            flat = asked.flatten()
            of = np.repeat(np.arange(block.num_rows), pa.compute.list_value_length(asked).to_numpy(zero_copy_only=False))
            mine = names[of] == flat.field("name").to_numpy(zero_copy_only=False)
            flat, of = flat.filter(pa.array(mine)), of[mine]
            first = offsets[of] + flat.field("place").to_numpy(zero_copy_only=False)
            size = flat.field("windows").to_numpy(zero_copy_only=False) + WINDOW - 1
            out = [whole[a : a + n] for a, n in zip(first.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays(
                [flat.field("anchor"), flat.field("digest"), block.column("id").take(pa.array(of)), flat.field("n"), pa.array(out, pa.binary())],
                ["anchor", "digest", "id", "n", "bytes"],
            )

    return texts.mapInArrow(work, "anchor long, digest long, id long, n long, bytes binary")


def earliest_windows(strings: list[bytes], ids: np.ndarray, groups: np.ndarray) -> list[np.ndarray]:
    """Per string: for each of its windows the smallest id among the strings of its group that hold an equal window.

    ``groups`` must be in order. Each group is one text, its strings ended by a symbol of their own, and gets a suffix array.
    """
    n = len(strings)
    lengths = np.fromiter(map(len, strings), np.int64, n)
    begins = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    last = np.append(begins[1:], n) - 1
    # symbols: 0 ends a text, 1 ends a string, bytes follow
    ends = np.cumsum(lengths + 1)
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    symbols = data.astype(np.int16) + 2
    symbols[ends - 1] = 1
    symbols[ends[last] - 1] = 0
    offsets = np.concatenate([[0], ends[last]])
    order = suffix_arrays(symbols, offsets)
    string = np.repeat(np.arange(n), lengths + 1)
    place = np.arange(len(symbols)) - (ends - lengths - 1)[string]
    fits = place + WINDOW <= lengths[string]
    order = order[fits[order]]
    views = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
    same = np.zeros(len(order), bool)
    for k in range(1, len(order), 100_000):
        a, b = order[k - 1 : k + 99_999], order[k : k + 100_000]
        same[k : k + 100_000] = (views[a[: len(b)]] == views[b]).all(axis=1)
    of_group = groups[string[order]]
    new = ~same
    new[1:] |= of_group[1:] != of_group[:-1]
    at = np.flatnonzero(new)
    low = np.minimum.reduceat(ids[string[order]], at) if len(at) else ids[:0]
    result = np.zeros(len(symbols), np.int64)
    result[order] = np.repeat(low, np.diff(np.append(at, len(order))))
    starts = ends - lengths - 1
    return [result[a : a + m - WINDOW + 1] for a, m in zip(starts.tolist(), lengths.tolist())]


def earliest_by_hash(strings: list[bytes], ids: np.ndarray, groups: np.ndarray) -> list[np.ndarray]:
    """What ``earliest_windows`` gives, without suffix arrays: windows in the order of their hashes, neighbours compared byte by byte."""
    n = len(strings)
    counts = np.fromiter(map(len, strings), np.int64, n) - WINDOW + 1
    offsets = np.concatenate([[0], np.cumsum(counts + WINDOW - 1)])
    data = np.frombuffer(b"".join(strings), np.uint8)
    begins = np.concatenate([[0], np.cumsum(counts)])
    string = np.repeat(np.arange(n), counts)
    first = np.arange(begins[-1]) + (offsets[:-1] - begins[:-1])[string]
    key = np.empty(len(first), np.uint64)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK_BYTES, side="right")) - 1)
        hashes = anchors.gram_hashes(data[offsets[a] : offsets[b]], WINDOW)
        own = slice(begins[a], begins[b])
        key[own] = hashes[first[own] - offsets[a]] ^ common.mix(groups[string[own]])
        a = b
    order = np.argsort(key)
    views = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
    group = groups[string]

    def equal_to_last(order: np.ndarray) -> np.ndarray:
        same = np.zeros(len(order), bool)
        for k in range(1, len(order), 100_000):
            x, y = order[k - 1 : k + 99_999], order[k : k + 100_000]
            x = x[: len(y)]
            same[k : k + 100_000] = (group[x] == group[y]) & (views[first[x]] == views[first[y]]).all(axis=1)
        return same

    same = equal_to_last(order)
    if (~same[1:] & (key[order[1:]] == key[order[:-1]])).any():  # two windows of one hash: bytes decide
        order = np.lexsort((np.ascontiguousarray(views[first]).view(f"V{WINDOW}").ravel(), group))
        same = equal_to_last(order)
    at = np.flatnonzero(~same)
    low = np.minimum.reduceat(ids[string[order]], at) if len(at) else ids[:0]
    result = np.empty(len(first), np.int64)
    result[order] = np.repeat(low, np.diff(np.append(at, len(order))))
    return np.split(result, begins[1:-1])


def by_anchor(strings: DataFrame, tasks: int) -> DataFrame:
    """Rows in partitions that hold whole anchors, one behind the other, those of like many strings ``n`` together.

    A batch of suffix arrays takes as many steps as its longest text has symbols, so long texts should not be among short ones.
    """
    return strings.repartition(tasks, "anchor").sortWithinPartitions("n", "anchor", "digest")


def _earliest(distinct: DataFrame) -> DataFrame:
    """``anchor``, ``digest`` and ``earliest`` (array, an id per window) for rows of anchor, digest, bytes, id, n, as ``by_anchor`` gives them."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        groups: dict[int, int] = {}
        for r in rows:
            groups[r[0]] = groups.get(r[0], 0) + len(r[2])
        rows.sort(key=lambda r: (groups[r[0]], r[0]))  # texts of like length side by side
        number = np.cumsum(np.concatenate([[0], [a[0] != b[0] for a, b in zip(rows, rows[1:])]]))
        compare = earliest_by_hash if rows[0][4] > MAX_STRINGS else earliest_windows
        found = compare([r[2] for r in rows], np.array([r[3] for r in rows], np.int64), number)
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), lists], ["anchor", "digest", "earliest"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if rows and row[:2] == rows[-1][:2]:  # a row that comes twice gives its strings twice
                    continue
                many = 2 * WINDOW * row[4]  # about the symbols of the anchor that begins
                if rows and row[0] != rows[-1][0] and (held + many > BATCH_SYMBOLS or (row[4] > MAX_STRINGS) != (rows[0][4] > MAX_STRINGS)):
                    yield solve(rows)
                    rows, held = [], 0
                    common.release()
                rows.append(row)
                held += len(row[2]) + 1
        if rows:
            yield solve(rows)
        common.release()

    return distinct.select("anchor", "digest", "bytes", "id", "n").mapInArrow(work, "anchor long, digest long, earliest array<long>")


def with_removals(documents: DataFrame, key: str, text: str, *carried: Column) -> tuple[DataFrame, np.ndarray]:
    """id, text, what is ``carried``, and what is to be removed from each row; and the names that are not used.

    ``covered`` is an array of (name, spans): in the text of that name, windows go from span >> 32 on, up to the low half of span.
    ``copied`` holds the names of the row's key whose whole text an earlier document has. Texts meet what belongs to them by id, three times.
    """
    spark = documents.sparkSession
    plain = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), *carried)
    rows = plain.where("id IS NOT NULL")
    clashing = np.zeros(0, np.uint64)
    while True:
        names = materialise(named(rows, "id", "text", clashing), "named", common.BATCH_BYTES)
        nodes = names.groupBy("name").agg(F.min("id").alias("first"), F.min("check").alias("low"), F.max("check").alias("high"))
        nodes = materialise(nodes, "named-once")
        # names that two different texts got: some hundred at 10^11 texts, by the birthday bound; those texts take their other digest
        clashes = [r["name"] for r in nodes.where("low <> high").select("name").collect()]
        if not clashes:
            break
        clashing = np.union1d(clashing, np.array(clashes, np.int64).view(np.uint64))
        discard(names, nodes)
    total = names.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(parts, total // 16 // TASK_DIGESTS + 1)
    shared = shared_anchors(rows, "text", tasks, clashing)
    listed = shared.groupBy("name").agg(F.collect_set("anchor").alias("anchors")).join(nodes.select("name", "first"), "name")
    # each step is written: what it shuffled and what only it reads go then, and a lost task repeats no earlier step
    listed = materialise(listed.select(F.col("first").alias("id"), "name", "anchors"), "shared-anchors", common.BATCH_BYTES)
    tasks_by_size = max(parts, total // 16_000_000 + 1)
    texts = rows.repartition(tasks_by_size, "id")
    found = materialise(_occurrences(texts.select("id", "text").join(listed, "id"), tasks, clashing), "occurrences", common.BATCH_BYTES)
    discard(listed)
    distinct = found.groupBy("anchor", "digest").agg(F.min(F.struct("id", "name", "place", "windows")).alias("own"))
    sizes = distinct.groupBy("anchor").agg(F.count("*").alias("n"))
    several = materialise(distinct.select("anchor", "digest", "own.*").join(sizes, "anchor"), "strings")
    # a single string needs no comparing: all its windows are its first holder's, ``low``
    single = several.where("n = 1").select("anchor", "digest", F.col("id").alias("low"), F.lit(None).cast("array<long>").alias("earliest"))
    asked = several.where("n > 1").groupBy("id").agg(F.collect_list(F.struct("anchor", "digest", "name", "place", "windows", "n")).alias("asked"))
    strings = materialise(_strings(texts.select("id", "text").join(asked, "id"), clashing), "bytes", common.BATCH_BYTES)
    compared = by_anchor(strings.where(F.col("n") <= MAX_GATHERED), tasks_by_size)
    # windows of the few others, each whole, as 96 bits of hash beside the anchor's 64
    windows = strings.where(F.col("n") > MAX_GATHERED).select("anchor", "digest", "id", "bytes", F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - WINDOW)).alias("nth"))
    window = F.expr(f"substring(bytes, nth + 1, {WINDOW})")
    windows = windows.select("anchor", "digest", "id", "nth", F.xxhash64(window).alias("h"), F.hash(window).alias("g"))
    low = windows.groupBy("anchor", "h", "g").agg(F.min("id").alias("low"))
    nth_low = windows.select("anchor", "digest", "nth", "h", "g").join(low, ["anchor", "h", "g"])
    # a set, since rows that come twice give their strings twice
    split = nth_low.groupBy("anchor", "digest").agg(F.array_sort(F.collect_set(F.struct("nth", "low")))["low"].alias("earliest"))
    several_low = _earliest(compared).unionByName(split).withColumn("low", F.array_min("earliest"))
    earliest = materialise(single.unionByName(several_low), "earliest", common.BATCH_BYTES)
    discard(several, strings)
    # the windows that an earlier document has
    hits = found.join(earliest, ["anchor", "digest"]).where(F.col("low") < F.col("id"))
    early = F.transform("earliest", lambda e: e < F.col("id"))
    hits = hits.select("id", "name", "place", F.col("windows"), early.alias("early"))
    size = F.size("early")
    begins = F.filter(F.sequence(F.lit(0), size - 1), lambda k: F.get("early", k) & ~F.coalesce(F.get("early", k - 1), F.lit(False)))
    ends = F.filter(F.sequence(F.lit(0), size - 1), lambda k: F.get("early", k) & ~F.coalesce(F.get("early", k + 1), F.lit(False)))
    place = F.col("place").cast("long")
    both = F.zip_with(begins, ends, lambda a, b: F.shiftleft(place + a, 32).bitwiseOR(place + b + 1))
    whole = F.array(F.shiftleft(place, 32).bitwiseOR(place + F.col("windows")))
    spans = hits.select("id", "name", F.explode(F.when(F.col("early").isNull(), whole).otherwise(both)).alias("span")).repartition(tasks_by_size, "id")
    spans = spans.groupBy("id", "name").agg(F.collect_list("span").alias("spans")).groupBy("id").agg(F.collect_list(F.struct("name", "spans")).alias("covered"))
    spans = materialise(spans, "spans")
    discard(found, earliest)
    copies = names.join(nodes, "name").where("first < id").groupBy("id").agg(F.collect_set("name").alias("copied"))
    marked = texts.join(spans, "id", "left").join(copies, "id", "left")
    return marked.unionByName(plain.where("id IS NULL"), allowMissingColumns=True), clashing


def _cut(block: pa.RecordBatch, clashing: np.ndarray) -> tuple[np.ndarray, list[list[bytes]], np.ndarray, list[int]]:
    """Bytes of each text, the pieces that are kept of it, bytes and runs removed."""
    data, offsets = common.text_bytes(block.column("text"))
    texts = _text_list(data, offsets)
    names = _names(texts, clashing)
    kept, removed, n_runs = [], [], []
    for k, (t, covered, copied) in enumerate(zip(texts, block.column("covered").to_pylist(), block.column("copied").to_pylist())):
        name = int(names[k])
        if len(t) >= WINDOW and copied and name in copied:
            mask = np.ones(len(t), bool)
        else:
            depth = np.zeros(len(t) + 1, np.int64)
            for c in covered or ():
                if c["name"] == name:
                    spans = np.array(c["spans"], np.int64)
                    np.add.at(depth, spans >> 32, 1)
                    np.add.at(depth, (spans & 0xFFFFFFFF) - 1 + WINDOW, -1)
            mask = np.cumsum(depth)[:-1] > 0
        starts, ends = common.runs(mask)
        n_runs.append(len(starts))
        removed.append(int((ends - starts).sum()))
        kept.append([t[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(t)])])
    return np.diff(offsets), kept, np.array(removed, np.int64), n_runs


def dedup(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (bytes) per row.

    A byte goes if a window of 50 bytes of its text that covers it also starts in a row with a smaller key; what is judged
    is the input, never what is left. Texts shorter than a window lose nothing; null texts are empty; rows that share a
    key don't judge each other; rows without a key neither judge nor lose anything; no rows give no rows.
    """
    marked, clashing = with_removals(documents, key, text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text", BLOCK_BYTES):
            sizes, pieces, removed, n_runs = _cut(block, clashing)
            kept = [b"".join(p) for p in pieces]
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), pa.array(sizes), pa.array(removed), pa.array(n_runs, pa.int64()), pa.array(kept, pa.binary())], [key, "n_bytes", "n_removed", "n_spans", "kept"]
            )

    return marked.mapInArrow(work, f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept binary")


def cut_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """All rows with all their columns, their text without what ``dedup`` removes.

    Where a removed run ends inside a character, the rest of the character goes too. A text that is wholly removed becomes
    empty, a null text stays null. ``length``, if there is such a column, becomes the characters of the new text.
    """
    names = [c for c in documents.columns if c != text]
    marked, clashing = with_removals(documents, key, text, F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    row = marked.select("row").schema.fields[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text", BLOCK_BYTES):
            _, pieces, _, _ = _cut(block, clashing)
            missing = block.column("text").is_null().to_pylist()
            texts = [None if m else "".join(p.decode("utf-8", "ignore") for p in own) for m, own in zip(missing, pieces)]
            yield pa.RecordBatch.from_arrays([block.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    cut = marked.mapInArrow(work, T.StructType([row, T.StructField("text", T.StringType())]))

    def value(c: str) -> Column:
        if c == text:
            return F.col("text").alias(c)
        return F.length("text").cast(documents.schema[c].dataType).alias(c) if c == length else F.col(f"row.`{c}`").alias(c)

    return cut.select(*map(value, documents.columns))
