"""N-gram Jaccard join by parity sketches.

A document's shingles are dealt to parts by a hash, and every part is XORed into a digest: the parity
sketch of that part. One shingle that two sets don't share changes one part, so the number of differing parts
bounds their symmetric difference from below. Sets with a Jaccard similarity of 0.75 differ in (a + b) / 7
shingles at most; bands of sizes have more parts than that, so linked sets agree in a part (pigeonhole),
and even in one of the rarest of each, which is what is joined. Candidates pass a second parity sketch of
512 bits, whose Hamming distance bounds the symmetric difference too, and are then verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import common
from corpusflow.llm.components import components
from corpusflow.session import materialise

SHINGLE_WORDS = 5
SKETCH_BITS = 512
#: Bands of sets with fewer shingles give each shingle a part of its own.
SMALL = 64
#: Part digests a task of the pigeonhole join gets, about.
TASK_DIGESTS = 1_000_000

#: Pairs of sets that a task compares at a time, sets of one part that are compared in one group, and twice the pairs of a least name in one task.
BLOCK_PAIRS, CHUNK_SETS, TASK_PAIRS = 1_000_000, 4096, 20_000_000

#: So many ids are broadcast to the scan at most; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a block of texts, sorted within each text, and the text of each.

    Words are hashed by xxHash; a text with fewer words than a shingle has its whole sequence as one.
    """
    data, offsets = common.text_bytes(column)
    data = _LOWER[data]
    starts, ends, of = common.words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    tiles = np.empty(2 * len(starts) + 1, np.int64)
    tiles[:-1:2], tiles[1::2], tiles[-1] = starts, ends, ends[-1]
    coded = common.strings(data, tiles).cast(pa.large_binary()).take(pa.array(np.arange(len(starts)) * 2)).dictionary_encode()
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    word = hashed[coded.indices.to_numpy(zero_copy_only=False)]
    n_words = np.bincount(of, minlength=len(offsets) - 1)
    first = np.cumsum(n_words) - n_words
    at = np.arange(len(word))
    size = np.minimum(n_words, SHINGLE_WORDS)[of]
    begins = at + size <= (first + n_words)[of]
    at, of, size = at[begins], of[begins], size[begins]
    rolled = size.astype(np.uint64)
    for k in range(SHINGLE_WORDS):
        more = k < size
        rolled = np.where(more, rolled * _BASE + word[np.minimum(at + k, len(word) - 1)], rolled)
    rolled = common.mix(rolled)
    order = np.lexsort((rolled, of))
    rolled, of = rolled[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (rolled[1:] != rolled[:-1]) | (of[1:] != of[:-1])
    return rolled[new], of[new]


def _band(n: np.ndarray) -> np.ndarray:
    """floor(log2(n)) of sizes from 1."""
    return np.frexp(n.astype(np.float64))[1] - 1


def _most_unlike(n: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Largest symmetric difference of a set of ``n`` shingles and a linked one in a band's scheme."""
    return (n + np.minimum(4 * n // 3, 2 ** (band + 1) - 1)) // 7


def part_digests(shingles: np.ndarray, of: np.ndarray, n: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the parts that hold a shingle, and the set of each.

    ``step`` 0 is the scheme of the set's own band; 1 the next band's, which only sets meet that may be linked to
    a larger one there (3/4 of the band's least size or more).
    """
    band = _band(np.maximum(n, 1)) + step
    meets = (n > 0) & ((step == 0) | (4 * n >= 3 * 2**band))
    own = meets[of]
    shingles, of = shingles[own], of[own]
    band = band[of]
    spread = common.mix(shingles ^ common.mix(band.astype(np.uint64) + np.uint64(1 << 20)))
    parts = np.where(2 ** band.astype(np.int64) < SMALL, np.int64(1) << 40, np.int64(1) << band.astype(np.int64))
    part = (spread >> np.uint64(20)).astype(np.int64) & (parts - 1)
    order = np.lexsort((part, of))
    spread, part, of, band = spread[order], part[order], of[order], band[order]
    begins = np.ones(len(of), bool)
    begins[1:] = (part[1:] != part[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(begins)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    digest = np.bitwise_xor.reduceat(common.mix(spread), at)
    return common.mix(digest ^ common.mix((band[at].astype(np.uint64) << np.uint64(48)) ^ part[at].astype(np.uint64))), of[at]


def _names(shingles: np.ndarray, of: np.ndarray, n: np.ndarray, clashing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set; the first, with bit 0 clear, is its name, unless it is ``clashing``: then the second one is."""
    sums = []
    for k in (1, 2):
        total = np.zeros(len(n), np.uint64)
        begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        if len(begins):
            total[of[begins]] = np.add.reduceat(common.mix(shingles ^ np.uint64(k)), begins)
        sums.append(common.mix(total ^ n.astype(np.uint64)))
    name, check = sums[0] & ~np.uint64(1), sums[1]
    other = np.isin(name, clashing)
    name, check = np.where(other, check & ~np.uint64(1), name), np.where(other, name, check)
    return name.view(np.int64), check.view(np.int64)


def sketched(documents: DataFrame, key: str, text: str, clashing: np.ndarray) -> DataFrame:
    """Per row: id, size of the set, name and check digest, slack of either scheme, sketch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text"):
            shingles, of = shingle_sets(block.column("text"))
            n = np.bincount(of, minlength=block.num_rows).astype(np.int64)
            name, check = _names(shingles, of, n, clashing)
            slack = []
            for step in (0, 1):
                _, whose = part_digests(shingles, of, n, step)
                parts = np.bincount(whose, minlength=block.num_rows)
                slack.append(parts - _most_unlike(n, _band(np.maximum(n, 1)) + step) - 1)
            bit = (common.mix(shingles ^ np.uint64(77)) & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
            parity = np.bincount(of * SKETCH_BITS + bit, minlength=block.num_rows * SKETCH_BITS).astype(np.uint8) & 1
            lanes = np.packbits(parity).view(np.int64).reshape(block.num_rows, -1)
            sketch = pa.FixedSizeListArray.from_arrays(pa.array(lanes.ravel()), lanes.shape[1]).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), pa.array(n), pa.array(name), pa.array(check), pa.array(slack[0]), pa.array(slack[1]), sketch],
                ["id", "n", "name", "check", "slack_0", "slack_1", "sketch"],
            )

    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(work, f"id {kind}, n long, name long, check long, slack_0 long, slack_1 long, sketch array<long>")


def shared_parts(documents: DataFrame, text: str, clashing: np.ndarray, tasks: int) -> DataFrame:
    """``part`` and ``who`` (the set's name, bit 0 telling its scheme) of all part digests that two sets or more have.

    Digests travel packed by bucket, one row per block and bucket. A task reads its buckets in pieces and keeps
    only distinct digests, so its memory doesn't grow with the sets that share one.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text"):
            shingles, of = shingle_sets(block.column("text"))
            n = np.bincount(of, minlength=block.num_rows).astype(np.int64)
            name, _ = _names(shingles, of, n, clashing)
            _, once = np.unique(name, return_index=True)  # copies within the block count once
            first = np.zeros(block.num_rows, bool)
            first[once] = True
            own = first[of]
            shingles, of = shingles[own], of[own]
            found = [part_digests(shingles, of, n, step) for step in (0, 1)]
            digest = np.concatenate([f[0] for f in found])
            who = np.concatenate([name[f[1]] | step for step, f in enumerate(found)])
            if not len(digest):
                continue
            yield common.packed(digest, who, tasks)

    packed = documents.select(F.col(text).alias("text")).mapInArrow(emit, common.PACKED)
    dealt = packed.repartition(tasks, "bucket")
    # a set that two blocks hold may come twice
    return dealt.mapInArrow(common.met_twice(2 * TASK_DIGESTS, "part", "who"), "part long, who long")


def _distance(a: str, b: str) -> Column:
    """Hamming distance of two sketches."""
    return sum((F.bit_count(F.get(F.col(a), F.lit(k)).bitwiseXOR(F.get(F.col(b), F.lit(k)))) for k in range(SKETCH_BITS // 64)), F.lit(0))


def _may_link(x: str, y: str) -> Column:
    """Sizes and sketches leave it open that the sets of rows ``x`` and ``y`` are linked."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (4 * nx >= 3 * ny) & (4 * ny >= 3 * nx) & (7 * _distance(f"{x}.sketch", f"{y}.sketch") <= nx + ny)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` whose sets are linked: 100 * intersection >= 75 * union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("in_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("in_b"))
    common_size = F.size(F.array_intersect("in_a", "in_b"))
    union = F.size("in_a") + F.size("in_b") - common_size
    return pairs.join(left, "a").join(right, "b").where(100 * common_size >= 75 * union).select("a", "b")


def _across(rest: DataFrame, nearest: bool) -> DataFrame:
    """``a`` and ``b``, the smaller first: the pairs of sets in one part but different components that may be linked.

    With ``nearest`` only the most similar one of such pairs for every two components.

    ``rest`` has part, sets (in the part), least (of their names), salt, name, component, n, sketch. A part of very many sets is cut into chunks
    by name, and every two chunks meet in a group of their own. Parts go to tasks by their least name, since near copies share many
    parts and mostly have one least name in them: a task compares in numpy and gives a pair only once per BLOCK_PAIRS found.
    """
    chunks = F.ceil(F.col("sets") / CHUNK_SETS).cast("int")
    rows = rest.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("name"), "chunks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    rows = rows.select("part", "least", "salt", "chunk", "name", "component", "n", "sketch", other)
    rows = rows.select("least", "salt", "part", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "name", "component", "n", "sketch")

    def near(columns: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, low, high, chunk, name, component, n, lanes = columns
        open_ = (component[left] != component[right]) & ((low[left] == high[left]) | (chunk[left] != chunk[right]))
        open_ &= (4 * n[left] >= 3 * n[right]) & (4 * n[right] >= 3 * n[left])
        left, right = left[open_], right[open_]
        distance = np.zeros(len(left), np.int64)
        for k in range(lanes.shape[1]):
            distance += np.bitwise_count(lanes[left, k] ^ lanes[right, k])
        may = 7 * distance <= n[left] + n[right]
        left, right, distance = left[may], right[may], distance[may]
        ends = [(c[left], c[right]) for c in (component, name)] if nearest else [(name[left], name[right])]
        pairs = [f(x, y) for x, y in ends for f in (np.minimum, np.maximum)]
        return (*pairs, distance / (n[left] + n[right])) if nearest else tuple(pairs)

    def once(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        """Of rows that are equal in the first two columns one, the one least unlike if that is known."""
        columns = [np.concatenate(c) for c in zip(*found)]
        order = np.lexsort((*columns[2:], columns[1], columns[0]))
        columns = [c[order] for c in columns]
        new = np.ones(len(order), bool)
        new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
        return tuple(c[new] for c in columns)

    fields = ["low", "high", "a", "b", "unlike"] if nearest else ["a", "b"]

    def sent(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], fields)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        for columns in _whole_groups(batches):
            part, low, high = columns[:3]
            new = np.ones(len(part), bool)
            new[1:] = (part[1:] != part[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            ends = np.append(np.flatnonzero(new)[1:], len(part))
            at = np.arange(len(part))
            after = ends[np.cumsum(new) - 1] - at - 1  # rows of the group behind each
            upto = np.cumsum(after)
            begin = 0
            while begin < len(at):
                done = upto[begin - 1] if begin else 0
                stop = max(begin + 1, int(np.searchsorted(upto, done + BLOCK_PAIRS, side="right")))
                times = after[begin:stop]
                left = np.repeat(at[begin:stop], times)
                right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
                found.append(near(columns, left, right))
                begin = stop
                if sum(len(f[0]) for f in found) > BLOCK_PAIRS:
                    found = [once(found)]
                    if len(found[0][0]) > BLOCK_PAIRS // 2:
                        yield sent(found.pop())
        if found:
            yield sent(once(found))
        common.release()

    dealt = rows.repartition("least", "salt", "low", "high").sortWithinPartitions("least", "salt", "part", "low", "high")
    met = dealt.drop("least", "salt").mapInArrow(meet, ", ".join(f"{f} {'double' if f == 'unlike' else 'long'}" for f in fields))
    if not nearest:
        return met.distinct()
    return met.groupBy("low", "high").agg(F.min(F.struct("unlike", "a", "b")).alias("best")).select("best.a", "best.b")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows in order of part, low and high, in pieces that hold whole groups; the last column is the sketches' lanes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]]
        columns.append(batch.columns[-1].flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(batch.num_rows, -1))
        last = (columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]) | (columns[2] != columns[2][-1])
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        same = held and all(held[-1][k][-1] == columns[k][0] for k in range(3))
        if held and not same:
            yield [np.concatenate(c) for c in zip(*held)]
            held = []
        if cut:
            held.append([c[:cut] for c in columns])
            yield [np.concatenate(c) for c in zip(*held)]
            held = []
        held.append([c[cut:] for c in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def link(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` per row: the smallest key it reaches over links.

    Equal sets are one node from the start, so copies cost nothing. Links are found as far as components need them: pairs that are in one
    component already are not compared any more.
    Rows whose key is null are linked like others but don't name a component: among such only, it is null.
    Null texts, and texts without words, have no shingles and their own key as component; rows that repeat, or
    share a key, are judged by their own text; no rows give no rows; other columns are not read.
    """
    clashing = np.zeros(0, np.uint64)
    while True:
        rows = materialise(sketched(documents, key, text, clashing), "sketched", common.BATCH_BYTES)
        nodes = rows.where("n > 0").groupBy("name").agg(
            F.min("id").alias("id"), F.min("check").alias("low"), F.max("check").alias("high"), *[F.first(c).alias(c) for c in ("n", "slack_0", "slack_1", "sketch")]
        )
        nodes = materialise(nodes, "nodes")
        # names that two different sets got: some hundred at 10^11 sets, by the birthday bound; those sets take their other digest
        clashes = [r["name"] for r in nodes.where("low <> high").select("name").collect()]
        if not clashes:
            break
        clashing = np.union1d(clashing, np.array(clashes, np.int64).view(np.uint64))
    total = nodes.agg(F.sum("n")).first()[0]
    spark = documents.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (total or 0) // TASK_DIGESTS + 1)
    shared = materialise(shared_parts(documents, text, clashing, tasks), "shared-parts", common.BATCH_BYTES)

    # each set joins on its rarest parts only: of its agreeing parts with a linked one, one is among them
    counts = shared.groupBy("part").agg(F.count("*").alias("sets"))
    ranked = shared.join(counts, "part").groupBy("who").agg(F.sort_array(F.collect_set(F.struct("sets", "part"))).alias("parts"))
    ranked = ranked.select(F.expr("who & ~1L").alias("name"), (F.col("who").bitwiseAND(F.lit(1)) == 1).alias("next"), "parts").join(nodes, "name")
    keep = F.size("parts") - F.greatest(F.when(F.col("next"), F.col("slack_1")).otherwise(F.col("slack_0")), F.lit(0))
    rarest = ranked.where(keep > 0).select("name", F.explode(F.slice("parts", F.lit(1), keep.cast("int"))["part"]).alias("part"))
    joined = materialise(rarest, "rarest-parts")
    sketches = nodes.select("name", "n", "sketch")

    # first one candidate per set: of the smallest names among those that share its parts, the most similar one
    least = joined.groupBy("part").agg(F.min("name").alias("b"))
    star = joined.join(least, "part").where("name <> b").select(F.col("name").alias("a"), "b").distinct()
    x, y = (sketches.select(F.col("name").alias(c), F.struct("n", "sketch").alias(r)) for c, r in (("a", "x"), ("b", "y")))
    near = star.join(x, "a").join(y, "b").where(_may_link("x", "y"))
    best = near.groupBy("a").agg(F.min(F.struct(_distance("x.sketch", "y.sketch").alias("d"), "b"))["b"].alias("b"))
    wanted = joined.select("name").distinct()
    sets = _sets_of(documents, key, text, clashing, wanted, nodes)
    links = materialise(_verified(best, sets), "links")

    # then all pairs of one part that are not yet in one component: the most similar pair of every two components goes first,
    # since the others between two large components need no look once that one is a link
    for nearest in (True, False):
        found = components(links)
        labelled = joined.join(found.withColumnRenamed("node", "name"), "name", "left").withColumn("component", F.coalesce("component", "name"))
        parts = labelled.groupBy("part").agg(F.count("*").alias("sets"), F.min("name").alias("least"), F.min("component").alias("low"), F.max("component").alias("high"))
        open_parts = materialise(parts.where("low <> high").select("part", "sets", "least"), "open-parts")
        # the parts of a least name go to several tasks if there is much to compare
        work = open_parts.groupBy("least").agg(F.ceil(F.sum(F.col("sets") * F.col("sets")) / TASK_PAIRS).alias("spread"))
        open_parts = open_parts.join(work, "least").select("part", "sets", "least", F.pmod(F.xxhash64("part"), "spread").alias("salt"))
        rest = labelled.join(open_parts, "part").join(sketches, "name")
        across = materialise(_across(rest, nearest), "candidates")
        links = materialise(links.unionByName(_verified(across, sets)), "links")
    reached = components(links)
    smallest = nodes.join(reached.withColumnRenamed("node", "name"), "name").groupBy("component").agg(F.min("id").alias("component_id"))
    of_node = reached.join(smallest, "component").select(F.col("node").alias("name"), "component_id")
    own = nodes.select("name", F.col("id").alias("own_id"))
    ids = own.join(of_node, "name", "left").select("name", F.coalesce("component_id", "own_id").alias("component_id"))
    ids = materialise(ids, "component-ids")  # so that a set that very many rows have can be split in the join
    labelled_rows = rows.select("id", "n", F.when(F.col("n") > 0, F.col("name")).alias("name")).join(ids, "name", "left")
    return labelled_rows.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )


def one_per_component(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose key names their component, with all their columns: one of each group of near copies.

    Equal rows (key and text) are one; rows that share a key but not the text go together, if all of them reach a
    smaller key; rows without a key stay. The rows to go are sent to the scan if their ids are few enough to be
    broadcast, and meet the rows by a shuffle otherwise.
    """
    labels = link(documents, key, text).where(F.col(key).isNotNull()).select(F.col(key).alias("id"), "component_id")
    per_key = materialise(labels.groupBy("id").agg(F.count("*").alias("rows"), F.max(F.col("id") == F.col("component_id")).alias("stays")), "labels")

    def ids(condition: Column) -> DataFrame:
        some = per_key.where(condition).select(F.col("id").alias("_gone"))
        return F.broadcast(some) if some.count() <= BROADCAST_IDS else some

    kept = documents.join(ids(~F.col("stays")), F.col(key) == F.col("_gone"), "left_anti")
    repeated = F.col("stays") & (F.col("rows") > 1)
    if not per_key.where(repeated).limit(1).count():
        return kept
    once = kept.join(ids(repeated), F.col(key) == F.col("_gone"), "left_anti")
    again = kept.join(ids(repeated), F.col(key) == F.col("_gone"), "left_semi")
    packed_rows = again.select(F.struct("*").alias("row"), F.col(key).alias("id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("content"))
    return once.unionByName(packed_rows.dropDuplicates(["id", "content"]).select("row.*"))


def _sets_of(documents: DataFrame, key: str, text: str, clashing: np.ndarray, wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node`` and its shingles for the wanted names: one text per name is read again."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text"):
            shingles, of = shingle_sets(block.column("text"))
            n = np.bincount(of, minlength=block.num_rows).astype(np.int64)
            name, _ = _names(shingles, of, n, clashing)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.ListArray.from_arrays(offsets, pa.array(shingles.view(np.int64)))], ["node", "shingles"])

    # rows that share a key with a wanted one give sets of other names, which go again
    ids = materialise(nodes.join(wanted, "name", "left_semi").select("id"), "wanted")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = documents.select(F.col(key).alias("id"), F.col(text).alias("text")).alias("t")
    texts = texts.join(ids.alias("w"), F.col("t.id").eqNullSafe(F.col("w.id")), "left_semi")
    sets = texts.select("text").mapInArrow(work, "node long, shingles array<long>")
    return materialise(sets.join(wanted.withColumnRenamed("name", "node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
