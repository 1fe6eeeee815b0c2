"""Prefix trie of conversations by van Emde Boas recursion, as joins and aggregations.

Sequences lie as one row per turn. A level cuts every piece at half its depth: the first half names the cut prefix (a digest of
the name it hangs on and of the half), the second half hangs on that name. Upper and lower halves are cut at the next level
together, so after log2(depth) levels every turn hangs on the name of all that precedes it: the trie. Totals are made the other
way: pieces of the lowest level are complete at once, and each level grafts the totals of all lower forests onto the nodes of the
upper tries they hang on, all at one time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.sharding import running_totals
from corpusflow.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Ids of this many neighbours make one string before they are hashed in order.
CHUNK_BITS = 8
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv``, ``pos`` from 0, the turn's two-part digest ``a``, ``b`` and ``words``, written.

    Places come from a global range-partitioned order, so a conversation may be longer than a task can hold.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    plain = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), F.sha2(text, 256).alias("text_sha"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    placed = running_totals(plain.withColumn("_one", F.lit(1)), ["conv", "turn", "role", "text_sha"], {"place": "_one"}, "turns")
    digests = [F.xxhash64(F.lit(k), "role", "text_sha").alias(c) for k, c in ((1, "a"), (2, "b"))]
    placed = materialise(placed.select("conv", "place", *digests, "words"), "placed-turns")
    first = materialise(placed.groupBy("conv").agg(F.min("place").alias("first")), "first-places")
    return materialise(placed.join(first, "conv").select("conv", (F.col("place") - F.col("first")).alias("pos"), "a", "b", "words"), "ordered-turns")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and all conversations; both written.

    Conversation c takes the first h turns of conversation c - c % 20, then its own from turn h on; h is crc32(c) % 4.
    """
    convs = turns.groupBy("conv").agg(F.count("*").alias("own"))
    name = F.col("conv").cast("string")
    convs = convs.select("conv", "own", (F.crc32(F.encode(name, "UTF-8")) % 4).alias("h"), (F.col("conv") - F.col("conv") % 20).alias("base"))
    convs = materialise(convs, "conversations")
    of_base = convs.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    heads = convs.join(of_base, "base", "left").select("conv", "h", "base", F.least("h", F.coalesce("base_own", F.lit(0))).alias("taken"))
    heads = materialise(heads, "heads")
    # only three turns of a base, at most, are taken, by the 40 conversations around it at most
    opening = turns.where("pos < 3").withColumnRenamed("conv", "base")
    lent = heads.join(opening, "base").where("pos < h").select("conv", "pos", "a", "b", "words")
    kept = turns.join(heads, "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "a", "b", "words")
    return materialise(lent.unionByName(kept), "rebuilt-turns"), convs.select("conv")


def _digest(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def distinct_sequences(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of one conversation per sequence (the smallest ``conv``) with the sequence's ``len`` and ``n`` conversations, and
    ``conv`` with its sequence's ``rep``; both written. Sequences without turns have no rows in the first."""
    whole = [F.bit_xor(_digest(k, "a", "b", "pos")).alias(c) for k, c in ((3, "wa"), (4, "wb"))]
    of_turns = turns.groupBy("conv").agg(F.count("*").alias("len"), *whole)
    named = convs.join(of_turns, "conv", "left").select("conv", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("len", "wa", "wb")])
    named = materialise(named, "named-sequences")
    classes = materialise(named.groupBy("wa", "wb", "len").agg(F.min("conv").alias("rep"), F.count("*").alias("n")), "sequences")
    reps = classes.select(F.col("rep").alias("conv"), "len", "n")
    return materialise(turns.join(reps, "conv"), "sequence-turns"), materialise(named.join(classes, ["wa", "wb", "len"]).select("conv", "rep", "len"), "members")


def named_prefixes(turns: DataFrame) -> tuple[DataFrame, int]:
    """``turns`` with the name (``na``, ``nb``) of the prefix that ends with each, and of the one before it (``ra``, ``rb``); the levels.

    A conversation of n turns takes part in the levels up to log2(n) only.
    """
    longest = turns.agg(F.max("len")).first()[0] or 0
    levels = int(longest).bit_length()
    fresh = turns.select("*", *[F.lit(v).cast("long").alias(c) for c, v in (("ra", 0), ("rb", 0), ("na", None), ("nb", None))])
    pieces = None
    for k in reversed(range(levels)):
        half = 1 << k
        entering = fresh.where((F.col("len") >= half) & (F.col("len") < 2 * half))
        pieces = entering if pieces is None else pieces.unionByName(entering)
        pair, in_upper = F.shiftright("pos", k + 1), F.col("pos").bitwiseAND(half) == 0
        pieces = pieces.withColumn("pair", pair)
        whole = in_upper & (F.col("len") >= F.col("pair") * (2 * half) + half)
        halves = [F.bit_xor(_digest(s, "a", "b", "pos")).alias(c) for s, c in ((5, "ha"), (6, "hb"))]
        cuts = pieces.where(whole).groupBy("conv", "pair").agg(F.first("ra").alias("ua"), F.first("rb").alias("ub"), *halves)
        names = [_digest(s, "ua", "ub", "ha", "hb").alias(c) for s, c in ((7, "ca"), (8, "cb"))]
        cuts = materialise(cuts.select("conv", "pair", *names), "cut-prefixes")
        last = F.col("pos") == F.col("pair") * (2 * half) + (half - 1)
        met = pieces.join(cuts, ["conv", "pair"], "left")
        grown = {c: F.when(last, F.col(cut)).otherwise(F.col(c)) for c, cut in (("na", "ca"), ("nb", "cb"))}
        hung = {c: F.when(~in_upper, F.col(cut)).otherwise(F.col(c)) for c, cut in (("ra", "ca"), ("rb", "cb"))}
        pieces = materialise(met.withColumns(grown | hung).drop("pair", "ca", "cb"), "pieces")
    return (pieces if pieces is not None else fresh), levels


def trie_nodes(pieces: DataFrame) -> DataFrame:
    """A written row per node below the root: name, parent's name, ``conv``, depth, n_convs, ``own`` saved tokens, ``leaf``, the
    conversation ``end`` whose sequence ends here, and the parent's conversation ``up``."""
    depth = F.col("pos") + 1
    nodes = pieces.groupBy("na", "nb").agg(
        F.first("ra").alias("pa"), F.first("rb").alias("pb"), F.min("conv").alias("conv"), F.min(depth).alias("depth"), F.sum("n").alias("n_convs"),
        F.max("words").alias("words"), F.min(F.when(F.col("len") == depth, F.col("conv"))).alias("end"), F.sum(F.when(F.col("len") == depth, F.col("n")).otherwise(0)).alias("n_ends"),
    )
    own = ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    nodes = nodes.select("na", "nb", "pa", "pb", "conv", "depth", "n_convs", own, (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaves"), "end")
    nodes = materialise(nodes, "nodes")
    parents = nodes.select(F.col("na").alias("pa"), F.col("nb").alias("pb"), F.col("conv").alias("up"))
    # nodes right below the root, of which there may be very many, need no join
    below = nodes.where("depth > 1").join(parents, ["pa", "pb"])
    return materialise(below.unionByName(nodes.where("depth = 1").withColumn("up", F.lit(None).cast("long"))), "hung-nodes")


def grafted(nodes: DataFrame, pieces: DataFrame, levels: int) -> DataFrame:
    """``nodes`` with ``saved`` and ``leaves`` summed over their subtrees, written.

    Before level k the sums cover a node's subtree down to the end of its block of 2 ** k depths. The level adds to all nodes above a cut
    in the upper block, found on the path of the cut's own conversation, the totals of the forest below the cut.
    """
    paths = pieces.select("conv", "pos", "na", "nb")
    for k in range(levels):
        at = F.col("depth") - 1  # the depth of the cut that a forest's top hangs on
        tops = nodes.where((at > 0) & (at.bitwiseAND((1 << k + 1) - 1) == 1 << k))
        forests = tops.groupBy("pa", "pb", F.col("up").alias("conv"), F.shiftright((F.col("depth") - 2).cast("long"), k).alias("block"))
        forests = materialise(forests.agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves")).drop("pa", "pb"), "forests")
        above = paths.withColumn("block", F.shiftright("pos", k)).join(forests, ["conv", "block"])
        added = above.groupBy("na", "nb").agg(F.sum("more_saved").alias("more_saved"), F.sum("more_leaves").alias("more_leaves"))
        sums = {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("saved", "leaves")}
        nodes = materialise(nodes.join(added, ["na", "nb"], "left").withColumns(sums).drop("more_saved", "more_leaves"), "grafted")
    return nodes


def ends_hashes(members: DataFrame) -> DataFrame:
    """``rep`` and the SHA-256 of the ids of its sequence's conversations, ascending and comma-joined.

    Neighbouring ids are joined first, by any number of tasks; the strings of a sequence are hashed in order as they
    are read, so no task holds more than one batch of them.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = members.groupBy("rep", F.shiftright("conv", CHUNK_BITS).alias("chunk")).agg(ids.alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, state = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple[int, str]] = []
            for of, some in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist()):
                if of == rep:
                    state.update(b",")
                else:
                    if rep is not None:
                        done.append((rep, state.hexdigest()))
                    rep, state = of, hashlib.sha256()
                state.update(some.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["rep", "ends_sha256"])
        if rep is not None:
            yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([state.hexdigest()])], ["rep", "ends_sha256"])

    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.repartition(tasks, "rep").sortWithinPartitions("rep", "chunk").select("rep", "ids")
    return dealt.mapInArrow(work, "rep long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role, text. Turns go by turn (null first), equal ones by role, then by the text's SHA-256; null roles and texts are
    empty; repeated rows are turns of their own; rows without a conv_id belong to no conversation; no conversations give no
    rows, not even a root; other columns are not read. A conversation without turns after rebuilding is a member of the root.
    """
    turns, convs = rebuilt_turns(ordered_turns(conversations))
    sequences, members = distinct_sequences(turns, convs)
    pieces, levels = named_prefixes(sequences)
    nodes = grafted(trie_nodes(pieces), pieces, levels)
    children = materialise(nodes.groupBy("pa", "pb").agg(F.count("*").alias("n_children")), "children")
    ends = materialise(ends_hashes(members), "ends")

    tops = nodes.where("depth = 1").agg(F.count("*").alias("n_children"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"), F.coalesce(F.sum("leaves"), F.lit(0)).alias("leaves")).first()
    everyone = members.agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.min(F.when(F.col("len") == 0, F.col("rep"))).alias("end")).first()
    root = members.limit(0) if everyone["n"] == 0 else members.where(F.col("conv") == everyone["conv"])
    root = root.select(
        F.col("conv").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(everyone["n"]).cast("long").alias("n_convs"),
        F.lit(tops["n_children"]).cast("long").alias("n_children"), F.lit(max(1, tops["leaves"])).cast("long").alias("n_leaves"), F.lit(tops["saved"]).cast("long").alias("saved_tokens"),
        F.lit(everyone["end"]).cast("long").alias("end"),
    )
    named = children.withColumnsRenamed({"pa": "na", "pb": "nb"})
    below = nodes.join(named, ["na", "nb"], "left").select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.coalesce("up", F.lit(everyone["conv"])).cast("long").alias("parent_conv_id"), F.col("n_convs").cast("long").alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("leaves").cast("long").alias("n_leaves"), F.col("saved").cast("long").alias("saved_tokens"), "end",
    )
    every = root.unionByName(below)
    ended = every.join(ends, every["end"] == ends["rep"]).drop("rep", "end")
    passed = every.where("end IS NULL").drop("end").withColumn("ends_sha256", F.lit(EMPTY_SHA256))
    return ended.unionByName(passed)
