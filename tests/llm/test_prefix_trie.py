"""The prefix trie against dictionaries of prefixes, on odd rows, deep conversations and hot groups."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

from corpusflow.llm import prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, pos long, na long, conv string, depth int"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows: list[tuple]) -> list[tuple]:
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, role.encode(), hashlib.sha256(text.encode()).hexdigest(), role, text))
    own = {c: [t[4:] for t in sorted(ts)] for c, ts in turns.items()}
    convs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        convs[c] = own.get(base, [])[:h] + ts[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        path = tuple(convs[c])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(WORD.findall(node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[c] for c in children[node])
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
    out = []
    for node, cs in members.items():
        joined = ",".join(map(str, ends[node]))
        up = members[node[:-1]][0] if node else None
        out.append((cs[0], len(node), up, len(cs), len(children[node]), leaves[node], saved[node], hashlib.sha256(joined.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows: list[tuple], parts: int = 4) -> list[tuple]:
    frame = spark.createDataFrame([(*r, 9, 8, "x", 7) for r in rows], SCHEMA).repartition(parts)
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(frame).select(*NAMES).collect()), key=str)
    assert got == brute(rows)
    return got


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(50_000))
    rows = [
        (0, 0, "user", "hello there"), (0, 1, "assistant", "hi"), (0, 2, "user", "more words here"), (0, 3, "assistant", "bye"),
        (1, None, "user", "null first"), (1, 0, None, None), (1, 0, None, None), (1, 0, "", "tie b"), (1, 0, "", "tie a"), (1, 5, "user", ""),
        (2, 7, "user", "hello there"), (3, 0, "user", "hello there"), (3, 1, "assistant", "hi"), (4, 0, "assistant", "hello there"), (5, 0, "us", "erhello there"),
        (21, 0, "user", "base is absent"), (21, 1, "user", "x"), (22, 0, "user", "only"), (None, 0, "user", "nobody"), (None, None, None, None),
        (-1, 0, "user", "below zero"), (-20, 0, "user", "below zero"), (-20, 1, "a", "two"), (-25, 0, "user", "below zero"), (40, 0, "user", long), (41, 0, "user", long),
        (41, 1, "user", "Ünïcödé   x"), (41, 2, "user", "q"), (41, 3, "user", "r"), (41, 4, "user", "s"),
    ]
    check(spark, rows)
    check(spark, rows[:1])


def test_empty(spark):
    assert check(spark, []) == []
    assert check(spark, [(None, 1, "user", "x")]) == []
    # a conversation whose turns all give way to an absent base is turnless
    lost = next(c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    [root] = check(spark, [(lost, 0, "user", "a"), (lost, 1, "user", "b")])
    assert root[:3] == (lost, 0, None) and root[-1] == hashlib.sha256(str(lost).encode()).hexdigest()


def test_random_trees(spark):
    rng = random.Random(11)
    rows = []
    for c in range(260):
        for t in range(rng.choice([1, 2, 3, 4, 5, 8, 9, 17])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"say {rng.choice('ab')} {'and on ' * rng.randint(0, 1)}"))
    check(spark, rows)


def test_hot_groups_and_depth(spark):
    rng = random.Random(12)
    rows = [(c, t, "user", f"same {t}") for c in range(0, 6000, 4) for t in range(4)]  # one sequence, very many times
    rows += [(c, 0, "user", "same 0") for c in range(1, 900, 4)]
    rows += [(100_000, t, "user", f"deep {t % 7}") for t in range(3000)]  # one conversation with a third of all rows
    rows += [(100_020, t, "user", f"deep {t % 7}") for t in range(2100)]
    rng.shuffle(rows)
    check(spark, rows)
