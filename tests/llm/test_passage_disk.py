"""What the passage step leaves on disk meanwhile, and anchors with many strings."""

import os
import random

import numpy as np
import pytest

from corpusflow.llm import anchors, passages
from corpusflow.session import shared_dir


def test_tables_of_passed_steps_go(spark):
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    shared = "".join(chr(97 + k * k % 23) for k in range(70))
    rows = [(k, f"{k} {shared[k % 3:]} {k}") for k in range(9)]
    cut = passages.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before}
    assert left == {"named", "named-once", "spans"}
    assert [sorted(map(str, cut.collect())) for _ in range(2)][1] and sum(r.n_removed > 0 for r in cut.collect()) == 8


def _crowd(rng, n, groups):
    base = bytes(rng.randrange(97, 101) for _ in range(400))
    strings, of = [], []
    for k in range(n):
        a = rng.randrange(300)
        strings.append(base[a : a + 50 + rng.randrange(31)])
        of.append(k * groups // n)
    return strings, np.array([rng.randrange(1000) for _ in strings]), np.array(of)


@pytest.mark.parametrize("hashes, block", [(None, 1_000_000), (None, 200), (7, 1_000_000)])
def test_windows_by_hash_like_by_suffix_arrays(monkeypatch, hashes, block):
    """Also in small blocks, and where most hashes are those of other windows too."""
    real = anchors.gram_hashes
    rng = random.Random(5)
    for n in (1, 2, 40, 150):
        strings, ids, groups = _crowd(rng, n, min(n, 3))
        wanted = passages.earliest_windows(strings, ids, groups)
        with monkeypatch.context() as m:
            m.setattr(passages, "BLOCK_BYTES", block)
            if hashes:
                m.setattr(anchors, "gram_hashes", lambda data, size: real(data, size) % np.uint64(hashes))
            found = passages.earliest_by_hash(strings, ids, groups)
        assert [list(f) for f in found] == [list(w) for w in wanted]


@pytest.mark.parametrize("strings, gathered", [(128, 40_000), (1, 40_000), (3, 40_000), (1, 1), (1, 3)])
def test_each_way_to_compare_cuts_the_same(spark, monkeypatch, strings, gathered):
    monkeypatch.setattr(passages, "MAX_STRINGS", strings)
    monkeypatch.setattr(passages, "MAX_GATHERED", gathered)
    shared = "".join(chr(97 + k * k * k % 25) for k in range(40))
    # texts that share some 40 bytes only, others with 10 to 60 bytes around them
    rows = [(k, f"{k}{'xyz'[k % 3] * 30}{'ab'[k % 2] * 9}{shared}{'uvw'[k % 3] * 30}{k}") for k in range(24)] * 2
    got = {r.doc_id: r for r in passages.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    seen: dict[str, int] = {}
    for k, text in rows[:24]:
        for at in range(len(text) - 49):
            seen[text[at : at + 50]] = min(k, seen.get(text[at : at + 50], k))
    for k, text in rows[:24]:
        gone = {j for at in range(len(text) - 49) if seen[text[at : at + 50]] < k for j in range(at, at + 50)}
        assert got[k].n_removed == len(gone) and bytes(got[k].kept) == "".join(c for j, c in enumerate(text) if j not in gone).encode()
    assert sum(r.n_removed > 0 for r in got.values()) > 10
