"""Packing of many sources, in bounded blocks, and to a target mixture."""

from collections import Counter, defaultdict

import public_tokenizers
import pytest

from corpusflow.llm import packing


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, " ".join(f"word{k} and{j}" for j in range(30 + k % 7 * 10)), f"s{k % 12:02d}") for k in range(120)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5, "doc_id")


def _windows(pieces, window):
    of, totals, docs = defaultdict(list), Counter(), defaultdict(list)
    for p in pieces:
        of[p.sequence_id].append(p)
        totals[p.source] += p.length
        docs[p.doc_id].append(p)
    for own in docs.values():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == own[0].doc_tokens
    windows = []
    for k in sorted(of):
        at, got = 0, Counter()
        for p in sorted(of[k], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
            got[p.source] += p.length
        assert at == window or k == max(of)
        windows.append(got)
    return windows, totals


@pytest.mark.parametrize("dense, block", [(1024, 1 << 20), (3, 1 << 20), (3, 8)])
def test_sources_beyond_the_dense_ones_keep_their_share_of_every_window(table, monkeypatch, dense, block):
    monkeypatch.setattr(packing, "DENSE_QUEUES", dense, raising=False)
    monkeypatch.setattr(packing, "BLOCK_NUMBERS", block, raising=False)
    monkeypatch.setattr(packing, "MAX_QUEUES", dense, raising=False)  # the name of the cap that merged sources
    pieces = packing.pack(table, public_tokenizers.path("word_bpe_49k.json"), window=256).collect()
    windows, totals = _windows(pieces, 256)
    for got in windows[:-1]:
        assert all(abs(got[s] - 256 * n / sum(totals.values())) <= len(totals) + 1 for s, n in totals.items())


@pytest.mark.parametrize("dense", [1024, 3])
def test_a_target_mixture_holds_until_a_source_is_empty(table, monkeypatch, dense):
    monkeypatch.setattr(packing, "DENSE_QUEUES", dense)
    weights = {f"s{k:02d}": 5.0 if k < 2 else 1.0 for k in range(12)}
    windows, totals = _windows(packing.pack(table, public_tokenizers.path("word_bpe_49k.json"), window=256, mixture=weights).collect(), 256)
    left = dict(totals)
    for got in windows[:-1]:
        for s in got:
            left[s] -= got[s]
        if min(left.values()) <= 256:
            break
        assert all(abs(got[s] - 256 * w / sum(weights.values())) <= len(totals) + 1 for s, w in weights.items())
    assert left != totals
    with pytest.raises(ValueError):
        packing.pack(table, public_tokenizers.path("word_bpe_49k.json"), mixture={"s00": 1})
