"""Every character comes back, and long words take time with their length only."""

import random
import time

import numpy as np
import public_tokenizers
import pytest

from corpusflow.llm import piece_sampling


@pytest.fixture(scope="module", params=["piece_bpe_32k.model"])
def model(request):
    return piece_sampling.PieceModel(public_tokenizers.path(request.param))


def back(model, texts: list[str]) -> list[str]:
    ids, counts = model.encode(texts, np.arange(len(texts), dtype=np.uint64))
    data, offsets = model.decode(ids, counts)
    return [data.tobytes()[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])]


def test_all_characters(model):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, points[k : k + 4096])) for k in range(0, len(points), 4096)]
    assert back(model, texts) == texts
    for text in ("a\U0010ff41b", "\U0010ff00€\U0010ffe2\U0010fff4x\U0010ffff", "▁ ▁a", "\U0010ffac€"):
        assert back(model, [text]) == [text]


def test_long_words(model):
    rng = random.Random(1)
    began = time.perf_counter()
    long = "".join(rng.choice("abcdefgilnorst") for _ in range(1_000_000))
    texts = [long, "short words " * 3, "x" * 300 + " y", "日本語" * 40_000]
    assert back(model, texts) == texts
    assert time.perf_counter() - began < 60


def test_long_words_are_drawn_like_others(model, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgilnorst") for _ in range(n)) + " tail" for n in (10, 100, 200, 250)]
    keys = np.arange(len(texts), dtype=np.uint64)
    whole = model.encode(texts, keys)
    monkeypatch.setattr(piece_sampling, "LONG_WORD", 5)
    alone = model.encode(texts, keys)
    assert whole[0].tolist() == alone[0].tolist() and whole[1].tolist() == alone[1].tolist()
