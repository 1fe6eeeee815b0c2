"""The filter audit against a plain count over all orders, and on odd rows."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from corpusflow.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int, n long, part string"


def fails(text: str, key, rows: list[tuple]) -> str:
    words = WORD.findall(text)
    found = "A" if len(words) < 200 else ""
    found += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    found += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
    found += "D" if re.search("[#$%&*|]", text) else ""
    copies = [k for k, t, *_ in rows if k is not None and key is not None and (t or "") == text and k < key]
    return found + ("E" if copies else "")


def brute(rows: list[tuple], labels: list[tuple]) -> set[tuple]:
    good = {d for d, q, *_ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t, *_ in labels if t == 1 and d is not None}
    judged = [(lang or "", key, fails(text or "", key, rows)) for key, text, lang, *_ in rows]
    out = {}
    for part in {p for p, _, _ in judged}:
        own = [(k, f) for p, k, f in judged if p == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(k, f) for k, f in left if letter in f]
                left = [(k, f) for k, f in left if letter not in f]
                shapley[letter] += len(gone)
                hit = sum(letter in f for _, f in own)
                out[part, order, step] = [
                    len(left), len(gone), hit - len(gone), sum(f == letter for _, f in own), sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone)
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def odd_rows() -> list[tuple]:
    many = " ".join(f"w{k}" for k in range(300))
    few = "a b c d " * 80
    texts = [
        (1, None, "en"), (2, "", "en"), (3, "", None), (4, many, "de"), (5, many, "de"), (6, many, ""), (7, many + " #", None), (8, few, "en"),
        (9, "É" * 40 + "A", "fr"), (10, "ÉÉ AB", "fr"), (5, many, "de"), (None, many, "de"), (None, many, "de"), (4, few, "en"), (11, many + "A" * 60, "en"),
        (12, " ".join(f"v{k}é" for k in range(90_000)), "en"), (0, "x|y" * 3, "de"),
    ]
    return [(i, t, lang, "shard", 7, b"x", 5) for i, t, lang in texts]


SCHEMA = "doc_id long, text string, lang string, part string, mask int, digest binary, n long"


def rows_of(frame) -> set[tuple]:
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = [tuple(r) for r in frame.select(*names).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_odd_rows(spark, monkeypatch):
    labels = [(1, 1, 0), (4, 0, 1), (4, 1, None), (5, 1, 1), (8, None, 1), (None, 1, 1), (99, 1, 1), (0, 1, 1)]
    labels = [(*r, 1, "en") for r in labels]
    frame = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    got = rows_of(filter_audit.audit(frame, spark.createDataFrame(labels, LABELS)))
    assert got == brute(odd_rows(), labels)
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 50)  # a shard per text, or few
    assert rows_of(filter_audit.audit(frame, spark.createDataFrame(labels, LABELS))) == got


def test_empty_tables(spark):
    documents, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(documents, labels).count() == 0
    some = spark.createDataFrame(odd_rows(), SCHEMA)
    assert rows_of(filter_audit.audit(some, labels)) == brute(odd_rows(), [])


def test_matrix_holds_every_word(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 100_000)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = filter_audit.local_shards(documents, "doc_id", "lang", "text")
    encoded = filter_audit.encoded_words(shards)
    pairs = filter_audit.dictionary(encoded).collect()
    word = {r.term: r.word for r in pairs}
    assert shards.count() > 3 and len(word) == len(set(word.values())) == len(pairs)
    found = {}
    for shard in filter_audit.matrix(shards, encoded).collect():
        starts, terms, counts = np.frombuffer(shard.starts, np.int32), np.frombuffer(shard.terms, np.int64), np.frombuffer(shard.counts, np.int32)
        for k, row in enumerate(shard.rows):
            a, b = starts[k], starts[k + 1]
            found[row.key] = Counter({word[t]: n for t, n in zip(terms[a:b].tolist(), counts[a:b].tolist())})
    assert found == {r.doc_id: Counter(WORD.findall(r.text or "")) for r in documents.collect()}


@pytest.mark.parametrize("text", ["", " \n", "one"])
def test_one_text(spark, text):
    frame = spark.createDataFrame([(1, text, None, "", 1, b"", 1)], SCHEMA)
    labels = spark.createDataFrame([], LABELS)
    rows = filter_audit.audit(frame, labels).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [r.removed for r in rows] == [1, 0, 0, 0, 0] and rows[0].unique_fails == 1 and rows[0].shapley == 120
