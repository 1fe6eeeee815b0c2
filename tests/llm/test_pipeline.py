"""The stages of the corpus pipeline against plain Python."""

from __future__ import annotations

import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusflow.llm import language
from tests.llm.test_operators import _cut_by_hand, odd, odd_rows  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        tables.append(docs)
    return tables


def test_stages_keep_the_columns(stages):
    assert all(t.columns == stages[0].columns for t in stages[1:-1])


def test_quality_stage(stages):
    def good(text):
        words = WORD.findall(text or "")
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
        return len(words) >= 10 and 100 * len(covered) <= 20 * len(words)

    kept = {r.doc_id for r in stages[1].collect()}
    fit = {r.doc_id for r in stages[0].collect() if good(r.text)}
    assert kept <= fit and len(kept) > 0.95 * len(fit)


def test_language_stage(spark, stages):
    """What the stage's model is sure of stays, and nothing else; what has no letter goes."""
    good = stages[1]
    model = language.fit(good.where(~language.is_held_out(F.col("doc_id"))))
    rows = good.collect()
    scores, letters = model.scores([r.text for r in rows])
    sure = {r.doc_id for r, s, n in zip(rows, scores.max(axis=1), letters) if n and s >= corpus_pipeline.MIN_LANGUAGE_SCORE}
    kept = {r.doc_id for r in stages[2].collect()}
    near = {r.doc_id for r, s in zip(rows, scores.max(axis=1)) if abs(s - corpus_pipeline.MIN_LANGUAGE_SCORE) < 1e-4}  # sums in another order
    assert kept - near == sure - near and len(kept) >= 0.99 * len(rows)
    digits = good.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit("12 34 56 78 90 12 34 56 78 90 11")).otherwise(F.col("text")))
    assert {r.doc_id % 2 for r in corpus_pipeline.known_language(spark, digits, "").select("doc_id").collect()} == {1}


def test_join_stage(stages):
    rows = {r.doc_id: r.text for r in stages[2].collect()}
    sets = {}
    for i, t in rows.items():
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    left, best = {}, {i: i for i in rows}
    for i in sorted(rows):  # groups grow with the smallest id
        linked = [j for j in left if 4 * len(sets[i]) >= 3 * len(sets[j]) and 4 * len(sets[j]) >= 3 * len(sets[i]) and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
        best[i] = min([best[j] for j in linked], default=i)
        old = {best[j] for j in linked}
        best = {k: best[i] if v in old else v for k, v in best.items()}
        left[i] = True
    assert {r.doc_id for r in stages[3].collect()} == {i for i, v in best.items() if v == i}


def test_passage_stage(stages):
    before = [(r.doc_id, (r.text or "").encode()) for r in stages[3].collect()]
    gone = _cut_by_hand(before)
    after = {r.doc_id: r for r in stages[4].collect()}
    assert len(after) == len(before)
    for i, t in before:
        kept, at = bytearray(), 0
        for c in t.decode():  # a character goes if one of its bytes does
            size = len(c.encode())
            if not any(gone[i][at : at + size]):
                kept += c.encode()
            at += size
        assert after[i].n_chars == len(after[i].text)
        assert after[i].text.encode() == kept
    assert any(any(m) for m in gone.values())


def test_packing_stage_holds_all_tokens(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in stages[4].collect())
    assert stages[5].agg(F.sum("length")).first()[0] == want


def test_stages_take_odd_rows(spark, odd, sf_dir):  # noqa: F811
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, odd, sf_dir)
        assert made.count() > 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.columns == odd.columns
            assert made.where("doc_id = 7").count() == (0 if name == "language_id" and made.where("doc_id = 7").count() == 0 else 1)
