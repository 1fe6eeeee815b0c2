"""Roll-up rounds as rows, events of a batch, repeated calls, eviction by a cut-off."""

import random

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import cache, calls, hooks, ledger
from corpusflow.operators.rollups import rolled_rows
from corpusflow.plans.batch import run_batch
from corpusflow.plans.interpret import interpret
from corpusflow.session import scratch_path

DOCS = "doc_id long, name string, path string, kind string, text string"


@pytest.mark.parametrize("fail_on", [None, "s7 ", "s1 "])
def test_rounds_as_rows_equal_the_fold(spark, fail_on):
    rows = [(k, f"n{k}", "txt", [f"s{i} of {k}. more" for i in range(1, n + 1)]) for k, n in enumerate([1, 5, 6, 13, 0])]
    docs = spark.createDataFrame(rows, "doc_id long, name string, kind string, summaries array<string>")
    client = calls.StubClient(fail_on=fail_on)
    got = rolled_rows(docs, "ask", lambda asked: calls.generate(asked, F.col("prompt"), client))
    fold = docs.filter(F.size("summaries") > 0).select("doc_id", calls.rolling_summary(client, F.col("summaries"), F.lit("ask"), F.col("name"), F.col("kind")).alias("rollup"))
    assert sorted(got.collect()) == sorted(fold.collect()) and got.count() == 4
    none = rolled_rows(docs.filter("doc_id = 4"), "ask", lambda asked: calls.generate(asked, F.col("prompt"), client))
    assert none.columns == ["doc_id", "rollup"] and none.count() == 0


def test_roll_ups_are_in_the_ledger(spark):
    body = " ".join(f"word{k}" for k in range(4500))
    docs = spark.createDataFrame([(1, "d.txt", "/c/d.txt", "txt", body)], DOCS)
    path, made = scratch_path(spark, "ledger"), spark.sparkContext.accumulator(0)

    def model(prompt):
        made.add(1)
        return "answer", 1, 1

    first, second = (interpret(docs, calls.CallableClient(model), "ask", "gpt-4", max_tokens=1000, ledger=path).first() for _ in range(2))
    assert first == second and first.chunking.chunk_count > 5
    rounds = -(-first.chunking.chunk_count // 5)
    assert made.value == first.chunking.chunk_count + rounds
    assert {r.chunk for r in ledger.read_ledger(spark, path).collect()} == {*range(first.chunking.chunk_count), *range(-rounds, 0)}


def test_events_of_a_batch(spark):
    rows = [(1, "d1.txt", "/c/d1.txt", "txt", "plain"), (2, "d2.txt", "/c/d2.txt", "txt", "boom"), (3, "d3.txt", "/c/d3.txt", "txt", "done")]
    seen, chain = [], hooks.Hooks()

    def broken(df):
        raise ValueError("observer")

    for stage in hooks.OBSERVER_STAGES:
        chain.on_event(stage, "broken", broken)
        chain.on_event(stage, "note", lambda df, stage=stage: seen.append((stage, df.columns, df.count())))
    chain.on_text("after_call", "mark", lambda c: F.concat(c, F.lit("!")))
    existing = spark.createDataFrame([("/out/d3_解读.md",)], "output_path string")
    items = run_batch(spark.createDataFrame(rows, DOCS), existing, calls.StubClient(fail_on="boom"), "ask", "m", "/out", retries=1, hooks=chain)
    assert [(stage, n) for stage, _, n in seen] == [("batch_before", 3), ("before_parse", 2), ("before_parse", 1), ("batch_after", 3)]
    assert "output_path" in seen[0][1] and "text" not in seen[1][1] and "status" in seen[3][1]
    assert {r.item_id: r.status for r in items.collect()} == {1: "success", 2: "failed", 3: "success"}
    assert "plain!" in items.filter("item_id = 1").first().report


def test_direction_calls_have_hooks_and_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def direction(prompt):
        made.add(1)
        return "asked" if "<<" in prompt else "unasked", 1, 1

    docs = spark.createDataFrame([(1, "d.txt", "/c/d.txt", "txt", "a text")], DOCS)
    chain = hooks.Hooks()
    chain.on_text("before_call", "mark", hooks.row_hook(lambda p: "<<" + p))
    for chosen in (None, chain):
        before = made.value
        done = interpret(docs, calls.StubClient(), "ask", "m", direction_client=calls.CallableClient(direction), hooks=chosen)
        assert done.collect() == done.collect()
        assert made.value == before + 1


def test_calls_wait_and_repeat(monkeypatch):
    waits, asked = [], {}
    monkeypatch.setattr(calls.time, "sleep", waits.append)

    def model(prompt):
        asked[prompt] = asked.get(prompt, 0) + 1
        if prompt == "closed":
            raise ValueError("HTTP_401")
        if prompt == "never" or (prompt == "third" and asked[prompt] < 3):
            raise ValueError("HTTP_4030 busy")
        return prompt.upper(), 1, 1

    found = calls.CallableClient(model, attempts=5).replies(["good", "closed", "third", "never"])
    assert [(r[0], r[-1]) for r in found] == [("GOOD", None), (None, "HTTP_401"), ("THIRD", None), (None, "HTTP_4030 busy")]
    assert asked == {"good": 1, "closed": 1, "third": 3, "never": 5} and waits == [4, 8, 10, 10]
    assert calls.CallableClient(model).reply("never")[-1] == "HTTP_4030 busy" and len(waits) == 4


def test_cutoff_equals_the_rank(spark):
    rng = random.Random(5)
    rows = [(rng.choice([7, 7, rng.randrange(10**12)]), "".join(rng.choices("abé😀", k=rng.randrange(6))) + str(i)) for i in range(400)]
    rows += [(None, "null"), (7, "a")]
    table = spark.createDataFrame([(t, k, "t", "r", "m") for t, k in rows], "last_access_ms long, key string, text string, result string, model string").repartition(5)
    order = sorted((t or 0, k) for t, k in rows)
    for count in (60, 250, 500):
        for buckets, take in ((16, 3), (4096, 10_000)):
            assert cache.lru_cutoff(table, count, buckets, take) == order[min(count, len(order)) - 1]
    assert cache.lru_cutoff(table, 0) is None and cache.lru_cutoff(table.limit(0), 3) is None
    marked = cache.evict_marked(table, 100, 1 << 60, 4, 8)
    assert sorted((r.last_access_ms or 0, r.key) for r in marked.filter("evicted").collect()) == order[:40]
    assert cache.evict_marked(table, 1000, 1 << 60).filter("evicted").count() == 0
    assert cache.evict_marked(table, 1000, 1, 4, 8).filter("evicted").count() == 80
    assert cache.evict_marked(table.limit(0), 0, 1).count() == 0
