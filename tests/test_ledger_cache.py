"""The call ledger and the living cache: what is called, what is kept, what survives."""

import os
import time

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import cache_log, calls, ledger
from corpusflow.plans.batch import run_batch
from corpusflow.session import scratch_path
from corpusflow.sources import reports

DOCS = "doc_id long, name string, path string, kind string, text string"


def test_a_retry_calls_open_chunks_only(spark):
    body = " ".join(f"word{k}" for k in range(4500))
    probe = spark.createDataFrame([(1, "d.txt", "/c/d.txt", "txt", body)], DOCS)
    seen, failed = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def model(prompt):
        if "word3000 " in prompt:
            failed.add(1)
            raise RuntimeError("HTTP_503")
        seen.add(1)
        return "answer", 1, 1

    items = run_batch(probe, spark.createDataFrame([], "output_path string"), calls.CallableClient(model), "ask", "gpt-4", "/out", retries=2, parallel=4, max_tokens=1000)
    row = items.first()
    assert (row.status, row.attempts) == ("failed", 3)
    chunks = seen.value + 1
    assert chunks >= 5 and failed.value == 3
    # every chunk once, the failing one twice more
    assert seen.value + failed.value == chunks + 2


def test_a_job_that_died_goes_on(spark, tmp_path):
    rows = spark.createDataFrame([(k, 0, f"prompt {k}") for k in range(12)], "doc_id long, index int, prompt string").repartitionByRange(12, "doc_id")
    folder, path = str(tmp_path), scratch_path(spark, "ledger")

    def dies(prompt):
        open(f"{folder}/{prompt}-{time.time_ns()}", "w").close()
        if prompt == "prompt 7":
            time.sleep(3)
            os._exit(1)  # the task is lost, and with it the job
        return prompt.upper(), 1, 2

    with pytest.raises(Exception):
        ledger.resumed_generate(rows, calls.CallableClient(dies), path, "m", parallel=12)
    kept = {r.document for r in ledger.read_ledger(spark, path).collect()}
    assert kept and "7" not in kept

    def lives(prompt):
        open(f"{folder}/{prompt}-{time.time_ns()}", "w").close()
        return prompt.upper(), 1, 2

    before = len(os.listdir(folder))
    done = ledger.resumed_generate(rows, calls.CallableClient(lives), path, "m", parallel=12).collect()
    assert {(r.doc_id, r.reply.content, r.reply.total_tokens) for r in done} == {(k, f"PROMPT {k}", 3) for k in range(12)}
    assert len(os.listdir(folder)) - before == 12 - len(kept)
    # another model or prompt is another request
    other = ledger.resumed_generate(rows.limit(1).withColumn("prompt", F.lit("new")), calls.CallableClient(lives), path, "m").first()
    assert other.reply.content == "NEW"


def _state(spark, path):
    found = cache_log.entries(cache_log.read_log(spark, path)).collect()
    return {r.text: (r.result, r.written_ms, r.last_access_ms, r.access_count) for r in found}


def test_cache_learns_touches_and_compacts(spark):
    path = scratch_path(spark, "cache-log")
    seen = spark.sparkContext.accumulator(0)

    def model(prompt):
        seen.add(1)
        if prompt == "bad":
            raise RuntimeError("no")
        return prompt + "!", 1, 1

    client = calls.CallableClient(model)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["a", "b", "a", "bad", "c"] + ["hot"] * 300)], "id int, text string").withColumn("prompt", F.col("text")).repartition(5)
    first = cache_log.generate(rows, client, path, "m", 1_000_000).collect()
    assert seen.value == 5 and len(first) == 305 and not any(r.hit for r in first)
    again = cache_log.generate(rows, client, path, "m", 2_000_000).collect()
    assert seen.value == 6 and {(r.id, r.reply.content) for r in again if r.hit} == {(r.id, r.reply.content) for r in first if r.reply.content}
    want = {t: (t + "!", 1_000_000, 2_000_000, n) for t, n in (("a", 2), ("b", 1), ("c", 1), ("hot", 300))}
    assert _state(spark, path) == want
    # the rest of a compaction that died is not read, a whole one changes nothing that is read
    cache_log.append(spark.createDataFrame([("m", "x", "put", 5, "x", "lost")], "model string, text_hash string, kind string, at_ms long, text string, result string"), path, into=1)
    assert _state(spark, path) == want
    assert cache_log.compact(spark, path, 2_000_001) == 2 and _state(spark, path) == want
    cache_log.put(spark.createDataFrame([("m", "b", "newer")], "model string, text string, result string"), path, 3_000_000)
    evicted = {r.text for r in cache_log.evict(spark, path, 2, 1 << 60, 3_000_001).collect() if r.evicted}
    assert len(evicted) == 1 and "b" not in evicted
    state = _state(spark, path)
    assert state["b"] == ("newer", 3_000_000, 3_000_000, 0) and set(state) == {"a", "b", "c", "hot"} - evicted
    day = 24 * 3600 * 1000
    cache_log.compact(spark, path, 2_000_000 + day)
    assert set(_state(spark, path)) == {"b"}


def test_equal_names_get_paths_of_their_own(spark):
    rows = [(1, "a.txt", "/x/a.txt"), (2, "a.txt", "/y/a.txt"), (3, "b.txt", "/x/b.txt"), (4, "a.txt", None)]
    names = spark.createDataFrame(rows, "doc_id long, name string, path string")
    found = {r.doc_id: r.output_path for r in reports.own_paths(names, "/out/").collect()}
    assert found == {r.doc_id: r.output_path for r in reports.own_paths(names, "/out/").collect()}
    assert len(set(found.values())) == 4 and found[3] == "/out/b_解读.md" and all(p.startswith("/out/") and p.endswith(".md") for p in found.values())
    docs = names.filter("doc_id < 3").withColumn("kind", F.lit("txt")).withColumn("text", F.lit("some text"))
    client = calls.CallableClient(lambda p: ("ok", 1, 1))
    one = run_batch(docs, spark.createDataFrame([(reports.own_paths(docs, "/out").filter("doc_id = 1").first().output_path,)], "output_path string"), client, "ask", "m", "/out").collect()
    assert {r.item_id: r.skipped for r in one} == {1: True, 2: False}
