"""Clients, caches, roll-up, fallback and hooks on small fixtures."""

from pyspark.sql import functions as F

from corpusflow import fixed_values as fv
from corpusflow.functions.keys import content_key
from corpusflow.operators import cache, calls, hooks, jobs, tables
from corpusflow.plans.interpret import interpret


def echo(prompt):
    """What the stub answers, as a Python client."""
    content = calls.STUB_MARK + prompt.split("\n")[-1].split(".")[0]
    quarter = lambda n: -(-n // 4)
    return content, quarter(len(prompt)), quarter(len(content))


def failing(prompt):
    if "boom" in prompt:
        raise RuntimeError("HTTP_503")
    return echo(prompt)


def summaries(spark):
    rows = [(n, [f"s{i}. tail" if i != bad else "boom" for i in range(n)]) for n, bad in ((1, -1), (5, -1), (6, -1), (17, -1), (7, 6), (3, 0))]
    return spark.createDataFrame(rows, "n int, s array<string>")


def test_python_rollup_equals_column_rollup(spark):
    df = summaries(spark)
    args = (F.col("s"), F.lit("ask"), F.lit("name"), F.lit("txt"))
    both = df.select(
        "n",
        calls.rolling_summary(calls.StubClient(fail_on="boom"), *args).alias("c"),
        calls.rolling_summary(calls.CallableClient(failing), *args).alias("p"),
    ).orderBy("n").collect()
    for r in both:
        keep = [f for f in calls.ROLLUP_TYPE.names if f != "total_tokens"]
        assert {f: r.c[f] for f in keep} == {f: r.p[f] for f in keep}, r.n
    reasons = {r.n: r.c.degrade_reason for r in both}
    assert reasons[7] == "汇总分块 6-7 时失败: HTTP_503" and reasons[3] == "HTTP_503" and reasons[17] is None


def test_cached_generate_calls_each_missing_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counting(prompt):
        seen.add(1)
        return f"new {prompt}", 1, 1

    rows = [(i, "hot") for i in range(40)] + [(100, "cold"), (101, "kept"), (102, "stale")]
    todo = spark.createDataFrame(rows, "id int, text string").withColumn("prompt", F.col("text"))
    stored = spark.createDataFrame([("kept", 1000), ("stale", -fv.CACHE_TTL_MS)], "text string, written_ms long").select(
        F.lit("m").alias("model"), content_key(F.col("text")).alias("text_hash"), "written_ms", F.concat(F.lit("old "), "text").alias("result")
    )
    out = calls.cached_generate(todo, calls.CallableClient(counting), stored, "m", 2000).collect()
    got = {r.id: (r.hit, r.reply.content) for r in out}
    assert len(out) == 43 and got[101] == (True, "old kept") and got[102] == (False, "new stale")
    assert {got[i] for i in range(40)} == {(False, "new hot")}
    assert seen.value == 3


def test_ttl_is_inclusive_and_has_a_floor(spark):
    df = spark.createDataFrame([(0,), (60000,), (60001,)], "age long")
    got = [r.f for r in df.select(cache.fresh(F.lit(0) - F.col("age"), F.lit(0), 5).alias("f")).collect()]
    assert got == [True, True, False]


def test_eviction_counts(spark):
    df = spark.createDataFrame([(5, False), (100, False), (4, True), (100, True)], "n long, over boolean")
    got = [r.c for r in df.select(cache.eviction_count(F.col("n"), F.col("over")).alias("c")).collect()]
    assert got == [1, 10, 1, 20]


def test_global_rank_is_exact(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("k"), F.col("id"))
    ranked = tables.global_rank(df, [F.col("k"), F.col("id")]).collect()
    assert [r["rank"] for r in sorted(ranked, key=lambda r: (r.k, r.id))] == list(range(1, 5001))


def test_fallback_stops_at_first_success(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "boom"), (3, "boom bang")], "id int, p string")
    clients = [("a", calls.CallableClient(failing)), ("b", calls.StubClient(fail_on="bang")), ("c", calls.StubClient(fail_on="boom"))]
    got = {r.id: (r.used_model, r.reply.error) for r in calls.generate_with_fallback(df, F.col("p"), clients).collect()}
    assert got == {1: ("a", None), 2: ("b", None), 3: (None, "HTTP_503")}


def test_retry_outcome(spark):
    rows = [
        (1, 1, "failed", "HTTP_429"), (1, 2, "success", None),
        (2, 1, "failed", "HTTP_401"), (2, 2, "failed", "请求超时"),
        (3, 1, "cancelled", "任务已取消"),
        (4, 1, "failed", "x"), (4, 2, "failed", "y"), (4, 3, "success", None),
    ]
    df = spark.createDataFrame(rows, "item_id int, attempt int, status string, message string")
    got = {r.item_id: (r.attempts, r.status, r.error_code, r.error_message) for r in jobs.retry_outcome(df, 1).collect()}
    assert got == {
        1: (2, "success", None, None),
        2: (2, "failed", "TIMEOUT", "请求超时"),
        3: (1, "cancelled", "CANCELLED", "任务已取消"),
        4: (2, "failed", "UNKNOWN", "y"),
    }


def test_hooks_run_in_order_and_isolate_failures(spark):
    chain = hooks.Hooks()
    chain.on_text("after_parse", "row", hooks.row_hook(lambda t: t + str(1 // (len(t) - 2))))
    chain.on_text("after_parse", "bad", lambda c: 1 / 0)
    chain.on_text("after_parse", "mark", lambda c: F.concat(c, F.lit("#")))
    df = spark.createDataFrame([("abc",), ("ab",)], "t string")
    assert [r.o for r in df.select(chain.apply("after_parse", F.col("t")).alias("o")).collect()] == ["abc1#", "ab#"]


def documents(spark):
    rows = [(1, "short text. end"), (2, " ".join(f"word{i}." for i in range(900))), (3, "boom " * 400)]
    return spark.createDataFrame(
        [(i, f"d{i}.txt", f"/c/d{i}.txt", "txt", t) for i, t in rows], "doc_id long, name string, path string, kind string, text string"
    )


def test_interpret_inline_equals_spread_calls(spark):
    """The column client in the row, the Python client spread over tasks: same reports."""
    options = {"max_tokens": 300, "generated_at": "t"}
    inline = interpret(documents(spark), calls.StubClient(fail_on="boom"), "ask", "m", **options).orderBy("doc_id").collect()
    spread = interpret(documents(spark), calls.CallableClient(failing), "ask", "m", parallel=4, **options).orderBy("doc_id").collect()
    for a, b in zip(inline, spread):
        assert (a.content, a.error, a.chunking, a.truncation) == (b.content, b.error, b.chunking, b.truncation)
        assert (a.usage.prompt, a.usage.completion) == (b.usage.prompt, b.usage.completion)
    assert [r.error for r in inline] == [None, None, "HTTP_503"] and inline[2].report is None
    assert not inline[0].chunking.enabled and inline[1].chunking.enabled
    assert "## 分块阶段性摘要附录" in inline[1].report and "## 分块阶段性摘要附录" not in inline[0].report


def counting(folder):
    """A client that leaves a file per call."""

    def reply(prompt):
        import os
        import uuid

        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return prompt.rsplit("\n", 1)[-1][:20], 1, 1

    return calls.CallableClient(reply)


def test_no_call_is_repeated_by_a_second_action(spark, tmp_path):
    reports = interpret(documents(spark), counting(str(tmp_path)), "ask", "m", max_tokens=300, generated_at="t")
    made = len(list(tmp_path.iterdir()))
    first, second = reports.collect(), reports.collect()
    assert first == second and len(list(tmp_path.iterdir())) == made
    assert made >= sum(r.chunking.chunk_count for r in first) + 1


def test_call_hooks_see_every_client(spark):
    def hooked(python):
        chain = hooks.Hooks()
        mark = (lambda t: f"<{t}>") if python else None
        chain.on_text("before_call", "ask", hooks.row_hook(lambda t: t) if python else (lambda c: c))
        chain.on_text("after_call", "mark", hooks.row_hook(mark) if python else (lambda c: F.concat(F.lit("<"), c, F.lit(">"))))
        return chain

    got = set()
    for client in (calls.StubClient(fail_on="boom"), calls.CallableClient(failing)):
        for python in (False, True):
            rows = interpret(documents(spark), client, "ask", "m", max_tokens=300, generated_at="t", hooks=hooked(python)).orderBy("doc_id").collect()
            assert rows[0].content.startswith("<") and rows[0].content.endswith(">") and rows[2].error == "HTTP_503"
            assert all(c.startswith("<") for c in rows[1].chunk_summaries)
            got.add((rows[0].content, tuple(rows[1].chunk_summaries)))
    assert len(got) == 1


def test_the_newest_of_several_cache_entries_counts(spark):
    table = spark.createDataFrame([("m", "h", 5, "old"), ("m", "h", 9, "new")], "model string, text_hash string, written_ms long, result string")
    asked = spark.createDataFrame([("m", "h"), ("m", "x")], "model string, text_hash string")
    assert sorted((r.text_hash, r.cached_result) for r in cache.lookup(asked, table, ["model", "text_hash"], 10).collect()) == [("h", "new"), ("x", None)]


def test_interpret_with_cache_reuses_chunk_answers(spark):
    empty = spark.createDataFrame([], "model string, text_hash string, written_ms long, result string")
    options = {"max_tokens": 300, "generated_at": "t", "now_ms": 1}
    plain = interpret(documents(spark), calls.StubClient(), "ask", "m", **options).orderBy("doc_id").collect()
    cached = interpret(documents(spark), calls.StubClient(), "ask", "m", cache=empty, **options).orderBy("doc_id").collect()
    assert [r.chunking.chunk_count for r in plain] == [r.chunking.chunk_count for r in cached]
    assert plain[0].content == cached[0].content and plain[1].chunk_summaries == cached[1].chunk_summaries
