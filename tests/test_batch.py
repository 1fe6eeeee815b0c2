"""The batch run end to end on a small corpus."""


from corpusflow.operators import calls, jobs, tables
from corpusflow.plans.batch import run_batch
from corpusflow.sources import reports


def test_batch_skips_retries_and_cancels(spark):
    rows = [(1, "done before"), (2, "plain text. x"), (3, "boom for ever"), (4, "stop me"), (5, "flaky text")]
    docs = spark.createDataFrame([(i, f"d{i}.txt", f"/c/d{i}.txt", "txt", t) for i, t in rows], "doc_id long, name string, path string, kind string, text string")
    existing = spark.createDataFrame([("/out/d1_解读.md",)], "output_path string")
    cancelled = spark.createDataFrame([(4,)], "doc_id long")
    seen = spark.sparkContext.accumulator(0)

    def model(prompt):
        seen.add(1)
        if "boom" in prompt:
            raise RuntimeError("HTTP_429")
        return "answer", 1, 1

    items = run_batch(docs, existing, calls.CallableClient(model), "ask", "m", "/out/", retries=2, cancelled=cancelled, generated_at="t")
    got = {r.item_id: r for r in items.collect()}
    assert (got[1].status, got[1].skipped, got[1].attempts, got[1].output_path) == ("success", True, 0, "/out/d1_解读.md")
    assert (got[2].status, got[2].attempts, got[2].output_path) == ("success", 1, "/out/d2_解读.md")
    assert "## 解读内容\nanswer" in got[2].report
    assert (got[3].status, got[3].attempts, got[3].error_code) == ("failed", 3, "RATE_LIMITED")
    assert (got[4].status, got[4].error_code, got[5].status) == ("cancelled", "CANCELLED", "success")
    # two good documents once, the bad one three times; nothing is called again
    assert seen.value == 5
    state = jobs.job_state(items).first()
    assert (state.total, state.completed, state.failed, state.cancelled_count, state.skipped_count) == (5, 3, 1, 1, 1)
    sections = reports.batch_report(items, jobs.job_state(items), "now").orderBy("section_no").collect()
    assert len(sections) == 6 and "- 状态：已跳过（沿用已有输出）" in sections[1].content


def test_update_reports_unknown_keys(spark):
    current = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    changes = spark.createDataFrame([("b", 5), ("c", 6)], "k string, v int")
    updated, unknown = tables.update(current, changes, "k")
    assert {tuple(r) for r in updated.collect()} == {("a", 1), ("b", 5)}
    assert [tuple(r) for r in unknown.collect()] == [("c", 6)]
    moved = tables.prepend(current, changes, "v").orderBy("v").select("k").collect()
    assert [r.k for r in moved] == ["b", "c", "a", "b"]
