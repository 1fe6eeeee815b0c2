"""Real files, sinks, and streams over several batches."""

import os

from pyspark.sql import functions as F

from corpusflow.functions.keys import file_kind
from corpusflow.operators import jobs
from corpusflow.sources import files, reports
from corpusflow.streaming import streams


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_scan_kinds_recursion_and_order(spark, tmp_path):
    for name in ("b.TXT", "a.md", "sub/c.pdf", "sub/d.docx", "sub/deep/e.Md"):
        write(tmp_path, name, "x")
    deep = files.scan_documents(spark, str(tmp_path)).collect()
    assert [(r.name, r.ext) for r in deep] == [("a.md", "md"), ("b.TXT", "txt"), ("c.pdf", "pdf"), ("e.Md", "md")]
    flat = files.scan_documents(spark, str(tmp_path), recursive=False).collect()
    assert [r.name for r in flat] == ["a.md", "b.TXT"]


def test_scan_reads_no_content(spark, tmp_path):
    write(tmp_path, "a.txt", "x")
    plan = files.scan_documents(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_blank_files_go_to_quarantine(spark, tmp_path):
    write(tmp_path, "good.txt", "two\nlines\n")
    write(tmp_path, "blank.md", " \n　\t")
    docs, quarantine = files.read_text_documents(spark, str(tmp_path))
    assert [(r.name, r.kind, r.text) for r in docs.collect()] == [("good.txt", "txt", "two\nlines\n")]
    assert [r.error for r in quarantine.collect()] == ["EMPTY_CONTENT"]


def test_custom_parser_routing(spark):
    df = spark.createDataFrame([("a.TEX",), ("b.md",), ("c.zip",)], "name string")
    got = files.route_by_kind(df, {"tex": None}).collect()
    assert [(r.kind, r.error) for r in got] == [("tex", None), ("md", None), (None, "UNSUPPORTED_TYPE")]
    parsers = {"md": lambda d: d.select("name", F.lit("m").alias("by")), "tex": lambda d: d.select("name", F.lit("t").alias("by"))}
    routed = files.route_by_kind(df, {"tex": None})
    assert {(r.name, r.by) for r in files.parse_by_kind(routed, parsers).collect()} == {("a.TEX", "t"), ("b.md", "m")}
    assert spark.range(1).select(file_kind(F.lit("x.md5")).alias("k")).first().k is None


def test_reports_are_whole_files(spark, tmp_path):
    df = spark.range(30).select(F.concat(F.lit("r"), "id", F.lit("_解读.md")).alias("file_name"), F.repeat(F.lit("行\n"), 50).alias("content"))
    reports.write_reports(df.repartition(4), str(tmp_path / "out"))
    names = sorted(os.listdir(tmp_path / "out"))
    assert len(names) == 30 and not any(n.endswith(".part") for n in names)
    assert (tmp_path / "out" / "r7_解读.md").read_text(encoding="utf-8") == "行\n" * 50


def test_batch_report_parts_read_in_order(spark, tmp_path):
    items = spark.range(200).select(
        (F.col("id") % 2).alias("job_id"), F.col("id").alias("item_id"), F.concat(F.lit("f"), "id").alias("name"),
        F.lit("success").alias("status"), F.lit(False).alias("skipped"), F.lit(1).alias("attempts"),
        F.lit(None).cast("string").alias("output_path"), F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_message"),
    )
    sections = reports.batch_report(items, jobs.job_state(items), "now")
    reports.write_sections(sections, str(tmp_path / "batch"))
    parts = sorted(p for p in os.listdir(tmp_path / "batch") if p.startswith("part-"))
    body = "".join((tmp_path / "batch" / p).read_text(encoding="utf-8") for p in parts)
    heads = [line for line in body.split("\n") if line.startswith("# ") or line.startswith("### ")]
    want = []
    for job in (0, 1):
        want += ["# 批处理报告"] + [f"### f{i}" for i in range(job, 200, 2)]
    assert heads == want


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_sse_stream_over_batches(spark, tmp_path):
    """Pieces of one call that arrive in three batches come out as one row at its end mark."""
    piece = 'data: {"choices":[{"delta":{"content":"%s"}}]}'
    usage = 'data: {"choices":[],"usage":{"prompt_tokens":%d}}'
    drops = [
        [(1, 0, piece % "a"), (2, 0, piece % "x"), (1, 1, usage % 3)],
        [(1, 2, "data: {oops"), (1, 3, piece % "b"), (1, 4, usage % 9)],
        [(1, 5, piece % "c"), (1, 6, "data: [DONE]")],
    ]
    for i, rows in enumerate(drops):
        df = spark.createDataFrame(rows, "call_id long, line_no long, line string")
        df.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    got = streams.appended(streams.sse_stream(stream_of(spark, tmp_path / "in", df.schema)), "sse-test").collect()
    assert [(r.call_id, r.content, r.prompt_tokens, r.total_tokens) for r in got] == [(1, "abc", 3, None)]


def test_job_state_stream_equals_batch_over_batches(spark, tmp_path):
    schema = "job_id long, status string, skipped boolean"
    rows = [(i % 3, ["success", "failed", "cancelled", "pending"][i % 4], i % 8 == 0) for i in range(60)]
    for part in (rows[:20], rows[20:45], rows[45:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    live = stream_of(spark, tmp_path / "in", schema)
    got = streams.snapshots(streams.job_state_stream(live), "state-test").orderBy("job_id").collect()
    assert got == jobs.job_state(spark.createDataFrame(rows, schema)).orderBy("job_id").collect()


def test_rate_stream_over_batches(spark, tmp_path):
    schema = "event_id long, ts_ms long, caller long"
    times = [0, 1000, 2000, 3000, 4000, 5000, 59999, 60000, 64999, 120000]
    for part in (times[:4], times[4:7], times[7:]):
        rows = [(t, t, 1) for t in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    live = stream_of(spark, tmp_path / "in", schema)
    got = {r.event_id: (r.in_window, r.wait_ms) for r in streams.appended(streams.rate_stream(live, "caller", bucket_ms=60000), "rate-test").collect()}

    def plain(t):
        recent = [u for u in times if t - 60000 < u < t]
        return len(recent), 60000 - (t - recent[0]) + 100 if len(recent) >= 5 else 0

    assert got == {t: plain(t) for t in times}


def test_documents_and_blank_files_in_one_pass(spark, tmp_path):
    for name, text in (("a.txt", "x"), ("b.MD", " \n"), ("c.log", "y"), ("d.md", "")):
        write(tmp_path, name, text)
    rows = files.text_rows(spark, str(tmp_path))
    got = sorted((r.path.rsplit("/", 1)[1], r.kind, r.text, r.error) for r in rows.collect())
    assert got == [("a.txt", "txt", "x", None), ("b.MD", "md", None, "EMPTY_CONTENT")]  # d.md has no bytes
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_parsers_in_the_row(spark):
    rows = [("a.TEX", "@x@", 1), ("b.md", "y", 2), ("c.zip", "z", 3), ("d.txt", "t", 4), ("e.tex", "@@", 5), ("f.md", None, 6), ("", "q", 7), (None, "n", 8)]
    df = spark.createDataFrame(rows, "name string, content string, id int")
    parsed = files.parse_in_row(df, {"md": F.upper, "tex": lambda c: F.replace(c, F.lit("@"), F.lit(""))})
    got = {r.id: (r.kind, r.text, r.error) for r in parsed.collect()}
    missing, empty = "UNSUPPORTED_TYPE", "EMPTY_CONTENT"
    assert got == {
        1: ("tex", "x", None), 2: ("md", "Y", None), 3: (None, None, missing), 4: ("txt", None, missing),
        5: ("tex", None, empty), 6: ("md", None, empty), 7: (None, None, missing), 8: (None, None, missing),
    }
    assert files.parse_in_row(df.limit(0), {"md": F.upper}).count() == 0


def test_ingested_files_come_in_bounded_batches(spark, tmp_path):
    for k in range(25):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.txt").write_text(f"text {k}")
    found = streams.ingest_stream(spark, str(tmp_path / "in"), files_per_batch=10).select("name", "text")
    streams.ingest_available(found, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert len([n for n in os.listdir(tmp_path / "checkpoint" / "commits") if n.isdigit()]) == 3
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(f"text {k}" for k in range(25))
    assert spark.conf.get("spark.sql.files.openCostInBytes", None) in (None, "4194304b", "4194304", "4MB")
