"""Report files appear whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from corpusflow.sources import report_sink
from corpusflow.sources.report_sink import FORMAT, filesystem_uri, publish, read_reports, save_reports

ROWS = "file_name string, path string, content string"


def files_of(folder):
    return {n: (folder / n).read_text(encoding="utf-8") for n in os.listdir(folder) if (folder / n).is_file()} if folder.exists() else {}


def leftovers(folder):
    return [os.path.join(at, n) for at, _, names in os.walk(folder) for n in names if "/_" in os.path.join(at, n)]


def test_equal_names_give_files_of_their_own(spark, tmp_path):
    out = tmp_path / "out"
    rows = [("a.md", "/x", "1"), ("a.md", "/y", "2"), ("A.md", "/z", "3"), ("b.md", None, None), ("c.md", "/c", "行\n"), ("c.md", "/c", "行\n"), ("d", "", ""), ("d", "", "e")]
    save_reports(spark.createDataFrame(rows, ROWS).repartition(4), str(out))
    found = files_of(out)
    assert found["b.md"] == "" and found["c.md"] == "行\n" and len(found) == 7
    assert sorted(v for k, v in found.items() if k.lower().startswith("a-")) == ["1", "2", "3"]
    assert all(k.endswith(".md") for k in found if not k.startswith("d")) and leftovers(out) == []
    save_reports(spark.createDataFrame([("b.md", "/b", "new"), ("e.md", "/e", "5")], ROWS), str(out))
    again = files_of(out)
    assert again["b.md"] == "new" and again["e.md"] == "5" and len(again) == 8


def test_failed_job_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    good = spark.range(40).select(F.concat(F.lit("r"), "id").alias("file_name"), F.lit("/p").alias("path"), F.lit("x").alias("content"))
    for bad in ("a/b", "_x", "", None):
        with pytest.raises(Exception, match="not a report's file name"):
            save_reports(good.unionByName(spark.createDataFrame([(bad, "/q", "y")], ROWS)).repartition(4), str(out))
        assert files_of(out) == {} and leftovers(out) == []
        assert publish(spark, str(out)) == 0


def test_death_after_the_commit_is_made_good(spark, tmp_path):
    """A run that was committed but not published, with a dead attempt beside it, and half moved."""
    out = tmp_path / "out"
    spark.dataSource.register(report_sink.ReportSink)
    rows = spark.range(30).select(F.concat(F.lit("r"), "id").alias("file_name"), F.col("id").cast("string").alias("content"))
    rows.repartition(3).write.format(FORMAT).mode("append").save(filesystem_uri(spark, str(out)))
    assert files_of(out) == {}
    run = out / "_staging" / os.listdir(out / "_staging")[0]
    (run / "dead").mkdir()
    (run / "dead" / "r1").write_text("half")
    first = next(d for d in run.iterdir() if d.name != "dead")
    moved = sorted(first.iterdir())[0]
    moved.rename(out / moved.name)
    assert publish(spark, str(out)) == 1 and publish(spark, str(out)) == 0
    assert files_of(out) == {f"r{i}": str(i) for i in range(30)} and leftovers(out) == []


def test_no_rows_and_no_overwriting(spark, tmp_path):
    empty = spark.createDataFrame([], ROWS)
    save_reports(empty, str(tmp_path / "none"))
    assert files_of(tmp_path / "none") == {}
    with pytest.raises(Exception, match="append"):
        empty.write.format(FORMAT).mode("overwrite").save(filesystem_uri(spark, str(tmp_path / "none")))


def test_abort_outlives_tasks_that_still_write(tmp_path, monkeypatch):
    """Files that come while the folder is being deleted, and a folder that comes again, are gone in the end."""
    writer = report_sink._ReportWriter(f"file://{tmp_path}/out", ["file_name", "content"])
    staged = tmp_path / "out" / "_staging" / writer.run
    late, pauses = [staged / "b", staged / "c"], []

    def pause(seconds):
        pauses.append(seconds)
        if late:
            late[0].mkdir(parents=True)
            (late.pop(0) / "r1").write_text("late")

    monkeypatch.setattr(report_sink.time, "sleep", pause)
    (staged / "a").mkdir(parents=True)
    writer.abort([])
    assert not staged.exists() and not late and len(pauses) > 2


def test_files_are_read_back_by_name_in_few_tasks(spark, tmp_path):
    """What was published comes back, odd names and empty files too, and the tasks follow the files' number, not 4 MB each."""
    out = tmp_path / "out"
    rows = [(f"r {i}%20+ü.md", "/p", "x" * i) for i in range(300)] + [("e", "/p", None)]
    names = save_reports(spark.createDataFrame(rows, ROWS).repartition(4), str(out))
    found = read_reports(names, str(out))
    assert found.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(r.file_name, bytes(r.content)) for r in found.collect()} == {(n, (c or "").encode()) for n, _, c in rows}
    assert leftovers(out) == [] and save_reports(spark.createDataFrame([], ROWS), str(out)).count() == 0
