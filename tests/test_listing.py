"""Folders listed and read by tasks give what Spark's file sources give, without the files in the driver."""

import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from corpusflow.plans import catalogue
from corpusflow.sources import files, listing
from corpusflow.streaming import streams

ODD = ["Doc 1.txt", "a%20b.md", "解读 x.TXT", "x#y?z.txt", "c[1]{2}^`|\\\".md", "u　v .txt", "+&=;,@!$'()*~.txt", "_hid.txt", ".dot.txt", "_a=b.txt"]
ODD += ["e.txt.", "new\nline.txt", "z.md\n", "_metadata.txt", "x.txt._COPYING_", "p.pdf", "q.MD", "sub/k=v/deep.txt", "sub/_no/t.txt", "sub/.no/t.txt", "sub/a b/中.md"]


@pytest.fixture
def odd(tmp_path):
    root = tmp_path / "odd one"
    for k, name in enumerate(ODD):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes([f"text {k}".encode(), b" \n", b"\xff\xfe\x00 bytes", "行\r\n﻿".encode()][k % 4])
    (root / "empty.txt").write_bytes(b"")
    os.symlink(root / "Doc 1.txt", root / "link.txt")
    os.symlink(root / "nothing", root / "broken.txt")
    return str(root)


@pytest.mark.parametrize("recursive", [True, False])
def test_files_as_spark_lists_and_reads_them(spark, odd, monkeypatch, recursive):
    if not recursive:  # Spark takes folders with = for partitions then
        os.rename(f"{odd}/sub/k=v", f"{odd}/sub/kv")
    both = []
    for tasks in (True, False):
        with monkeypatch.context() as m:
            if not tasks:
                m.setattr(listing, "tasks_can_list", lambda spark, folder: False)
            found = files.scan_documents(spark, odd, recursive), files.text_rows(spark, odd, recursive)
            texts = found[1].withColumn("text", F.hex(F.col("text").cast("binary")))
            both.append((found[0].collect(), sorted(texts.collect(), key=str), [f.dtypes for f in found]))
    assert both[0] == both[1]
    assert len(both[0][0]) == (14 if recursive else 12) and any("%2520" in r.path for r in both[0][1])


def test_a_folder_larger_than_a_file_of_names(spark, tmp_path, monkeypatch):
    for k in range(57):
        (tmp_path / f"{k}.txt").write_text(f"text {k}")
    monkeypatch.setattr(listing, "LISTED_FILES", 10)
    names = listing.listed_files(spark, str(tmp_path))
    assert len(names.inputFiles()) == 6 and names.count() == 57  # of the written table, none is a document
    assert not any(f.endswith(".txt") for f in files.text_rows(spark, str(tmp_path)).inputFiles())
    assert not any(f.endswith(".txt") for f in files.scan_documents(spark, str(tmp_path)).inputFiles())
    assert sorted(r.text for r in files.text_rows(spark, str(tmp_path)).collect()) == sorted(f"text {k}" for k in range(57))


def test_single_files_patterns_and_missing_folders(spark, odd):
    assert [r.name for r in files.scan_documents(spark, f"{odd}/Doc 1.txt").collect()] == ["Doc 1.txt"]
    assert sorted(r.name for r in files.scan_documents(spark, f"{odd}/*/*b").collect()) == ["中.md"]
    for read in (files.scan_documents, files.text_rows):
        with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
            read(spark, f"{odd}/not there")


def test_each_run_ingests_new_files_once_in_bounded_batches(spark, tmp_path):
    inbox, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    inbox.mkdir()

    def run(k):
        found = streams.ingest_stream(spark, str(inbox), files_per_batch=10, checkpoint=checkpoint).select("name", "path", "text", F.lit(k).alias("run"))
        streams.ingest_available(found, out, checkpoint)

    run(0)  # nothing is there
    for k in range(25):
        (inbox / f"{k} a.txt").write_text(f"text {k}")
    (inbox / "no.log").write_text("x")
    (inbox / "empty.md").write_text("")
    before = len([n for n in os.listdir(f"{checkpoint}/commits") if n.isdigit()])
    run(1)
    assert len([n for n in os.listdir(f"{checkpoint}/commits") if n.isdigit()]) - before >= 3
    run(2)
    (inbox / "new.MD").write_text("late")
    (inbox / "3 a.txt").write_text("changed")  # not a new file
    # a run that finds files and dies before it reads them
    streams.ingest_stream(spark, str(inbox), files_per_batch=10, checkpoint=checkpoint)
    run(3)
    got = sorted((r.run, r.text) for r in spark.read.parquet(out).collect())
    assert got == sorted([(1, f"text {k}") for k in range(25)] + [(3, "late")])
    assert all("%20" in r.path for r in spark.read.parquet(out).where("run = 1").collect())
    listed = spark.read.parquet(f"{checkpoint}/found-files")
    assert listed.count() == 27 and all(r["count"] <= 10 for r in listed.groupBy(F.input_file_name()).count().collect())


def test_a_checkpoint_of_the_other_form_is_refused(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x")
    where = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    streams.ingest_available(streams.ingest_stream(spark, where[0]).select("text"), str(tmp_path / "out"), where[1])
    with pytest.raises(ValueError, match="another form"):
        streams.ingest_stream(spark, where[0], checkpoint=where[1])


def test_the_query_lists_by_tasks(spark, sf_dir, monkeypatch):
    asked = []
    real = listing.listed_files
    monkeypatch.setattr(listing, "listed_files", lambda *a, **k: (asked.append(a[1]), real(*a, **k))[1])
    assert catalogue.QUERIES["stream_ingest"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert len(asked) == 2
