"""Running tables: repeated batches, bases, late rows."""

import datetime

from pyspark.sql import functions as F

from corpusflow.operators import jobs
from corpusflow.session import scratch_path
from corpusflow.streaming import incremental

ITEMS = "job_id long, status string, skipped boolean"


def test_job_totals_survive_repeats_and_bases(spark):
    rows = [(i % 5, ["success", "failed", "cancelled", "pending"][i % 4], i % 8 == 0) for i in range(140)]
    table = incremental.job_table(scratch_path(spark, "jobs"), compact_every=3)
    batches = [rows[k : k + 20] for k in range(0, 140, 20)]
    for batch, part in enumerate(batches):
        for _ in range(2 if batch in (1, 2, 5, 6) else 1):  # some are repeated, also the ones that became a base
            table.add(spark.createDataFrame(part, ITEMS), batch)
    got = incremental.job_states(table, spark).orderBy("job_id").collect()
    assert got == jobs.job_state(spark.createDataFrame(rows, ITEMS)).select(*got[0].asDict()).orderBy("job_id").collect()
    kept = spark.read.parquet(f"{table.path}/part").groupBy("part").count().collect()
    assert {r.part for r in kept} == {6}  # two bases, and the batch behind them


def test_no_row_is_unaccounted_for(spark, tmp_path):
    schema = "ts timestamp, name string, value double"
    start = datetime.datetime(2024, 1, 1)
    at = lambda s: start + datetime.timedelta(seconds=s)
    batches = [
        [(at(1), "a", 1.0), (at(4), "a", 3.0), (at(100), "b", None)],
        [(at(2), "a", 9.0), (at(95), "b", 4.0), (at(103), "b", 2.0), (at(200), "a", 5.0)],
        [(at(150), "b", 7.0), (at(196), "a", 6.0), (None, "a", 1.0)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = incremental.window_table(scratch_path(spark, "windows"))
    table.run(live, scratch_path(spark, "windows-checkpoint"), **incremental.window_lateness(5000, 30_000))
    late = table.late_rows(spark, schema).collect()
    assert sorted(r.value for r in late) == [1.0, 7.0, 9.0]
    got = {(r.window_start, r.name): (r.average, r.samples) for r in incremental.window_averages(table, spark).collect()}
    assert got == {(at(0), "a"): (2.0, 2), (at(100), "b"): (2.0, 2), (at(95), "b"): (4.0, 1), (at(200), "a"): (5.0, 1), (at(195), "a"): (6.0, 1)}
