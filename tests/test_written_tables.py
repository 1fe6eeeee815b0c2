"""Written tables leave nothing behind that nothing reads."""

import os
import time

from pyspark.sql import functions as F

from corpusflow.session import discard, materialise


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName() for k in range(files.size())}


def test_a_written_table_leaves_no_shuffle_files(spark):
    kept = spark.range(1000).repartition(4, "id")
    kept.count()
    before = _shuffle_files(spark)
    table = materialise(spark.range(100_000).repartition(3, "id").groupBy(F.col("id") % 7).count(), "unshuffled")
    assert table.count() == 7
    for _ in range(20):
        left = {n for n in _shuffle_files(spark) - before if n.startswith("shuffle") and n.endswith(".data")}
        if len(left) <= 1:  # of the count of the rows itself
            break
        time.sleep(0.1)
    assert len(left) <= 1
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    folder = table._written_at.removeprefix("file://")
    assert os.path.isdir(folder)
    discard(table)
    assert not os.path.exists(folder)
