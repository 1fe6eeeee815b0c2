"""Session helper and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "corpusflow", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Give row-heavy work all cores when a scan has fewer splits than cores.

    A large input has many splits and is returned as it is, without a shuffle.
    Meant for plain scans, whose split count is known without running anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.isStreaming or scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a
    machine-local folder would lose data with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="corpusflow-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: While a table is written: what its plan shuffled is deleted as soon as it is over, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, batch_bytes: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used after steps that must not be recomputed (model calls) or whose rows
    must keep their partitions (global ranks). ``batch_bytes`` bounds the Arrow
    batches of this write; by rows alone, batches of whole texts are many times
    what a Python step works on, in the JVM and in the worker. ``discard`` deletes the table.
    """
    path = scratch_path(df.sparkSession, name)
    wanted = {_CLEANUP: "true"}
    if batch_bytes is not None:
        wanted["spark.sql.execution.arrow.maxBytesPerBatch"] = batch_bytes
    conf = df.sparkSession.conf
    before = {key: conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)
    table = df.sparkSession.read.parquet(path)
    table._written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``materialise`` that nothing reads any more: everything made of them is written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
