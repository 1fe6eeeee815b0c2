"""Small helpers on tables: fixed rows, exact global ranks, registries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.session import materialise


def fixed_rows(spark: SparkSession, columns: list[str], rows: list[tuple], types: list[pa.DataType]) -> DataFrame:
    """A table of constants as a local relation.

    Its size is known to the optimizer, which then chooses a broadcast on its own.
    """
    data = [pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)]
    return spark.createDataFrame(pa.table(data, names=columns))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Exact one-based rank over all rows without one sorting task.

    Rows are range-partitioned and sorted, written once, and each partition's
    offset is the row count of the partitions before it. The written table keeps
    the ranges stable; ``order`` must end in a unique column.
    """
    position = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = ranged.select("*", F.shiftright(position, 33).alias("_part"), (position.bitwiseAND((1 << 33) - 1)).alias("_pos"))
    stored = materialise(ranked, "ranked")
    # one row per partition: the window below is bounded by the partition count
    sizes = stored.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return (
        stored.join(offsets, "_part")
        .withColumn(name, F.col("_before") + F.col("_pos") + 1)
        .drop("_part", "_pos", "_before")
    )


def upsert(current: DataFrame, changes: DataFrame, key: str, deleted: DataFrame | None = None) -> DataFrame:
    """Changed rows replace rows with their key, new rows come in, deleted keys go out."""
    kept = current.join(changes.select(key), key, "left_anti").unionByName(changes)
    return kept if deleted is None else kept.join(deleted.select(key), key, "left_anti")


def update(current: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Changed rows replace rows with their key; changes of unknown keys come back apart."""
    known = changes.join(current.select(key), key, "left_semi")
    unknown = changes.join(current.select(key), key, "left_anti")
    return current.join(changes.select(key), key, "left_anti").unionByName(known), unknown


def prepend(current: DataFrame, created: DataFrame, position: str) -> DataFrame:
    """Put new rows in front: their positions run below the current minimum.

    Positions among the new rows keep their given order.
    """
    low = current.agg(F.coalesce(F.min(position), F.lit(0))).scalar()
    high = created.agg(F.max(position)).scalar()
    moved = created.withColumn(position, F.col(position) + low - high - 1)
    return current.unionByName(moved)


def reorder(current: DataFrame, ordered: DataFrame, key: str, priority: str) -> DataFrame:
    """Priority becomes the listed position; rows that are not listed go out."""
    return current.drop(priority).join(ordered.select(key, priority), key)
