"""Sharding by global prefix sums of sizes.

Rows are put into one order, range-partitioned and written once. Each partition's total and a
running sum inside it give every row's place in the whole; the places are cut at equal targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.session import materialise


def running_totals(rows: DataFrame, order: list[str], sums: dict[str, str], name: str) -> DataFrame:
    """Adds, for each ``new: column`` of ``sums``, the sum of ``column`` over all rows before this one.

    ``rows`` is written in range partitions of ``order``; the only global step is a window over one
    row per partition. Rows with equal ``order`` come in any order, so it should name all that matters.
    Null keys come first. Columns named ``_part`` must not exist.
    """
    # the written table fixes the partitions, so that totals and rows can't disagree after a lost task
    stored = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), name)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = totals.select("_part", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = stored.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{n}") for n, c in sums.items()])
    joined = placed.join(before, "_part")
    return joined.select(*rows.columns, *[(F.col(f"_i_{n}") + F.col(f"_b_{n}")).cast("long").alias(n) for n in sums])


def shard_rows(sized: DataFrame, n_shards: int, order: list[str]) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows with a positive ``size``: contiguous shards of near equal size.

    A row lies in the shard in which the middle of its bytes falls, so every shard is within one row of
    total / ``n_shards``; with fewer rows than shards some stay empty. ``slot`` counts from 0 in each
    shard. No rows give no rows; equal rows are placed one behind the other.
    """
    placed = running_totals(sized.withColumn("_one", F.lit(1)), order, {"_bytes": "size", "_rank": "_one"}, "shards")
    total = sized.agg(F.sum("size").alias("_total"))
    shard = F.least(F.lit(n_shards - 1), F.expr(f"((2 * _bytes + size) * {int(n_shards)}) div (2 * _total)")).cast("int")
    cut = placed.join(total).withColumn("shard", shard)
    first = cut.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row per shard
    return cut.join(first, "shard").select(*sized.columns, "shard", (F.col("_rank") - F.col("_first")).alias("slot"))


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def shard_documents(documents: DataFrame, n_shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, size, text_crc32, shard, slot per document; only sizes travel, never texts.

    A null key comes first, a null text counts as empty, repeated rows are placed each on its own;
    other columns of ``documents`` are not read.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    sized = documents.select(
        F.col(key).alias(key), text_size(F.col(text)).alias("size"), F.crc32(F.encode(plain, "UTF-8")).alias("text_crc32")
    )
    return shard_rows(sized, n_shards, [key, "size", "text_crc32"])
