"""Bibliography items and collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import fixed_values as fv


def items_by_collection(items: DataFrame, membership: DataFrame, collection: Column | int) -> DataFrame:
    """Items of one collection; the membership rows are filtered before the join."""
    wanted = membership.filter(F.col("collection_id") == collection).select("item_id")
    return items.join(wanted, "item_id", "left_semi")


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def items_to_files(items: DataFrame, index: Column) -> DataFrame:
    """Items as file references; ``index`` numbers the list from zero."""
    number = (index + 1).cast("string")
    return items.select(
        F.concat(F.lit(fv.BIB_ID_PREFIX), F.coalesce(_given(F.col("item_id").cast("string")), index.cast("string"))).alias("id"),
        F.coalesce(_given(F.col("title")), F.concat(F.lit(fv.BIB_NAME_PREFIX), number)).alias("name"),
        F.coalesce(_given(F.col("file_path")), _given(F.col("url")), F.lit("")).alias("path"),
        F.lit("pdf").alias("ext"),
    )
