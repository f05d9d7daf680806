"""One row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _one_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Rows are cut to one per key before the shuffle, and columns that are not asked for are not even read."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def min_row_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the smallest ``order`` of every key, whole; null keys group together. ``order`` must be unique within a key."""
    return _one_per_key(df, keys, F.asc_nulls_last(order))


def later_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest ``order`` of every key."""
    return _one_per_key(df, keys, F.desc_nulls_last(order))


def first_wins_groups(df: DataFrame, keys: list[str], order: str, ids: str) -> DataFrame:
    """The first row of every key with the ordered list of all ids of the group as ``ids``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"), F.sort_array(F.collect_list(ids)).alias("ids")).select(*keys, "_row.*", "ids")
