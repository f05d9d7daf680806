"""Several sources in one list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["siruta", "street_type", "name", "core_name_norm", "is_saint", "is_date", "is_numeric"]


def consolidate(sources: list[tuple[str, DataFrame]], units: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per (siruta, street_type, core_name_norm or else name) of all sources together.

    name and core_name_norm are the smallest ones, ``variants`` the sorted distinct source|name|type, ``sources`` the sorted sources,
    ``corroboration_count`` their number. judet and uat come from ``units``, else from ``labels``. Null keys group together.
    """
    rows = reduce(DataFrame.unionByName, (t.select(F.lit(n).alias("source"), *COLUMNS) for n, t in sources))
    none = F.lit("")
    variant = F.concat_ws("|", "source", F.coalesce("name", none), F.coalesce("street_type", none))
    key = F.coalesce("core_name_norm", "name")
    g = rows.groupBy("siruta", "street_type", key.alias("k")).agg(
        F.min("name").alias("name"), F.min("core_name_norm").alias("core_name_norm"), F.count_distinct("source").alias("corroboration_count"), F.max(F.when(F.col("source") == "registry", 1).otherwise(0)).alias("in_registry"),
        *(F.max(c).alias(c) for c in ("is_saint", "is_date", "is_numeric")), F.array_join(F.array_sort(F.collect_set(variant)), ";").alias("variants"), F.array_sort(F.collect_set("source")).alias("sources"),
    )
    u = units.select(F.col("siruta").alias("_s"), F.col("judet").alias("_j"), F.col("uat").alias("_u"))
    x = labels.select(F.col("siruta").alias("_s2"), F.col("judet").alias("_j2"), F.col("uat").alias("_u2"))
    out = g.join(u, g.siruta == F.col("_s"), "left").join(x, g.siruta == F.col("_s2"), "left")
    return out.withColumn("judet", F.coalesce("_j", "_j2")).withColumn("uat", F.coalesce("_u", "_u2")).drop("_s", "_j", "_u", "_s2", "_j2", "_u2")


def additive_union(registry: DataFrame, sources: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """The registry and, of each other source, the rows that its matches (right_id) do not hold, tagged with ``source``."""
    cols = ["siruta", "street_type", "name", "name_normalized", "core_name_norm"]
    out = registry.select(F.lit("registry").alias("source"), *cols)
    for name, t, m in sources:
        out = out.unionByName(t.join(m.select(F.col("right_id").alias("id")), "id", "left_anti").select(F.lit(name).alias("source"), *cols))
    return out
