"""Roads brought together from their ways: one record a road, and its length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hodonym.functions.scoring import class_rank

#: Metres.
EARTH_RADIUS = 6_371_000.0


def merge_ways(ways: DataFrame, keys: list[str], order: str, way_id: str, road_class: str, ref: str) -> DataFrame:
    """One row per ``keys``: the first way's columns, the ids of all ways in ``order``, the highest class and the first road number.

    Of classes of one rank the first seen counts; an empty number is none. Null keys group together.
    """
    rest = [c for c in ways.columns if c not in (*keys, way_id, road_class, ref)]
    has = F.coalesce(F.col(ref), F.lit("")) != ""
    return ways.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), order).alias("_first"), F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(way_id).alias("w")))), lambda x: x["w"]).alias("way_ids"),
        F.max_by(road_class, F.struct(class_rank(F.col(road_class)), -F.col(order))).alias(road_class), F.min_by(F.when(has, F.col(ref)), F.when(has, F.col(order))).alias(ref),
    ).select(*keys, "_first.*", "way_ids", road_class, ref)


def path_lengths(ways: DataFrame, keys: list[str], points: str) -> DataFrame:
    """(keys..., length_m): the length of all ways of a road on the plane around each stretch; a stretch that two ways share counts once.

    ``points`` is an array of structs (lon, lat). Ways of fewer than two points have no length.
    """
    n = F.size(points)
    pairs = F.when(n > 1, F.arrays_zip(F.slice(points, 1, n - 1).alias("a"), F.slice(points, 2, n - 1).alias("b")))
    legs = ways.select(*keys, F.explode(pairs).alias("x")).select(*keys, F.least("x.a", "x.b").alias("a"), F.greatest("x.a", "x.b").alias("b")).distinct()
    mean = F.radians((F.col("a.lat") + F.col("b.lat")) / 2)
    leg = F.hypot(F.radians(F.col("b.lon") - F.col("a.lon")) * F.cos(mean), F.radians(F.col("b.lat") - F.col("a.lat"))) * EARTH_RADIUS
    return legs.groupBy(*keys).agg(F.sum(leg).alias("length_m"))
