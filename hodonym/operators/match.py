"""Tiered matching of two sources: a tier sees only the left rows that no tier before it has matched."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Tier:
    """``keys``: (left column, right column, null-safe). Null keys match nothing unless null-safe."""

    name: str
    confidence: float
    keys: tuple[tuple[str, str, bool], ...]


def _runs(tiers: list[Tier]) -> list[list[Tier]]:
    """Consecutive tiers of which each loosens the one before."""
    out: list[list[Tier]] = []
    for t in tiers:
        if out and set(t.keys) <= set(out[-1][-1].keys):
            out[-1].append(t)
        else:
            out.append([t])
    return out


def tiered_match(left: DataFrame, left_id: str, right: DataFrame, right_id: str, tiers: list[Tier]) -> DataFrame:
    """(left_id, right_id, match_type, confidence); many-to-many within a tier. All joins are equi-joins.

    Tiers that only loosen the one before share one join on the loosest keys; a left row keeps the pairs of its first tier that has any,
    which is told within the join's own partitions.
    """
    used_l = [left_id, *dict.fromkeys(a for t in tiers for a, _, _ in t.keys)]
    used_r = [right_id, *dict.fromkeys(b for t in tiers for _, b, _ in t.keys)]
    rest = left.select(*(F.col(c).alias(f"l_{c}") for c in dict.fromkeys(used_l)))
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in dict.fromkeys(used_r)))
    both = lambda t: reduce(lambda x, y: x & y, (F.col(f"l_{x}").eqNullSafe(F.col(f"r_{y}")) if safe else F.col(f"l_{x}") == F.col(f"r_{y}") for x, y, safe in t.keys))
    found: list[DataFrame] = []
    runs = _runs(tiers)
    for k, run in enumerate(runs):
        loosest = run[-1]
        pairs = rest.join(b, both(loosest))
        place = F.lit(len(run) - 1)
        for i in range(len(run) - 2, -1, -1):
            place = F.when(both(run[i]), i).otherwise(place)
        pairs = pairs.withColumn("_tier", place)
        if len(run) > 1:
            near = Window.partitionBy(*(f"l_{x}" for x, _, _ in loosest.keys), f"l_{left_id}")
            pairs = pairs.withColumn("_first", F.min("_tier").over(near)).where("_tier = _first")
        name, sure = (F.element_at(F.array(*(F.lit(getattr(t, x)) for t in run)), F.col("_tier") + 1) for x in ("name", "confidence"))
        found.append(pairs.select(F.col(f"l_{left_id}").alias("left_id"), F.col(f"r_{right_id}").alias("right_id"), name.alias("match_type"), sure.alias("confidence")))
        if k + 1 < len(runs):
            rest = rest.join(b, both(loosest), "left_anti")
    return reduce(DataFrame.unionByName, found)


#: The tiers of the street sources.
EXACT = Tier("exact_type_core", 1.0, (("siruta", "siruta", False), ("core_name_norm", "core_name_norm", False), ("street_type", "street_type", True)))
CORE = Tier("core_only", 0.5, (("siruta", "siruta", False), ("core_name_norm", "core_name_norm", False)))
SWAPPED = Tier("core_swapped", 0.4, (("siruta", "siruta", False), ("core_name_norm", "core_name_norm_swapped", False)))


def coverage(matches: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: matched and all rows of both sides."""
    size = lambda t: t.agg(F.count(F.lit(1))).scalar()
    m = matches.agg(F.countDistinct("left_id").alias("left_matched"), F.countDistinct("right_id").alias("right_matched"))
    return m.withColumns({"left_total": size(left), "right_total": size(right)})


def resolution_ladder(rows: DataFrame, units: DataFrame, direct: str, region: str, place: str, unit_id: str = "siruta", unit_region: str = "region", unit_name: str = "place") -> DataFrame:
    """``rows`` with unit, method and confidence: by code (1.0), by exact name in the region (0.8), by a name that starts with the other (0.5), else unresolved.

    A prefix that fits several units takes the first by id.
    """
    u = units.select(F.col(unit_id).alias("_u"), F.col(unit_region).alias("_r"), F.col(unit_name).alias("_n"))
    known = u.select(F.col("_u").alias("_code")).distinct()
    exact = u.groupBy("_r", "_n").agg(F.min("_u").alias("_exact"))
    out = rows.join(known, rows[direct] == F.col("_code"), "left").join(exact, (F.col(region) == exact["_r"]) & (F.col(place) == exact["_n"]), "left").drop("_r", "_n")
    open_ = out.where("_code is null and _exact is null").select(region, place).distinct()
    near = (F.col("_n").startswith(F.col(place)) | F.col(place).startswith(F.col("_n"))) & (F.length(place) > 0) & (F.length("_n") > 0)
    prefix = open_.join(u, (F.col(region) == F.col("_r")) & near).groupBy(F.col(region).alias("_pr"), F.col(place).alias("_pp")).agg(F.min("_u").alias("_prefix"))
    out = out.join(prefix, (F.col(region) == F.col("_pr")) & (F.col(place) == F.col("_pp")), "left").drop("_pr", "_pp")
    unit = F.coalesce("_code", "_exact", "_prefix")
    method = F.when(F.col("_code").isNotNull(), "direct").when(F.col("_exact").isNotNull(), "name_exact").when(F.col("_prefix").isNotNull(), "name_prefix").otherwise("unresolved")
    sure = F.when(F.col("_code").isNotNull(), 1.0).when(F.col("_exact").isNotNull(), 0.8).when(F.col("_prefix").isNotNull(), 0.5).otherwise(0.0)
    return out.withColumn("unit", unit).withColumn("method", method).withColumn("confidence", sure).drop("_code", "_exact", "_prefix")
