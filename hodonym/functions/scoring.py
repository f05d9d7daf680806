"""Scores and labels computed from attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Weights of the classes of roads, their order from the lowest, and the bonus of a road number.
ROAD_WEIGHTS = {"primary": 5, "secondary": 4, "tertiary": 3, "unclassified": 2, "residential": 2, "living_street": 1, "pedestrian": 1, "service": 1}
ROAD_ORDER = ["service", "pedestrian", "living_street", "residential", "unclassified", "tertiary", "secondary", "primary"]
ROAD_NUMBER, ROAD_BONUS = r"(?i)\b(DN|DJ|DC|A)\d+", 2.0
# What the causes of death are told by, the first that fits.
CAUSES = {
    "boală": ["tuberculosis", "pneumonia", "typhus", "plague", "cancer", "hepatitis", "nephritis", "infarction", "stroke", "gout", "seizure", "foodborne", "lung", "infectious", "alzheimer", "asphyxia", "disease", "illness"],
    "violență": ["gunshot", "shooting", "execution", "decapitation", "breaking wheel", "poison", "ambush", "murder", "killed"],
    "accident": ["collision", "vehicle", "accident", "earthquake", "invention"],
}
NO_CAUSE, OTHER_CAUSE = "necunoscută", "altele"


def class_rank(c: Column) -> Column:
    """Place in the order of road classes, from 0; -1 for an unknown one."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, ROAD_ORDER)), c).cast("int") - 1, F.lit(-1))


def road_score(road_class: Column, length_m: Column, ref: Column) -> Column:
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in ROAD_WEIGHTS.items() for x in kv])[road_class], F.lit(1))
    bonus = F.when(F.coalesce(ref.rlike(ROAD_NUMBER), F.lit(False)), ROAD_BONUS).otherwise(0.0)
    return weight * F.log1p(F.greatest(F.lit(0.0), F.coalesce(length_m, F.lit(0.0)))) + bonus


def group_zscore(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``name``: the z-score of ``value`` in its group; 0 in a group of one or without spread."""
    w = Window.partitionBy(*by)
    sd, n = F.stddev_pop(value).over(w), F.count(value).over(w)
    return df.withColumn(name, F.when((n < 2) | (sd == 0), 0.0).otherwise((F.col(value) - F.avg(value).over(w)) / sd))


def scope(n: Column, universal: int = 50, national: int = 5) -> Column:
    return F.when(F.coalesce(n, F.lit(0)) == 0, "unknown").when(n >= universal, "universal").when(n >= national, "national").otherwise("local")


def cause_macro(label: Column) -> Column:
    out = F.when(F.coalesce(label, F.lit("")) == "", NO_CAUSE)
    for name, words in CAUSES.items():
        out = out.when(F.lower(label).rlike("|".join(words)), name)
    return out.otherwise(OTHER_CAUSE)


def candidate_confidence(name: Column, label: Column, known: Column) -> Column:
    """0.95 for the same name where something else is known of the person, 0.85 where nothing is, 0.7 for a longer label."""
    return F.when(F.lower(name) == F.lower(label), F.when(known, 0.95).otherwise(0.85)).when(F.contains(F.lower(label), F.lower(name)), 0.7)
