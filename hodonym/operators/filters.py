"""Filters over many attributes: values of one dimension are alternatives, dimensions are all required."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hodonym.functions.text import key_slug, match_key
from hodonym.operators.classify import filter_class

MOST, USUAL = 1000, 200
#: Classes by which one can filter.
CLASSES = ("person", "nature", "place", "category", "saint", "date", "numeric")
PERSON_DIMENSIONS = ("profession", "nationality", "gender", "era", "wiki_scope")
#: dimension -> (column, lookup that must have matched)
DIMENSIONS = {"judet": ("judet", None), "street_type": ("street_type", None), **{d: (d, "person") for d in PERSON_DIMENSIONS}, "category": ("category", "category"), "subcategory": ("subcategory", "category"), "nature_type": ("nature_type", "nature"), "place_type": ("place_type", "place"), "place_country": ("country", "place")}
ATTRIBUTES = ["wikidata_qid", "full_name", *PERSON_DIMENSIONS, "category", "subcategory", "nature_type", "place_type", "country"]
Params = Mapping[str, Sequence[str]]


def _has(kind: str) -> Column:
    return F.coalesce(F.col(f"is_{kind}") == 1, F.lit(False)) if kind in ("saint", "date", "numeric") else F.col(f"has_{kind}")


def predicate(params: Params) -> Column:
    """The filter as a column over a star. Unknown dimensions and unknown classes are ignored; texts are taken literally."""
    out = F.lit(True)
    if (name := (params.get("name") or [""])[0].strip()):
        out &= F.contains("name_normalized", F.lit(match_key(name)))
    if unit := (params.get("uat") or [""])[0]:
        out &= F.contains("uat", F.lit(unit.upper()))
    if kinds := [k for k in params.get("classification", ()) if k in CLASSES]:
        any_ = F.lit(False)
        for k in kinds:
            any_ |= _has(k)
        out &= any_
    for d, (column, lookup) in DIMENSIONS.items():
        if values := list(params.get(d, ())):
            out &= F.coalesce(F.col(column).isin(values), F.lit(False))
            if lookup:
                out &= F.col(f"has_{lookup}")
    return out


def filtered_rows(star: DataFrame, params: Params) -> DataFrame:
    """A row per street; ``name_count`` counts the name among all streets, before the filter."""
    counts = star.groupBy("name_normalized").agg(F.count(F.lit(1)).alias("name_count"))
    x = star.where(predicate(params)).join(counts, "name_normalized", "left")
    return x.select("name", "street_type", "uat", "judet", "siruta", "core_name", "name_normalized", "name_count", filter_class().alias("classification"), *ATTRIBUTES, key_slug(F.col("name_normalized")).alias("street_slug"), "id")


def filtered_names(star: DataFrame, params: Params) -> DataFrame:
    """A row per name with the largest attributes; ``name_count`` counts after the filter."""
    flags = ["is_numeric", "is_date", "is_saint", "has_person", "has_nature", "has_place", "has_category"]
    g = star.where(predicate(params)).groupBy("name_normalized").agg(F.max("name").alias("name"), F.max("core_name").alias("core_name"), F.count(F.lit(1)).alias("name_count"), *(F.max(c).alias(c) for c in [*flags, *ATTRIBUTES]))
    return g.select("name_normalized", "name", "core_name", "name_count", filter_class().alias("classification"), *ATTRIBUTES)


def page(df: DataFrame, sort: str = "count", limit: int = USUAL, offset: int = 0) -> DataFrame:
    """One page in a total order: by count, name or location; limit between 1 and ``MOST``, offset not negative."""
    tie = [c for c in ("name_normalized", "street_type", "siruta", "id") if c in df.columns]
    order = {"name": ["name", *tie], "location": ["judet", "uat", "name", *tie]}.get(sort if sort != "location" or "judet" in df.columns else "count", [F.desc("name_count"), "name", *tie])
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, MOST)))


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def meta(star: DataFrame, persons: DataFrame, nature: DataFrame, places: DataFrame, categories: DataFrame) -> DataFrame:
    """(dimension, value): every value by which one can filter."""
    lists = [("judet", star, "judet"), ("street_type", star, "street_type"), *((d, persons, d) for d in PERSON_DIMENSIONS), ("category", categories, "category"), ("subcategory", categories, "subcategory"), ("nature_type", nature, "nature_type"), ("place_type", places, "place_type"), ("place_country", places, "country")]
    out = star.sparkSession.createDataFrame([("classification", c) for c in CLASSES], "dimension string, value string")
    for d, t, c in lists:
        out = out.unionByName(t.where(F.col(c).isNotNull()).select(F.lit(d).alias("dimension"), F.col(c).alias("value")).distinct())
    return out
