"""Classification by precedence: the first rule that holds names the class. The variants differ and are kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOOKUPS = ("person", "nature", "place", "category")


def star(streets: DataFrame, persons: DataFrame, nature: DataFrame, places: DataFrame, categories: DataFrame, key: str = "core_name_norm") -> DataFrame:
    """``streets`` with the four lookups (unique by key) and has_person ... has_category. The planner broadcasts what is small."""
    out = streets
    for name, t, cols in (("person", persons, PERSON), ("nature", nature, ("term", "nature_type")), ("place", places, ("place_name", "place_type", "country")), ("category", categories, ("category", "subcategory"))):
        side = t.select(F.col(key).alias(f"_{name}"), *(c for c in cols if c in t.columns))
        out = out.join(side, F.col(key) == F.col(f"_{name}"), "left").withColumn(f"has_{name}", F.col(f"_{name}").isNotNull()).drop(f"_{name}")
    return out


PERSON = ("full_name", "gender", "birth_year", "death_year", "era", "profession", "nationality", "wikidata_qid", "wiki_scope", "wiki_ro_views", "birth_judet", "cause_of_death_label")


def _rules(*rules: tuple[Column, Column | str], otherwise: Column | str | None) -> Column:
    out = None
    for cond, label in rules:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(F.lit(None).cast("string") if otherwise is None else otherwise)


def _flag(c: str) -> Column:
    return F.col(c) == 1




def coverage_class() -> Column:
    """numeric, date, religious, person, nature, place, category."""
    return _rules((_flag("is_numeric"), "numeric"), (_flag("is_date"), "date"), (_flag("is_saint"), "religious"), *((F.col(f"has_{k}"), k) for k in ("person", "nature", "place", "category")), otherwise="unclassified")


def filter_class() -> Column:
    """numeric, date, saint, person, nature, category, place; null where nothing holds."""
    return _rules((_flag("is_numeric"), "numeric"), (_flag("is_date"), "date"), (_flag("is_saint"), "saint"), *((F.col(f"has_{k}"), k) for k in ("person", "nature", "category", "place")), otherwise=None)


def theme_class() -> Column:
    """As the coverage class, with the subtype of nature and place and the category itself; null if that is null."""
    return _rules(
        (_flag("is_numeric"), "numeric"), (_flag("is_date"), "date"), (_flag("is_saint"), "religious"), (F.col("has_person"), "person"),
        (F.col("has_nature"), F.concat(F.lit("nature_"), F.col("nature_type"))), (F.col("has_place"), F.concat(F.lit("place_"), F.col("place_type"))), (F.col("has_category"), F.col("category")), otherwise="unclassified",
    )


def top_name_class() -> Column:
    return _rules((F.col("has_person"), "person"), (F.col("has_nature"), "nature"), (_flag("is_saint"), "saint"), (_flag("is_date"), "date"), (F.col("has_category"), F.col("category")), otherwise="other")


def macro_class() -> Column:
    """Numbers are not told apart; of the categories only ideological ones count."""
    return _rules((_flag("is_saint"), "saint"), (_flag("is_date"), "date"), (F.col("has_person"), "person"), (F.col("has_nature"), "nature"), (F.col("has_place"), "place"), (F.col("category") == "ideological", "ideologic"), otherwise="other")


def unit_theme_class() -> Column:
    return _rules((_flag("is_saint"), "saint"), (_flag("is_date"), "date"), (_flag("is_numeric"), "numeric"), (F.col("has_person"), "person"), (F.col("has_nature"), "nature"), (F.col("has_place"), "place"), (F.col("category") == "ideological", "ideologic"), otherwise="other")


def municipality_class() -> Column:
    return _rules((F.col("has_person"), "person"), (F.col("has_nature"), "nature"), (_flag("is_saint"), "saint"), otherwise="other")


def street_theme() -> Column:
    """As the macro class, but any subcategory makes an ideologic one."""
    return _rules((_flag("is_saint"), "saint"), (_flag("is_date"), "date"), (F.col("has_person"), "person"), (F.col("has_nature"), "nature"), (F.col("has_place"), "place"), (F.col("subcategory").isNotNull(), "ideologic"), otherwise="other")
