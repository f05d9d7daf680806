"""The queries of the training-data problems, with the SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hodonym.llm.canonical_values import Dictionary, dictionary, mapped_values
from hodonym.llm.format_duplicates import copy_counts, format_duplicates
from hodonym.llm.leakage import WINDOW, leaked_passages
from hodonym.llm.packing import container_use, pack_containers
from hodonym.llm.person_names import person_groups, same_person_pairs
from hodonym.llm.skeletons import look_alike_groups, look_alike_pairs
from hodonym.llm.sql import LLM_SQL  # noqa: F401
from hodonym.llm.street_linkage import cadastre_side, registry_side, street_links
from hodonym.llm.survivors import street_survivors
from hodonym.llm.term_counts import item_counts, mark_items
from hodonym.session import table

NAME_FIELDS = ["core_name_norm", "name_normalized"]


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    types = road_dictionary(spark, d)
    return street_links(registry_side(table(spark, d, "streets"), types), cadastre_side(table(spark, d, "renns_streets"), table(spark, d, "uat_reference"), types))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_links(spark, d).select("street_id", "renns_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates(table(spark, d, "streets"), "id", "artera_raw", ["judet", "uat"])


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return copy_counts(table(spark, d, "streets"), "id", "artera_raw", ["judet", "uat"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return same_person_pairs(table(spark, d, "persons"), table(spark, d, "postal_streets"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return person_groups(table(spark, d, "persons"), table(spark, d, "postal_streets"))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "streets")
    return mark_items(item_counts(s, NAME_FIELDS), s)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_counts(spark, d).where("mark is not null").select("field", "kind", "item", "mark")


def road_dictionary(spark: SparkSession, d: str) -> Dictionary:
    """The types of road_types; ranked by how often each is the type of a street."""
    return dictionary(table(spark, d, "road_types"), "road_type", "abbreviation", table(spark, d, "streets"), "street_type")


def p6_survivors(spark: SparkSession, d: str) -> DataFrame:
    return street_survivors(table(spark, d, "streets"), road_dictionary(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_survivors(spark, d).select("first_id", "name", "core_name", "street_type")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    types = table(spark, d, "road_types")
    typed = table(spark, d, "renns_streets").select(F.lit("renns_streets").alias("table_name"), F.col("id").alias("row_id"), F.col("road_type_raw").alias("typed"))
    typed = typed.unionByName(table(spark, d, "postal_streets").select(F.lit("postal_streets").alias("table_name"), F.col("id").alias("row_id"), F.col("street_type").alias("typed")))
    odd = typed.where("typed is not null").join(types.select(F.col("road_type").alias("typed")), "typed", "left_anti")
    return mapped_values(odd, "typed", types, "road_type", "abbreviation", "road_type", typed).select("table_name", "row_id", "road_type")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_containers(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "containers"))


def p8_use(spark: SparkSession, d: str) -> DataFrame:
    return container_use(p8_containers(spark, d), table(spark, d, "containers"))


def p9_alignments(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_alignments(spark, d).where(F.col("run") >= WINDOW).select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return look_alike_pairs(table(spark, d, "documents"), "doc_id", "text")


def p10_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per document of a group: its group (the smallest id with its skeleton)."""
    return look_alike_groups(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "group_id")


LLM_QUERIES = {"p1_found": p1_found, "p1_links": p1_links, "p2_found": p2_found, "p2_counts": p2_counts, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p4_counts": p4_counts, "p6_found": p6_found, "p6_survivors": p6_survivors, "p7_found": p7_found, "p8_containers": p8_containers, "p8_use": p8_use, "p9_found": p9_found, "p9_alignments": p9_alignments, "p10_found": p10_found, "p10_groups": p10_groups}
