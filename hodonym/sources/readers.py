"""Readers of the inputs: everything with an explicit schema, nothing inferred."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hodonym.functions.text import clean_name, clean_road_type, extract_features, map_street_type, normalize_match, parse_artery, swap_two_tokens

REGISTRY = "judet string, uat string, siruta string, artera_raw string"
CENTRES = "siruta string, lat string, long string, cod_judet string, localitate string"
CURATION = [
    "core_name_norm", "freq", "judete_n", "uats_n", "sample_name", "judete_list", "table", "full_name", "gender", "birth_year", "death_year", "era", "profession", "nationality",
    "wikidata_qid", "term", "nature_type", "category", "subcategory", "place_name", "place_type", "country", "notes",
]
# The codes of the capital's sectors and their centres.
SECTORS = {179141: (44.47, 26.01), 179150: (44.46, 26.12), 179169: (44.43, 26.16), 179178: (44.40, 26.07), 179187: (44.40, 26.00), 179196: (44.44, 25.97)}
_QUERY = re.compile(r"^-- :name[ \t]+(\S+)[ \t]*$", re.M)


def registry(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The registry as CSV with its row number as ``ordinal``: rows up to the first without a county, without those that have no street.

    The file is read in one pass per split; row numbers come from the order of the splits.
    """
    rows = spark.read.schema(REGISTRY).option("header", True).csv(path).withColumn("ordinal", F.monotonically_increasing_id())
    end = rows.where("judet is null").agg(F.min("ordinal")).first()[0]
    rows = rows if end is None else rows.where(F.col("ordinal") < end)
    rows = rows.where("artera_raw is not null and trim(artera_raw) != ''").withColumn("siruta", F.col("siruta").try_cast("int"))
    return rows.orderBy("ordinal").limit(limit) if limit else rows


def streets(rows: DataFrame) -> DataFrame:
    """Registry rows taken apart; ``id`` is the row's ordinal, so the first spelling of a street stays the first."""
    x = rows.withColumn("_a", parse_artery(F.col("artera_raw"))).withColumn("_f", extract_features(F.col("_a.name")))
    return x.select(
        F.col("ordinal").alias("id"), "judet", "uat", "siruta", "artera_raw", "_a.street_type", "_a.name", normalize_match(F.col("_a.name")).alias("name_normalized"), "_f.title", "_f.rank", "_f.is_saint", "_f.is_date", "_f.is_numeric", "_f.core_name",
        F.when(F.col("_f.core_name").isNotNull(), normalize_match(F.col("_f.core_name"))).alias("core_name_norm"), F.col("_a.aliases").alias("aliases"),
    )


def aliases(streets_: DataFrame) -> DataFrame:
    """(street_id, alias, alias_normalized) of the names in brackets."""
    return streets_.select(F.col("id").alias("street_id"), F.explode("aliases").alias("alias")).withColumn("alias_normalized", normalize_match(F.col("alias")))


def centres(spark: SparkSession, path: str) -> DataFrame:
    """(siruta, judet, uat, lat, lon); rows without a number are skipped."""
    x = spark.read.schema(CENTRES).option("header", True).csv(path)
    x = x.select(F.col("siruta").try_cast("int").alias("siruta"), F.col("cod_judet").alias("judet"), F.col("localitate").alias("uat"), F.col("lat").try_cast("double").alias("lat"), F.col("long").try_cast("double").alias("lon"))
    return x.where("siruta is not null")


def with_sectors(centres_: DataFrame) -> DataFrame:
    """The centres with the six sectors of the capital, which the list lacks; a code that is there already stays as it is."""
    rows = [(code, "B", f"BUCUREȘTI SECTORUL {i}", *at) for i, (code, at) in enumerate(SECTORS.items(), 1)]
    own = centres_.sparkSession.createDataFrame(rows, "siruta int, judet string, uat string, lat double, lon double")
    return centres_.select("siruta", "judet", "uat", "lat", "lon").unionByName(own.join(centres_.select("siruta"), "siruta", "left_anti"))


def postal(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both postal sheets in one shape: (source_sheet, row_id, judet_raw, localitate_raw, code, street_type, name, core_name_norm, core_name_norm_swapped).

    Rows without a type or a name are left out, as are names that are nothing but a bracket.
    """
    a = first.select(F.lit("capital").alias("source_sheet"), "row_id", F.lit("București").alias("judet_raw"), F.lit(None).cast("string").alias("localitate_raw"), F.col("sector_code").try_cast("int").alias("code"), "tip", "denumire")
    b = second.select(F.lit("towns").alias("source_sheet"), "row_id", "judet_raw", "localitate_raw", F.col("sirsup").try_cast("int").alias("code"), "tip", "denumire")
    x = a.unionByName(b).where("tip != '' and denumire != ''").withColumn("name", clean_name(F.col("denumire"))).where("name is not null")
    x = x.withColumn("_f", extract_features(F.col("name"))).withColumn("core_name_norm", F.when(F.col("_f.core_name").isNotNull(), normalize_match(F.col("_f.core_name"))))
    return x.select("source_sheet", "row_id", "judet_raw", "localitate_raw", "code", map_street_type(F.col("tip")).alias("street_type"), "name", "core_name_norm", swap_two_tokens(F.col("core_name_norm")).alias("core_name_norm_swapped"))


CADASTRE = "id long, name string, uat struct<id: int>, county struct<shortName: string>, locality struct<name: string>, roadType struct<name: string>, roadStatus struct<name: string>"


def cadastre(spark: SparkSession, path: str, pages: bool = False) -> DataFrame:
    """Cadastral items, flattened, with the type cleaned: JSON lines, or files that each hold a page as one array."""
    x = spark.read.schema(CADASTRE).option("multiLine", pages).json(path)
    return x.select("id", F.col("uat.id").alias("uat_siruta"), F.col("county.shortName").alias("judet"), F.col("locality.name").alias("locality_raw"), F.col("roadType.name").alias("road_type_raw"), clean_road_type(F.col("roadType.name")).alias("street_type"), "name", F.col("roadStatus.name").alias("road_status"))


def curation(spark: SparkSession, path: str) -> DataFrame:
    """Curation rows with typed years; the first row of a (table, key) wins."""
    x = spark.read.schema(", ".join(f"`{c}` string" for c in CURATION)).option("header", True).csv(path).withColumn("_n", F.monotonically_increasing_id())
    for c in ("birth_year", "death_year"):
        x = x.withColumn(c, F.col(c).try_cast("int"))
    rest = [c for c in CURATION if c not in ("table", "core_name_norm")]
    return x.groupBy("table", "core_name_norm").agg(F.min_by(F.struct(*rest), "_n").alias("_r")).select("table", "core_name_norm", "_r.*")


def not_done(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows of ``work`` whose key is not in an earlier output."""
    return work.join(done.select(key), key, "left_anti")


def named_queries(path: str) -> dict[str, str]:
    """The bodies of a file of queries by name; a body ends at two blank lines, at a rule of equals signs, or at the next name."""
    text = Path(path).read_text()
    marks = list(_QUERY.finditer(text))
    out = {}
    for i, m in enumerate(marks):
        body = text[m.end() : marks[i + 1].start() if i + 1 < len(marks) else len(text)]
        out[m[1]] = re.split(r"\n[ \t]*\n[ \t]*\n|^-- =+", body, maxsplit=1, flags=re.M)[0].strip().rstrip(";")
    return out
