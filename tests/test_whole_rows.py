"""Results over all rows of a table, beside the table's own columns or every pair of rows."""

import pytest
from pyspark.sql import functions as F

from hodonym.functions import text as tx
from hodonym.plans.adapter import Views
from hodonym.plans.panels import PANELS
from tests.compare import DATA

tables = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def test_compatibility_forms_are_folded(spark):
    names = ["Ion Creangă", "Ｉｏｎ", "ﬁ", "Čapek Žižka Ðš", "G.ral Vlad", "  "]
    got = spark.createDataFrame(list(enumerate(names)), "i int, s string").select("i", tx.normalize_match(F.col("s")).alias("k")).orderBy("i").collect()
    assert [r["k"] for r in got] == ["ion creanga", "ion", "fi", "capek zizka ðs", "general vlad", ""]


@tables
def test_normalized_names_are_those_of_the_table(spark):
    v = Views(spark, str(DATA))
    got = {r["id"]: r["normalized"] for r in PANELS["normalized_names"](v).collect()}
    assert got == {r["id"]: r["name_normalized"] for r in v.raw.select("id", "name_normalized").collect()}


def test_normalized_names_keep_every_row(spark):
    v = Views(spark, "")
    v.raw = spark.createDataFrame([(1, "G.ral Vlad"), (2, "g-ral Vlad"), (3, None)], "id long, name string")
    assert sorted(tuple(r) for r in PANELS["normalized_names"](v).collect()) == [(1, "G.ral Vlad", "general vlad", "general-vlad"), (2, "g-ral Vlad", "general vlad", "general-vlad"), (3, None, "", "")]


def test_identifier_candidates_contain_the_name_anywhere(spark):
    persons = [
        ("a", "Ion Vlad", None, None), ("b", "Ana Dutucil", None, None), ("c", "Vlad", None, 1900), ("d", "Ana Nimeni", None, None), ("e", "X", None, None), ("f", None, None, None), ("g", "Ion Vlad", None, 1900),
        ("h", "Ion Vlad tânărul", "Q12", None), ("i", "Ana Dutucilă", "Q3", None), ("j", "vlad", "Q7", None), ("k", None, "Q9", None), ("l", "Ion Vlad bătrânul", "Q1", None),
    ]
    v = Views(spark, "")
    v.persons = spark.createDataFrame(persons, "core_name_norm string, full_name string, wikidata_qid string, birth_year int").selectExpr("*", "cast(null as string) gender", "cast(null as int) death_year")
    assert sorted(tuple(r) for r in PANELS["identifier_candidates"](v).collect()) == [("a", "Q1", 0.7), ("b", "Q3", 0.7), ("c", "Q7", 0.95), ("g", "Q1", 0.7)]


def test_every_postal_type_is_mapped(spark):
    want = {"Sosea": "Șoseaua", "Fundac": "Fundătura", "Trecătoare": "Trecerea", "Potecă": "Cărarea", "Rampa": "Rampa", "Fundătură": "Fundătura"}
    got = spark.createDataFrame([(k,) for k in want], "t string").select("t", tx.map_street_type(F.col("t"))).collect()
    assert {a: b for a, b in got} == want
