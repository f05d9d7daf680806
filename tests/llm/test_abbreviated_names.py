"""Streets whose names have more than two words, or were last written surname first, are found by initial or surname (p1)."""

from hodonym.llm.canonical_values import Dictionary
from hodonym.llm.street_linkage import cadastre_side, candidates, registry_side


def found(spark, streets, renns):
    s = spark.createDataFrame([(i, "J", "COMUNA LOC", "Strada " + n) for i, n in enumerate(streets)], "id long, judet string, uat string, artera_raw string")
    r = spark.createDataFrame([(i, 100, "J", "Loc", "Strada", None, n) for i, n in enumerate(renns)], "id long, uat_siruta int, judet string, locality_raw string, road_type_raw string, street_type string, name string")
    u = spark.createDataFrame([(100, "J", "LOC")], "siruta int, judet string, uat string")
    d = Dictionary([("Strada", "Str."), ("Aleea", "Al.")])
    key = {x["e"]: x["key"] for x in registry_side(s, d).selectExpr("xxhash64(muni, key) e", "key").collect()}
    return sorted((renns[x["rid"]], key[x["eid"]]) for x in candidates(registry_side(s, d), cadastre_side(r, u, d)).where("v2 >= 0").collect())


def test_more_than_two_words(spark):
    streets = ["Ana-Paula Dudonteanu", "Nahinte Corneliu-Aurel", "Nicolae-Ion Vlad"]
    renns = ["Dudonteanu", "C. Nahinte", "C. A. Nahinte", "A. Nahinte", "Nicu-Ion Vlad", "Ana-Paula"]
    nahinte = "aurel corneliu nahinte"
    assert found(spark, streets, renns) == [("C. A. Nahinte", nahinte), ("C. Nahinte", nahinte), ("Dudonteanu", "ana dudonteanu paula"), ("Nicu-Ion Vlad", "ion nicolae vlad")]


def test_surname_first(spark):
    """A surname counts wherever the street's rows have it; a given name alone finds nothing."""
    streets = ["Yvonne Vlad", "Yvonne Retisanteanu", "Yvonne Retisanteanu", "Retisanteanu Yvonne", "Elena Dudonteanu", "Maria Dudonteanu", "Dudonteanu Yvonne"]
    got = found(spark, streets, ["Retisanteanu", "Dudonteanu", "Yvonne"])
    assert [x for x in got if x[0] == "Retisanteanu"] == [("Retisanteanu", "retisanteanu yvonne")]
    assert [x[1] for x in got if x[0] == "Dudonteanu"] == ["dudonteanu elena", "dudonteanu maria", "dudonteanu yvonne"]
