"""Golden cases of the text functions."""

from pyspark.sql import functions as F

from hodonym.functions import scoring as sc
from hodonym.functions import text as tx


def value(spark, f, *args):
    kinds = {str: "string", int: "int", float: "double"}
    schema = ", ".join(f"c{i} {next((kinds[type(a)] for a in [a] if a is not None), 'string')}" for i, a in enumerate(args))
    out = spark.createDataFrame([tuple(args)], schema).select(f(*(F.col(f"c{i}") for i in range(len(args)))).alias("x")).first()[0]
    return tuple(out) if hasattr(out, "asDict") else out


CASES = [
    (tx.normalize_match, "Ștefan cel Mare", "stefan cel mare"), (tx.normalize_match, "Topîrceanu", "toparceanu"), (tx.normalize_match, "Topârceanu", "toparceanu"), (tx.normalize_match, "Înfrățirii", "anfratirii"),
    (tx.normalize_match, "G-ral Magheru", "general magheru"), (tx.normalize_match, None, ""), (tx.normalize_match, "", ""), (tx.normalize_match, "Ștefan", "stefan"),
    (tx.slugify, "C.I. Parhon", "c-i-parhon"), (tx.slugify, "", ""), (tx.fix_diacritics, "Piaţa Ştefan", "Piața Ștefan"), (tx.fix_diacritics, None, None),
    (tx.strip_street_type, "Bd. Unirii", ("Bulevardul", "Unirii")), (tx.strip_street_type, "Stradela Florilor", ("Stradela", "Florilor")), (tx.strip_street_type, "Dr. Taberei", ("Drumul", "Taberei")), (tx.strip_street_type, "Strada", (None, "Strada")),
    (tx.parse_artery, "Strada Florilor (Strada Lenin) (D)", ("Strada", "Florilor", ["Strada Lenin"])), (tx.parse_artery, "", (None, None, [])), (tx.parse_artery, None, (None, None, [])),
    (tx.extract_features, "12A", (None, None, 0, 0, 1, None)), (tx.extract_features, "1 Decembrie", (None, None, 0, 1, 0, "1 Decembrie")), (tx.extract_features, "1 Decembrie 1918", (None, None, 0, 0, 0, "1 Decembrie 1918")),
    (tx.extract_features, "Profesor Universitar Ion Tudorache", ("Profesor Universitar", None, 0, 0, 0, "Ion Tudorache")), (tx.extract_features, "Colonel Dr. Ion Ștefănescu", ("Dr.", "Colonel", 0, 0, 0, "Ion Ștefănescu")),
    (tx.extract_features, "Sfânta Maria", (None, None, 1, 0, 0, "Maria")), (tx.extract_features, "General", (None, "General", 0, 0, 0, None)), (tx.extract_features, "Generalilor", (None, None, 0, 0, 0, "Generalilor")),
    (tx.extract_features, "Maior Căpitan Ion", (None, "Maior Căpitan", 0, 0, 0, "Ion")), (tx.extract_features, None, (None, None, 0, 0, 0, None)), (tx.extract_features, "", (None, None, 0, 0, 0, "")),
    (tx.swap_two_tokens, "alecsandri vasile", "vasile alecsandri"), (tx.swap_two_tokens, "a b c", None), (tx.swap_two_tokens, None, None),
    (tx.map_street_type, "Alee IV", "Aleea"), (tx.map_street_type, "Stradă", "Strada"), (tx.map_street_type, "Piaţă", "Piață"), (tx.clean_name, "Unirii (fost Lenin)", "Unirii"), (tx.clean_name, "(x)", None),
    (tx.clean_road_type, "Strada aleea", "Aleea"), (tx.clean_road_type, "strada strada", "Strada"), (tx.clean_road_type, "DC", None), (tx.clean_road_type, "Piaţa", "Piața"), (tx.clean_road_type, "Foo", None), (tx.clean_road_type, None, None),
    (tx.search_key, "Înfrățirii!", "infratirii"), (tx.claim_year, "-0044-03-15T00:00:00Z", -44), (tx.claim_year, "+1850-01-15T00:00:00Z", 1850), (tx.leading_int, "12A", 12), (tx.leading_int, "A12", None),
    (tx.century_label, 1800, "sec. 19"), (tx.century_label, -100, "sec. 1 î.Hr."),
    (sc.scope, 0, "unknown"), (sc.scope, 1, "local"), (sc.scope, 4, "local"), (sc.scope, 5, "national"), (sc.scope, 49, "national"), (sc.scope, 50, "universal"), (sc.class_rank, "primary", 7), (sc.class_rank, "x", -1),
    (sc.cause_macro, "", "necunoscută"), (sc.cause_macro, None, "necunoscută"), (sc.cause_macro, "Viral Pneumonia", "boală"), (sc.cause_macro, "gunshot wound", "violență"), (sc.cause_macro, "traffic collision", "accident"), (sc.cause_macro, "altceva", "altele"),
    (tx.clean_road_type, "Ulicioara", "Ulicioara"), (tx.clean_road_type, "Drum Comunal DC", None), (tx.clean_road_type, "Strada FUNDATURA", "Fundătura"), (tx.clean_road_type, "Strada ", "Strada"), (tx.county_code, "CARAȘ-SEVERIN", "CS"), (tx.county_code, "Satu Mare", "SM"), (tx.county_code, "x", None), (tx.title_case, "MUNICIPIUL CLUJ-NAPOCA", "Municipiul Cluj-Napoca"),
]


def test_golden(spark):
    """All cases in one job."""
    cols = [f(F.lit(x) if x is not None else F.lit(None).cast("string")).alias(f"c{i}") for i, (f, x, _) in enumerate(CASES)]
    got = spark.range(1).select(*cols).first()
    for i, (f, x, want) in enumerate(CASES):
        v = got[i]
        assert (tuple(v) if hasattr(v, "asDict") else v) == want, (f.__name__, x)


def test_scores(spark):
    assert value(spark, sc.road_score, "primary", 0.0, "DN1") == 2.0
    assert abs(value(spark, sc.road_score, "residential", 2.718281828459045 - 1, None) - 2.0) < 1e-12
    z = sc.group_zscore(spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0), ("c", 2.0), ("c", 2.0)], "g string, x double"), ["g"], "x", "z")
    assert sorted(tuple(r) for r in z.select("g", "z").collect()) == [("a", 0.0), ("b", -1.0), ("b", 1.0), ("c", 0.0), ("c", 0.0)]
    assert value(spark, tx.person_slug, "Q12", "Ion") == "q12"
    assert value(spark, tx.person_slug, None, "Ion Creangă") == "ion-creanga"
