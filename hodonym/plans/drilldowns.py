"""Rankings and counts within counties and municipalities, detail pages, notebook reports and the text functions over whole tables, each beside its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hodonym.functions import text as tx
from hodonym.operators import profiles, roads
from hodonym.operators.classify import coverage_class
from hodonym.plans.adapter import Views
from hodonym.plans.catalog import _persons, _roads, n_if, n_rows, pct, unmatched
from hodonym.plans.catalog_sql import _COVER, _ROADS, _pct
from hodonym.plans.panels import _CULT, _PREPS, _SP, PANELS, PANELS_SQL, panel, unit_pages
from hodonym.sources.readers import SECTORS

_B = "case when judet like 'BUCURESTI%' or judet = 'B' then 'B' else judet end"


def county() -> Column:
    """The county, all parts of the capital being one."""
    return F.when(F.col("judet").like("BUCURESTI%") | (F.col("judet") == "B"), "B").otherwise(F.col("judet"))


def _top(df: DataFrame, by: list[str], n: str, tie: str, k: int) -> DataFrame:
    return profiles.top_per_group(df, by, [F.desc(n), tie], k)


# ---- persons ---------------------------------------------------------------------------------------------------------


@panel(f"select gender, core_name_norm, full_name, n, rn from (select gender, core_name_norm, min(full_name) full_name, count(*) n, row_number() over (partition by gender order by count(*) desc, core_name_norm) rn from {_SP} where gender in ('M', 'F') and is_numeric = 0 group by 1, 2) where rn <= 20")
def persons_by_gender(v: Views) -> DataFrame:
    g = _persons(v, "full_name", "gender").where("gender in ('M', 'F') and is_numeric = 0").groupBy("gender", "core_name_norm").agg(F.min("full_name").alias("full_name"), n_rows().alias("n"))
    return _top(g, ["gender"], "n", "core_name_norm", 20)


@panel(f"select judet, core_name_norm, full_name, nationality, n, rn from (select {_B} judet, core_name_norm, max(full_name) full_name, max(nationality) nationality, count(*) n, row_number() over (partition by {_B} order by count(*) desc, core_name_norm) rn from {_SP} where is_numeric = 0 and nationality <> 'RO' group by 1, 2) where rn <= 10")
def foreigners_by_judet(v: Views) -> DataFrame:
    x = _persons(v, "full_name", "nationality").where("is_numeric = 0 and nationality != 'RO'")
    g = x.groupBy(county().alias("judet"), "core_name_norm").agg(F.max("full_name").alias("full_name"), F.max("nationality").alias("nationality"), n_rows().alias("n"))
    return _top(g, ["judet"], "n", "core_name_norm", 10)


for _c in ("profession", "era"):

    @panel(f"select {_B} judet, {_c}, count(distinct core_name_norm) n from {_SP} where {_c} is not null group by 1, 2", f"{_c}s_by_judet")
    def attribute_by_judet(v: Views, column: str = _c) -> DataFrame:
        return _persons(v, column).where(F.col(column).isNotNull()).groupBy(county().alias("judet"), column).agg(F.count_distinct("core_name_norm").alias("n"))


@panel(f"select {_B} judet, count(*) filter (gender = 'M') m, count(*) filter (gender = 'F') f from {_SP} group by 1")
def genders_by_judet(v: Views) -> DataFrame:
    return _persons(v, "gender").groupBy(county().alias("judet")).agg(F.count(F.when(F.col("gender") == "M", 1)).alias("m"), F.count(F.when(F.col("gender") == "F", 1)).alias("f"))


@panel("select case when nationality = 'RO' then 'RO' else 'other' end origin, count(*) streets, round(100.0::double * count(*) / sum(count(*)) over (), 1) pct from sd join p using (core_name_norm) where nationality is not null group by 1")
def domestic_share(v: Views) -> DataFrame:
    g = _persons(v, "nationality").where("nationality is not null").groupBy(F.when(F.col("nationality") == "RO", "RO").otherwise("other").alias("origin")).agg(n_rows().alias("streets"))
    return g.withColumn("pct", pct(F.col("streets"), F.sum("streets").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))  # two rows


_SELF = f"(select judet, count(*) total, count(birth_judet) known, count(*) filter (birth_judet = judet) home, {_pct('count(*) filter (birth_judet = judet)', 'count(birth_judet)')} pct from {_SP} group by 1 having count(birth_judet) >= 20)"


@panel(f"select side, judet, total, known, home, pct, rn from (select 'top' side, *, row_number() over (order by pct desc, judet) rn from {_SELF} union all select 'bottom', *, row_number() over (order by coalesce(pct, 0), judet) from {_SELF}) where rn <= 5")
def self_honor_extremes(v: Views) -> DataFrame:
    """The five counties that honour their own most and least, of those with at least twenty streets of known birth."""
    g = _persons(v, "birth_judet").groupBy("judet").agg(n_rows().alias("total"), F.count("birth_judet").alias("known"), n_if(F.col("birth_judet") == F.col("judet")).alias("home")).where("known >= 20").withColumn("pct", pct(F.col("home"), F.col("known")))
    top = profiles.top_per_group(g.withColumn("side", F.lit("top")), ["side"], [F.desc_nulls_last("pct"), "judet"], 5)
    bottom = profiles.top_per_group(g.withColumn("side", F.lit("bottom")), ["side"], [F.coalesce("pct", F.lit(0.0)), "judet"], 5)
    return top.unionByName(bottom).select("side", "judet", "total", "known", "home", "pct", "rn")


@panel(f"select count(birth_judet) known, count(*) filter (birth_judet = judet) home, coalesce({_pct('count(*) filter (birth_judet = judet)', 'count(birth_judet)')}, 0.0) pct from {_SP}")
def self_honor_national(v: Views) -> DataFrame:
    g = _persons(v, "birth_judet").agg(F.count("birth_judet").alias("known"), F.count(F.when(F.col("birth_judet") == F.col("judet"), 1)).alias("home"))
    return g.withColumn("pct", F.coalesce(pct(F.col("home"), F.col("known")), F.lit(0.0)))


_PAIRS = PANELS_SQL["person_pairs_by_lift"]
_CANON = "(select item name from (select distinct siruta basket, full_name item from sd join p using (core_name_norm) where siruta is not null) group by 1 having 10 * count(*) >= 3 * (select count(distinct siruta) from sd join p using (core_name_norm)) order by count(*) desc, 1 limit 3)"


@panel(None)
def surprising_pairs(v: Views) -> DataFrame:
    """The twelve pairs of highest lift, without those of which both are among the three most usual persons."""
    pairs = PANELS["person_pairs_by_lift"](v)
    canon = PANELS["canon_set"](v).orderBy(F.desc("units"), "full_name").limit(3).select("full_name")
    usual = lambda c: canon.select(F.col("full_name").alias(c), F.lit(True).alias(f"{c}_usual"))
    x = pairs.join(usual("name_a"), "name_a", "left").join(usual("name_b"), "name_b", "left").where("name_a_usual is null or name_b_usual is null")
    return x.orderBy(F.desc("lift"), "name_a", "name_b").limit(12).drop("name_a_usual", "name_b_usual")


_HEAD, _TAIL = _PAIRS.split("select a.item", 1)
PANELS_SQL["surprising_pairs"] = f"{_HEAD}, pr as (select a.item{_TAIL}) select * from pr where not (name_a in {_CANON} and name_b in {_CANON}) order by lift desc, name_a, name_b limit 12"


# ---- themes by county ------------------------------------------------------------------------------------------------


@panel(f"select {_B} judet, nature_type, count(distinct name_normalized) n from st where has_nature and {_CULT} group by 1, 2")
def nature_by_judet(v: Views) -> DataFrame:
    return v.star.where("has_nature").where(_CULT).groupBy(county().alias("judet"), "nature_type").agg(F.count_distinct("name_normalized").alias("n"))


@panel(f"select {_B} judet, subcategory token, count(distinct name_normalized) n from st where category = 'ideological' and subcategory is not null and is_numeric = 0 group by 1, 2")
def ideology_by_judet(v: Views) -> DataFrame:
    return v.star.where("category = 'ideological' and subcategory is not null and is_numeric = 0").groupBy(county().alias("judet"), F.col("subcategory").alias("token")).agg(F.count_distinct("name_normalized").alias("n"))


_FLAGS = {"person": "has_person", "nature": "has_nature", "saint": "is_saint = 1", "date": "is_date = 1", "ideologic": "category = 'ideological'", "abstract": "category in ('abstract', 'commemorative', 'institutional')"}


def _flag_counts() -> list[Column]:
    return [*(F.count(F.when(F.expr(c), 1)).alias(k) for k, c in _FLAGS.items()), n_rows().alias("total")]


_FLAGS_SQL = ", ".join(f"count(*) filter ({c}) {k}" for k, c in _FLAGS.items()) + ", count(*) total"


@panel(f"select {_B} judet, {_FLAGS_SQL} from st where is_numeric = 0 group by 1")
def theme_flags_by_judet(v: Views) -> DataFrame:
    return v.star.where("is_numeric = 0").groupBy(county().alias("judet")).agg(*_flag_counts())


@panel(f"select siruta, {_FLAGS_SQL} from st where is_numeric = 0 and uat like 'MUNICIPIUL%' group by 1")
def theme_flags_by_municipality(v: Views) -> DataFrame:
    return v.star.where("is_numeric = 0 and uat like 'MUNICIPIUL%'").groupBy("siruta").agg(*_flag_counts())


_TIER = "case when highway_class in ('primary', 'secondary') then 'main' when highway_class in ('tertiary', 'unclassified') then 'middle' when highway_class in ('residential', 'living_street') then 'living' else 'other' end"
_KM = ", ".join(f"round(coalesce(sum(o.length_m) filter ({_TIER} = '{t}'), 0) / 1000.0, 1) {t}, round(100.0::double * coalesce(sum(o.length_m) filter ({_TIER} = '{t}'), 0) / sum(o.length_m), 1) {t}_pct" for t in ("main", "middle", "living", "other"))


@panel(f"select category, round(sum(o.length_m) / 1000.0, 1) total_km, {_KM} from (select id, {_COVER} category from st) s {_ROADS} group by 1")
def km_by_category_and_tier(v: Views) -> DataFrame:
    tier = F.when(F.col("highway_class").isin("primary", "secondary"), "main").when(F.col("highway_class").isin("tertiary", "unclassified"), "middle").when(F.col("highway_class").isin("residential", "living_street"), "living").otherwise("other")
    g = _roads(v, v.star.select("id", coverage_class().alias("category"))).withColumn("tier", tier).groupBy("category")
    part = {t: F.coalesce(F.sum(F.when(F.col("tier") == t, F.col("length_m"))), F.lit(0.0)) for t in ("main", "middle", "living", "other")}
    cols = [c for t, x in part.items() for c in (F.round(x / 1000.0, 1).alias(t), F.round(F.lit(100.0) * x / F.sum("length_m"), 1).alias(f"{t}_pct"))]
    return g.agg(F.round(F.sum("length_m") / 1000.0, 1).alias("total_km"), *cols)


@panel("select name_normalized label, count(*) n from st where category in ('trade', 'occupational') group by 1 order by 2 desc, 1 limit 7")
def trade_contest(v: Views) -> DataFrame:
    return v.star.where("category in ('trade', 'occupational')").groupBy(F.col("name_normalized").alias("label")).agg(n_rows().alias("n")).orderBy(F.desc("n"), "label").limit(7)


@panel("select nature_type, term, n, rn from (select nature_type, term, count(*) n, row_number() over (partition by nature_type order by count(*) desc, term) rn from st where has_nature group by 1, 2) where rn <= 7")
def nature_contests(v: Views) -> DataFrame:
    return _top(v.star.where("has_nature").groupBy("nature_type", "term").agg(n_rows().alias("n")), ["nature_type"], "n", "term", 7)


@panel(f"select id, name, length(name) chars from sd where {_CULT} and length(name) > 30 order by 3 desc, name, id limit 8")
def very_long_names(v: Views) -> DataFrame:
    return v.sd.where(_CULT).select("id", "name", F.length("name").alias("chars")).where("chars > 30").orderBy(F.desc("chars"), "name", "id").limit(8)


@panel("select disp, len, streets from (select *, length(regexp_replace(trim(disp), '\\s+', ' ', 'g')) len from (select name_normalized n, min(name) disp, count(*) streets from sd where is_numeric = 0 group by 1)) where not regexp_matches(n, '\\bkm \\d|^d[njc]\\s?\\d') order by len desc, n limit 8")
def longest_without_roads(v: Views) -> DataFrame:
    """The longest names that are no descriptions of road segments."""
    g = v.sd.where("is_numeric = 0").groupBy("name_normalized").agg(F.min("name").alias("disp"), n_rows().alias("streets")).where(~F.col("name_normalized").rlike(r"\bkm \d|^d[njc]\s?\d"))
    return g.withColumn("len", F.length(F.regexp_replace(F.trim("disp"), r"\s+", " "))).orderBy(F.desc("len"), "name_normalized").limit(8).select("disp", "len", "streets")


@panel("select (select count(*) from (select name_normalized from sd where is_numeric = 0 group by 1)) total_names, (select count(distinct judet) from sd where is_numeric = 0) counties, (select count(*) from (select name_normalized from sd where is_numeric = 0 group by 1 having count(distinct judet) = (select count(distinct judet) from sd where is_numeric = 0))) universal, (select count(*) from (select name_normalized n from sd where is_numeric = 0 group by 1) where contains(n, ' ') and split_part(n, ' ', 1) in ('la', 'sub', 'catre', 'peste', 'intre', 'spre', 'dupa', 'langa', 'din', 'in', 'pe', 'dinspre', 'dintre', 'deasupra')) prepositional")
def lexical_totals(v: Views) -> DataFrame:
    named = v.sd.where("is_numeric = 0")
    every = named.agg(F.count_distinct("judet")).scalar()
    g = named.groupBy(F.col("name_normalized").alias("n")).agg(F.count_distinct("judet").alias("j"))
    return g.agg(n_rows().alias("total_names"), F.first(every).alias("counties"), F.count(F.when(F.col("j") == every, 1)).alias("universal"), F.count(F.when(F.col("n").contains(" ") & F.split("n", " ")[0].isin(_PREPS), 1)).alias("prepositional"))


# ---- detail pages ----------------------------------------------------------------------------------------------------


def _nested(df: DataFrame, key: str) -> DataFrame:
    """Per ``key`` and county: streets, municipalities, and these as ``name:count`` from the most streets down."""
    per = df.groupBy(key, "judet", "siruta").agg(F.min_by("uat", "id").alias("uat"), n_rows().alias("n"))
    nest = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), tx.fix_diacritics(F.col("uat")).alias("u"), "siruta"))), lambda x: F.concat(x["u"], F.lit(":"), (-x["o"]).cast("string"))), ";")
    return per.groupBy(key, "judet").agg(F.sum("n").alias("total"), n_rows().alias("units"), nest.alias("uats"))


def _nested_sql(key: str, where: str) -> str:
    return f"select {key}, judet, sum(n)::bigint total, count(*) units, array_to_string(list(u || ':' || n order by n desc, u, siruta nulls first), ';') uats from (select {key}, judet, siruta, translate(arg_min(uat, id), 'şţŞŢ', 'șțȘȚ') u, count(*) n from sd where {where} group by 1, 2, 3) group by 1, 2"


@panel(_nested_sql("name_normalized", "true"))
def street_footprints(v: Views) -> DataFrame:
    return _nested(v.sd, "name_normalized")


@panel(_nested_sql("core_name_norm", "core_name_norm in (select core_name_norm from p)"))
def person_footprints(v: Views) -> DataFrame:
    return _nested(v.sd.join(v.persons.select("core_name_norm"), "core_name_norm", "left_semi"), "core_name_norm")


_FIRST = ["name", "core_name", "is_saint", "is_date", "full_name", "wikidata_qid", "profession", "era", "nationality", "wiki_scope", "nature_type", "place_type", "category", "subcategory"]


@panel("select name_normalized, coalesce(x.core_name, x.name) display_name, streets, units, counties, " + ", ".join(f"x.{c} {c}" for c in _FIRST[2:]) + " from (select name_normalized, count(*) streets, count(distinct siruta) units, count(distinct judet) counties, arg_min(st, (judet, uat, id)) x from st group by 1)")
def street_heads(v: Views) -> DataFrame:
    """What is said of a name as a whole: its counts, and honoree and theme from its first street by county, municipality and id."""
    g = v.star.groupBy("name_normalized").agg(n_rows().alias("streets"), F.count_distinct("siruta").alias("units"), F.count_distinct("judet").alias("counties"), F.min_by(F.struct(*_FIRST), F.struct("judet", "uat", "id")).alias("x"))
    return g.select("name_normalized", F.coalesce("x.core_name", "x.name").alias("display_name"), "streets", "units", "counties", *(f"x.{c}" for c in _FIRST[2:]))


@panel("select siruta, core_name_norm, full_name, profession, n, rn from (select siruta, core_name_norm, min(full_name) full_name, min(profession) profession, count(*) n, row_number() over (partition by siruta order by count(*) desc, min(full_name), core_name_norm) rn from sd join p using (core_name_norm) group by 1, 2) where rn <= 12")
def unit_top_persons(v: Views) -> DataFrame:
    g = _persons(v, "full_name", "profession").groupBy("siruta", "core_name_norm").agg(F.min("full_name").alias("full_name"), F.min("profession").alias("profession"), n_rows().alias("n"))
    return profiles.top_per_group(g, ["siruta"], [F.desc("n"), "full_name", "core_name_norm"], 12)


@panel(f"select siruta, name_normalized, display, n, rn from (select siruta, name_normalized, min(core_name) display, count(*) n, row_number() over (partition by siruta order by count(*) desc, min(core_name), name_normalized) rn from sd where {_CULT} group by 1, 2) where rn <= 20")
def unit_top_names(v: Views) -> DataFrame:
    g = v.sd.where(_CULT).groupBy("siruta", "name_normalized").agg(F.min("core_name").alias("display"), n_rows().alias("n"))
    return profiles.top_per_group(g, ["siruta"], [F.desc("n"), "display", "name_normalized"], 20)


@panel(f"select siruta, name_normalized, display, uat_n, rn from (select *, row_number() over (partition by siruta order by uat_n, display, name_normalized) rn from (select siruta, name_normalized, min(core_name) display from sd where {_CULT} group by 1, 2) join (select name_normalized, count(distinct siruta) uat_n from sd where {_CULT} group by 1) using (name_normalized) where uat_n <= 3) where rn <= 12")
def unit_rare_names(v: Views) -> DataFrame:
    named = v.sd.where(_CULT)
    rare = named.groupBy("name_normalized").agg(F.count_distinct("siruta").alias("uat_n")).where("uat_n <= 3")
    g = named.groupBy("siruta", "name_normalized").agg(F.min("core_name").alias("display")).join(rare, "name_normalized")
    return profiles.top_per_group(g, ["siruta"], ["uat_n", "display", "name_normalized"], 12)


_NAT = "(select round(100.0::double * sum({c}) / count(*), 2) from sd)"


@panel("select siruta, total, saint_pct, numeric_pct, round(saint_pct - " + _NAT.format(c="is_saint") + ", 2) delta_saint, round(numeric_pct - " + _NAT.format(c="is_numeric") + ", 2) delta_numeric from (select siruta, count(*) total, round(100.0::double * sum(is_saint) / count(*), 2) saint_pct, round(100.0::double * sum(is_numeric) / count(*), 2) numeric_pct from sd group by 1)")
def unit_deltas(v: Views) -> DataFrame:
    share = lambda c: F.round(F.lit(100.0) * F.sum(c) / n_rows(), 2)
    g = v.sd.groupBy("siruta").agg(n_rows().alias("total"), share("is_saint").alias("saint_pct"), share("is_numeric").alias("numeric_pct"))
    nation = lambda c: v.sd.agg(share(c)).scalar()
    return g.select("*", F.round(F.col("saint_pct") - nation("is_saint"), 2).alias("delta_saint"), F.round(F.col("numeric_pct") - nation("is_numeric"), 2).alias("delta_numeric"))


#: kind of theme -> the column of its key among streets with their lookups, or None where the key names a condition.
THEME_KEYS = {"profession": "profession", "nature": "nature_type", "ideology": "subcategory"}
MACRO_THEMES = {"saint": "is_saint = 1", "date": "is_date = 1", "person": "has_person", "nature": "has_nature", "place": "has_place", "ideologic": "category = 'ideological'"}


def theme_streets(star: DataFrame, kind: str, key: str) -> DataFrame:
    """The streets of one theme; an unknown kind or macro theme has none."""
    if kind == "macro":
        return star.where(F.expr(MACRO_THEMES[key]) if key in MACRO_THEMES else F.lit(False))
    if kind not in THEME_KEYS:
        return star.where(F.lit(False))
    of = star.where(F.col(THEME_KEYS[kind]) == key)
    return of.where("category = 'ideological'") if kind == "ideology" else of


def _themed(v: Views) -> DataFrame:
    """(kind, key, street...) of every theme at once: a street stands once for each of its themes."""
    macro = F.filter(F.array(*(F.when(F.expr(c), F.lit(k)) for k, c in MACRO_THEMES.items())), lambda x: x.isNotNull())
    one = lambda kind, key: F.when(key.isNotNull(), F.array(F.struct(F.lit(kind).alias("kind"), key.alias("key")))).otherwise(F.array().cast("array<struct<kind:string,key:string>>"))
    every = F.concat(F.transform(macro, lambda x: F.struct(F.lit("macro").alias("kind"), x.alias("key"))), one("profession", F.col("profession")), one("nature", F.col("nature_type")), one("ideology", F.when(F.col("category") == "ideological", F.col("subcategory"))))
    return v.star.where("is_numeric = 0").withColumn("_t", F.explode(every)).withColumns({"kind": F.col("_t.kind"), "key": F.col("_t.key")})


_THEMED = "(" + " union all ".join([*(f"select *, 'macro' kind, '{k}' key from st where {c}" for k, c in MACRO_THEMES.items()), "select *, 'profession', profession from st where profession is not null", "select *, 'nature', nature_type from st where nature_type is not null", "select *, 'ideology', subcategory from st where category = 'ideological' and subcategory is not null"]) + ")"


@panel(f"select kind, key, judet, count(*) n from {_THEMED} where is_numeric = 0 group by 1, 2, 3")
def theme_counts_by_judet(v: Views) -> DataFrame:
    return _themed(v).groupBy("kind", "key", "judet").agg(n_rows().alias("n"))


@panel(f"select kind, key, name_normalized, display, total, units, rn from (select kind, key, name_normalized, min(core_name) display, count(*) total, count(distinct siruta) units, row_number() over (partition by kind, key order by count(*) desc, name_normalized) rn from {_THEMED} where {_CULT} group by 1, 2, 3) where rn <= 60")
def theme_top_names(v: Views) -> DataFrame:
    g = _themed(v).where("core_name is not null").groupBy("kind", "key", "name_normalized").agg(F.min("core_name").alias("display"), n_rows().alias("total"), F.count_distinct("siruta").alias("units"))
    return _top(g, ["kind", "key"], "total", "name_normalized", 60)


@panel("select 0 n where false")
def unknown_theme(v: Views) -> DataFrame:
    return theme_streets(v.star, "no such kind", "x").select(F.lit(0).alias("n"))


@panel(None)
def explorer_units(v: Views) -> DataFrame:
    """The municipalities with a page, for the search."""
    return unit_pages(v).select("slug", "judet", "uat", "streets")


_UNIT_HEAD, _UNIT_BODY = PANELS_SQL["unit_pages"].split("select siruta, judet, translate", 1)
PANELS_SQL["explorer_units"] = f"{_UNIT_HEAD} select slug, judet, uat, streets from (select siruta, judet, translate{_UNIT_BODY})"


@panel(f"select {_B} judet, siruta, uat, array_to_string(list_transform(string_split(lower(uat), ' '), lambda w: upper(w[1]) || w[2:]), ' ') title, count(*) total from sd where uat like 'MUNICIPIUL%' and is_numeric = 0 and not contains(uat, '-') group by 1, 2, 3")
def municipalities(v: Views) -> DataFrame:
    """The towns by county with their names in title case; names with a hyphen, after which a capital follows too, are in ``municipalities_with_hyphen``."""
    return _municipalities(v).where(~F.contains("uat", F.lit("-")))


@panel(f"select {_B} judet, siruta, uat, array_to_string(list_transform(string_split(lower(uat), ' '), lambda w: array_to_string(list_transform(string_split(w, '-'), lambda x: upper(x[1]) || x[2:]), '-')), ' ') title, count(*) total from sd where uat like 'MUNICIPIUL%' and is_numeric = 0 and contains(uat, '-') group by 1, 2, 3")
def municipalities_with_hyphen(v: Views) -> DataFrame:
    return _municipalities(v).where(F.contains("uat", F.lit("-")))


def _municipalities(v: Views) -> DataFrame:
    g = v.sd.where("uat like 'MUNICIPIUL%' and is_numeric = 0").groupBy(county().alias("judet"), "siruta", "uat").agg(n_rows().alias("total"))
    return g.withColumn("title", tx.title_case(F.col("uat")))


@panel(f"select siruta, name_normalized, core_name, category, nat_count, rn from (select siruta, name_normalized, core_name, category, nat_count, row_number() over (partition by siruta order by nat_count desc, name_normalized) rn from (select siruta, name_normalized, min(core_name) core_name, case when bool_or(has_person) then 'person' when bool_or(has_nature) then 'nature' when max(is_saint) = 1 then 'saint' else 'other' end category from st where {_CULT} and uat like 'MUNICIPIUL%' group by 1, 2) join (select name_normalized, count(distinct siruta) nat_count from sd where {_CULT} group by 1) using (name_normalized)) where rn <= 25")
def municipality_names_by_reach(v: Views) -> DataFrame:
    reach = v.sd.where(_CULT).groupBy("name_normalized").agg(F.count_distinct("siruta").alias("nat_count"))
    kind = F.when(F.max("has_person"), "person").when(F.max("has_nature"), "nature").when(F.max("is_saint") == 1, "saint").otherwise("other")
    g = v.star.where(_CULT).where("uat like 'MUNICIPIUL%'").groupBy("siruta", "name_normalized").agg(F.min("core_name").alias("core_name"), kind.alias("category")).join(reach, "name_normalized")
    return _top(g, ["siruta"], "nat_count", "name_normalized", 25)


@panel("select siruta, gender, core_name_norm, full_name, n, rn from (select siruta, gender, core_name_norm, max(full_name) full_name, count(*) n, row_number() over (partition by siruta, gender order by count(*) desc, core_name_norm) rn from sd join p using (core_name_norm) where uat like 'MUNICIPIUL%' and gender in ('M', 'F') group by 1, 2, 3) where rn <= 10")
def municipality_persons(v: Views) -> DataFrame:
    g = _persons(v, "full_name", "gender").where("uat like 'MUNICIPIUL%' and gender in ('M', 'F')").groupBy("siruta", "gender", "core_name_norm").agg(F.max("full_name").alias("full_name"), n_rows().alias("n"))
    return _top(g, ["siruta", "gender"], "n", "core_name_norm", 10)


@panel("select siruta, count(*) filter (gender = 'M') m, count(*) filter (gender = 'F') f from sd join p using (core_name_norm) where uat like 'MUNICIPIUL%' group by 1")
def municipality_genders(v: Views) -> DataFrame:
    return _persons(v, "gender").where("uat like 'MUNICIPIUL%'").groupBy("siruta").agg(F.count(F.when(F.col("gender") == "M", 1)).alias("m"), F.count(F.when(F.col("gender") == "F", 1)).alias("f"))


# ---- reports ---------------------------------------------------------------------------------------------------------

#: Municipalities of the country.
ALL_UNITS = 3181

for _s in ("postal", "renns"):

    @panel(f"select siruta, id, name, rn from (select siruta, id, name, row_number() over (partition by siruta order by id) rn from {_s} where id not in (select right_id from {_s}_m)) where rn <= 3", f"unmatched_{_s}_by_unit")
    def unmatched_by_unit(v: Views, source: str = _s) -> DataFrame:
        return profiles.top_per_group(unmatched(v, source), ["siruta"], ["id"], 3).select("siruta", "id", "name", "rn")


@panel("select count(distinct uat_siruta) units_with_rows, 3181 all_units, round(100.0::double * count(distinct uat_siruta) / 3181, 1) pct, (select count(distinct siruta) from streets) registry_units, count(*) filter (uat_siruta in (179141, 179150, 179169, 179178, 179187, 179196)) capital_rows from renns_streets")
def national_coverage(v: Views) -> DataFrame:
    t = v.table("renns_streets")
    g = t.agg(F.count_distinct("uat_siruta").alias("units_with_rows"), F.count(F.when(F.col("uat_siruta").isin(list(SECTORS)), 1)).alias("capital_rows"))
    units = v.raw.agg(F.count_distinct("siruta")).scalar()
    return g.select("units_with_rows", F.lit(ALL_UNITS).alias("all_units"), pct(F.col("units_with_rows"), F.lit(ALL_UNITS)).alias("pct"), units.alias("registry_units"), "capital_rows")


_KEYS = "(select distinct core_name_norm k from sd where core_name_norm is not null and is_numeric = 0 and is_date = 0 and is_saint = 0)"


@panel(f"select count(*) total, count(*) filter (known) classified, {_pct('count(*) filter (known)', 'count(*)')} pct, count(*) filter (not known) unclassified from (select k, k in (select core_name_norm from p union select core_name_norm from n union select core_name_norm from c union select core_name_norm from pl) known from {_KEYS})")
def curation_progress(v: Views) -> DataFrame:
    keys = v.sd.where("core_name_norm is not null and is_numeric = 0 and is_date = 0 and is_saint = 0").select("core_name_norm").distinct()
    known = reduce(DataFrame.union, (t.select("core_name_norm") for t in (v.persons, v.nature, v.categories, v.places))).distinct().withColumn("hit", F.lit(1))
    g = keys.join(known, "core_name_norm", "left").agg(n_rows().alias("total"), F.count("hit").alias("classified"))
    return g.select("total", "classified", pct(F.col("classified"), F.col("total")).alias("pct"), (F.col("total") - F.col("classified")).alias("unclassified"))


@panel("select judet, f_streets, m_streets, n total_person_streets, f_streets / n * 100::double f_pct from (select judet, count(*) filter (gender = 'F') f_streets, count(*) filter (gender = 'M') m_streets, count(*) n from sd join p using (core_name_norm) where gender in ('M', 'F') group by 1 having count(*) >= 10)")
def female_share_by_judet(v: Views) -> DataFrame:
    g = _persons(v, "gender").where("gender in ('M', 'F')").groupBy("judet").agg(n_if(F.col("gender") == "F").alias("f_streets"), n_if(F.col("gender") == "M").alias("m_streets"), n_rows().alias("total_person_streets")).where("total_person_streets >= 10")
    return g.withColumn("f_pct", F.col("f_streets") / F.col("total_person_streets") * 100.0)


@panel("select era, count(distinct core_name_norm) filter (gender = 'F') f, count(distinct core_name_norm) filter (gender = 'M') m from p where gender in ('M', 'F') and era is not null group by 1")
def persons_by_era_and_gender(v: Views) -> DataFrame:
    x = v.persons.where("gender in ('M', 'F') and era is not null")
    return x.groupBy("era").pivot("gender", ["F", "M"]).agg(F.count_distinct("core_name_norm")).na.fill(0).select("era", F.col("F").alias("f"), F.col("M").alias("m"))


_VIEWED = "(select core_name_norm, min(full_name) full_name, max(wiki_ro_views) views, count(*) streets from sd join p using (core_name_norm) where wiki_ro_views > 0 group by 1)"


@panel(f"select core_name_norm, full_name, views, streets from {_VIEWED} where views > (select quantile_cont(views, 0.92) from {_VIEWED}) or streets > (select quantile_cont(streets, 0.90) from {_VIEWED})")
def outliers_by_views_or_streets(v: Views) -> DataFrame:
    g = _persons(v, "full_name", "wiki_ro_views").where("wiki_ro_views > 0").groupBy("core_name_norm").agg(F.min("full_name").alias("full_name"), F.max("wiki_ro_views").alias("views"), n_rows().alias("streets"))
    cut = lambda c, q: g.agg(F.percentile(c, q)).scalar()
    return g.where((F.col("views") > cut("views", 0.92)) | (F.col("streets") > cut("streets", 0.90)))


@panel("select core_name_norm, min(full_name) full_name, min(profession) profession, min(era) era, count(*) streets from sd join p using (core_name_norm) where coalesce(wiki_sitelinks, 0) = 0 and wikidata_qid is not null group by 1 order by 5 desc, 1 limit 15")
def persons_without_article(v: Views) -> DataFrame:
    x = _persons(v, "full_name", "profession", "era", "wiki_sitelinks", "wikidata_qid").where("coalesce(wiki_sitelinks, 0) = 0 and wikidata_qid is not null")
    g = x.groupBy("core_name_norm").agg(*(F.min(c).alias(c) for c in ("full_name", "profession", "era")), n_rows().alias("streets"))
    return g.orderBy(F.desc("streets"), "core_name_norm").limit(15)


@panel("select judet, count(*) filter (category = 'ideological') ideo_streets, count(*) total_streets, round(100.0::double * count(*) filter (category = 'ideological') / count(*), 2) ideo_pct from st group by 1")
def ideology_share_by_judet(v: Views) -> DataFrame:
    hit = F.count(F.when(F.col("category") == "ideological", 1))
    return v.star.groupBy("judet").agg(hit.alias("ideo_streets"), n_rows().alias("total_streets"), F.round(F.lit(100.0) * hit / n_rows(), 2).alias("ideo_pct"))


@panel("select core_name_norm, min(name) as name, min(subcategory) subcategory, count(*) streets, count(distinct judet) judete from st where category = 'ideological' group by 1 order by 4 desc, 1 limit 15")
def ideological_names(v: Views) -> DataFrame:
    g = v.star.where("category = 'ideological'").groupBy("core_name_norm").agg(F.min("name").alias("name"), F.min("subcategory").alias("subcategory"), n_rows().alias("streets"), F.count_distinct("judet").alias("judete"))
    return g.orderBy(F.desc("streets"), "core_name_norm").limit(15)


@panel("select judet, count(*) filter (has_nature) nature_streets, count(*) filter (has_person) person_streets, count(*) total from st group by 1")
def nature_and_persons_by_judet(v: Views) -> DataFrame:
    return v.star.groupBy("judet").agg(F.count(F.when(F.col("has_nature"), 1)).alias("nature_streets"), F.count(F.when(F.col("has_person"), 1)).alias("person_streets"), n_rows().alias("total"))


@panel("select full_name, profession, era, sum(streets)::bigint streets, sum(units)::bigint units from (select full_name, profession, era, count(*) streets, count(distinct siruta) units from sd join p using (core_name_norm) where profession in ('poet', 'writer') group by 1, 2, 3, core_name_norm) group by 1, 2, 3 order by 4 desc, 1, 2, 3 nulls first limit 12")
def poets_and_writers(v: Views) -> DataFrame:
    g = _persons(v, "full_name", "profession", "era").where("profession in ('poet', 'writer')").groupBy("full_name", "profession", "era", "core_name_norm").agg(n_rows().alias("streets"), F.count_distinct("siruta").alias("units"))
    g = g.groupBy("full_name", "profession", "era").agg(F.sum("streets").alias("streets"), F.sum("units").alias("units"))
    return g.orderBy(F.desc("streets"), "full_name", "profession", "era").limit(12)


_ONE = "core_name_norm in ('eroilor')"


@panel(f"select judet, count(*) streets, any_value(units) units, count(*) / any_value(units)::double density from sd join (select judet, count(distinct siruta) units from sd group by 1) using (judet) where {_ONE} group by 1")
def one_name_density(v: Views) -> DataFrame:
    units = v.sd.groupBy("judet").agg(F.count_distinct("siruta").alias("units"))
    g = v.sd.where(_ONE).groupBy("judet").agg(n_rows().alias("streets")).join(units, "judet")
    return g.withColumn("density", F.col("streets") / F.col("units"))


@panel(f"select a.judet, count(*) total_uats, count(*) filter (e.siruta is null) missing_uats, round(100.0::double * count(*) filter (e.siruta is null) / count(*), 1) pct_missing from (select distinct judet, siruta, uat from sd) a left join (select distinct siruta from sd where {_ONE}) e using (siruta) group by 1 having count(*) >= 10")
def units_without_one_name(v: Views) -> DataFrame:
    have = v.sd.where(_ONE).select("siruta", F.lit(1).alias("hit")).distinct()
    g = v.sd.select("judet", "siruta", "uat").distinct().join(have, "siruta", "left").groupBy("judet").agg(n_rows().alias("total_uats"), (n_rows() - F.count("hit")).alias("missing_uats"))
    return g.where("total_uats >= 10").withColumn("pct_missing", pct(F.col("missing_uats"), F.col("total_uats")))


@panel("select name_normalized form, count(*) streets from sd where core_name_norm = 'eroilor' group by 1 order by 2 desc, 1 limit 15")
def one_name_forms(v: Views) -> DataFrame:
    return v.sd.where("core_name_norm = 'eroilor'").groupBy(F.col("name_normalized").alias("form")).agg(n_rows().alias("streets")).orderBy(F.desc("streets"), "form").limit(15)


@panel("select siruta, street_type, k, to_json(list(x order by x.source, x.name nulls first, x.street_type nulls first))::varchar variants from (select distinct siruta, street_type, coalesce(core_name_norm, name) k, {'source': source, 'name': name, 'street_type': street_type} x from un_all) group by 1, 2, 3")
def variants_as_json(v: Views) -> DataFrame:
    """The distinct spellings of a consolidated street as JSON, nulls kept."""
    sources = [("registry", v.sd), ("osm", v.osm), ("postal", v.postal.where("siruta is not null")), ("renns", v.renns)]
    rows = reduce(DataFrame.unionByName, (t.select(F.lit(n).alias("source"), "siruta", "street_type", "name", F.coalesce("core_name_norm", "name").alias("k")) for n, t in sources))
    g = rows.groupBy("siruta", "street_type", "k").agg(F.array_sort(F.collect_set(F.struct("source", "name", "street_type"))).alias("x"))
    return g.select("siruta", "street_type", "k", F.to_json("x", {"ignoreNullFields": "false"}).alias("variants"))


@panel("select source, count(*) n from (select distinct siruta, street_type, coalesce(core_name_norm, name) k, source, name from un_all) group by 1")
def variants_by_source(v: Views) -> DataFrame:
    """The spellings by source, read back from the JSON."""
    shape = "array<struct<source:string,name:string,street_type:string>>"
    return variants_as_json(v).select(F.explode(F.from_json("variants", shape)).alias("x")).groupBy("x.source").agg(n_rows().alias("n"))


@panel("select name_normalized, coalesce(len(list_distinct(list(judet) filter (judet is not null))), 0) n_judete, coalesce(len(list_distinct(list(street_type) filter (street_type is not null))), 0) n_types from sd group by 1")
def browser_arrays(v: Views) -> DataFrame:
    """The comma lists of the browser's rows as arrays again."""
    parts = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, ","))).cast("long")
    return PANELS["browser_rows"](v).select("name_normalized", parts("judete").alias("n_judete"), parts("street_types").alias("n_types"))


@panel("select strftime(date_trunc('month', published_at) - interval 1 month, '%Y-%m') as month, count(*) n from documents where published_at is not null group by 1")
def last_complete_months(v: Views) -> DataFrame:
    """How many texts each month is the last complete one for."""
    month = F.date_format(F.add_months(F.trunc("published_at", "month"), -1), "yyyy-MM")
    return v.table("documents").where("published_at is not null").groupBy(month.alias("month")).agg(n_rows().alias("n"))


# ---- text functions over whole tables --------------------------------------------------------------------------------

_FIXED = "regexp_replace(translate({c}, 'şţŞŢ', 'șțȘȚ'), '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')"
_LONG = """case when starts_with(s, 'Bd-ul ') then 'Bulevardul ' || s[7:] when starts_with(s, 'Bd. ') then 'Bulevardul ' || s[5:] when starts_with(s, 'B-dul ') then 'Bulevardul ' || s[7:] when starts_with(s, 'Bul. ') then 'Bulevardul ' || s[6:]
    when starts_with(s, 'Str. ') then 'Strada ' || s[6:] when starts_with(s, 'Sos. ') then 'Șoseaua ' || s[6:] when starts_with(s, 'Șos. ') then 'Șoseaua ' || s[6:] when starts_with(s, 'Cal. ') then 'Calea ' || s[6:] when starts_with(s, 'Pța. ') then 'Piața ' || s[6:]
    when starts_with(s, 'Pța ') then 'Piața ' || s[5:] when starts_with(s, 'Al. ') then 'Aleea ' || s[5:] when starts_with(s, 'Int. ') then 'Intrarea ' || s[6:] when starts_with(s, 'Dr. ') then 'Drumul ' || s[5:] else s end"""
_KINDS = "Bulevardul|Fundătura|Cartierul|Prelungirea|Strada|Aleea|Intrarea|Calea|Drumul|Piața|Șoseaua|Ulița|Splaiul|Pasajul|Cheiul|Trecerea|Cărarea|Stradela|Rampa"


@panel(f"select id, nullif(regexp_extract(t, '^({_KINDS}) ', 1), '') street_type, case when regexp_matches(t, '^({_KINDS}) ') then {_FIXED.format(c=f'regexp_replace(t, ' + chr(39) + f'^({_KINDS}) ' + chr(39) + ', ' + chr(39) + chr(39) + ')')} else t end rest from (select id, {_LONG} t from (select id, {_FIXED.format(c='artera_raw')} s from streets))")
def stripped_types(v: Views) -> DataFrame:
    return v.raw.select("id", tx.strip_street_type(F.col("artera_raw")).alias("x")).select("id", "x.street_type", "x.rest")


@panel(f"select id, nullif({_FIXED.format(c='regexp_replace(' + _FIXED.format(c='artera_raw') + ', ' + chr(39) + '[' + chr(92) + 's' + chr(92) + 'x{a0}]*' + chr(92) + '([^)]*' + chr(92) + ')' + chr(39) + ', ' + chr(39) + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, '') cleaned from streets")
def cleaned_names(v: Views) -> DataFrame:
    return v.raw.select("id", tx.clean_name(F.col("artera_raw")).alias("cleaned"))


_ROAD_MAP = "map {'strada': 'Strada', 'aleea': 'Aleea', 'fundatura': 'Fundătura', 'fundătura': 'Fundătura', 'fundacul': 'Fundătura', 'infundatura': 'Fundătura', 'înfundătura': 'Fundătura', 'intrarea': 'Intrarea', 'ulita': 'Ulița', 'ulița': 'Ulița', 'ulicioara': 'Ulicioara', 'drumul': 'Drumul', 'calea': 'Calea', 'bulevardul': 'Bulevardul', 'piata': 'Piața', 'piața': 'Piața', 'soseaua': 'Șoseaua', 'șoseaua': 'Șoseaua', 'soseaua nationala': 'Șoseaua', 'șoseaua națională': 'Șoseaua', 'stradela': 'Stradela', 'prelungirea': 'Prelungirea', 'curtea': 'Curtea', 'pasajul': 'Pasajul', 'splaiul': 'Splaiul', 'cartierul': 'Cartierul', 'parcul': 'Parcul', 'parc': 'Parcul', 'vadul': 'Vadul', 'trecatoarea': 'Trecerea', 'trecătoarea': 'Trecerea', 'cantonul': 'Cantonul', 'catun': 'Cătun', 'cătun': 'Cătun', 'scuarul': 'Scuarul', 'colonia': 'Colonia', 'centura': 'Centura', 'cvartal': 'Cvartal', 'pietonal': 'Pietonal', 'podul': 'Podul'}"
_ADMIN = "'', 'nespecificat', 'ds', 'd.s.', 'dc', 'de', 'dj', 'drumul ds', 'drumul dc', 'drum comunal', 'drum comunal dc', 'drum comunal de', 'drum judetean', 'drum judeţean', 'drum judetean dj', 'drum județean dj', 'drum national', 'drum naţional', 'drum național'"


@panel(f"select id, case when k in ({_ADMIN}) then null when m[k] is not null then m[k] when starts_with(k, 'strada ') then case when trim(k[8:]) in ('', 'strada') then 'Strada' else m[trim(k[8:])] end end street_type from (select id, lower({_FIXED.format(c='road_type_raw')}) k, {_ROAD_MAP} m from renns_streets)")
def cleaned_road_types(v: Views) -> DataFrame:
    return v.table("renns_streets").select("id", tx.clean_road_type(F.col("road_type_raw")).alias("street_type"))


@panel("select core_name_norm, coalesce(nullif(lower(wikidata_qid), ''), trim(regexp_replace(lower(strip_accents(replace(replace(full_name, 'î', 'â'), 'Î', 'Â'))), '[^a-z0-9]+', '-', 'g'), '-'), '') slug from p")
def person_slugs(v: Views) -> DataFrame:
    return v.persons.select("core_name_norm", tx.person_slug(F.col("wikidata_qid"), F.col("full_name")).alias("slug"))


@panel("select core_name_norm, try_cast(nullif(regexp_extract(t, '^([+-]?\\d{1,6})-', 1), '') as int) as year from (select core_name_norm, case when birth_year < 0 then '' else '+' end || birth_year || '-01-01T00:00:00Z' t from p)")
def claimed_years(v: Views) -> DataFrame:
    t = F.concat(F.when(F.col("birth_year") < 0, "").otherwise("+"), F.col("birth_year").cast("string"), F.lit("-01-01T00:00:00Z"))
    return v.persons.select("core_name_norm", tx.claim_year(t).alias("year"))


_CODES = "map {'alba': 'AB', 'arges': 'AG', 'arad': 'AR', 'bucuresti': 'B', 'bacau': 'BC', 'bihor': 'BH', 'bistrita-nasaud': 'BN', 'braila': 'BR', 'botosani': 'BT', 'brasov': 'BV', 'buzau': 'BZ', 'cluj': 'CJ', 'calarasi': 'CL', 'caras-severin': 'CS', 'constanta': 'CT', 'covasna': 'CV', 'dambovita': 'DB', 'dolj': 'DJ', 'gorj': 'GJ', 'galati': 'GL', 'giurgiu': 'GR', 'hunedoara': 'HD', 'harghita': 'HR', 'ilfov': 'IF', 'ialomita': 'IL', 'iasi': 'IS', 'mehedinti': 'MH', 'maramures': 'MM', 'mures': 'MS', 'neamt': 'NT', 'olt': 'OT', 'prahova': 'PH', 'sibiu': 'SB', 'salaj': 'SJ', 'satu mare': 'SM', 'suceava': 'SV', 'tulcea': 'TL', 'timis': 'TM', 'teleorman': 'TR', 'valcea': 'VL', 'vrancea': 'VN', 'vaslui': 'VS'}"


@panel(f"select id, ({_CODES})[lower(strip_accents(trim(judet_raw)))] code from postal_streets")
def county_codes(v: Views) -> DataFrame:
    return v.table("postal_streets").select("id", tx.county_code(F.col("judet_raw")).alias("code"))


@panel("select c_custkey node, n_regionkey + 20000000000 ancestor, 2 as level from customer join nation on n_nationkey = c_nationkey")
def regions_of_customers(v: Views) -> DataFrame:
    """The walk to an ancestor of a type, over customers, their nations and regions."""
    at = lambda c, shift: (F.col(c).cast("long") + shift)
    customers, nations = v.table("customer"), v.table("nation")
    edges = customers.select(F.col("c_custkey").alias("child"), at("c_nationkey", 10_000_000_000).alias("parent")).union(nations.select(at("n_nationkey", 10_000_000_000), at("n_regionkey", 20_000_000_000)))
    types = v.table("region").select(at("r_regionkey", 20_000_000_000).alias("node"), F.lit("region").alias("type"))
    start = customers.select(F.col("c_custkey").alias("node"))
    return profiles.ancestor_of_type(start, edges, types, ["region"], depth=3)


_CLASS_OF = "case street_type when 'Bulevardul' then 'primary' when 'Calea' then 'secondary' when 'Șoseaua' then 'tertiary' when 'Strada' then 'residential' else 'service' end"


@panel(f"""select uat_siruta, name_normalized, arg_min({{'n': name, 'l': locality_raw}}, id)['n'] as name, arg_min({{'n': name, 'l': locality_raw}}, id)['l'] locality_raw, array_to_string(list(id order by id), ',') way_ids,
    arg_max(c, (list_position(['service', 'pedestrian', 'living_street', 'residential', 'unclassified', 'tertiary', 'secondary', 'primary'], c), -id)) highway_class, arg_min(road_status, id) filter (road_status <> '') "ref"
    from (select *, {_CLASS_OF} c from renns_streets) group by 1, 2""")
def merged_roads(v: Views) -> DataFrame:
    """The cadastre's rows of one name as one road: the first row, all ids, the highest class, the first status that is given."""
    cls = F.when(F.col("street_type") == "Bulevardul", "primary").when(F.col("street_type") == "Calea", "secondary").when(F.col("street_type") == "Șoseaua", "tertiary").when(F.col("street_type") == "Strada", "residential").otherwise("service")
    ways = v.table("renns_streets").select("id", "uat_siruta", "name_normalized", "name", "locality_raw", F.col("id").alias("way"), cls.alias("highway_class"), F.col("road_status").alias("ref"))
    return roads.merge_ways(ways, ["uat_siruta", "name_normalized"], "id", "way", "highway_class", "ref").drop("id").withColumn("way_ids", F.array_join(F.col("way_ids").cast("array<string>"), ","))
