"""Panels, drill-downs, filters, reports and text functions as queries, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hodonym.functions import text as tx
from hodonym.functions.scoring import candidate_confidence, cause_macro, class_rank, group_zscore, scope
from hodonym.operators import filters as fl
from hodonym.operators import match, profiles, upserts
from hodonym.operators.classify import coverage_class, filter_class, macro_class, municipality_class, street_theme, top_name_class, unit_theme_class
from hodonym.operators.consolidate import additive_union
from hodonym.plans.adapter import CTES, Views
from hodonym.plans.catalog import TOKENS, _persons, _roads, n_if, n_rows, pct, unmatched
from hodonym.plans.catalog_sql import _CLASS, _COVER, _ROADS, _pct

PANELS: dict[str, Callable[[Views], DataFrame]] = {}
PANELS_SQL: dict[str, str] = {}


def panel(sql: str | None, name: str | None = None) -> Callable:
    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        PANELS[name or f.__name__] = f
        if sql:
            PANELS_SQL[name or f.__name__] = CTES + sql
        return f

    return add


_SP = "sd s join p using (core_name_norm)"
_CULT = "is_numeric = 0 and core_name is not null"
_MACRO = "case when is_saint = 1 then 'saint' when is_date = 1 then 'date' {n} when has_person then 'person' when has_nature then 'nature' when has_place then 'place' when {i} then 'ideologic' else 'other' end"
_V5 = _MACRO.format(n="", i="category = 'ideological'")
_V6 = _MACRO.format(n="when is_numeric = 1 then 'numeric'", i="category = 'ideological'")
_V16 = _MACRO.format(n="", i="subcategory is not null")
_V4 = "case when has_person then 'person' when has_nature then 'nature' when is_saint = 1 then 'saint' when is_date = 1 then 'date' when has_category then category else 'other' end"
_V7 = "case when has_person then 'person' when has_nature then 'nature' when is_saint = 1 then 'saint' else 'other' end"
_MAXED = "(select name_normalized, min(name) as name, count(*) n, max(is_numeric) is_numeric, max(is_date) is_date, max(is_saint) is_saint, bool_or(has_person) has_person, bool_or(has_nature) has_nature, bool_or(has_place) has_place, bool_or(has_category) has_category, max(category) category, max(subcategory) subcategory from st group by 1)"
_HAS = ["has_person", "has_nature", "has_place", "has_category"]


def _maxed(v: Views) -> DataFrame:
    return v.star.groupBy("name_normalized").agg(F.min("name").alias("name"), n_rows().alias("n"), *(F.max(c).alias(c) for c in ("is_numeric", "is_date", "is_saint", *_HAS, "category", "subcategory")))


# ---- names and persons -------------------------------------------------------------------------------------------


@panel(f"select judet, name, n, rn from (select judet, name_normalized, min(name) as name, count(*) n, row_number() over (partition by judet order by count(*) desc, name_normalized) rn from sd where {_CULT} group by 1, 2) where rn <= 50")
def top_names_by_judet(v: Views) -> DataFrame:
    g = v.sd.where(_CULT).groupBy("judet", "name_normalized").agg(F.min("name").alias("name"), n_rows().alias("n"))
    return profiles.top_per_group(g, ["judet"], [F.desc("n"), "name_normalized"], 50).select("judet", "name", "n", "rn")


@panel(f"select name, n, {_V4} kind from {_MAXED} order by n desc, name_normalized limit 50")
def top_names_with_class(v: Views) -> DataFrame:
    return _maxed(v).withColumn("kind", top_name_class()).orderBy(F.desc("n"), "name_normalized").limit(50).select("name", "n", "kind")


@panel(f"select judet, gender, full_name, n, rn from (select judet, gender, full_name, count(*) n, row_number() over (partition by judet, gender order by count(*) desc, full_name) rn from {_SP} where gender in ('M', 'F') group by 1, 2, 3) where rn <= 10")
def persons_by_judet_and_gender(v: Views) -> DataFrame:
    g = _persons(v, "full_name", "gender").where("gender in ('M', 'F')").groupBy("judet", "gender", "full_name").agg(n_rows().alias("n"))
    return profiles.top_per_group(g, ["judet", "gender"], [F.desc("n"), "full_name"], 10)


@panel(f"select judet, full_name, n, rn from (select judet, full_name, count(*) n, row_number() over (partition by judet order by count(*) desc, full_name) rn from {_SP} group by 1, 2) where rn <= 20")
def persons_by_judet(v: Views) -> DataFrame:
    g = _persons(v, "full_name").groupBy("judet", "full_name").agg(n_rows().alias("n"))
    return profiles.top_per_group(g, ["judet"], [F.desc("n"), "full_name"], 20)


@panel("select profession, era, count(distinct full_name) persons from p group by 1, 2")
def persons_by_profession_and_era(v: Views) -> DataFrame:
    return v.persons.groupBy("profession", "era").agg(F.count_distinct("full_name").alias("persons"))


@panel("select nationality, count(distinct p.core_name_norm) persons, count(s.id) streets from p left join sd s on s.core_name_norm = p.core_name_norm group by 1")
def nationality_by_persons_and_streets(v: Views) -> DataFrame:
    x = v.persons.select("core_name_norm", "nationality").join(v.sd.select("core_name_norm", "id"), "core_name_norm", "left")
    return x.groupBy("nationality").agg(F.count_distinct("core_name_norm").alias("persons"), F.count("id").alias("streets"))


@panel("select judet, siruta, nationality, count(*) streets from sd join p using (core_name_norm) group by 1, 2, 3")
def nationality_by_unit(v: Views) -> DataFrame:
    return _persons(v, "nationality").groupBy("judet", "siruta", "nationality").agg(n_rows().alias("streets"))


@panel("select full_name, max(wiki_ro_views)::bigint as views from p where wiki_ro_views is not null group by 1 order by 2 desc, 1 limit 20")
def most_viewed_persons(v: Views) -> DataFrame:
    return v.persons.where("wiki_ro_views is not null").groupBy("full_name").agg(F.max("wiki_ro_views").cast("long").alias("views")).orderBy(F.desc("views"), "full_name").limit(20)


@panel("select coalesce(wiki_scope, 'local') scope, count(distinct full_name) persons from p group by 1")
def scope_tiers(v: Views) -> DataFrame:
    return v.persons.groupBy(F.coalesce("wiki_scope", F.lit("local")).alias("scope")).agg(F.count_distinct("full_name").alias("persons"))


@panel("select core_name_norm, case when coalesce(wiki_sitelinks, 0) = 0 then 'unknown' when wiki_sitelinks >= 50 then 'universal' when wiki_sitelinks >= 5 then 'national' else 'local' end scope from p")
def scope_of_sitelinks(v: Views) -> DataFrame:
    return v.persons.select("core_name_norm", scope(F.col("wiki_sitelinks")).alias("scope"))


@panel("select min(full_name) full_name, min(judet) judet, count(*) streets from sd join p using (core_name_norm) group by core_name_norm having count(distinct siruta) = 1 order by 3 desc, 1, 2 limit 10")
def local_honorees(v: Views) -> DataFrame:
    g = _persons(v, "full_name").groupBy("core_name_norm").agg(F.min("full_name").alias("full_name"), F.min("judet").alias("judet"), n_rows().alias("streets"), F.count_distinct("siruta").alias("units"))
    return g.where("units = 1").orderBy(F.desc("streets"), "full_name", "judet").limit(10).select("full_name", "judet", "streets")


# ---- themes ---------------------------------------------------------------------------------------------------------

_OVERLAP = {"persons": "has_person", "nature": "has_nature", "saints": "is_saint = 1", "dates": "is_date = 1", "numbers": "is_numeric = 1", "places": "has_place", "ideology": "category = 'ideological'", "trades": "category in ('trade', 'occupational')"}


@panel(" union all ".join(f"select '{k}' theme, count(*) n from st where {c}" for k, c in _OVERLAP.items()))
def overlapping_themes(v: Views) -> DataFrame:
    hit = F.filter(F.array(*(F.when(F.expr(c), F.lit(k)) for k, c in _OVERLAP.items())), lambda x: x.isNotNull())
    found = v.star.select(F.explode(hit).alias("theme")).groupBy("theme").agg(n_rows().alias("n"))
    every = v.spark.createDataFrame([(k,) for k in _OVERLAP], "theme string")
    return every.join(found, "theme", "left").select("theme", F.coalesce("n", F.lit(0)).alias("n"))


@panel(f"select judet, {_V5} theme, count(*) n from st group by 1, 2")
def macro_themes_by_judet(v: Views) -> DataFrame:
    return v.star.groupBy("judet", macro_class().alias("theme")).agg(n_rows().alias("n"))


@panel(f"select siruta, {_V6} theme, count(*) n, {_pct('count(*)', 'sum(count(*)) over (partition by siruta)')} pct from st group by 1, 2")
def themes_by_unit(v: Views) -> DataFrame:
    g = v.star.groupBy("siruta", unit_theme_class().alias("theme")).agg(n_rows().alias("n"))
    return g.withColumn("pct", pct(F.col("n"), F.sum("n").over(Window.partitionBy("siruta"))))


@panel(f"select {_V7} theme, count(*) names, sum(n)::bigint streets from {_MAXED} group by 1")
def themes_of_names(v: Views) -> DataFrame:
    return _maxed(v).groupBy(municipality_class().alias("theme")).agg(n_rows().alias("names"), F.sum("n").alias("streets"))


@panel(f"select {_V16} theme, count(*) n from st group by 1")
def street_themes(v: Views) -> DataFrame:
    return v.star.groupBy(street_theme().alias("theme")).agg(n_rows().alias("n"))


@panel("select nature_type, name, n, rn from (select nature_type, min(name) as name, count(*) n, row_number() over (partition by nature_type order by count(*) desc, core_name_norm) rn from st where has_nature group by nature_type, core_name_norm) where rn <= 7")
def contests(v: Views) -> DataFrame:
    g = v.star.where("has_nature").groupBy("nature_type", "core_name_norm").agg(F.min("name").alias("name"), n_rows().alias("n"))
    return profiles.top_per_group(g, ["nature_type"], [F.desc("n"), "core_name_norm"], 7).drop("core_name_norm")


@panel(f"select alias_normalized token, count(*) n from street_aliases where regexp_matches(alias_normalized, '{TOKENS}') group by 1 order by 2 desc, 1 limit 12")
def ideology_tokens(v: Views) -> DataFrame:
    g = v.aliases.where(F.col("alias_normalized").rlike(TOKENS)).groupBy(F.col("alias_normalized").alias("token")).agg(n_rows().alias("n"))
    return g.orderBy(F.desc("n"), "token").limit(12)


# ---- regions --------------------------------------------------------------------------------------------------------

_SHARES = {"saint": "is_saint = 1", "numeric": "is_numeric = 1", "date": "is_date = 1", "female": "gender = 'F'", "male": "gender = 'M'", "person": "has_person", "foreign": "nationality <> 'RO'", "universal": "wiki_scope = 'universal'", "nature": "has_nature", "flora": "nature_type in ('flower', 'tree', 'plant', 'fruit', 'forest', 'orchard')", "ideology": "category = 'ideological'"}
_SHARE_SQL = ", ".join(f"{_pct(f'count(*) filter ({c})', 'count(*)')} {k}_pct" for k, c in _SHARES.items()) + f", {_pct('count(*) filter (birth_judet = judet)', 'count(birth_judet)')} self_honor_pct"


def _shares(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(n_rows().alias("total_streets"), *(pct(n_if(F.expr(c)), n_rows()).alias(f"{k}_pct") for k, c in _SHARES.items()), pct(n_if(F.expr("birth_judet = judet")), F.count("birth_judet")).alias("self_honor_pct"))


@panel(f"select judet, count(*) total_streets, {_SHARE_SQL} from st group by 1")
def shares_by_judet(v: Views) -> DataFrame:
    return _shares(v.star, "judet")


@panel(f"select siruta, count(*) total_streets, {_SHARE_SQL} from st group by 1 having count(*) >= 10")
def shares_by_unit(v: Views) -> DataFrame:
    return _shares(v.star, "siruta").where("total_streets >= 10")


@panel(f"select siruta, name, n from (select siruta, min(name) as name, count(*) n, row_number() over (partition by siruta order by count(*) desc, min(name), name_normalized) rn from sd where {_CULT} group by siruta, name_normalized) where rn = 1")
def modal_by_unit(v: Views) -> DataFrame:
    g = v.sd.where(_CULT).groupBy("siruta", "name_normalized").agg(F.min("name").alias("name"), n_rows().alias("n"))
    return profiles.top_per_group(g, ["siruta"], [F.desc("n"), "name", "name_normalized"], 1).select("siruta", "name", "n")


@panel(f"select judet, name, national, rn from (select judet, name, national, row_number() over (partition by judet order by national, name, name_normalized) rn from (select judet, name_normalized, min(name) as name from sd where {_CULT} group by 1, 2) join (select name_normalized, count(*) national from sd group by 1) using (name_normalized)) where rn <= 5")
def rarest_by_judet(v: Views) -> DataFrame:
    g = v.sd.where(_CULT).groupBy("judet", "name_normalized").agg(F.min("name").alias("name")).join(v.sd.groupBy("name_normalized").agg(n_rows().alias("national")), "name_normalized")
    return profiles.top_per_group(g, ["judet"], ["national", "name", "name_normalized"], 5).drop("name_normalized")


@panel(f"select name, judet, k local_total, t::bigint national_total, {_pct('k', 't')} pct from (select *, sum(k) over (partition by name_normalized) t from (select name_normalized, judet, min(name) as name, count(*) k from sd where {_CULT} group by 1, 2)) where t >= 5 and 10 * k >= 8 * t order by t desc, pct desc, name_normalized, judet limit 18")
def regional_signatures(v: Views) -> DataFrame:
    g = v.sd.where(_CULT).groupBy("name_normalized", "judet").agg(F.min("name").alias("name"), n_rows().alias("local_total"))
    g = g.withColumn("national_total", F.sum("local_total").over(Window.partitionBy("name_normalized"))).where("national_total >= 5 and 10 * local_total >= 8 * national_total").withColumn("pct", pct(F.col("local_total"), F.col("national_total")))
    return g.orderBy(F.desc("national_total"), F.desc("pct"), "name_normalized", "judet").limit(18).drop("name_normalized")


# The words that open names of landscapes.
HEADS = [
    "Valea", "Dealul", "Plaiul", "Pârâul", "Lunca", "Poiana", "Pădurea", "Moara", "Cetatea", "Stejarii", "Vatra", "Cireșii", "Râul", "Lacul", "Izvorul", "Vârful", "Gura", "Dosul", "Mănăstirea", "Cheile", "Coasta", "Pietrele",
    "Fântâna", "Câmpul", "Crucea", "Movila", "Vâlcele", "Bradului",
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEADS_SQL = "'Valea', 'Dealul', 'Plaiul', 'Pârâul', 'Lunca', 'Poiana', 'Pădurea', 'Moara', 'Cetatea', 'Stejarii', 'Vatra', 'Cireșii', 'Râul', 'Lacul', 'Izvorul', 'Vârful', 'Gura', 'Dosul', 'Mănăstirea', 'Cheile', 'Coasta', 'Pietrele', 'Fântâna', 'Câmpul', 'Crucea', 'Movila', 'Vâlcele', 'Bradului'"


@panel(f"select name, judet, uat from (select *, split_part(name, ' ', 1) prefix, row_number() over (partition by split_part(name, ' ', 1) order by name, name_normalized) rn from (select name_normalized, min(name) as name, min(judet) judet, min(uat) uat from sd where {_CULT} group by 1 having count(distinct siruta) = 1) where length(name) between 10 and 30 and contains(name, ' ') and translate(split_part(name, ' ', 1), '{UPPER}', '{LOWER}') in (select translate(unnest([{_HEADS_SQL}]), '{UPPER}', '{LOWER}'))) where rn = 1 order by prefix limit 14")
def local_uniques(v: Views) -> DataFrame:
    """The first name of each landscape word that one municipality alone has; letters A to Z count in either case."""
    small = lambda c: F.translate(c, UPPER, LOWER)
    g = v.sd.where(_CULT).groupBy("name_normalized").agg(F.min("name").alias("name"), F.min("judet").alias("judet"), F.min("uat").alias("uat"), F.count_distinct("siruta").alias("units"))
    g = g.withColumn("prefix", F.substring_index("name", " ", 1)).where((F.col("units") == 1) & F.length("name").between(10, 30) & F.contains("name", F.lit(" ")) & small(F.col("prefix")).isin([h.translate(str.maketrans(UPPER, LOWER)) for h in HEADS]))
    return profiles.top_per_group(g, ["prefix"], ["name", "name_normalized"], 1).orderBy("prefix").limit(14).select("name", "judet", "uat")


@panel(f"select judet, count(*) n from (select name_normalized, min(judet) judet, count(*) k from sd where {_CULT} group by 1 having count(distinct judet) = 1) where k >= 3 group by 1 order by 2 desc, 1 limit 8")
def exclusive_names_by_judet(v: Views) -> DataFrame:
    g = v.sd.where(_CULT).groupBy("name_normalized").agg(F.min("judet").alias("judet"), n_rows().alias("k"), F.count_distinct("judet").alias("j")).where("j = 1 and k >= 3")
    return g.groupBy("judet").agg(n_rows().alias("n")).orderBy(F.desc("n"), "judet").limit(8)


@panel(f"select judet, count(*) total, {_pct('count(*) filter (has_nature)', 'count(*)')} nature_pct, {_pct('count(*) filter (category = ' + chr(39) + 'ideological' + chr(39) + ')', 'count(*)')} ideology_pct from st where is_numeric = 0 group by 1")
def nature_and_ideology_by_judet(v: Views) -> DataFrame:
    return v.star.where("is_numeric = 0").groupBy("judet").agg(n_rows().alias("total"), pct(n_if(F.col("has_nature")), n_rows()).alias("nature_pct"), pct(n_if(F.expr("category = 'ideological'")), n_rows()).alias("ideology_pct"))


# ---- places of birth, ages, causes ------------------------------------------------------------------------------------

_PER = "(select full_name, min(birth_judet) birth_judet, count(distinct s.id) total_streets, count(distinct s.judet) judete_reach, count(*) filter (s.judet = birth_judet) home_streets from sd s join p using (core_name_norm) where birth_judet is not null group by 1)"


def _per_person(v: Views) -> DataFrame:
    g = _persons(v, "full_name", "birth_judet").where("birth_judet is not null").groupBy("full_name")
    return g.agg(F.min("birth_judet").alias("birth_judet"), F.count_distinct("id").alias("total_streets"), F.count_distinct("judet").alias("judete_reach"), n_if(F.col("judet") == F.col("birth_judet")).alias("home_streets"))


@panel(f"select *, {_pct('home_streets', 'total_streets')} home_pct from {_PER} where total_streets >= 10 and 20 * home_streets <= total_streets order by total_streets desc, full_name limit 12")
def forgotten_at_home(v: Views) -> DataFrame:
    g = _per_person(v).where("total_streets >= 10 and 20 * home_streets <= total_streets").withColumn("home_pct", pct(F.col("home_streets"), F.col("total_streets")))
    return g.orderBy(F.desc("total_streets"), "full_name").limit(12)


@panel(f"select birth_judet, count(*) honorees, sum(total_streets)::bigint streets from {_PER} group by 1 order by 3 desc, 1 limit 10")
def most_exported(v: Views) -> DataFrame:
    return _per_person(v).groupBy("birth_judet").agg(n_rows().alias("honorees"), F.sum("total_streets").alias("streets")).orderBy(F.desc("streets"), "birth_judet").limit(10)


@panel(f"select full_name, judet dominant_judet, k streets_in_judet, t::bigint total_streets, {_pct('k', 't')} pct_in_dominant from (select *, row_number() over (partition by full_name order by k desc, judet) rn, sum(k) over (partition by full_name) t from (select full_name, s.judet, count(*) k from sd s join p using (core_name_norm) group by 1, 2)) where rn = 1 and t >= 8 order by 5 desc, 4 desc, 1 limit 12")
def most_parochial(v: Views) -> DataFrame:
    g = _persons(v, "full_name").groupBy("full_name", F.col("judet").alias("dominant_judet")).agg(n_rows().alias("streets_in_judet")).withColumn("total_streets", F.sum("streets_in_judet").over(Window.partitionBy("full_name")))
    g = profiles.top_per_group(g, ["full_name"], [F.desc("streets_in_judet"), "dominant_judet"], 1).where("total_streets >= 8").withColumn("pct_in_dominant", pct(F.col("streets_in_judet"), F.col("total_streets")))
    return g.orderBy(F.desc("pct_in_dominant"), F.desc("total_streets"), "full_name").limit(12).drop("rn")


@panel("select round(sum((death_year - birth_year) * k)::double / sum(k), 6) mean_age, count(*) persons, min(death_year - birth_year)::int youngest from (select core_name_norm, min(birth_year) birth_year, min(death_year) death_year, count(*) k from sd join p using (core_name_norm) where birth_year is not null and death_year is not null group by 1)")
def mean_age_at_death(v: Views) -> DataFrame:
    g = _persons(v, "birth_year", "death_year").where("birth_year is not null and death_year is not null").groupBy("core_name_norm").agg((F.min("death_year") - F.min("birth_year")).alias("age"), n_rows().alias("k"))
    return g.agg(F.round(F.sum(F.col("age") * F.col("k")).cast("double") / F.sum("k"), 6).alias("mean_age"), n_rows().alias("persons"), F.min("age").cast("int").alias("youngest"))


_CAUSE = """case when coalesce(cause_of_death_label, '') = '' then 'necunoscută'
    when regexp_matches(lower(cause_of_death_label), 'tuberculosis|pneumonia|typhus|plague|cancer|hepatitis|nephritis|infarction|stroke|gout|seizure|foodborne|lung|infectious|alzheimer|asphyxia|disease|illness') then 'boală'
    when regexp_matches(lower(cause_of_death_label), 'gunshot|shooting|execution|decapitation|breaking wheel|poison|ambush|murder|killed') then 'violență'
    when regexp_matches(lower(cause_of_death_label), 'collision|vehicle|accident|earthquake|invention') then 'accident' else 'altele' end"""


@panel(f"select {_CAUSE} cause, count(*) persons, {_pct('count(*)', 'sum(count(*)) over ()')} pct from p group by 1")
def causes_of_death(v: Views) -> DataFrame:
    g = v.persons.groupBy(cause_macro(F.col("cause_of_death_label")).alias("cause")).agg(n_rows().alias("persons"))
    return g.withColumn("pct", pct(F.col("persons"), F.sum("persons").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))  # five rows at most


@panel("select century_start, 'sec. ' || (abs(century_start // 100) + case when century_start < 0 then 0 else 1 end) || case when century_start < 0 then ' î.Hr.' else '' end label, persons from (select (cast(birth_year as int) // 100) * 100 century_start, count(*) persons from p where birth_year is not null group by 1)")
def birth_centuries(v: Views) -> DataFrame:
    g = v.persons.where("birth_year is not null").groupBy((F.expr("birth_year div 100") * 100).alias("century_start")).agg(n_rows().alias("persons"))
    return g.withColumn("label", tx.century_label(F.col("century_start")))


# ---- roads, scores ----------------------------------------------------------------------------------------------------

_TIERS = {"main": ("primary", "secondary"), "local": ("tertiary", "unclassified"), "living": ("residential", "living_street"), "other": ("pedestrian", "service")}


@panel("select category, " + ", ".join(f"count(*) filter (o.highway_class in {t}) {k}" for k, t in _TIERS.items()) + f", count(*) total from (select id, {_COVER} category from st) s {_ROADS} group by 1")
def class_by_category_pivot(v: Views) -> DataFrame:
    tier = None
    for k, t in _TIERS.items():
        tier = F.when(F.col("highway_class").isin(*t), k) if tier is None else tier.when(F.col("highway_class").isin(*t), k)
    g = _roads(v, v.star.select("id", coverage_class().alias("category"))).withColumn("tier", tier)
    x = g.groupBy("category").pivot("tier", list(_TIERS)).agg(n_rows()).na.fill(0)
    return x.withColumn("total", sum((F.col(k) for k in _TIERS), F.lit(0)))


@panel("select id, siruta, importance, case when n < 2 or s = 0 then 0.0 else round((importance - a) / s, 6) end z from (select id, siruta, importance, avg(importance) over w a, stddev_pop(importance) over w s, count(*) over w n from osm window w as (partition by siruta))")
def importance_zscores(v: Views) -> DataFrame:
    return group_zscore(v.osm.select("id", "siruta", "importance"), ["siruta"], "importance", "z").withColumn("z", F.round("z", 6))


@panel("select highway_class, min(importance) least, median(importance) middle, max(importance) most from osm group by 1")
def importance_spread(v: Views) -> DataFrame:
    return v.osm.groupBy("highway_class").agg(F.min("importance").alias("least"), F.median("importance").alias("middle"), F.max("importance").alias("most"))


@panel("select id, coalesce(list_position(['service', 'pedestrian', 'living_street', 'residential', 'unclassified', 'tertiary', 'secondary', 'primary'], highway_class), 0) - 1 as place from osm")
def road_class_ranks(v: Views) -> DataFrame:
    return v.osm.select("id", class_rank(F.col("highway_class")).alias("place"))


# ---- association, diversity -------------------------------------------------------------------------------------------

_BASKETS = "(select distinct siruta basket, full_name item from sd join p using (core_name_norm) where siruta is not null)"


@panel(f"select item full_name, count(*) units, {_pct('count(*)', f'(select count(distinct basket) from {_BASKETS})')} pct from {_BASKETS} group by 1 having 10 * count(*) >= 3 * (select count(distinct basket) from {_BASKETS})")
def canon_set(v: Views) -> DataFrame:
    b = profiles.baskets(_persons(v, "full_name"), "siruta", "full_name")
    total = b.agg(F.count_distinct("basket")).scalar()
    g = b.groupBy(F.col("item").alias("full_name")).agg(n_rows().alias("units")).where(F.col("units") * 10 >= total * 3)
    return g.withColumn("pct", pct(F.col("units"), total))


@panel(f"""select a.item name_a, b.item name_b, count(*) co, round(count(*) * t.n / (a.sup * b.sup)::double, 6) lift, {_pct('count(*)', 'a.sup')} conf_ab, a.sup sup_a, b.sup sup_b
    from (select *, count(*) over (partition by item) sup from {_BASKETS}) a join (select *, count(*) over (partition by item) sup from {_BASKETS}) b on a.basket = b.basket and a.item < b.item, (select count(distinct basket) n from {_BASKETS}) t
    where a.sup >= greatest(5, floor(0.05 * t.n)) and b.sup >= greatest(5, floor(0.05 * t.n)) group by a.item, b.item, a.sup, b.sup, t.n having count(*) >= 5""")
def person_pairs_by_lift(v: Views) -> DataFrame:
    """Every pair; ``surprising_pairs`` is its head without the pairs that one expects."""
    return profiles.association_rules(profiles.baskets(_persons(v, "full_name"), "siruta", "full_name"))


@panel("select judet, sum(c)::bigint n, round(-sum(c / t * log2(c / t + 1e-12)), 6) entropy from (select judet, theme, count(*)::double c, sum(count(*)) over (partition by judet)::double t from (select judet, " + _COVER + " theme from st) group by 1, 2) group by 1")
def theme_entropy_bits(v: Views) -> DataFrame:
    return profiles.entropy(v.star.select("judet", coverage_class().alias("theme")), ["judet"], "theme", base2=True, smoothing=1e-12)


# ---- words and letters ------------------------------------------------------------------------------------------------

_NAMES = f"(select name_normalized n, min(name) disp, count(*) streets, count(distinct siruta) uats from sd where {_CULT} group by 1)"
_WORDS = "(select name_normalized n, min(name) disp, count(*) streets, count(distinct siruta) uats from sd where is_numeric = 0 group by 1)"


def _names(v: Views, which: str = _CULT) -> DataFrame:
    return v.sd.where(which).groupBy(F.col("name_normalized").alias("n")).agg(F.min("name").alias("disp"), n_rows().alias("streets"), F.count_distinct("siruta").alias("uats"))


@panel(f"select upper(left(n, 1)) letter, count(*) as names, sum(streets)::bigint streets from {_WORDS} where regexp_matches(n, '^[a-z]') group by 1")
def first_letters(v: Views) -> DataFrame:
    return _names(v, "is_numeric = 0").where("n rlike '^[a-z]'").groupBy(F.upper(F.substring("n", 1, 1)).alias("letter")).agg(n_rows().alias("names"), F.sum("streets").alias("streets"))


@panel(f"select disp, streets, uats from (select *, regexp_replace(n, '[^a-z0-9]', '', 'g') k from {_WORDS}) where length(k) >= 5 and k = reverse(k) and not regexp_matches(n, '^a [ivxlcdm]+-?a?$')")
def palindromes(v: Views) -> DataFrame:
    k = F.regexp_replace("n", "[^a-z0-9]", "")
    return _names(v, "is_numeric = 0").where((F.length(k) >= 5) & (k == F.reverse(k)) & ~F.col("n").rlike(r"^a [ivxlcdm]+-?a?\z")).select("disp", "streets", "uats")


@panel(f"select disp, len, streets from (select *, length(regexp_replace(trim(disp), '\\s+', ' ', 'g')) len from {_WORDS}) where not contains(trim(disp), ' ') and regexp_full_match(trim(disp), '\\p{{L}}+') and len >= 3 order by len, streets desc, n limit 8")
def shortest_names(v: Views) -> DataFrame:
    d = F.trim("disp")
    x = _names(v, "is_numeric = 0").withColumn("len", F.length(F.regexp_replace(d, r"\s+", " "))).where(d.rlike(r"^\p{L}+$") & (F.col("len") >= 3))
    return x.orderBy("len", F.desc("streets"), "n").limit(8).select("disp", "len", "streets")


# Prepositions that open names.
_PREPS = ["la", "sub", "catre", "peste", "intre", "spre", "dupa", "langa", "din", "in", "pe", "dinspre", "dintre", "deasupra"]


@panel(f"select disp, streets from {_WORDS} where contains(n, ' ') and split_part(n, ' ', 1) in ({', '.join(repr(p) for p in _PREPS)}) order by streets desc, n limit 18")
def prepositional_names(v: Views) -> DataFrame:
    return _names(v, "is_numeric = 0").where(F.col("n").contains(" ") & F.split("n", " ")[0].isin(_PREPS)).orderBy(F.desc("streets"), "n").limit(18).select("disp", "streets")


@panel(f"select disp, streets, missing from (select name_normalized, min(name) disp, count(*) streets, list_sort(list_distinct(list(judet))) seen from sd where is_numeric = 0 group by 1) s, (select judet missing from sd where is_numeric = 0 group by 1) m where not list_contains(seen, missing) and len(seen) = (select count(distinct judet) - 1 from sd where is_numeric = 0)")
def near_universal(v: Views) -> DataFrame:
    named = v.sd.where("is_numeric = 0")
    every = named.where("judet is not null").agg(F.array_sort(F.collect_set("judet"))).scalar()  # the counties
    g = named.groupBy("name_normalized").agg(F.min("name").alias("disp"), n_rows().alias("streets"), F.collect_set("judet").alias("seen"))
    return g.where(F.size("seen") == F.size(every) - 1).select("disp", "streets", F.array_except(every, "seen")[0].alias("missing"))


@panel(f"select count(*) as names, count(*) filter (uats = 1) singletons, {_pct('count(*) filter (uats = 1)', 'count(*)')} pct from {_WORDS}")
def singleton_share(v: Views) -> DataFrame:
    return _names(v, "is_numeric = 0").agg(n_rows().alias("names"), n_if(F.col("uats") == 1).alias("singletons"), pct(n_if(F.col("uats") == 1), n_rows()).alias("pct"))


# ---- entities ---------------------------------------------------------------------------------------------------------

_SLUG = "trim(regexp_replace(name_normalized, '[^a-z0-9]+', '-', 'g'), '-')"


@panel(f"select name_normalized, streets, uats, slug || case when rn > 1 then '-' || rn else '' end slug from (select *, row_number() over (partition by slug order by streets desc, name_normalized) rn from (select name_normalized, {_SLUG} slug, count(*) streets, count(distinct siruta) uats from sd where {_CULT} group by 1, 2 having count(distinct siruta) >= 5))")
def street_pages(v: Views) -> DataFrame:
    g = v.sd.where(_CULT).groupBy("name_normalized").agg(n_rows().alias("streets"), F.count_distinct("siruta").alias("uats")).where("uats >= 5")
    g = g.withColumn("slug", F.regexp_replace(F.regexp_replace("name_normalized", "[^a-z0-9]+", "-"), "^-+|-+$", ""))
    return profiles.unique_slugs(g, "slug", [F.desc("streets"), "name_normalized"])


@panel("select full_name, min(wikidata_qid) wikidata_qid, count(s.id) streets, count(distinct p.core_name_norm) spellings from p left join sd s on s.core_name_norm = p.core_name_norm group by 1")
def person_pages(v: Views) -> DataFrame:
    x = v.persons.select("core_name_norm", "full_name", "wikidata_qid").join(v.sd.select("core_name_norm", "id"), "core_name_norm", "left")
    return x.groupBy("full_name").agg(F.min("wikidata_qid").alias("wikidata_qid"), F.count("id").alias("streets"), F.count_distinct("core_name_norm").alias("spellings"))


# The codes of the county seats.
SEATS = [
    1017, 13169, 9262, 20297, 26564, 32394, 42682, 35731, 40198, 44818, 54975, 92569, 50790, 60419, 63394, 65342, 69900, 77812, 75098, 100521, 86687, 83320, 100576, 92658, 95060, 109773, 106318, 114319,
    120726, 125347, 130534, 143450, 139704, 136483, 146263, 159614, 155243, 151790, 167473, 174744, 161945,
]
_SEATS_SQL = "1017, 13169, 9262, 20297, 26564, 32394, 42682, 35731, 40198, 44818, 54975, 92569, 50790, 60419, 63394, 65342, 69900, 77812, 75098, 100521, 86687, 83320, 100576, 92658, 95060, 109773, 106318, 114319, 120726, 125347, 130534, 143450, 139704, 136483, 146263, 159614, 155243, 151790, 167473, 174744, 161945"
_UNITS_SQL = f"(select siruta, arg_min(judet, id) judet, arg_min(uat, id) uat, count(*) streets, coalesce(siruta in ({_SEATS_SQL}), false) is_capital from sd group by 1 having siruta in ({_SEATS_SQL}) or arg_min(judet, id) = 'B' or (arg_min(uat, id) like 'MUNICIPIUL %' and count(*) >= 50))"


@panel(f"select siruta, judet, translate(uat, 'şţŞŢ', 'șțȘȚ') uat, streets, is_capital, trim(regexp_replace(lower(strip_accents(replace(replace(uat, 'î', 'â'), 'Î', 'Â'))), '[^a-z0-9]+', '-', 'g'), '-') slug from {_UNITS_SQL}")
def unit_pages(v: Views) -> DataFrame:
    """The municipalities with a page: county seats, the sectors of the capital, and towns called MUNICIPIUL with at least fifty streets."""
    g = v.sd.groupBy("siruta").agg(F.min_by("judet", "id").alias("judet"), F.min_by("uat", "id").alias("uat"), n_rows().alias("streets")).withColumn("is_capital", F.coalesce(F.col("siruta").isin(SEATS), F.lit(False)))
    g = g.where("is_capital or judet = 'B' or (uat like 'MUNICIPIUL %' and streets >= 50)")
    return g.select("siruta", "judet", tx.fix_diacritics(F.col("uat")).alias("uat"), "streets", "is_capital", tx.slugify(tx.fix_diacritics(F.col("uat"))).alias("slug")).where("slug != ''")


@panel(f"select 'macro' kind, {_V5} theme, count(*) n from st group by 2 union all select 'profession', profession, count(*) from st where profession is not null group by 2 union all select 'nature', nature_type, count(*) from st where has_nature group by 2 union all select 'ideology', subcategory, count(*) from st where category = 'ideological' group by 2")
def theme_pages(v: Views) -> DataFrame:
    parts = [("macro", v.star, macro_class()), ("profession", v.star.where("profession is not null"), F.col("profession")), ("nature", v.star.where("has_nature"), F.col("nature_type")), ("ideology", v.star.where("category = 'ideological'"), F.col("subcategory"))]
    out = None
    for k, t, c in parts:
        g = t.groupBy(c.alias("theme")).agg(n_rows().alias("n")).select(F.lit(k).alias("kind"), "theme", "n")
        out = g if out is None else out.unionByName(g)
    return out


@panel("select name_normalized, judet, count(*) streets, count(distinct siruta) units, array_to_string(list_sort(list_distinct(list(uat))), ';') uats from sd group by 1, 2")
def street_details(v: Views) -> DataFrame:
    return v.sd.groupBy("name_normalized", "judet").agg(n_rows().alias("streets"), F.count_distinct("siruta").alias("units"), F.array_join(F.array_sort(F.collect_set("uat")), ";").alias("uats"))


@panel("""select core_name_norm, peer, streets, rn from (select a.core_name_norm, b.core_name_norm peer, b.k streets, row_number() over (partition by a.core_name_norm order by b.k desc, b.core_name_norm) rn
    from p a join (select p.core_name_norm, profession, era, count(s.id) k from p left join sd s using (core_name_norm) group by 1, 2, 3) b on (a.profession <> '' and a.profession = b.profession or a.era <> '' and a.era = b.era) and a.core_name_norm <> b.core_name_norm) where rn <= 8""")
def person_peers(v: Views) -> DataFrame:
    """The eight most honoured other persons of a person's profession or era: those are among the nine best of either."""
    best = v.persons.select("core_name_norm", "profession", "era").join(v.sd.select("core_name_norm", "id"), "core_name_norm", "left").groupBy("core_name_norm", "profession", "era").agg(F.count("id").alias("streets"))
    near = None
    for c in ("profession", "era"):
        top = profiles.top_per_group(best.where(f"{c} != ''"), [c], [F.desc("streets"), "core_name_norm"], 9).select(F.col("core_name_norm").alias("peer"), c, "streets")
        x = v.persons.select("core_name_norm", c).join(top, c).select("core_name_norm", "peer", "streets")
        near = x if near is None else near.unionByName(x)
    return profiles.top_per_group(near.where("core_name_norm != peer").distinct(), ["core_name_norm"], [F.desc("streets"), "peer"], 8)


@panel(f"select siruta, name_normalized, units from (select distinct siruta, name_normalized from sd where {_CULT}) join (select name_normalized, count(distinct siruta) units from sd group by 1 having count(distinct siruta) <= 3) using (name_normalized)")
def rare_names_by_unit(v: Views) -> DataFrame:
    rare = v.sd.groupBy("name_normalized").agg(F.count_distinct("siruta").alias("units")).where("units <= 3")
    return v.sd.where(_CULT).select("siruta", "name_normalized").distinct().join(rare, "name_normalized")


@panel(f"select theme, name, n, rn from (select theme, name_normalized, min(name) as name, count(*) n, row_number() over (partition by theme order by count(*) desc, name_normalized) rn from (select *, {_V5} theme from st) group by 1, 2) where rn <= 60")
def theme_details(v: Views) -> DataFrame:
    g = v.star.withColumn("theme", macro_class()).groupBy("theme", "name_normalized").agg(F.min("name").alias("name"), n_rows().alias("n"))
    return profiles.top_per_group(g, ["theme"], [F.desc("n"), "name_normalized"], 60).drop("name_normalized")


@panel(f"select n name_normalized, disp, streets, uats >= 5 has_page from {_NAMES}")
def explorer_index(v: Views) -> DataFrame:
    return _names(v).select(F.col("n").alias("name_normalized"), "disp", "streets", (F.col("uats") >= 5).alias("has_page"))


@panel("select name_normalized, array_to_string(list_sort(list_distinct(list(judet))), ',') judete, array_to_string(list_sort(list_distinct(list(street_type))), ',') street_types, count(*) n from sd group by 1")
def browser_rows(v: Views) -> DataFrame:
    return v.sd.groupBy("name_normalized").agg(F.array_join(F.array_sort(F.collect_set("judet")), ",").alias("judete"), F.array_join(F.array_sort(F.collect_set("street_type")), ",").alias("street_types"), n_rows().alias("n"))


@panel("select siruta, name_normalized, reach, rn from (select siruta, name_normalized, reach, row_number() over (partition by siruta order by reach desc, name_normalized) rn from (select distinct siruta, name_normalized from sd where uat like 'MUNICIPIUL%') join (select name_normalized, count(distinct siruta) reach from sd group by 1) using (name_normalized)) where rn <= 25")
def municipality_top_names(v: Views) -> DataFrame:
    reach = v.sd.groupBy("name_normalized").agg(F.count_distinct("siruta").alias("reach"))
    x = v.sd.where("uat like 'MUNICIPIUL%'").select("siruta", "name_normalized").distinct().join(reach, "name_normalized")
    return profiles.top_per_group(x, ["siruta"], [F.desc("reach"), "name_normalized"], 25)


# ---- sources ----------------------------------------------------------------------------------------------------------

_NAMES4 = ("registry", "osm", "postal", "renns")


@panel("select judet, count(*) n, " + ", ".join(f"count(*) filter (list_contains(sources, '{s}')) in_{s}" for s in _NAMES4) + " from al group by 1")
def source_coverage_by_judet(v: Views) -> DataFrame:
    return v.all_names.groupBy("judet").agg(n_rows().alias("n"), *(n_if(F.array_contains("sources", s)).alias(f"in_{s}") for s in _NAMES4))


@panel("select siruta, count(*) n, " + ", ".join(f"count(*) filter (list_contains(sources, '{s}')) in_{s}" for s in _NAMES4) + " from al group by 1")
def source_coverage_by_unit(v: Views) -> DataFrame:
    return v.all_names.groupBy("siruta").agg(n_rows().alias("n"), *(n_if(F.array_contains("sources", s)).alias(f"in_{s}") for s in _NAMES4))


@panel("select source, count(*) n, count(distinct siruta) units from un_all group by 1")
def sources_overview(v: Views) -> DataFrame:
    parts = [(n, t) for n, t in zip(_NAMES4, (v.sd, v.osm, v.postal.where("siruta is not null"), v.renns))]
    out = None
    for n, t in parts:
        g = t.select(F.lit(n).alias("source"), "siruta")
        out = g if out is None else out.unionByName(g)
    return out.groupBy("source").agg(n_rows().alias("n"), F.count_distinct("siruta").alias("units"))


@panel("select source, count(*) n from (select 'registry' source from sd union all select 'osm' from osm where id not in (select right_id from osm_m) union all select 'postal' from postal where siruta is not null and id not in (select right_id from postal_m) union all select 'renns' from renns where siruta is not null and id not in (select right_id from renns_m)) group by 1")
def additive_sources(v: Views) -> DataFrame:
    src = [("osm", v.osm, v.osm_m), ("postal", v.postal.where("siruta is not null"), v.postal_m), ("renns", v.renns.where("siruta is not null"), v.renns_m)]
    return additive_union(v.sd, src).groupBy("source").agg(n_rows().alias("n"))


for _s in ("osm", "postal", "renns"):
    PANELS[f"match_tiers_{_s}"] = lambda v, s=_s: getattr(v, f"{s}_m").groupBy("match_type", "confidence").agg(n_rows().alias("n"))
    PANELS_SQL[f"match_tiers_{_s}"] = CTES + f"select match_type, confidence, count(*) n from {_s}_m group by 1, 2"
    PANELS[f"match_coverage_{_s}"] = lambda v, s=_s: match.coverage(getattr(v, f"{s}_m"), v.sd, getattr(v, s))
    PANELS_SQL[f"match_coverage_{_s}"] = CTES + f"select count(distinct left_id) left_matched, count(distinct right_id) right_matched, (select count(*) from sd) left_total, (select count(*) from {_s}) right_total from {_s}_m"


@panel("select resolution_method, count(*) n, count(siruta) located from postal group by 1")
def resolution_methods(v: Views) -> DataFrame:
    return v.postal.groupBy("resolution_method").agg(n_rows().alias("n"), F.count("siruta").alias("located"))


_LOC = "lower(strip_accents(regexp_replace(localitate_raw, '^Mun\\. ', '')))"


@panel(f"""select method, count(*) n, count(distinct unit) units from (select o.id, coalesce(d.siruta, e.siruta, f.siruta) unit, case when d.siruta is not null then 'direct' when e.siruta is not null then 'name_exact' when f.siruta is not null then 'name_prefix' else 'unresolved' end as method
    from (select id, cast(uat_siruta as int) code, judet_raw, {_LOC} place from postal_streets) o left join un d on d.siruta = o.code
    left join (select judet, lower(strip_accents(uat)) place, min(siruta) siruta from un group by 1, 2) e on e.judet = o.judet_raw and e.place = o.place
    left join (select o.judet_raw, o.place, min(un.siruta) siruta from (select distinct judet_raw, {_LOC} place from postal_streets) o join un on un.judet = o.judet_raw and (starts_with(lower(strip_accents(un.uat)), o.place) or starts_with(o.place, lower(strip_accents(un.uat)))) where length(o.place) > 0 group by 1, 2) f on f.judet_raw = o.judet_raw and f.place = o.place) group by 1""")
def postal_resolution_ladder(v: Views) -> DataFrame:
    fold = lambda c: F.translate(F.lower(c), "ăâîșțşţ", "aaistst")
    rows = v.table("postal_streets").select("id", F.col("uat_siruta").cast("int").alias("code"), "judet_raw", fold(F.regexp_replace("localitate_raw", r"^Mun\. ", "")).alias("place_raw"))
    units = v.units.select("siruta", F.col("judet").alias("region"), fold(F.col("uat")).alias("place"))
    return match.resolution_ladder(rows, units, "code", "judet_raw", "place_raw").groupBy("method").agg(n_rows().alias("n"), F.count_distinct("unit").alias("units"))


# ---- filters ----------------------------------------------------------------------------------------------------------

_ATTR = "wikidata_qid, full_name, profession, nationality, gender, era, wiki_scope, category, subcategory, nature_type, place_type, country"
_ATTR_MAX = ", ".join(f"max({c}) {c}" for c in _ATTR.split(", "))
_ROW = f"select name, street_type, uat, judet, siruta, core_name, name_normalized, name_count, {_CLASS} classification, {_ATTR}, trim(regexp_replace(name_normalized, '[^a-z0-9]+', '-', 'g'), '-') street_slug from (select *, count(*) over (partition by name_normalized) name_count from st)"


def _filter(name: str, params: dict, where: str, sort: str = "count", limit: int = 200, offset: int = 0) -> None:
    order = {"count": "name_count desc, name nulls first", "name": "name nulls first", "location": "judet nulls first, uat nulls first, name nulls first"}[sort]
    PANELS[f"filter_rows_{name}"] = lambda v: fl.page(fl.filtered_rows(v.star, params), sort, limit, offset).drop("id")
    PANELS_SQL[f"filter_rows_{name}"] = CTES + f"select * from ({_ROW.replace('from (select *,', 'from (select *, id idx,')} where {where} order by {order}, name_normalized, street_type nulls first, siruta nulls first, id limit {limit} offset {offset})"
    PANELS[f"filter_names_{name}"] = lambda v: fl.page(fl.filtered_names(v.star, params), "name" if sort == "name" else "count", limit, offset)
    agg_order = "name nulls first" if sort == "name" else "name_count desc, name nulls first"
    PANELS_SQL[f"filter_names_{name}"] = CTES + f"select name_normalized, name, core_name, name_count, {_CLASS} classification, {_ATTR} from (select name_normalized, max(name) as name, max(core_name) core_name, count(*) name_count, max(is_numeric) is_numeric, max(is_date) is_date, max(is_saint) is_saint, bool_or(has_person) has_person, bool_or(has_nature) has_nature, bool_or(has_place) has_place, bool_or(has_category) has_category, {_ATTR_MAX} from st where {where} group by 1) order by {agg_order}, name_normalized limit {limit} offset {offset}"
    PANELS[f"filter_total_{name}"] = lambda v: fl.total(fl.filtered_rows(v.star, params))
    PANELS_SQL[f"filter_total_{name}"] = CTES + f"select count(*) total from st where {where}"
    PANELS[f"filter_groups_{name}"] = lambda v: fl.total(fl.filtered_names(v.star, params))
    PANELS_SQL[f"filter_groups_{name}"] = CTES + f"select count(distinct name_normalized) total from st where {where}"


_filter("persons", {"profession": ["poet", "pictor"], "gender": ["F"]}, "profession in ('poet', 'pictor') and gender = 'F'")
_filter("nature", {"classification": ["nature", "place"], "street_type": ["Strada", "Aleea"]}, "(has_nature or has_place) and street_type in ('Strada', 'Aleea')", sort="name")
_filter("name", {"name": ["Lunca"], "uat": ["municipiul"]}, "contains(name_normalized, 'lunca') and contains(uat, 'MUNICIPIUL')", sort="location")
_filter("page2", {"classification": ["saint", "date", "numeric", "no such class"]}, "(is_saint = 1 or is_date = 1 or is_numeric = 1)", limit=50, offset=50)
_filter("categories", {"category": ["trade", "ideological"], "subcategory": ["political"]}, "category in ('trade', 'ideological') and subcategory = 'political'")
_filter("places", {"place_type": ["lunca", "valea"], "place_country": ["RO"]}, "place_type in ('lunca', 'valea') and country = 'RO'")


@panel("select 'classification' dimension, unnest(['person', 'nature', 'place', 'category', 'saint', 'date', 'numeric']) as value union all " + " union all ".join(f"select distinct '{d}', {c} from {t} where {c} is not null" for d, t, c in [("judet", "sd", "judet"), ("street_type", "sd", "street_type"), *((x, "p", x) for x in fl.PERSON_DIMENSIONS), ("category", "c", "category"), ("subcategory", "c", "subcategory"), ("nature_type", "n", "nature_type"), ("place_type", "pl", "place_type"), ("place_country", "pl", "country")]))
def filter_meta(v: Views) -> DataFrame:
    return fl.meta(v.star, v.persons, v.nature, v.places, v.categories)


# ---- notebooks, reports -----------------------------------------------------------------------------------------------


@panel("select count(*) raw_rows, (select count(*) from sd) dedup_rows, (select count(*) from street_aliases) alias_rows, (select count(*) from p) person_rows from raw")
def table_sizes(v: Views) -> DataFrame:
    size = lambda t: t.agg(n_rows()).scalar()
    return v.raw.agg(n_rows().alias("raw_rows")).withColumns({"dedup_rows": size(v.sd), "alias_rows": size(v.aliases), "person_rows": size(v.persons)})


@panel("select era, count(*) filter (gender = 'F') f, count(*) filter (gender = 'M') m from sd join p using (core_name_norm) where era is not null group by 1")
def gender_by_era(v: Views) -> DataFrame:
    return _persons(v, "era", "gender").where("era is not null").groupBy("era").pivot("gender", ["F", "M"]).agg(n_rows()).na.fill(0).select("era", F.col("F").alias("f"), F.col("M").alias("m"))


@panel("select count(*) n, median(wiki_sitelinks::double) middle, quantile_cont(wiki_sitelinks::double, 0.9) q90, round(avg(wiki_sitelinks), 6) mean from p where wiki_sitelinks is not null")
def sitelink_quantiles(v: Views) -> DataFrame:
    s = F.col("wiki_sitelinks").cast("double")
    return v.persons.where("wiki_sitelinks is not null").agg(n_rows().alias("n"), F.median(s).alias("middle"), F.percentile(s, 0.9).alias("q90"), F.round(F.avg(s), 6).alias("mean"))


@panel("select least(greatest(floor(wiki_sitelinks / 5.0)::int, 0), 39) as bin, count(*) n from p where wiki_sitelinks is not null group by 1")
def sitelink_histogram(v: Views) -> DataFrame:
    b = F.least(F.greatest(F.floor(F.col("wiki_sitelinks") / 5.0).cast("int"), F.lit(0)), F.lit(39))
    return v.persons.where("wiki_sitelinks is not null").groupBy(b.alias("bin")).agg(n_rows().alias("n"))


@panel("select profession, " + ", ".join(f"count(*) filter (coalesce(wiki_scope, 'unknown') = '{s}') {s}" for s in ("universal", "national", "local", "unknown")) + " from p where profession is not null group by 1")
def profession_by_scope(v: Views) -> DataFrame:
    x = v.persons.where("profession is not null").withColumn("scope", F.coalesce("wiki_scope", F.lit("unknown")))
    return x.groupBy("profession").pivot("scope", ["universal", "national", "local", "unknown"]).agg(n_rows()).na.fill(0)


@panel("select judet, count(distinct s.id) streets, count(distinct m.left_id) matched, round(100.0::double * count(distinct m.left_id) / count(distinct s.id), 1) pct from sd s left join renns_m m on m.left_id = s.id group by 1")
def distinct_coverage_by_judet(v: Views) -> DataFrame:
    x = v.sd.join(v.renns_m.select(F.col("left_id").alias("id"), F.lit(1).alias("hit")).distinct(), "id", "left")
    return x.groupBy("judet").agg(n_rows().alias("streets"), F.count("hit").alias("matched"), pct(F.count("hit"), n_rows()).alias("pct"))


@panel("select j.judet, coalesce(k, 0) units, n all_units from (select judet, count(distinct siruta) n from sd group by 1) j left join (select judet, count(distinct siruta) k from sd where core_name_norm = 'eroilor' group by 1) x using (judet)")
def one_name_reach(v: Views) -> DataFrame:
    every = v.sd.groupBy("judet").agg(F.count_distinct("siruta").alias("all_units"))
    hit = v.sd.where("core_name_norm = 'eroilor'").groupBy("judet").agg(F.count_distinct("siruta").alias("units"))
    return every.join(hit, "judet", "left").select("judet", F.coalesce("units", F.lit(0)).alias("units"), "all_units")


@panel("select count(*) common, (select count(*) from (select core_name_norm from c except select core_name_norm from n)) only_a, (select count(*) from (select core_name_norm from n except select core_name_norm from c)) only_b, count(*) filter (c.category = n.nature_type) agree from c join n using (core_name_norm)")
def labelling_agreement(v: Views) -> DataFrame:
    return profiles.agreement(v.categories.withColumnRenamed("category", "label"), v.nature.withColumnRenamed("nature_type", "label"), "core_name_norm", "label")


@panel(f"select core_name_norm, n, judete, units, sample_name, array_to_string(judete_list, ',') judete_list from (select core_name_norm, count(*) n, count(distinct judet) judete, count(distinct siruta) units, min(name) sample_name, list_sort(list_distinct(list(judet))) judete_list from st where core_name_norm is not null and {_CLASS} is null group by 1) order by n desc, core_name_norm limit 500")
def curation_worklist(v: Views) -> DataFrame:
    x = v.star.where(F.col("core_name_norm").isNotNull() & filter_class().isNull()).groupBy("core_name_norm")
    g = x.agg(n_rows().alias("n"), F.count_distinct("judet").alias("judete"), F.count_distinct("siruta").alias("units"), F.min("name").alias("sample_name"), F.array_join(F.array_sort(F.collect_set("judet")), ",").alias("judete_list"))
    return g.orderBy(F.desc("n"), "core_name_norm").limit(500)


@panel("select core_name_norm, coalesce(p.birth_year, q.birth_year) birth_year, coalesce(p.death_year, q.death_year) death_year from p left join (select wikidata_qid, arg_min(birth_year, core_name_norm) birth_year, arg_min(death_year, core_name_norm) death_year from p where wikidata_qid is not null group by 1) q using (wikidata_qid)")
def propagated_years(v: Views) -> DataFrame:
    return upserts.propagate(v.persons.select("core_name_norm", "wikidata_qid", "birth_year", "death_year"), "wikidata_qid", ["birth_year", "death_year"], "core_name_norm").drop("wikidata_qid")


@panel("select wikidata_qid, count(distinct full_name) as names, count(*) n from p where wikidata_qid is not null group by 1 having count(distinct full_name) > 1")
def shared_identifiers(v: Views) -> DataFrame:
    return v.persons.where("wikidata_qid is not null").groupBy("wikidata_qid").agg(F.count_distinct("full_name").alias("names"), n_rows().alias("n")).where("names > 1")


# ---- text functions over whole tables ---------------------------------------------------------------------------------

# the table's own column is the key of the name
@panel("select id, translate(name, 'şţŞŢ', 'șțȘȚ') fixed, name_normalized normalized, trim(regexp_replace(name_normalized, '[^a-z0-9]+', '-', 'g'), '-') slug from raw")
def normalized_names(v: Views) -> DataFrame:
    c = F.col("name")
    return v.raw.select("id", tx.fix_diacritics(c).alias("fixed"), tx.normalize_match(c).alias("normalized"), tx.slugify(c).alias("slug"))


@panel("""select id, street_type, name, array_to_string(list_filter(list_transform(regexp_extract_all(translate(artera_raw, 'şţŞŢ', 'șțȘȚ'), '\\(([^)]+)\\)', 1), lambda x: regexp_replace(x, '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g')), lambda x: length(x) > 2), ';') aliases from raw""")
def parsed_arteries(v: Views) -> DataFrame:
    return v.raw.select("id", tx.parse_artery(F.col("artera_raw")).alias("x")).select("id", "x.street_type", "x.name", F.array_join("x.aliases", ";").alias("aliases"))


@panel('select id, title, "rank", is_saint, is_date, is_numeric, core_name from raw')
def extracted_features(v: Views) -> DataFrame:
    return v.raw.select("id", tx.extract_features(F.col("name")).alias("x")).select("id", "x.*")


@panel("select id, case when len(string_split(core_name_norm, ' ')) = 2 then string_split(core_name_norm, ' ')[2] || ' ' || string_split(core_name_norm, ' ')[1] end swapped from postal_streets")
def swapped_tokens(v: Views) -> DataFrame:
    return v.table("postal_streets").select("id", tx.swap_two_tokens(F.col("core_name_norm")).alias("swapped"))


_POSTAL = """case t when 'Stradă' then 'Strada' when 'Bulevard' then 'Bulevardul' when 'Cale' then 'Calea' when 'Drum' then 'Drumul' when 'Intrare' then 'Intrarea' when 'Prelungire' then 'Prelungirea' when 'Sosea' then 'Șoseaua'
    when 'Splai' then 'Splaiul' when 'Stradelă' then 'Stradela' when 'Cartier' then 'Cartierul' when 'Fundătură' then 'Fundătura' when 'Fundac' then 'Fundătura' when 'Pasaj' then 'Pasajul' when 'Trecătoare' then 'Trecerea' when 'Potecă' then 'Cărarea' else t end"""


@panel(f"select id, case when t = '' then null when starts_with(t, 'Alee') then 'Aleea' else {_POSTAL} end street_type from (select id, translate(trim(tip_artera_raw), 'şţŞŢ', 'șțȘȚ') t from postal_streets)")
def mapped_postal_types(v: Views) -> DataFrame:
    return v.table("postal_streets").select("id", tx.map_street_type(F.col("tip_artera_raw")).alias("street_type"))




# ---- further reports and searches ---------------------------------------------------------------------------------------


@panel("select siruta, name, highway_class, importance, rn from (select *, row_number() over (partition by siruta order by importance desc, id) rn from (select * exclude (rn) from osm)) where rn <= 10")
def importance_top_by_unit(v: Views) -> DataFrame:
    return profiles.top_per_group(v.osm, ["siruta"], [F.desc("importance"), "id"], 10).select("siruta", "name", "highway_class", "importance", "rn")


@panel("select siruta, count(distinct s.id) streets, count(distinct m.left_id) matched, 2 * count(distinct m.left_id) < count(distinct s.id) low from sd s left join osm_m m on m.left_id = s.id group by 1")
def coverage_by_unit(v: Views) -> DataFrame:
    x = v.sd.join(v.osm_m.select(F.col("left_id").alias("id"), F.lit(1).alias("hit")).distinct(), "id", "left").groupBy("siruta").agg(n_rows().alias("streets"), F.count("hit").alias("matched"))
    return x.withColumn("low", 2 * F.col("matched") < F.col("streets"))


@panel("select siruta, name, importance, rn from (select siruta, name, importance, row_number() over (partition by siruta order by importance desc, id) rn from osm where id not in (select right_id from osm_m)) where rn <= 3")
def unmatched_roads_by_unit(v: Views) -> DataFrame:
    return profiles.top_per_group(unmatched(v, "osm"), ["siruta"], [F.desc("importance"), "id"], 3).select("siruta", "name", "importance", "rn")


@panel(f"select gender, honorees, km, {_pct('km', 'sum(km) over ()')} pct from (select gender, count(distinct full_name) honorees, sum(o.length_m) / 1000.0 km from sd s join p on p.core_name_norm = s.core_name_norm {_ROADS} where gender in ('F', 'M') group by 1)")
def gender_km_share(v: Views) -> DataFrame:
    g = _roads(v, _persons(v, "full_name", "gender").where("gender in ('F', 'M')")).groupBy("gender").agg(F.count_distinct("full_name").alias("honorees"), (F.sum("length_m") / 1000.0).alias("km"))
    return g.withColumn("pct", pct(F.col("km"), F.sum("km").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))  # two rows


@panel("select full_name, age, streets from (select min(full_name) full_name, min(death_year) - min(birth_year) age, count(*) streets, core_name_norm from sd join p using (core_name_norm) where birth_year is not null and death_year is not null group by core_name_norm) order by age, core_name_norm limit 10")
def died_young(v: Views) -> DataFrame:
    g = _persons(v, "full_name", "birth_year", "death_year").where("birth_year is not null and death_year is not null").groupBy("core_name_norm")
    g = g.agg(F.min("full_name").alias("full_name"), (F.min("death_year") - F.min("birth_year")).alias("age"), n_rows().alias("streets"))
    return g.orderBy("age", "core_name_norm").limit(10).drop("core_name_norm")


@panel("select judet, full_name, v as views, rn from (select judet, full_name, max(wiki_ro_views)::bigint v, row_number() over (partition by judet order by max(wiki_ro_views) desc, full_name) rn from sd join p using (core_name_norm) where wiki_ro_views is not null group by 1, 2) where rn <= 5")
def most_viewed_by_judet(v: Views) -> DataFrame:
    g = _persons(v, "full_name", "wiki_ro_views").where("wiki_ro_views is not null").groupBy("judet", "full_name").agg(F.max("wiki_ro_views").cast("long").alias("views"))
    return profiles.top_per_group(g, ["judet"], [F.desc("views"), "full_name"], 5)


@panel(f"select u.siruta, theme, round(u.s - n.s, 6) delta from (select siruta, {_V6} theme, count(*)::double / sum(count(*)) over (partition by siruta) s from st group by 1, 2) u join (select {_V6} theme, count(*)::double / sum(count(*)) over () s from st group by 1) n using (theme)")
def theme_deltas_by_unit(v: Views) -> DataFrame:
    x = v.star.select("siruta", unit_theme_class().alias("theme")).groupBy("siruta", "theme").agg(n_rows().alias("k"))
    here = F.col("k").cast("double") / F.sum("k").over(Window.partitionBy("siruta"))
    nation = x.groupBy("theme").agg(F.sum("k").alias("t"))
    nation = nation.withColumn("n_share", F.col("t").cast("double") / F.sum("t").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))  # a row per theme
    return x.withColumn("share", here).join(nation, "theme").select("siruta", "theme", F.round(F.col("share") - F.col("n_share"), 6).alias("delta"))


@panel(f"select n name_normalized, streets, uats >= 5 has_page from {_NAMES} where contains(regexp_replace(lower(strip_accents(disp)), '[^a-z0-9 -]', '', 'g'), 'ilor') order by uats >= 5 desc, streets desc, n limit 20")
def search_names(v: Views) -> DataFrame:
    x = _names(v).where(F.contains(tx.search_key(F.col("disp")), tx.search_key(F.lit("ilor")))).withColumn("has_page", F.col("uats") >= 5)
    return x.orderBy(F.desc("has_page"), F.desc("streets"), "n").limit(20).select(F.col("n").alias("name_normalized"), "streets", "has_page")


@panel("select min(judet) judet, siruta, count(*) total, sum(is_numeric)::bigint numeric_streets from sd group by siruta having sum(is_numeric) > 0")
def numeric_share_by_unit(v: Views) -> DataFrame:
    return v.sd.groupBy("siruta").agg(F.min("judet").alias("judet"), n_rows().alias("total"), F.sum("is_numeric").alias("numeric_streets")).where("numeric_streets > 0")


#: Lengths of the n-grams by which labels are sought.
GRAMS = (1, 2, 4, 8)


@panel("""select core_name_norm, arg_min(qid, (1 - sure, qid)) qid, max(sure) sure from (select a.core_name_norm, b.wikidata_qid qid,
    case when lower(b.full_name) = lower(a.full_name) then case when a.gender is not null or a.birth_year is not null or a.death_year is not null then 0.95::double else 0.85::double end else 0.7::double end sure
    from p a join p b on b.wikidata_qid is not null and contains(lower(b.full_name), lower(a.full_name)) where a.wikidata_qid is null) group by 1""")
def identifier_candidates(v: Views) -> DataFrame:
    """The best identifier for persons without one: by the same name, or as part of a longer one.

    A label that contains a name has all its n-grams, so labels are sought by the rarest one of each name, of the longest of GRAMS that fits.
    """
    name = F.lower("full_name")
    persons = v.persons.where("wikidata_qid is null").select("core_name_norm", name.alias("name"), F.expr("gender is not null or birth_year is not null or death_year is not null").alias("known"))
    labels = v.persons.where("wikidata_qid is not null and full_name is not null").groupBy(name.alias("label")).agg(F.min("wikidata_qid").alias("qid"))
    grams = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: c.substr(i, F.lit(n))))
    of_name = F.array(F.lit(""))
    for n in GRAMS:
        of_name = F.when(F.length("name") >= n, grams(F.col("name"), n)).otherwise(of_name)
    of_label = F.concat(F.array(F.lit("")), *(F.when(F.length("label") >= n, grams(F.col("label"), n)).otherwise(F.array().cast("array<string>")) for n in GRAMS))
    b = labels.select("label", "qid", F.explode(of_label).alias("gram"))
    sought = persons.where("name is not null").select("name").distinct().select("name", F.explode(of_name).alias("gram"))
    a = sought.join(b.groupBy("gram").agg(n_rows().alias("n")), "gram").groupBy("name").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    found = a.join(b, "gram").where(F.contains("label", F.col("name"))).groupBy("name", (F.col("label") == F.col("name")).alias("same")).agg(F.min("qid").alias("qid"), F.min("label").alias("label"))
    x = persons.join(found, "name").withColumn("sure", candidate_confidence(F.col("name"), F.col("label"), F.col("known")))
    return x.groupBy("core_name_norm").agg(F.min_by("qid", F.struct(-F.col("sure"), "qid")).alias("qid"), F.max("sure").alias("sure"))


@panel("select model, left(regexp_replace(lower(regexp_replace(string_split(model, '/')[-1], '-\\d{8}$', '')), '[^a-z0-9.-]', '-', 'g'), 40) slug from (select distinct source || '/' || lang || '_X-20240101' model from documents where lang is not null)")
def label_source_slugs(v: Views) -> DataFrame:
    m = v.table("documents").where("lang is not null").select(F.concat("source", F.lit("/"), "lang", F.lit("_X-20240101")).alias("model")).distinct()
    return m.select("model", tx.source_slug(F.col("model")).alias("slug"))
