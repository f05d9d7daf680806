"""The fifty named queries. Each takes ``Views`` and returns a DataFrame; ties under a limit are broken by a total order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hodonym.functions.text import leading_int
from hodonym.operators.classify import coverage_class, filter_class, theme_class
from hodonym.plans.adapter import Views

CATALOG: dict[str, Callable[[Views], DataFrame]] = {}


def n_rows() -> Column:
    """The number of rows."""
    return F.count(F.lit(1))


def named(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    CATALOG[f.__name__] = f
    return f


def pct(a: Column, b: Column, digits: int = 1) -> Column:
    return F.round(F.lit(100.0) * a / F.nullif(b, F.lit(0)), digits)


def n_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def _persons(v: Views, *cols: str) -> DataFrame:
    """Streets of known persons."""
    return v.sd.join(v.persons.select("core_name_norm", *cols), "core_name_norm")


def _whole(df: DataFrame, n: str = "n") -> Column:
    return F.sum(n).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # over the few rows of an aggregate


@named
def coverage_summary(v: Views) -> DataFrame:
    g = v.star.groupBy(coverage_class().alias("status")).agg(n_rows().alias("streets"))
    return g.select("status", "streets", pct(F.col("streets"), _whole(g, "streets")).alias("pct"))


@named
def coverage_names(v: Views) -> DataFrame:
    keys = v.sd.where("core_name_norm is not null and is_numeric = 0 and is_date = 0 and is_saint = 0").select("core_name_norm").distinct()
    known = v.persons.select("core_name_norm")
    for t in (v.nature, v.categories, v.places):
        known = known.union(t.select("core_name_norm"))
    hit = keys.join(known.distinct().withColumn("hit", F.lit(1)), "core_name_norm", "left")
    return hit.agg(n_rows().alias("total_keys"), F.coalesce(F.sum("hit"), F.lit(0)).alias("curated_keys")).withColumn("pct_keys_curated", pct(F.col("curated_keys"), F.col("total_keys")))


@named
def overview_kpis(v: Views) -> DataFrame:
    a = v.sd.agg(n_rows().alias("total_streets"), F.count_distinct("siruta").alias("total_uats"), F.count_distinct("judet").alias("total_judete"), F.count_distinct("name_normalized").alias("distinct_names"), n_if(F.col("is_numeric") == 1).alias("anonymous_streets"), n_if(F.col("is_date") == 1).alias("date_streets"), n_if(F.col("is_saint") == 1).alias("saint_streets"))
    return a.withColumn("aliases", v.aliases.agg(n_rows()).scalar())


@named
def overview_street_types(v: Views) -> DataFrame:
    return v.sd.groupBy(F.coalesce("street_type", F.lit("(none)")).alias("type")).agg(n_rows().alias("n"))


@named
def top_names_national(v: Views) -> DataFrame:
    g = v.sd.groupBy(F.col("name_normalized").alias("key")).agg(F.min("name").alias("display"), n_rows().alias("occurrences"), F.count_distinct("judet").alias("judete_present"), F.count_distinct("siruta").alias("uats_present"))
    return g.orderBy(F.desc("occurrences"), "key").limit(100)


@named
def universal_names(v: Views) -> DataFrame:
    g = v.sd.groupBy("name_normalized").agg(F.min("name").alias("name"), F.count_distinct("judet").alias("in_judete"), n_rows().alias("total"))
    return g.where(F.col("in_judete") == v.sd.agg(F.count_distinct("judet")).scalar())


@named
def unique_names(v: Views) -> DataFrame:
    g = v.sd.groupBy("name_normalized").agg(n_rows().alias("n"), *(F.min(c).alias(c) for c in ("judet", "uat", "name")))
    return g.where("n = 1 and not name_normalized rlike '^[0-9]'").orderBy("name_normalized").limit(50).select("judet", "uat", "name")


@named
def people_gender(v: Views) -> DataFrame:
    return _persons(v, "gender").groupBy("gender").agg(n_rows().alias("streets"), F.count_distinct("core_name_norm").alias("distinct_persons"))


@named
def top_persons(v: Views) -> DataFrame:
    cols = ["full_name", "gender", "era", "profession"]
    g = _persons(v, *cols).groupBy("core_name_norm").agg(*(F.min(c).alias(c) for c in cols), n_rows().alias("streets"), F.count_distinct("judet").alias("judete"))
    return g.orderBy(F.desc("streets"), "core_name_norm").limit(30).drop("core_name_norm")


@named
def top_women(v: Views) -> DataFrame:
    g = _persons(v, "full_name", "gender").where("gender = 'F'").groupBy("core_name_norm").agg(F.min("full_name").alias("full_name"), n_rows().alias("streets"))
    return g.orderBy(F.desc("streets"), "core_name_norm").limit(20).drop("core_name_norm")


@named
def people_profession(v: Views) -> DataFrame:
    return _persons(v, "profession").groupBy("profession").agg(n_rows().alias("streets"))


@named
def people_era(v: Views) -> DataFrame:
    return _persons(v, "era").groupBy("era").agg(n_rows().alias("streets"))


@named
def foreign_honorees(v: Views) -> DataFrame:
    g = _persons(v, "full_name", "nationality").where("nationality != 'RO'").groupBy("core_name_norm")
    return g.agg(F.min("full_name").alias("full_name"), F.min("nationality").alias("nationality"), n_rows().alias("streets"), F.array_join(F.array_sort(F.collect_set("judet")), ",").alias("judete")).drop("core_name_norm")


@named
def theme_composition(v: Views) -> DataFrame:
    return v.star.groupBy(theme_class().alias("theme")).agg(n_rows().alias("n"))


@named
def nature_subtypes(v: Views) -> DataFrame:
    return v.star.where("has_nature").groupBy("nature_type").agg(n_rows().alias("streets"), F.array_join(F.array_sort(F.collect_set("term")), ",").alias("terms"))


@named
def judet_aggregates(v: Views) -> DataFrame:
    s = v.sd.join(v.persons.select("core_name_norm", "gender"), "core_name_norm", "left")
    return s.groupBy("judet").agg(n_rows().alias("total_streets"), F.count_distinct("uat").alias("uats"), pct(n_if(F.col("gender") == "F"), F.count("gender")).alias("pct_female_among_persons"), pct(n_if(F.col("is_saint") == 1), n_rows()).alias("pct_saint"), pct(n_if(F.col("is_numeric") == 1), n_rows()).alias("pct_anonymous"))


@named
def modal_per_judet(v: Views) -> DataFrame:
    g = v.sd.groupBy("judet", "name_normalized").agg(F.min("name").alias("name"), n_rows().alias("n"))
    w = Window.partitionBy("judet").orderBy(F.desc("n"), "name_normalized")
    return g.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("judet", "name", "n")


@named
def uat_diversity(v: Views) -> DataFrame:
    g = v.sd.groupBy("uat", "judet", "name_normalized").agg(n_rows().cast("double").alias("c"))
    g = g.withColumn("total", F.sum("c").over(Window.partitionBy("uat")))
    e = g.groupBy("uat", "judet").agg(F.max("total").cast("long").alias("streets"), F.round(-F.sum(F.col("c") / F.col("total") * F.log(F.col("c") / F.col("total"))), 6).alias("entropy"))
    return e.where("streets >= 10").orderBy("entropy", "uat", "judet").limit(20)


def _alias_pairs(v: Views) -> DataFrame:
    return v.raw.join(v.aliases.select(F.col("street_id").alias("id"), "alias", "alias_normalized"), "id")


@named
def real_renamings(v: Views) -> DataFrame:
    a, b = F.col("alias_normalized"), F.col("core_name_norm")
    x = _alias_pairs(v).where(b.isNotNull() & (a != b) & ~a.contains(b) & ~b.contains(a))
    return x.select("judet", "uat", F.col("core_name").alias("current_name"), F.col("alias").alias("historical_name")).distinct()


# The words of the names that are told apart as ideological.
TOKENS = r"(colectivist|uzin|lenin|stalin|partidul|tovaras|mai 1|7 noiembrie|23 august|cap-?ului|ceapeu)"


@named
def communist_aliases(v: Views) -> DataFrame:
    x = _alias_pairs(v).where(F.coalesce(F.col("alias_normalized").rlike(TOKENS), F.lit(False)))
    return x.select(F.col("core_name").alias("current_name"), F.col("alias").alias("communist_alias"), "uat").distinct()


def _year() -> Column:
    return F.col("name").rlike("^[0-9]{4}$") & leading_int(F.col("name")).between(1700, 2099)


@named
def anonymous_uats(v: Views) -> DataFrame:
    x = v.sd.where((F.col("is_numeric") == 1) & ~_year()).withColumn("number", leading_int(F.col("name")))
    return x.groupBy("uat").agg(F.min("judet").alias("judet"), n_rows().alias("anonymous_streets"), F.min("number").alias("lowest"), F.max("number").alias("highest"))


@named
def commemorative_year_streets(v: Views) -> DataFrame:
    x = v.sd.where((F.col("is_numeric") == 1) & _year())
    return x.groupBy("name").agg(F.min(leading_int(F.col("name"))).alias("year"), n_rows().alias("streets"), F.count_distinct("uat").alias("uats")).drop("name")


@named
def longest_names(v: Views) -> DataFrame:
    x = v.sd.select("judet", "uat", "name", F.length("name").alias("chars"), "id")
    return x.orderBy(F.desc("chars"), "name", "judet", "uat", "id").limit(20).drop("id")


@named
def locally_honored(v: Views) -> DataFrame:
    g = v.sd.where("title is not null or rank is not null").groupBy("core_name_norm").agg(n_rows().alias("n"), *(F.min(c).alias(c) for c in ("judet", "uat", "name")))
    return g.where("n = 1").orderBy("core_name_norm").limit(30).select("judet", "uat", "name")


def _coverage(v: Views, m: DataFrame, name: str) -> DataFrame:
    """A street with two matches counts twice."""
    x = v.sd.join(m.select(F.col("left_id").alias("id"), F.lit(1).alias("hit")), "id", "left")
    g = x.groupBy("judet").agg(n_rows().alias("registry_streets"), F.count("hit").alias(f"{name}_matched"))
    return g.withColumn(f"pct_{name}", pct(F.col(f"{name}_matched"), F.col("registry_streets")))


KEY = ["siruta", "core_name_norm"]


def met_keys(v: Views, name: str) -> DataFrame:
    """(siruta, core_name_norm, hit): the keys by which a registry row is matched by a source in some tier."""
    t = getattr(v, name)
    keys = t.select(*KEY)
    if name == "postal":
        keys = keys.union(t.select("siruta", "core_name_norm_swapped"))
    return keys.where("siruta is not null and core_name_norm is not null").distinct().withColumn("hit", F.lit(1))


def unmatched(v: Views, name: str) -> DataFrame:
    """The rows of a source that no registry row matches in any tier.

    Every tier asks for the municipality and the words. Words in turned order are only asked of registry names that no row of the source has
    as they are.
    """
    t, registry = getattr(v, name), v.sd.select(*KEY)
    out = t.join(registry, KEY, "left_anti")
    if name == "postal":
        turned = registry.where("siruta is not null and core_name_norm is not null").join(t.select(*KEY), KEY, "left_anti").select("siruta", F.col("core_name_norm").alias("core_name_norm_swapped"))
        out = out.join(turned, ["siruta", "core_name_norm_swapped"], "left_anti")
    return out


def _gap(v: Views, name: str) -> DataFrame:
    g = v.sd.join(met_keys(v, name), KEY, "left").groupBy("name_normalized").agg(F.min("name").alias("name"), F.count_distinct("uat").alias("uats_in_registry"), F.count_distinct(F.when(F.col("hit") == 1, F.col("uat"))).alias(f"uats_with_{name}_match"))
    return g.where(f"uats_in_registry >= 10 and uats_with_{name}_match = 0").orderBy(F.desc("uats_in_registry"), "name_normalized").limit(30).drop("name_normalized")


for _s in ("osm", "postal", "renns"):
    CATALOG[f"{_s}_judet_coverage"] = lambda v, s=_s: _coverage(v, getattr(v, f"{s}_m"), s)
    CATALOG[f"registry_{_s}_gap"] = lambda v, s=_s: _gap(v, s)


@named
def osm_only_prominent(v: Views) -> DataFrame:
    return unmatched(v, "osm").orderBy(F.desc("importance"), "id").limit(50).select(F.col("siruta").alias("uat_siruta"), "name", "highway_class", "length_m", "importance")


@named
def postal_only_streets(v: Views) -> DataFrame:
    return unmatched(v, "postal").orderBy(F.desc("sub_ranges"), "id").limit(50).select(F.col("siruta").alias("uat_siruta"), "name", "source_sheet", "sub_ranges")


@named
def renns_only_streets(v: Views) -> DataFrame:
    return unmatched(v, "renns").orderBy(F.desc("instances"), "id").limit(50).select(F.col("siruta").alias("uat_siruta"), "name", "road_type_raw", "instances")


@named
def self_honor_per_judet(v: Views) -> DataFrame:
    g = _persons(v, "birth_judet").groupBy("judet").agg(n_if(F.col("birth_judet") == F.col("judet")).alias("self_honor_streets"), F.count("birth_judet").alias("known_birth_streets"), n_rows().alias("total_person_streets"))
    return g.withColumn("pct_self_honor_known", pct(F.col("self_honor_streets"), F.col("known_birth_streets")))


@named
def most_parochial_honorees(v: Views) -> DataFrame:
    g = _persons(v, "full_name", "birth_judet").groupBy("core_name_norm", "full_name", "birth_judet", F.col("judet").alias("dominant_judet")).agg(n_rows().alias("streets_in_judet"))
    g = g.withColumn("total_streets", F.sum("streets_in_judet").over(Window.partitionBy("core_name_norm")))
    g = g.where("total_streets >= 5 and 2 * streets_in_judet >= total_streets").withColumn("pct_in_dominant", pct(F.col("streets_in_judet"), F.col("total_streets")))
    return g.orderBy(F.desc("total_streets"), F.desc("pct_in_dominant"), "core_name_norm", "dominant_judet").limit(40).drop("core_name_norm")


def _roads(v: Views, streets: DataFrame) -> DataFrame:
    """``streets`` with the roads that they match."""
    m = v.osm_m.select(F.col("left_id").alias("id"), "right_id")
    return streets.join(m, "id").join(v.osm.select(F.col("id").alias("right_id"), "length_m", "highway_class"), "right_id")


def km() -> Column:
    return F.sum("length_m") / 1000.0



@named
def total_km_per_honoree(v: Views) -> DataFrame:
    cols = ["full_name", "gender", "era", "profession", "nationality"]
    g = _roads(v, _persons(v, *cols)).groupBy("core_name_norm").agg(*(F.min(c).alias(c) for c in cols), F.count_distinct("id").alias("matched_streets"), km().alias("total_km"))
    return g.orderBy(F.desc("total_km"), "core_name_norm").limit(50).drop("core_name_norm")


@named
def highway_class_by_category(v: Views) -> DataFrame:
    return _roads(v, v.star.select("id", coverage_class().alias("category"))).groupBy("category", "highway_class").agg(n_rows().alias("streets"), km().alias("total_km"))


def _by_key(v: Views) -> DataFrame:
    """One row per core name with its class over the largest flags, and its streets."""
    keep = ["has_person", "has_nature", "has_place", "has_category"]
    g = v.star.where("core_name_norm is not null").groupBy("core_name_norm").agg(n_rows().alias("n"), *(F.max(c).alias(c) for c in ("is_numeric", "is_date", "is_saint", *keep)))
    return g.select("core_name_norm", "n", filter_class().alias("class"))


@named
def classification_coverage(v: Views) -> DataFrame:
    g = _by_key(v).groupBy(F.coalesce("class", F.lit("unclassified")).alias("category")).agg(n_rows().alias("key_count"), F.sum("n").alias("street_count"))
    return g.withColumn("pct_of_streets", pct(F.col("street_count"), _whole(g, "street_count")))


@named
def classification_coverage_summary(v: Views) -> DataFrame:
    g = _by_key(v).agg(n_rows().alias("total_keys"), F.count("class").alias("classified_keys"), F.sum("n").alias("total_streets"), F.coalesce(F.sum(F.when(F.col("class").isNotNull(), F.col("n"))), F.lit(0)).alias("classified_streets"))
    return g.withColumn("pct_keys_classified", pct(F.col("classified_keys"), F.col("total_keys"))).withColumn("pct_streets_classified", pct(F.col("classified_streets"), F.col("total_streets")))


@named
def age_at_death(v: Views) -> DataFrame:
    x = _persons(v, "full_name", "birth_year", "death_year", "gender", "profession", "wikidata_qid").where("birth_year is not null and death_year is not null")
    cols = ["full_name", "birth_year", "death_year", "gender", "profession", "wikidata_qid"]
    g = x.groupBy("core_name_norm").agg(*(F.min(c).alias(c) for c in cols), n_rows().alias("street_count"))
    return g.withColumn("age_at_death", F.col("death_year") - F.col("birth_year")).drop("core_name_norm")


def _street_counts(v: Views) -> DataFrame:
    return v.sd.where("core_name_norm is not null").groupBy("core_name_norm").agg(n_rows().alias("n"))


@named
def cause_of_death_breakdown(v: Views) -> DataFrame:
    x = v.persons.join(_street_counts(v), "core_name_norm").groupBy(F.coalesce(F.nullif("cause_of_death_label", F.lit("")), F.lit("unknown")).alias("cause_label"))
    return x.agg(F.count_distinct("core_name_norm").alias("persons"), F.sum("n").alias("streets"))


@named
def birth_century_distribution(v: Views) -> DataFrame:
    x = v.persons.where("birth_year is not null").join(_street_counts(v), "core_name_norm")
    return x.groupBy((F.expr("birth_year div 100") * 100).alias("century_start")).agg(n_rows().alias("persons"), F.sum("n").alias("streets"))


@named
def gender_km_gap(v: Views) -> DataFrame:
    g = _roads(v, _persons(v, "gender")).groupBy("gender").agg(F.count_distinct("core_name_norm").alias("honorees"), F.count_distinct("id").alias("matched_streets"), km().alias("total_km"), F.avg("length_m").alias("avg_length_m"))
    return g.withColumn("km_per_honoree", F.col("total_km") / F.col("honorees"))


@named
def female_km_leaderboard(v: Views) -> DataFrame:
    x = _roads(v, _persons(v, "full_name", "gender", "wikidata_qid").where("gender = 'F'"))
    return x.groupBy("full_name").agg(F.min("wikidata_qid").alias("wikidata_qid"), F.count_distinct("id").alias("streets"), km().alias("km"), F.avg("length_m").alias("avg_m"))


@named
def external_corroboration_gap(v: Views) -> DataFrame:
    """Names of other sources that the registry has nowhere in the municipality, by the number of sources.

    A row of such a name can only be matched by its words in turned order: by a registry name that no row of the source itself has.
    """
    key = KEY
    registry = v.sd.select(*key).where("siruta is not null and core_name_norm is not null").distinct()
    turned = registry.join(v.postal.select(*key), key, "left_anti").select(F.col("siruta"), F.col("core_name_norm").alias("core_name_norm_swapped"))
    postal = v.postal.join(turned, ["siruta", "core_name_norm_swapped"], "left_anti")
    flag = lambda t, k: t.where("core_name_norm is not null").select(*key, *(F.lit(int(i == k)).alias(f"s{i}") for i in range(4)))
    rows = flag(v.raw.where("name_normalized != '' and siruta is not null"), 0).union(flag(v.osm, 1)).union(flag(postal, 2)).union(flag(v.renns, 3))
    g = rows.groupBy(*key).agg(*(F.max(f"s{i}").alias(f"s{i}") for i in range(4))).where("s0 = 0").withColumn("corroboration_level", (F.col("s1") + F.col("s2") + F.col("s3")).cast("long"))
    return g.orderBy(F.desc("corroboration_level"), *key).limit(100).select(*key, "corroboration_level")


@named
def registry_uncorroborated(v: Views) -> DataFrame:
    met = met_keys(v, "osm").union(met_keys(v, "postal")).union(met_keys(v, "renns")).drop("hit")
    return v.sd.join(met, KEY, "left_anti").orderBy("judet", "uat", "name", "id").limit(100).select("judet", "uat", "name", F.lit(1).alias("uncorroborated"))


@named
def all_street_names_summary(v: Views) -> DataFrame:
    a = v.all_names.agg(n_rows().alias("master_list_size"), n_if(F.col("in_registry") == 1).alias("registry_rows"), n_if(F.col("in_registry") == 0).alias("external_only_rows"), n_if(F.col("corroboration_count") >= 2).alias("multi_source_corroborated"))
    raw = v.sd.select("id").union(v.osm.select("id")).union(v.postal.where("siruta is not null").select("id")).union(v.renns.select("id"))
    a = a.withColumn("raw_union_size", raw.agg(n_rows()).scalar())
    return a.withColumn("duplicates_collapsed", F.col("raw_union_size") - F.col("master_list_size"))


@named
def corroboration_distribution(v: Views) -> DataFrame:
    return v.all_names.groupBy("corroboration_count").agg(n_rows().alias("n_streets"))


@named
def high_confidence_registry_misses(v: Views) -> DataFrame:
    x = v.all_names.where("in_registry = 0 and corroboration_count >= 2")
    return x.orderBy(F.desc("corroboration_count"), "judet", "uat", "name", "street_type").limit(100).select("judet", "uat", "siruta", "name", "street_type", "corroboration_count", "variants")


@named
def type_variant_candidates(v: Views) -> DataFrame:
    same = Window.partitionBy(*KEY)
    x = v.all_names.where("siruta is not null and core_name_norm is not null").withColumn("n_types", F.size(F.collect_set("street_type").over(same)))
    y = x.withColumn("n_sources_total", F.size(F.array_distinct(F.flatten(F.collect_list("sources").over(same)))).cast("long")).where("n_types > 1")
    return y.orderBy(F.desc("n_sources_total"), "judet", "uat", "core_name_norm", "street_type", "siruta").limit(200).select("judet", "uat", "siruta", "core_name_norm", "street_type", "name", "corroboration_count", "n_sources_total")
