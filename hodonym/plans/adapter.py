"""The relations of the catalog over the street tables, and the SQL that defines the same relations.

Lookups that have no table of their own are short value lists; places and roads are derived from whole tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hodonym.functions.scoring import road_score
from hodonym.operators.classify import star
from hodonym.operators.dedup import min_row_per_key
from hodonym.operators.match import CORE, EXACT, SWAPPED, tiered_match
from hodonym.session import table

# Fixed values: (key, term, type) of nature names, (key, category, subcategory) of other names, words that open names of places.
NATURE = [
    ("bujorilor", "bujor", "flower"), ("bujorului", "bujor", "flower"), ("lalelelor", "lalea", "flower"), ("crinilor", "crin", "flower"), ("garoafelor", "garoafă", "flower"), ("viorelelor", "viorea", "flower"),
    ("toporasilor", "toporaș", "flower"), ("narciselor", "narcisă", "flower"), ("trandafirilor", "trandafir", "flower"), ("margaretelor", "margaretă", "flower"), ("liliacului", "liliac", "flower"),
    ("castanilor", "castan", "tree"), ("castanului", "castan", "tree"), ("teilor", "tei", "tree"), ("salcamilor", "salcâm", "tree"), ("salcamului", "salcâm", "tree"), ("plopului", "plop", "tree"), ("nucului", "nuc", "tree"),
    ("merilor", "măr", "fruit"), ("perilor", "păr", "fruit"), ("prunilor", "prun", "fruit"), ("ciresilor", "cireș", "fruit"), ("visinilor", "vișin", "fruit"),
    ("mentei", "mentă", "plant"), ("busuiocului", "busuioc", "plant"), ("padurii", "pădure", "forest"), ("dumbravii", "dumbravă", "forest"), ("livezilor", "livadă", "orchard"), ("viilor", "vie", "orchard"),
    ("vulturilor", "vultur", "bird"), ("cocorilor", "cocor", "bird"), ("lebedei", "lebădă", "bird"), ("randunicii", "rândunică", "bird"), ("soimului", "șoim", "bird"), ("ursului", "urs", "animal"), ("cerbului", "cerb", "animal"), ("fluturilor", "fluture", "animal"), ("albinelor", "albină", "animal"),
    ("muntelui", "munte", "landform"), ("stancii", "stâncă", "landform"), ("campiei", "câmpie", "landform"), ("vantului", "vânt", "weather"), ("furtunii", "furtună", "weather"), ("soarelui", "soare", "sky"), ("stelelor", "stea", "sky"),
]
CATEGORIES = [
    ("eroilor", "ideological", "memorial"), ("republicii", "ideological", "political"), ("independentei", "ideological", "political"), ("unirii", "ideological", "political"), ("muncii", "ideological", "abstract"), ("progresului", "ideological", "abstract"),
    ("prieteniei", "abstract", None), ("armoniei", "abstract", None), ("sperantei", "abstract", None), ("dreptatii", "abstract", None), ("recoltei", "abstract", None),
    ("fierarilor", "trade", None), ("dogarilor", "trade", None), ("zidarilor", "trade", None), ("olarilor", "trade", None), ("croitorilor", "trade", None), ("pescarilor", "occupational", None), ("aviatorilor", "occupational", None), ("marinarilor", "occupational", None),
    ("bisericii", "institutional", None), ("garii", "institutional", None), ("spitalului", "institutional", None), ("primariei", "institutional", None), ("morii", "institutional", None), ("fabricii", "institutional", None), ("gradinitei", "institutional", None),
]
PLACE_WORDS = ["dealul", "valea", "lunca", "poiana", "podul", "campul", "varful", "izvorul", "paraul", "fantana"]
#: Roads by type of street: class and the prefix of the road's number.
ROADS = {"Bulevardul": ("primary", "DN"), "Calea": ("secondary", "DN"), "Șoseaua": ("tertiary", "DJ"), "Strada": ("residential", None), "Drumul": ("unclassified", "DC"), "Aleea": ("living_street", None), "Piața": ("pedestrian", None)}
FEATURES = ["street_type", "name", "name_normalized", "title", "rank", "is_saint", "is_date", "is_numeric", "core_name", "core_name_norm"]


class Views:
    """Lazy relations over one directory; each is defined once per instance."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @cached_property
    def raw(self) -> DataFrame:
        return self.table("streets").select("id", "judet", "uat", F.col("siruta").cast("int").alias("siruta"), "artera_raw", *FEATURES)

    @cached_property
    def sd(self) -> DataFrame:
        """The registry without repetitions: the first row of every (siruta, name, type); empty names are left out."""
        return min_row_per_key(self.raw.where("name_normalized != ''"), ["siruta", "name_normalized", "street_type"], "id")

    @cached_property
    def aliases(self) -> DataFrame:
        return self.table("street_aliases")

    @cached_property
    def persons(self) -> DataFrame:
        return self.table("persons")

    @cached_property
    def nature(self) -> DataFrame:
        return self.spark.createDataFrame(NATURE, "core_name_norm string, term string, nature_type string")

    @cached_property
    def categories(self) -> DataFrame:
        return self.spark.createDataFrame(CATEGORIES, "core_name_norm string, category string, subcategory string")

    @cached_property
    def places(self) -> DataFrame:
        head = F.substring_index("core_name_norm", " ", 1)
        named = self.raw.where(head.isin(PLACE_WORDS) & F.col("core_name_norm").contains(" "))
        return named.groupBy("core_name_norm").agg(F.min("core_name").alias("place_name"), F.min(head).alias("place_type"), F.lit("RO").alias("country"))

    @cached_property
    def star(self) -> DataFrame:
        return star(self.sd, self.persons, self.nature, self.places, self.categories)

    @cached_property
    def units(self) -> DataFrame:
        return self.table("uat_reference").select(F.col("siruta").cast("int").alias("siruta"), "judet", "uat")

    def _source(self, name: str, extra: list) -> DataFrame:
        t = self.table(name).where("name_normalized != ''").withColumn("siruta", F.col("uat_siruta").cast("int"))
        return t.select("id", "siruta", *FEATURES, *extra)

    @cached_property
    def renns(self) -> DataFrame:
        rows = self._source("renns_streets", ["road_type_raw", F.json_array_length("source_road_ids").alias("n_ids")])
        return _grouped(rows, {"instances": F.sum("n_ids")}).drop("n_ids")

    @cached_property
    def postal(self) -> DataFrame:
        rows = self._source("postal_streets", ["source_sheet", "resolution_method", "core_name_norm_swapped", F.json_array_length("source_row_ids").alias("n_ids")])
        return _grouped(rows, {"sub_ranges": F.sum("n_ids")}).drop("n_ids")

    @cached_property
    def osm(self) -> DataFrame:
        """Roads drawn from the cadastre's located rows; lengths are whole metres made from the ids."""
        rows = self._source("renns_streets", []).where("siruta is not null").withColumn("len", (F.lit(40) + F.col("id") * 37 % 1960).cast("double"))
        g = _grouped(rows, {"length_m": F.sum("len")}).drop("len")
        t = F.col("street_type")
        cls, pre = (F.coalesce(F.create_map(*[F.lit(x) for k, v in ROADS.items() for x in (k, v[i] or "")])[t], F.lit("service" if i == 0 else "")) for i in (0, 1))
        g = g.withColumn("highway_class", F.when(t.isNull(), "service").otherwise(cls)).withColumn("ref", F.when((pre != "") & t.isNotNull(), F.concat(pre, (F.col("id") % 90 + 10).cast("string"))))
        return g.withColumn("importance", F.round(road_score(F.col("highway_class"), F.col("length_m"), F.col("ref")), 6))

    @cached_property
    def osm_m(self) -> DataFrame:
        return tiered_match(self.sd, "id", self.osm, "id", [EXACT, CORE])

    @cached_property
    def renns_m(self) -> DataFrame:
        return tiered_match(self.sd, "id", self.renns, "id", [EXACT, CORE])

    @cached_property
    def postal_m(self) -> DataFrame:
        return tiered_match(self.sd, "id", self.postal, "id", [EXACT, CORE, SWAPPED])

    @cached_property
    def all_names(self) -> DataFrame:
        from hodonym.operators.consolidate import consolidate

        sources = [("registry", self.sd), ("osm", self.osm), ("postal", self.postal.where("siruta is not null")), ("renns", self.renns)]
        labels = self.raw.where("siruta is not null").groupBy("siruta").agg(F.min("judet").alias("judet"), F.min("uat").alias("uat"))
        return consolidate(sources, self.units, labels)


def _grouped(rows: DataFrame, sums: dict) -> DataFrame:
    """The first row by id of every (siruta, name_normalized), with sums over the group where they are asked for."""
    keys = ["siruta", "name_normalized"]
    w = Window.partitionBy(*keys)
    return min_row_per_key(rows.withColumns({n: c.over(w) for n, c in sums.items()}), keys, "id")


def _values(rows: list[tuple]) -> str:
    lit = lambda x: "null" if x is None else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def _first(table_: str, extra: str, sums: str, where: str = "true") -> str:
    cols = ", ".join(f'"{c}"' for c in FEATURES)
    return f"""select * from (select id, cast(uat_siruta as int) siruta, {cols}, {extra} {sums}, row_number() over (partition by uat_siruta, name_normalized order by id) rn
        from {table_} where name_normalized <> '' and {where}) where rn = 1"""


def _match(right: str, swapped: bool = False) -> str:
    """Tiers of the registry and ``right`` as table expressions ``right``_1, _2, _3 and their union ``right``_m."""
    tier = lambda name, sure, cond: f"select s.id left_id, r.id right_id, '{name}' match_type, {sure}::double confidence from sd s join {right} r on s.siruta = r.siruta and {cond}"
    parts = [
        f"{right}_1 as ({tier('exact_type_core', 1.0, 's.core_name_norm = r.core_name_norm and s.street_type is not distinct from r.street_type')})",
        f"{right}_2 as ({tier('core_only', 0.5, 's.core_name_norm = r.core_name_norm')} where s.id not in (select left_id from {right}_1))",
    ]
    if swapped:
        parts.append(f"{right}_3 as ({tier('core_swapped', 0.4, 's.core_name_norm = r.core_name_norm_swapped')} where s.id not in (select left_id from {right}_1 union all select left_id from {right}_2))")
    parts.append(f"{right}_m as ({' union all '.join(f'select * from {right}_{k + 1}' for k in range(len(parts)))})")
    return ", ".join(parts)


_ROAD = "case street_type " + " ".join(f"when '{k}' then '{v[0]}'" for k, v in ROADS.items()) + " else 'service' end"
_REF = "case " + " ".join(f"when street_type = '{k}' then '{v[1]}' || (id % 90 + 10)" for k, v in ROADS.items() if v[1]) + " end"
_WEIGHT = "case highway_class when 'primary' then 5 when 'secondary' then 4 when 'tertiary' then 3 when 'unclassified' then 2 when 'residential' then 2 else 1 end"
_UNION = " union all ".join(f"select '{n}' source, siruta, street_type, name, core_name_norm, is_saint, is_date, is_numeric from {t}{w}" for n, t, w in (("registry", "sd", ""), ("osm", "osm", ""), ("postal", "postal", " where siruta is not null"), ("renns", "renns", "")))

#: The relations as common table expressions, for the oracles.
CTES = f"""with recursive raw as (select id, judet, uat, cast(siruta as int) siruta, artera_raw, {", ".join(f'"{c}"' for c in FEATURES)} from streets),
sd as (select * exclude (rn) from (select *, row_number() over (partition by siruta, name_normalized, street_type order by id) rn from raw where name_normalized <> '') where rn = 1),
p as (select * from persons), n as (select * from (values {_values(NATURE)}) t(core_name_norm, term, nature_type)),
c as (select * from (values {_values(CATEGORIES)}) t(core_name_norm, category, subcategory)),
pl as (select core_name_norm, min(core_name) place_name, min(split_part(core_name_norm, ' ', 1)) place_type, 'RO' country from raw where split_part(core_name_norm, ' ', 1) in ({", ".join(f"'{w}'" for w in PLACE_WORDS)}) and contains(core_name_norm, ' ') group by 1),
st as (select s.*, p.* exclude (core_name_norm), n.term, n.nature_type, pl.place_name, pl.place_type, pl.country, c.category, c.subcategory, p.core_name_norm is not null has_person, n.core_name_norm is not null has_nature, pl.core_name_norm is not null has_place, c.core_name_norm is not null has_category
    from sd s left join p using (core_name_norm) left join n using (core_name_norm) left join pl using (core_name_norm) left join c using (core_name_norm)),
renns as ({_first("renns_streets", "road_type_raw,", "sum(json_array_length(source_road_ids)) over (partition by uat_siruta, name_normalized)::bigint instances")}),
postal as ({_first("postal_streets", "source_sheet, resolution_method, core_name_norm_swapped,", "sum(json_array_length(source_row_ids)) over (partition by uat_siruta, name_normalized)::bigint sub_ranges")}),
osm_ as (select *, {_ROAD} highway_class, {_REF} "ref" from ({_first("renns_streets", "", "sum((40 + id * 37 % 1960)::double) over (partition by uat_siruta, name_normalized) length_m", "uat_siruta is not null")})),
osm as (select *, round({_WEIGHT} * ln(1 + length_m) + case when "ref" is not null then 2.0 else 0.0 end, 6) importance from osm_),
{_match("osm")}, {_match("renns")}, {_match("postal", True)},
un as (select siruta, judet, uat from uat_reference), lab as (select siruta, min(judet) judet, min(uat) uat from raw where siruta is not null group by 1),
un_all as ({_UNION}),
grp as (select siruta, street_type, coalesce(core_name_norm, name) k, min(name) name, min(core_name_norm) core_name_norm, count(distinct source) corroboration_count, max(case when source = 'registry' then 1 else 0 end) in_registry, max(is_saint) is_saint, max(is_date) is_date, max(is_numeric) is_numeric,
    array_to_string(list_sort(list_distinct(list(source || '|' || coalesce(name, '') || '|' || coalesce(street_type, '')))), ';') variants, list_sort(list_distinct(list(source))) sources from un_all group by all),
al as (select g.*, coalesce(un.judet, lab.judet) judet, coalesce(un.uat, lab.uat) uat from grp g left join un on un.siruta = g.siruta left join lab on lab.siruta = g.siruta)
"""
