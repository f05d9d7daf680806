"""Operators on small tables."""

import datetime as dt
import random

import pytest

from hodonym.operators import filters as fl
from hodonym.operators import match, profiles, upserts
from hodonym.operators.consolidate import consolidate
from hodonym.operators.dedup import first_wins_groups, later_wins, min_row_per_key
from hodonym.operators.references import broken_references, key_runs


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_dedup(spark):
    df = spark.createDataFrame([(3, "a", None, "x"), (1, "a", None, "y"), (2, "a", "T", "z"), (4, None, None, "w")], "id long, k string, t string, v string")
    assert rows(min_row_per_key(df, ["k", "t"], "id").select("id", "v")) == [(1, "y"), (2, "z"), (4, "w")]
    assert rows(later_wins(df, ["k"], "id").select("id", "v")) == [(3, "x"), (4, "w")]
    assert rows(first_wins_groups(df, ["k"], "id", "id").select("id", "ids")) == [(1, [1, 2, 3]), (4, [4])]
    assert min_row_per_key(df.limit(0), ["k"], "id").count() == 0


def test_tiers(spark):
    schema = "id long, siruta int, core_name_norm string, street_type string"
    left = spark.createDataFrame([(1, 1, "a", "S"), (2, 1, "b", None), (3, 1, "c", "S"), (4, 1, None, "S"), (5, 1, "y x", "S"), (6, 1, "a", "B")], schema)
    right = spark.createDataFrame([(10, 1, "a", "S", None), (11, 1, "b", None, None), (12, 1, "c", "T", None), (13, 1, None, "S", None), (14, 1, "x y", "S", "y x"), (15, 2, "a", "S", None)], schema + ", core_name_norm_swapped string")
    got = rows(match.tiered_match(left, "id", right, "id", [match.EXACT, match.CORE, match.SWAPPED]))
    assert got == [(1, 10, "exact_type_core", 1.0), (2, 11, "exact_type_core", 1.0), (3, 12, "core_only", 0.5), (5, 14, "core_swapped", 0.4), (6, 10, "core_only", 0.5)]


def test_ladder(spark):
    units = spark.createDataFrame([(1, "A", "alba"), (2, "A", "albac"), (3, "B", "alba")], "siruta int, region string, place string")
    x = spark.createDataFrame([(1, 1, None, None), (2, None, "A", "alba"), (3, 99, "A", "albacu"), (4, None, "C", "alba"), (5, None, "A", "")], "id int, code int, r string, p string")
    assert rows(match.resolution_ladder(x, units, "code", "r", "p").select("id", "unit", "method")) == [(1, 1, "direct"), (2, 1, "name_exact"), (3, 1, "name_prefix"), (4, None, "unresolved"), (5, None, "unresolved")]


def test_consolidate(spark):
    schema = "siruta int, street_type string, name string, core_name_norm string, is_saint int, is_date int, is_numeric int"
    a = spark.createDataFrame([(1, "S", "Ion", "ion", 0, 0, 0), (1, "S", "12", None, 0, 0, 1)], schema)
    b = spark.createDataFrame([(1, "S", "ION", "ion", 0, 0, 0), (1, "B", "Ion", "ion", 0, 0, 0), (2, None, "X", "x", 0, 0, 0)], schema)
    labels = spark.createDataFrame([(2, "J", "U2")], "siruta int, judet string, uat string")
    units = spark.createDataFrame([(1, "J", "U1")], "siruta int, judet string, uat string")
    got = rows(consolidate([("registry", a), ("other", b)], units, labels).select("siruta", "street_type", "name", "corroboration_count", "in_registry", "uat"))
    assert got == [(1, "B", "Ion", 1, 0, "U1"), (1, "S", "12", 1, 1, "U1"), (1, "S", "ION", 2, 1, "U1"), (2, None, "X", 1, 0, "U2")]


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "k string, v int, w string")
    new = spark.createDataFrame([("b", 3, None), ("c", 4, "y")], "k string, v int, w string")
    assert rows(upserts.upsert(old, new, ["k"])) == [("a", 1, None), ("b", 3, None), ("c", 4, "y")]
    assert rows(upserts.insert_or_ignore(old, new.union(spark.createDataFrame([("c", 1, "z")], new.schema)), ["k"], "v")) == [("a", 1, None), ("b", 2, "x"), ("c", 1, "z")]
    assert rows(upserts.fill_nulls(old, spark.createDataFrame([("a", 9, "n"), ("b", 9, "n")], old.schema), "k", ["w"])) == [("a", 1, "n"), ("b", 2, "x")]
    q = spark.createDataFrame([("a", "Q1", None), ("b", "Q1", 7), ("c", None, None), ("d", None, 5)], "k string, q string, y int")
    assert rows(upserts.propagate(q, "q", ["y"], "k")) == [("a", "Q1", 7), ("b", "Q1", 7), ("c", None, None), ("d", None, 5)]
    c = spark.createDataFrame([("t1", "k1", "x"), ("t2", "k2", "y")], "table string, key string, v string")
    assert rows(upserts.route_curation(c, {"t1": ["key", "v"], "t2": ["key", "v"]})["t2"]) == [("k2", "y")]
    with pytest.raises(ValueError):
        upserts.route_curation(c.union(spark.createDataFrame([("t1", "k3", " ")], c.schema)), {"t1": ["key", "v"], "t2": ["key", "v"]})


def test_profiles(spark):
    rng = random.Random(1)
    b = [(i, f"p{rng.randrange(12)}") for i in range(60) for _ in range(4)]
    got = {(r.name_a, r.name_b): (r.co, r.lift) for r in profiles.association_rules(profiles.baskets(spark.createDataFrame(b, "basket long, item string"), "basket", "item")).collect()}
    have = {}
    for i, p in b:
        have.setdefault(p, set()).add(i)
    want = {(x, y): (len(have[x] & have[y]), round(len(have[x] & have[y]) * 60 / (len(have[x]) * len(have[y])), 6)) for x in have for y in have if x < y and len(have[x] & have[y]) >= 5}
    assert got == want
    pts = [(i, rng.uniform(44, 48), rng.uniform(21, 29)) for i in range(80)] + [(99, 10.0, 10.0)]
    cs = [(i, rng.uniform(44, 48), rng.uniform(21, 29)) for i in range(60)]
    near = dict(tuple(r) for r in profiles.nearest_point(spark.createDataFrame(pts, "id long, lat double, lon double"), spark.createDataFrame(cs, "centre long, c_lat double, c_lon double"), cell=4.0).collect())
    import math

    d = lambda p, c: (p[1] - c[1]) ** 2 + ((p[2] - c[2]) * math.cos(math.radians(p[1]))) ** 2
    assert near == {p[0]: min(cs, key=lambda c: d(p, c))[0] for p in pts}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "child string, parent string")
    types = spark.createDataFrame([("c", "county"), ("z", "county")], "node string, type string")
    start = spark.createDataFrame([("a",), ("c",), ("x",)], "node string")
    assert rows(profiles.ancestor_of_type(start, edges, types, ["county"])) == [("a", "c", 2), ("c", "c", 0)]
    s = spark.createDataFrame([("a", 3), ("a", 2), ("b", 1)], "slug string, n int")
    assert rows(profiles.unique_slugs(s, "slug", ["n"])) == [("a", 2), ("a-2", 3), ("b", 1)]
    l1, l2 = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, l string"), spark.createDataFrame([("b", "y"), ("c", "z")], "k string, l string")
    assert tuple(profiles.agreement(l1, l2, "k", "l").first()) == (1, 1, 1, 1)


def test_filter_pages(spark):
    star = spark.createDataFrame([(i, f"n{i:03}", "S" if i % 2 else None, "U", "J") for i in range(50)], "id long, name string, street_type string, uat string, judet string")
    star = star.selectExpr("*", "name name_normalized", "1 siruta", "name core_name", "0 is_numeric", "0 is_date", "0 is_saint", *(f"false has_{k}" for k in ("person", "nature", "place", "category")), *(f"cast(null as string) {c}" for c in fl.ATTRIBUTES))
    a, b = (fl.page(fl.filtered_rows(star, {}), "name", 10, o).select("id").collect() for o in (0, 10))
    assert len(a) == len(b) == 10 and not {r[0] for r in a} & {r[0] for r in b}
    assert fl.page(fl.filtered_rows(star, {"street_type": ["S"]}), limit=0).count() == 1
    assert fl.filtered_rows(star, {"classification": ["unknown"]}).count() == 50
    assert fl.filtered_rows(star, {"uat": ["%"]}).count() == 0


def test_references(spark):
    rng = random.Random(3)
    at = lambda d: dt.datetime(2021, 1, 1) + dt.timedelta(days=d)
    parents = [(k, at(rng.randrange(200)), at(rng.randrange(400)) if rng.random() < 0.2 else None) for k in sorted({rng.choice([rng.randrange(300), rng.randrange(65_500, 65_600), -rng.randrange(50)]) for _ in range(300)})]
    children = [(i, rng.choice([rng.randrange(-60, 320), rng.randrange(65_480, 65_620), 7, None]), at(rng.randrange(400)) if rng.random() < 0.9 else None, "x") for i in range(600)]
    p = spark.createDataFrame(parents, "id long, loaded_at timestamp_ntz, deleted_at timestamp_ntz").selectExpr("*", "'clash' k", "1 there", "2 row_id")
    c = spark.createDataFrame(children, "id long, ref long, loaded_at timestamp_ntz, k string")
    by = {k: (a, d) for k, a, d in parents}
    want = set()
    for i, k, t, _ in children:
        if k is None:
            continue
        if k not in by:
            want.add((i, k, "missing"))
        elif t and by[k][1] and by[k][1] <= t:
            want.add((i, k, "deleted"))
        elif t and by[k][0] > t:
            want.add((i, k, "late"))
    got = broken_references(c.unionByName(c), "id", "ref", "loaded_at", p, "id", "loaded_at", "deleted_at").select("row_id", "k", "reason")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    runs = key_runs(p, "id").collect()
    assert sum(r.end - r.start + 1 for r in runs) == len(parents)
    assert broken_references(c.limit(0), "id", "ref", "loaded_at", p, "id").count() == 0
    assert {r.reason for r in broken_references(c, "id", "ref", "loaded_at", p.limit(0), "id").collect()} == {"missing"}


def test_roads(spark):
    from hodonym.operators import roads

    ways = spark.createDataFrame([("a", 1, "A1", "service", None, [(26.0, 44.0), (26.0, 44.01)]), ("a", 2, "A2", "primary", "", [(26.0, 44.01), (26.0, 44.0)]), ("a", 3, "A3", "primary", "DN1", [(26.0, 44.01), (26.01, 44.01)]), (None, 4, "B", "x", "DJ2", [(1.0, 1.0)])], "k string, n int, name string, cls string, ref string, p array<struct<lon:double,lat:double>>")
    got = {r.k: r for r in roads.merge_ways(ways.withColumn("id", ways.n * 10), ["k"], "n", "id", "cls", "ref").collect()}
    assert (got["a"].name, got["a"].way_ids, got["a"].cls, got["a"].ref) == ("A1", [10, 20, 30], "primary", "DN1") and got[None].way_ids == [40]
    length = {r.k: r.length_m for r in roads.path_lengths(ways, ["k"], "p").collect()}
    assert abs(length["a"] - (1111.95 + 799.76)) < 1.0 and None not in length
