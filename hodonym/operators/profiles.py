"""Analyses that need more than one aggregate: diversity, association rules, slugs, nearest points, chains to an ancestor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group with their place ``rn``; the planner cuts groups before the shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= k)


def entropy(df: DataFrame, by: list[str], item: str, base2: bool = False, smoothing: float = 0.0, digits: int = 6) -> DataFrame:
    """(by..., n, entropy) of the items' shares in each group."""
    g = df.groupBy(*by, item).agg(F.count(F.lit(1)).cast("double").alias("c")).withColumn("t", F.sum("c").over(Window.partitionBy(*by)))
    p = F.col("c") / F.col("t")
    log = F.log2(p + smoothing) if base2 else F.log(p + smoothing)
    return g.groupBy(*by).agg(F.sum("c").cast("long").alias("n"), F.round(-F.sum(p * log), digits).alias("entropy"))


def baskets(df: DataFrame, basket: str, item: str) -> DataFrame:
    return df.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).select(F.col(basket).alias("basket"), F.col(item).alias("item")).distinct()


def association_rules(b: DataFrame, share: float = 0.05, least: int = 5, together: int = 5) -> DataFrame:
    """(a, b, co, lift, confidence, sup_a, sup_b) of the pairs of items that share at least ``together`` baskets.

    Only items in at least max(``least``, ``share`` of all baskets) take part, so a basket holds at most 1/``share`` times its mean of
    items on average, and the pairs are counted with map-side combine.
    """
    n = b.agg(F.count_distinct("basket").alias("n"))
    support = b.groupBy("item").agg(F.count(F.lit(1)).alias("sup"))
    total = n.scalar()
    kept = support.where((F.col("sup") >= least) & (F.col("sup") >= F.floor(total * share)))
    x = b.join(kept, "item")
    l, r = (x.select("basket", F.col("item").alias(f"name_{s}"), F.col("sup").alias(f"sup_{s}")) for s in "ab")
    pairs = l.join(r, "basket").where("name_a < name_b").groupBy("name_a", "name_b", "sup_a", "sup_b").agg(F.count(F.lit(1)).alias("co")).where(F.col("co") >= together)
    lift = F.round(F.col("co") * total / (F.col("sup_a") * F.col("sup_b")).cast("double"), 6)
    return pairs.select("name_a", "name_b", "co", lift.alias("lift"), F.round(F.lit(100.0) * F.col("co") / F.col("sup_a"), 1).alias("conf_ab"), "sup_a", "sup_b")


def unique_slugs(df: DataFrame, slug: str, order: list) -> DataFrame:
    """``slug`` made unique: the second and later rows of a slug in ``order`` get -2, -3, ..."""
    rn = F.row_number().over(Window.partitionBy(slug).orderBy(*order))
    return df.withColumn(slug, F.when(rn == 1, F.col(slug)).otherwise(F.concat_ws("-", F.col(slug), rn.cast("string"))))


#: How much wider than the first cells that find a centre those are that hold the nearest one.
SURE = 16


def nearest_point(points: DataFrame, centres: DataFrame, cell: float = 0.5) -> DataFrame:
    """``points`` (id, lat, lon) with the nearest of ``centres`` (centre, c_lat, c_lon), on the plane around the point.

    Centres are spread to the 3 x 3 cells around theirs and joined by cell; the nearest of those counts. For a point that finds none there, wider
    cells are tried until one finds some, and the nearest is taken from cells so much wider (``SURE``) that none outside them can be nearer
    (below 79 degrees of latitude). All joins are equi-joins; without centres there is no row.
    """
    dist = F.pow(F.col("lat") - F.col("c_lat"), F.lit(2.0)) + F.pow((F.col("lon") - F.col("c_lon")) * F.cos(F.radians("lat")), F.lit(2.0))
    d = F.sequence(F.lit(-1), F.lit(1))

    def best(some: DataFrame, width: float) -> DataFrame:
        cell_of = lambda c: F.floor(F.col(c) / width)
        p = some.withColumn("gx", cell_of("lat")).withColumn("gy", cell_of("lon"))
        c = centres.withColumn("dx", F.explode(d)).withColumn("dy", F.explode(d)).withColumn("gx", cell_of("c_lat") + F.col("dx")).withColumn("gy", cell_of("c_lon") + F.col("dy")).drop("dx", "dy")
        return p.join(c, ["gx", "gy"]).groupBy("id").agg(F.min_by("centre", F.struct(dist.alias("d"), F.col("centre"))).alias("centre"))

    rest = points.select("id", "lat", "lon")
    out = best(rest, cell)
    rest = rest.join(out.select("id"), "id", "left_anti")
    width = cell
    while width < 360.0:
        width *= 8.0
        some = best(rest, width).select("id")
        out = out.unionByName(best(rest.join(some, "id", "left_semi"), width * SURE))
        rest = rest.join(some, "id", "left_anti")
    return out


def ancestor_of_type(start: DataFrame, edges: DataFrame, types: DataFrame, wanted: list[str], depth: int = 6) -> DataFrame:
    """(node, ancestor, level): the nearest ancestor of a wanted type, a node itself being level 0; the smallest of equals.

    ``edges`` (child, parent), ``types`` (node, type). One join per level, for at most ``depth`` levels.
    """
    good = types.where(F.col("type").isin(wanted)).select(F.col("node").alias("ancestor")).distinct()
    front = start.select(F.col("node"), F.col("node").alias("at")).distinct()
    out = None
    for level in range(depth + 1):
        hit = front.join(good, front.at == good.ancestor).groupBy("node").agg(F.min("ancestor").alias("ancestor")).withColumn("level", F.lit(level))
        out = hit if out is None else out.unionByName(hit)
        front = front.join(hit.select("node"), "node", "left_anti").join(edges, F.col("at") == F.col("child")).select("node", F.col("parent").alias("at")).distinct()
    return out


def agreement(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """One row: keys in both labellings, only in one, and of the common ones those with the same label."""
    j = a.select(F.col(key).alias("ka"), F.col(label).alias("la")).join(b.select(F.col(key).alias("kb"), F.col(label).alias("lb")), F.col("ka") == F.col("kb"), "full_outer")
    both = F.col("ka").isNotNull() & F.col("kb").isNotNull()
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return j.agg(n(both).alias("common"), n(F.col("kb").isNull()).alias("only_a"), n(F.col("ka").isNull()).alias("only_b"), n(both & F.col("la").eqNullSafe(F.col("lb"))).alias("agree"))
