"""Problem 5 over the street tables: references without a valid target."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hodonym.operators.references import broken_references, by_period
from hodonym.session import table


def _broken(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    parts = [
        ("streets", broken_references(t("streets"), "id", "siruta", "loaded_at", t("uat_reference"), "siruta", "loaded_at", "deleted_at")),
        ("renns_streets", broken_references(t("renns_streets"), "id", "uat_siruta", "loaded_at", t("uat_reference"), "siruta", "loaded_at", "deleted_at")),
        ("street_aliases", broken_references(t("street_aliases"), "alias_id", "street_id", "loaded_at", t("streets"), "id", "loaded_at")),
    ]
    return reduce(DataFrame.unionByName, (x.withColumn("table_name", F.lit(n)) for n, x in parts))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _broken(spark, d).select("table_name", "row_id", "reason")


def p5_by_month(spark: SparkSession, d: str) -> DataFrame:
    return by_period(_broken(spark, d))


_REFS = """
    select 'streets' table_name, id row_id, cast(siruta as bigint) k, loaded_at as at_, 'u' parent from streets
    union all select 'renns_streets', id, cast(uat_siruta as bigint), loaded_at, 'u' from renns_streets
    union all select 'street_aliases', alias_id, street_id, loaded_at, 's' from street_aliases"""
_CASES = f"""
    select distinct table_name, row_id, k, at_, case when p.key is null then 'missing' when p.deleted_at <= at_ then 'deleted' when p.loaded_at > at_ then 'late' end reason
    from ({_REFS}) r left join (
        select 'u' parent, cast(siruta as bigint) "key", loaded_at, deleted_at from uat_reference
        union all select 's', id, loaded_at, null from streets) p on p.parent = r.parent and p.key = r.k
    where k is not null"""
P5_SQL = {
    "p5_found": f"select table_name, row_id, reason from ({_CASES}) where reason is not null",
    "p5_by_month": f"select table_name, strftime(at_, '%Y-%m') as month, reason, count(*) as n_rows, count(distinct k) as n_keys from ({_CASES}) where reason is not null group by 1, 2, 3",
}
P5_QUERIES = {"p5_found": p5_found, "p5_by_month": p5_by_month}
