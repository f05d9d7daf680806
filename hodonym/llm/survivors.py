"""One surviving record per group of duplicates, chosen field by field (problem 6).

The fields are unpivoted to long rows (group, field, normalised value). Every row votes for its values with the trust in how it is written
times a decay by age; the votes are summed per value, ``max_by`` takes the value with the largest sum of each field, and the winners are
pivoted back. Votes are kept as log2, so that weights may span any range: with the weights of TESTDATA a point of fullness outweighs any
number of poorer spellings and a second any number of older rows, with milder ones many older rows outvote a new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hodonym.llm.canonical_values import Dictionary
from hodonym.llm.street_names import CLEAN, parsed_spellings
from hodonym.session import materialize

#: Seconds in which a vote loses half its weight, and log2 of the weight of a point of fullness: here a row that is a second newer
#: outweighs 2 ** 40 rows, and a point more than a century.
HALF_LIFE, POINT = 1 / 40, 2.0**37


def field_winners(rows: DataFrame, group: list[str], fields: list[str]) -> DataFrame:
    """(group..., fields..., n_rows, first_id): of each field the value with the largest sum of votes; of equal sums the largest value.

    ``rows`` has group..., for every field a value and ``<field>_vote``, log2 of the weight of the row's ``n`` records, n and first_id. Null values
    and null votes do not vote; a field without any vote is null. Null group columns group together.
    """
    whole = Window.partitionBy(*group)
    has = lambda f: F.col(f).isNotNull() & F.col(f"{f}_vote").isNotNull()
    # weights relative to the group's largest one: what is too small for a double could not win
    tops = rows.withColumns({f"{f}_weight": F.when(has(f), F.pow(F.lit(2.0), F.col(f"{f}_vote") - F.max(F.when(has(f), F.col(f"{f}_vote"))).over(whole))) for f in fields})
    stack = ", ".join(f"'{f}', {f}, {f}_weight" for f in fields)
    votes = tops.select(*group, "n", "first_id", F.expr(f"stack({len(fields)}, {stack}) as (field, value, weight)"))
    summed = votes.groupBy(*group, "field", "value").agg(F.sum("weight").alias("votes"), F.sum("n").alias("n"), F.min("first_id").alias("first_id"))
    of = lambda f, x: F.when((F.col("field") == f) & F.col("value").isNotNull() & F.col("votes").isNotNull(), x)
    chosen = [F.max_by("value", of(f, F.struct("votes", "value"))).alias(f) for f in fields]
    return summed.groupBy(*group).agg(*chosen, F.sum(F.when(F.col("field") == fields[0], F.col("n"))).alias("n_rows"), F.min("first_id").alias("first_id"))


def _turned(forms: DataFrame, where: list[str]) -> DataFrame:
    """(where..., turned): of streets whose words stand in several orders, the orders with the surname first.

    How much likelier a word opens a name than it closes one is counted over all rows; an order is turned if its last word opens names more
    readily than its first one. Streets without a municipality have no orders.
    """
    several = forms.where("spelt like '% %'").groupBy(*where, "spelt").agg(F.sum("n").alias("n"))
    ends = several.select(F.explode(F.array(*(F.struct(F.substring_index("spelt", " ", i).alias("w"), (F.col("n") if i > 0 else F.lit(0)).alias("opens"), (F.col("n") if i < 0 else F.lit(0)).alias("closes")) for i in (1, -1)))).alias("x")).select("x.*")
    lean = ends.groupBy("w").agg(F.log2((F.sum("opens") + 1) / (F.sum("closes") + 1)).alias("lean"))
    mixed = several.groupBy(*where).agg(F.min("spelt").alias("a"), F.max("spelt").alias("b")).where("a != b").select(*where)
    orders = several.join(mixed, where, "left_semi").select(*where, "spelt", F.substring_index("spelt", " ", 1).alias("first"), F.substring_index("spelt", " ", -1).alias("last"))
    side = lambda name: lean.select(F.col("w").alias(name), F.col("lean").alias(f"{name}_lean"))
    told = orders.join(side("first"), "first").join(side("last"), "last").where("first_lean < last_lean")
    return told.groupBy(*where).agg(F.collect_set("spelt").alias("turned"))


def street_survivors(streets: DataFrame, types: Dictionary, half_life: float = HALF_LIFE, point: float = POINT) -> DataFrame:
    """(first_id, name, core_name, street_type, n_rows) of every street with at least two rows and no bare number.

    A street is (judet, uat, type, words of the name); rows without a type belong to the street of that name if there is one
    type only, are left out where there are several, and make a street of their own where there is none. name and core_name are
    tidy: composed, single blanks, commas for cedillas; a row's type votes for street_type. A row without a date counts as of 1970.
    """
    where = ["judet", "uat", "key"]
    forms = materialize(parsed_spellings(streets, types, half_life), "spellings")
    x = forms.join(_turned(forms, where), where, "left")
    turned: Column = F.coalesce(F.array_contains("turned", F.col("spelt")), F.lit(False))
    of = lambda f: F.col(f"{f}_points") - F.when(turned & F.col(f"{f}_clean"), CLEAN).otherwise(0)
    w = Window.partitionBy(*where)  # what follows stays in this partitioning
    x = x.withColumns({"least": F.min("kind").over(w), "most": F.max("kind").over(w)})
    x = x.withColumn("type", F.coalesce("kind", F.when(F.col("least") == F.col("most"), F.col("least")))).where("type is not null or most is null")
    weight = F.col("newest") + F.log2("votes")
    group = [*where, "type"]
    fields = ["name", "core_name", "street_type"]
    votes = x.select(*group, "n", "first_id", "name", "core_name", F.col("kind").alias("street_type"), (of("name") * F.lit(point) + weight).alias("name_vote"), (of("core") * F.lit(point) + weight).alias("core_name_vote"), weight.alias("street_type_vote"))
    return field_winners(votes, group, fields).where("n_rows >= 2").select("first_id", *fields, "n_rows")
