"""Changes of stored tables as pure functions of the stored and the incoming rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """The incoming row wins whole; null keys match null keys. Incoming keys must be unique."""
    s, i = stored.alias("s"), incoming.select(*stored.columns).alias("i")
    cond = None
    for k in key:
        c = F.col(f"s.{k}").eqNullSafe(F.col(f"i.{k}"))
        cond = c if cond is None else cond & c
    return s.join(i, cond, "left_anti").unionByName(incoming.select(*stored.columns))


def insert_or_ignore(stored: DataFrame, incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """Stored rows stay; of the incoming rows of a new key the first by ``order`` is added."""
    new = incoming.join(stored.select(*key), key, "left_anti")
    rest = [c for c in incoming.columns if c not in key]
    first = new.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")
    return stored.unionByName(first.select(*stored.columns))


def fill_nulls(stored: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Only null values are filled, from the incoming row of the same key."""
    i = incoming.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in columns))
    out = stored.join(i, F.col(key) == F.col("_k"), "left")
    return out.select(*(F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in stored.columns))


def propagate(stored: DataFrame, same: str, columns: list[str], order: str) -> DataFrame:
    """Null values are filled from the rows with the same ``same``: the first non-null by ``order``. Null ``same`` shares nothing."""
    known = stored.where(F.col(same).isNotNull()).groupBy(F.col(same).alias("_g")).agg(*(F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in columns))
    out = stored.join(known, F.col(same) == F.col("_g"), "left")
    return out.select(*(F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in stored.columns))


def route_curation(rows: DataFrame, targets: dict[str, list[str]], table: str = "table") -> dict[str, DataFrame]:
    """The rows of a curation file by target table, each with the target's columns; the whole batch is refused if a row's target is
    unknown or its required first two columns are empty."""
    known = F.col(table).isin(list(targets)) | F.coalesce(F.col(table), F.lit("")).isin("")
    lacking = F.lit(False)
    for t, cols in targets.items():
        for c in cols[:2]:
            lacking |= (F.col(table) == t) & (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "")
    if bad := rows.where(~known | F.coalesce(lacking, F.lit(False))).limit(5).collect():
        raise ValueError(f"curation rows refused, among them {bad}")
    return {t: rows.where(F.col(table) == t).select(*cols) for t, cols in targets.items()}
