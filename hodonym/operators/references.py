"""References to records that are missing, deleted or not there yet.

Parent keys are integers. They are compressed into runs ``[start, end]`` of consecutive keys that never
leave their bucket of ``BUCKET`` keys, so no task ever sees more than one bucket. A distinct child key is matched
as of the last run that starts at or before it and is an orphan when it lies beyond that run's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys in a bucket: bounds what one task holds.
BUCKET = 65_536


def _bucket(c: Column) -> Column:
    return F.floor(c / F.lit(BUCKET)).cast("long")


def key_runs(parents: DataFrame, key: str) -> DataFrame:
    """(bucket, start, end) of the consecutive keys; null keys are no keys, repeated ones count once."""
    k = parents.select(F.col(key).cast("long").alias("k")).where("k is not null").distinct().select(_bucket(F.col("k")).alias("bucket"), "k")
    w = Window.partitionBy("bucket").orderBy("k")
    return k.withColumn("run", F.col("k") - F.row_number().over(w)).groupBy("bucket", "run").agg(F.min("k").alias("start"), F.max("k").alias("end")).drop("run")


def orphan_keys(children: DataFrame, key: str, runs: DataFrame) -> DataFrame:
    """The distinct non-null keys of ``children`` that no run holds, as column ``k``."""
    keys = children.select(F.col(key).cast("long").alias("k")).where("k is not null").distinct()
    both = keys.select(_bucket(F.col("k")).alias("bucket"), "k", F.lit(1).alias("side"), F.lit(None).cast("long").alias("end"))
    both = both.unionByName(runs.select("bucket", F.col("start").alias("k"), F.lit(0).alias("side"), "end"))
    w = Window.partitionBy("bucket").orderBy("k", "side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("until", F.last("end", ignorenulls=True).over(w))
    return seen.where((F.col("side") == 1) & (F.col("until").isNull() | (F.col("k") > F.col("until")))).select("k")


def broken_references(children: DataFrame, row_id: str, key: str, at: str, parents: DataFrame, parent_key: str, parent_at: str | None = None, deleted_at: str | None = None) -> DataFrame:
    """(row_id, key, at, reason) of the references without a valid target.

    reason is ``missing`` if no parent has the key, else ``deleted`` if the parent's ``deleted_at`` is not after
    the child's ``at``, else ``late`` if the parent's ``parent_at`` is after it. Null keys are no references; a
    null date never makes a reference deleted or late. Repeated rows give one. Of a repeated parent key the
    last deletion and the first arrival count, and an undeleted copy keeps the key alive.
    """
    c = children.select(F.col(row_id).alias("row_id"), F.col(key).cast("long").alias("k"), F.col(at).alias("at")).where("k is not null")
    keys = c.groupBy("k").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    gone = orphan_keys(keys, "k", key_runs(parents, parent_key)).withColumn("gone", F.lit(True))
    dates = {n: F.col(x).cast("timestamp") if x else F.lit(None).cast("timestamp") for n, x in (("p_at", parent_at), ("p_del", deleted_at))}
    p = parents.select(F.col(parent_key).cast("long").alias("k"), F.lit(True).alias("there"), *(c_.alias(n) for n, c_ in dates.items())).where("k is not null")
    p = p.groupBy("k").agg(F.first("there").alias("there"), F.min("p_at").alias("p_at"), F.when(F.count("p_del") == F.count(F.lit(1)), F.max("p_del")).alias("p_del"))
    # the keys of which some row may be broken; a hot key that is in order never moves a row
    odd = keys.join(gone, "k", "left").join(p, "k", "left").where("gone or p_del <= last or p_at > first").select("k", "gone", "p_del", "p_at")
    out = c.join(odd, "k")
    reason = F.when(F.col("gone"), "missing").when(F.col("p_del") <= F.col("at"), "deleted").when(F.col("p_at") > F.col("at"), "late")
    return out.select("row_id", "k", "at", reason.alias("reason")).where("reason is not null").distinct()


def by_period(broken: DataFrame) -> DataFrame:
    """Counts of rows and keys per table, month and reason; rows without a date are in month null."""
    month = F.date_format(F.date_trunc("month", F.col("at")), "yyyy-MM")
    return broken.groupBy("table_name", month.alias("month"), "reason").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("k").alias("n_keys"))
