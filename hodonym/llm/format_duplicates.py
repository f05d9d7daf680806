"""Records that differ only in white space, letter case, punctuation or word order (problem 2).

Canonical records are range-partitioned and sorted by (scope, words, id), then each partition is scanned once:
adjacent rows with the same full key form a run. Ids take part in the range bounds, so a key that holds a third
of all rows is spread over many partitions; the run that goes on across a border is mended with one summary
row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hodonym.session import materialize, parallelism, ship_code

#: Separates the parts of a key; no word holds it.
SEP = "\x1f"
_RUNS = "pid int, head long, id long, position long, key string, n_rows long"


def word_bag(c: Column) -> Column:
    """The words (runs of letters and digits) in lower case and sorted, each as often as it occurs."""
    return F.array_join(F.array_sort(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))), " ")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pid, head, id, position) of the sorted partition and, last, one summary row per end of it.

    The summary of the partition has id null: key and head of the last run, its rows, and as position the number of
    runs; the summary of the first run has id null and position -1.
    """
    pid = TaskContext.get().partitionId()
    schema = pa.schema([("pid", pa.int32()), ("head", pa.int64()), ("id", pa.int64()), ("position", pa.int64()), ("key", pa.string()), ("n_rows", pa.int64())])
    key = head = first_key = None
    run_no, n, first_n = 0, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        keys, ids = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
        new = np.ones(b.num_rows, dtype=bool)
        if b.num_rows > 1:
            new[1:] = pa.compute.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        new[0] = key is None or keys[0].as_py() != key
        starts = np.flatnonzero(new)
        at = np.searchsorted(starts, np.arange(b.num_rows), side="right")
        heads = np.where(at > 0, ids[starts[np.maximum(at, 1) - 1]] if len(starts) else 0, head if head is not None else 0)
        if first_key is None:
            first_key = keys[0].as_py()
        if run_no <= 1:
            first_n += int(np.sum(run_no + at == 1))
        n = b.num_rows - int(starts[-1]) if len(starts) else n + b.num_rows
        run_no += len(starts)
        key, head = keys[-1].as_py(), int(heads[-1])
        size = b.num_rows
        yield pa.record_batch([pa.array(np.full(size, pid, np.int32)), pa.array(heads), pa.array(ids), pa.array(run_no - len(starts) + at), pa.nulls(size, pa.string()), pa.nulls(size, pa.int64())], schema=schema)
    if first_key is not None:
        yield pa.record_batch([pa.array([pid, pid], pa.int32()), pa.array([head, head], pa.int64()), pa.nulls(2, pa.int64()), pa.array([run_no, -1], pa.int64()), pa.array([key, first_key]), pa.array([n, first_n], pa.int64())], schema=schema)


def adjacent_runs(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """(id, head): ``head`` is the smallest id among the rows with the same ``key``. Ids must be unique and not null."""
    spark = df.sparkSession
    ship_code(spark)
    n = parallelism(spark)
    sorted_ = df.select(F.col(key).alias("key"), F.col(row_id).cast("long").alias("id")).repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id")
    runs = materialize(sorted_.mapInArrow(_scan, _RUNS), "runs")
    carry = _carry([tuple(r) for r in runs.where("id is null").select("pid", "head", "position", "key").collect()])  # two rows per partition
    rows = runs.where("id is not null").select("id", "head", "pid", "position")
    if not carry:
        return rows.select("id", "head")
    fix = F.broadcast(spark.createDataFrame(sorted(carry.items()), "pid int, carried long"))
    return rows.join(fix, "pid", "left").select("id", F.when((F.col("position") == 1) & F.col("carried").isNotNull(), F.col("carried")).otherwise(F.col("head")).alias("head"))


def _carry(summaries: list[tuple[int, int, int, str]]) -> dict[int, int]:
    """Partition -> the head with which its first run goes on from the partitions before."""
    ends: dict[int, dict[str, tuple]] = {}
    for pid, head, position, key in summaries:
        ends.setdefault(pid, {})["first" if position == -1 else "last"] = (key, head, position)
    out: dict[int, int] = {}
    last_key, last_head = None, None
    for pid in sorted(ends):
        first_key, (key, head, runs) = ends[pid]["first"][0], ends[pid]["last"]
        if last_key is not None and first_key == last_key:
            out[pid] = last_head
            head = last_head if runs == 1 else head
        last_key, last_head = key, head
    return out


def format_duplicates(df: DataFrame, row_id: str, text: str, scope: list[str]) -> DataFrame:
    """(first_id, copy_id) for each row that repeats an earlier one of its scope in another typographic form.

    Texts without any word (null, empty, punctuation only) are compared with nothing. Null scope values form a scope of
    their own. Exact repetitions are copies too.
    """
    bag = word_bag(F.col(text))
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in scope]
    keyed = df.select(F.concat_ws(SEP, *parts, bag).alias("key"), F.col(row_id).alias("id"), bag.alias("bag")).where("bag != '' and id is not null")
    return adjacent_runs(keyed, "key", "id").where("id != head").select(F.col("head").alias("first_id"), F.col("id").alias("copy_id"))


def copy_counts(df: DataFrame, row_id: str, text: str, scope: list[str]) -> DataFrame:
    """One row per distinct text: (first_id, n_copies), the row itself included."""
    bag = word_bag(F.col(text))
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in scope]
    keyed = df.select(F.concat_ws(SEP, *parts, bag).alias("key"), F.col(row_id).alias("id"), bag.alias("bag")).where("bag != '' and id is not null")
    return adjacent_runs(keyed, "key", "id").groupBy(F.col("head").alias("first_id")).agg(F.count(F.lit(1)).alias("n_copies"))
