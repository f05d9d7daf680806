"""How often every value and every term occurs, in how many records (problem 4).

Last-seen counters: within a partition the tokens come ordered by record, so a term needs only its occurrences, its
records and the number of the record in which it was seen last. A record never spans partitions, hence the partial
counters of the partitions add up exactly. Counters are handed on whenever ``HELD`` terms are held, so memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hodonym.session import ship_code

#: Terms that a task holds before it hands its counters on.
HELD = 200_000
_SCHEMA = pa.schema([("field", pa.int8()), ("kind", pa.int8()), ("item", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])
KINDS = ("value", "term")


def _counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, int, str], list[int]] = {}
    record = 0

    def hand_on() -> pa.RecordBatch:
        out = pa.record_batch([pa.array([k[0] for k in held], pa.int8()), pa.array([k[1] for k in held], pa.int8()), pa.array([k[2] for k in held], pa.string()), pa.array([c[0] for c in held.values()], pa.int64()), pa.array([c[1] for c in held.values()], pa.int64())], schema=_SCHEMA)
        held.clear()
        return out

    for b in batches:
        start = record
        for f in range(b.num_columns):
            record = start
            for value in b.column(f).to_pylist():
                record += 1
                if not value:
                    continue
                c = held.get((f, 0, value))
                if c is None:
                    held[f, 0, value] = [1, 1, record]
                else:
                    c[0] += 1
                    c[1] += 1
                for term in value.split():
                    c = held.get((f, 1, term))
                    if c is None:
                        held[f, 1, term] = [1, 1, record]
                    else:
                        c[0] += 1
                        if c[2] != record:
                            c[1] += 1
                            c[2] = record
        if len(held) > HELD:
            yield hand_on()
    if held:
        yield hand_on()


def item_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, kind, item, occurrences, records) of every value and every term of ``fields``.

    A term is a part between white space (of any kind), kept as it is. Null and '' are no values; a value of white space
    only is a value without terms.
    """
    ship_code(df.sparkSession)
    counted = df.select(*(F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields))).mapInArrow(_counters, "field tinyint, kind tinyint, item string, occurrences long, records long")
    summed = counted.groupBy("field", "kind", "item").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    name = lambda c, names: F.element_at(F.array(*map(F.lit, names)), F.col(c).cast("int") + 1)
    return summed.select(name("field", fields).alias("field"), name("kind", KINDS).alias("kind"), "item", "occurrences", "records")


def mark_items(counts: DataFrame, df: DataFrame, rare: int = 1, common: int = 500) -> DataFrame:
    """``counts`` with ``mark``: 'rare' in at most ``rare`` records, 'common' in more than 1/``common`` of all rows, else null."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.withColumn("mark", F.when(F.col("records") <= rare, "rare").when(F.col("records") * common > total, "common"))
