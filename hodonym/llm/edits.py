"""Blocks in which all texts within one edit meet, with a few rows for each text instead of one for every letter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_blocks(c: Column, lengths: list[int]) -> list[Column]:
    """(block, rest) of both halves that a name of ``length(c)`` letters more or less could share with ``c``.

    If two names differ by one edit, it lies in one half of the other name, and the other half is the same in both.
    """
    m, out = F.length(c), []
    for d in lengths:
        n = m + d
        head = F.floor(n / 2).cast("int")
        tail = n - head
        sized = lambda x, rest, side: F.struct(F.concat_ws("\x1f", F.lit(side), n.cast("string"), x).alias("b"), rest.alias("rest"))  # noqa: E731, B023
        out.append(sized(c.substr(F.lit(1), head), c.substr(head + 1, m), "<"))
        out.append(sized(c.substr(m - tail + 1, m), c.substr(F.lit(1), m - tail), ">"))
    # two neighbours that changed places may spoil both halves, but leave the letters what they are
    letters = F.array_join(F.array_sort(F.split(c, "")), "")
    return [*out, F.struct(F.concat(F.lit("~"), letters).alias("b"), F.lit("").alias("rest"))]
