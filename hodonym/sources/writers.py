"""Writers of results."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A whole table anew, pruned columns and all; partitioned folders let later reads skip."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object per line; null fields are kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With header; null becomes an empty field."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def text_table(df: DataFrame, rows: int = 15) -> str:
    """The first rows for reading, null as a dot."""
    head = df.limit(rows).collect()
    cells = [list(df.columns), *[["·" if v is None else str(v) for v in r] for r in head]]
    width = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(n) for v, n in zip(r, width)).rstrip() for r in cells)


def worklist(df: DataFrame, labels: list[str]) -> DataFrame:
    """``df`` with empty columns to be filled in."""
    return df.select("*", *(F.lit(None).cast("string").alias(c) for c in labels))


#: The columns of the registry that the shipped tables keep.
SLIM = ["judet", "uat", "siruta", "street_type", "name", "name_normalized", "core_name", "core_name_norm", "is_numeric", "is_date", "is_saint"]


def write_slim(registry: DataFrame, path: str) -> None:
    """The registry without the columns that only its making needs."""
    replace_table(registry.select(*SLIM), path)


def named_csv(results: list[tuple[str, DataFrame]], most: int = 1000) -> str:
    """Several results as one CSV text for reading: each under ``# name``, an empty line between them, at most ``most`` rows each; null is empty."""
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    for i, (name, df) in enumerate(results):
        out.write(("\n" if i else "") + f"# {name}\n")
        w.writerow(df.columns)
        w.writerows(["" if v is None else v for v in r] for r in df.limit(most).collect())
    return out.getvalue()
