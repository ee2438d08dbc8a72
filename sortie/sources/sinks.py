"""Table sinks: Parquet per run, CSV or JSON exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("run_id",)) -> None:
    """Parquet, replacing only the partitions the new rows belong to."""
    by = [c for c in partition_by if c in df.columns]
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if by else "static")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """CSV with a header (arrays as `;` lists) or JSON lines, one folder per table."""
    if kind == "json":
        df.write.mode("overwrite").json(path)
    elif kind == "csv":
        flat = [
            F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if t.startswith("array") else F.col(c)
            for c, t in df.dtypes
        ]
        df.select(*flat).write.mode("overwrite").option("header", "true").csv(path)
    else:
        raise ValueError(f"unknown export {kind}")


def counted_write(df: DataFrame, path: str, name: str) -> dict[str, int]:
    """Write a table and return how many rows went through, without a second pass."""
    seen = Observation(name)
    write_table(df.observe(seen, F.count(F.lit(1)).alias("rows")), path)
    return {name: seen.get["rows"]}


def run_counters(**tables: DataFrame) -> DataFrame:
    """(run_id, counter, rows) over several tables that carry a run_id."""
    out = None
    for name, df in tables.items():
        part = df.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows")).select("run_id", F.lit(name).alias("counter"), "rows")
        out = part if out is None else out.unionByName(part)
    return out
